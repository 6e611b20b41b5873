"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain restatements."""

import random
import zlib
from collections import Counter
from math import comb, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuefold.llm import bbit_minhash, best_fit, host_rules, language_fusion, license_rules, positional_index, recurrent_lm, revisits, token_counts, wrapper_induction
from cuefold.llm.common import tokenizer_path, words_of

DDL = "doc_id long, text string, lang string, source string, n_chars long, host string, term string, block long, bucket long, rep long, home long, shard long, ord int, n long, kept boolean"
rng = random.Random(5)
VOCABULARY = ["the", "of", "cat", "sat", "über", "mañana", "déjà", "12", "x#y", "don't", "end.", "日本", "Rare1", "rare2"] + [f"w{i}" for i in range(60)]


def sentence(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


LONG = sentence(6000)
BASE = sentence(120)
NEAR = " ".join(BASE.split()[:118])
ROWS = [
    (1, "", "en", "a.com"), (2, None, None, None), (3, "   \n\t ", "en", "a.com"), (4, "one", "xx", "b.org"), (5, LONG, "en", "a.com"), (6, BASE, "en", "a.com"),
    (7, BASE, "fr", "a.com"), (8, NEAR, "en", "b.org"), (9, NEAR.upper(), "en", "c"), (10, sentence(80), "de", "c"), (10, sentence(70), "de", "c"), (None, sentence(60), "en", "a.com"),
    (11, "line one two three\n" * 30, "en", "b.org"), (12, "a#*$ b%& c<> " * 40, "en", "b.org"), (13, "<|endoftext|> and <|startoftext|> here", "en", "c"), (14, "é" * 300, "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, l, s, 0, "h", "t", 1, 2, 3, 4, 5, 6, 7, False) for i, t, l, s in ROWS], DDL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def texts():
    return [(i, (t or "")) for i, t, _, _ in ROWS]


def test_quality_rules_follow_plain_counts(docs, none):
    got = host_rules.host_quality(docs).collect()
    want = []
    for i, t in texts():
        words = [w for w in __import__("re").split(r"[ \t\n\x0b\x0c\r]+", t) if w]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want.append((i, len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(want, key=key)
    assert all(not r.kept for r in got if r.base_failed)
    assert {r.doc_id for r in got if r.kept} >= {6, 7, 8, 9}
    assert host_rules.host_quality(none).count() == 0


def test_beta_prior_pulls_small_hosts_to_the_pool():
    mean, strength = host_rules.beta_prior(2000, 3, 110, 100 * 100 / 1000 + 10 * 10 / 999)
    assert mean == 0.055 and 1 <= strength < 1e6
    assert host_rules.beta_prior(100, 2, 10, 10 * 10 / 100)[1] == 1e6
    assert host_rules.beta_prior(0, 0, 0, 0.0) == (0.0, 1.0)


def plain_components(rows):
    sets = {}
    for i, t in rows:
        words = words_of(t.encode())
        s = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
        sets.setdefault(i, []).append(s)
    ids = sorted(sets)
    group = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return group


def test_near_duplicates_match_all_pairs(docs, none):
    rows = [(i, t) for i, t in texts() if i is not None]
    want = plain_components(rows)
    got = bbit_minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert bbit_minhash.near_duplicates(none).count() == 0


def test_screen_loses_no_more_than_the_bands():
    for threshold in (0.6, 0.75, 0.9):
        agree = 1 / 16 + 15 / 16 * threshold
        estimates = [(k / bbit_minhash.HASHES - 1 / 16) / (15 / 16) for k in range(bbit_minhash.HASHES + 1)]
        lost = [comb(bbit_minhash.HASHES, k) * agree**k * (1 - agree) ** (bbit_minhash.HASHES - k) for k, e in enumerate(estimates) if e < bbit_minhash.screen(threshold)]
        assert sum(lost) <= (1 - threshold**bbit_minhash.ROWS) ** bbit_minhash.BANDS


def test_copies_below_the_threshold_of_each_other_stay_apart(spark, monkeypatch):
    """Texts alike at 0.5 to 0.7, some of them linked: more than a block of members meets in a bucket."""
    monkeypatch.setattr(bbit_minhash, "BLOCK", 8)
    monkeypatch.setattr(bbit_minhash, "TILE", 8)
    base = sentence(150).split()
    rows = []
    for i in range(50):
        copy = list(base)
        for k in range(rng.choice([1, 4, 5, 6, 7])):
            copy[rng.randrange(150)] = f"edit{i}x{k}"
        rows.append((i, " ".join(copy)))
    got = bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_components(rows)
    assert len({r.component_id for r in got}) > 5


def test_a_large_group_of_near_copies_is_one_component(spark):
    words = sentence(200).split()
    rows = []
    for i in range(120):
        copy = list(words)
        for _ in range(3):
            copy[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, sentence(100)) for i in range(20)]
    got = bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_components(rows)


def test_bit_estimate_is_near_the_similarity(spark):
    hashes = bbit_minhash.WordHashes()
    a = [f"a{i}".encode() for i in range(1000)]
    b = a[:900] + [f"b{i}".encode() for i in range(100)]
    x, y = (bbit_minhash.shingle_set(w, hashes) for w in (a, b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    packed = [np.array([bbit_minhash.packed_bits(bbit_minhash.minima(s))], np.int64).view(np.uint64) for s in (x, y)]
    assert abs(bbit_minhash.estimate(*packed)[0, 0] - true) < 0.12 and bbit_minhash.agreeing(packed[0], packed[0])[0, 0] == bbit_minhash.HASHES


def test_decontamination_matches_a_plain_search(spark, docs, none):
    base = BASE.split()
    items = [(1, " ".join(base[20:45])), (2, "one"), (3, None), (3, "nothing of the kind here at all, really nothing"), (4, " ".join(base[20:45])), (None, BASE), (10, ""), (12, " ".join(base[100:112]))]
    got = positional_index.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    windows = {(i, w) for i, t in items if i is not None for w in positional_index.windows_of(positional_index.item_words((t or "").encode()))}
    want = []
    for i, t in texts():
        words = positional_index.item_words(t.encode())
        hit, found = set(), set()
        for item, w in windows:
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    found.add(str(item))
        want.append((i, len(words), len(hit), sorted(found), bool(hit)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got), key=key) == sorted(want, key=key)
    assert positional_index.decontaminate(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert positional_index.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def test_phrases_near_their_places(spark):
    df = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    windows = positional_index.test_windows(spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string"))
    index = positional_index.build_index(df, shard_words=1)
    found = lambda slop: {r.doc_id for r in positional_index.search(index, windows, slop, block=1).collect()}
    assert found(0) == {2} and found(1) == {1, 2}


def test_packing_keeps_every_token(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, t in texts():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = best_fit.packed_documents(docs, path).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert best_fit.packed_documents(none, path).count() == 0


def test_token_ids_of_chunks_are_those_of_the_whole_text(monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    monkeypatch.setattr(best_fit, "REMEMBERED", 40)  # most is forgotten again and again
    ids = best_fit.ChunkIds(path)
    letters = [*map(chr, range(33, 0x530)), "H\u0331", "e\u0301", "İ", "日本", "한", "ª", "½", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "...", ".\u0338"]
    odd = random.Random(9)
    for _ in range(400):
        text = "".join(odd.choice(["", "", "", " ", "\n"]) + odd.choice(letters if odd.random() < 0.4 else letters[:94]) for _ in range(120))
        assert ids.of(text.encode()) == np.array(ids.words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert ids.of(b"bad \xff\xfe. \xc3") == np.array(ids.words.tokenizer.encode("bad \ufffd\ufffd. \ufffd", add_special_tokens=False).ids, "<u4").tobytes()
    assert len(ids) <= 21 and len(ids.before) <= 21


def test_a_word_is_tokenized_once_for_all_its_marks_and_cases(monkeypatch):
    ids, asked = best_fit.ChunkIds(tokenizer_path("word_bpe_49k.json")), []
    monkeypatch.setattr(ids.words, "ids", lambda text, find=ids.words.ids: asked.append(text) or find(text))
    ids.of(b"Zorblat zorblat. ZORBLAT, zorblat!! zorblat's zorblat")
    assert asked == ["zorblat", ".", ",", "!!", "zorblat's"]


def test_open_bins_close_the_fullest_first():
    bins = best_fit.OpenBins(10, 2)
    assert [bins.place(n)[0] for n in (6, 7, 8)] == [0, 1, 2]  # the bin with two free places was the fullest
    assert bins.open == 2 and bins.place(2) == (1, 7, None)  # bin 2, the fullest, is closed; bin 1 has three places, bin 0 four
    bins = best_fit.OpenBins(10, 5)
    for n in (4, 7, 6):
        bins.place(n)
    assert bins.place(3) == (1, 7, 1)


def test_token_counts_are_the_tokenizers(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = [(i, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, token_counts.token_counts(docs, path).collect()), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(none, path).count() == 0


def test_language_model_scores_whole_texts(docs, none):
    got = recurrent_lm.language_model(docs).collect()
    tokens = [(i, [*words_of(t.encode()), b"\n"]) for i, t in texts()]
    counts = Counter()
    for i, w in tokens:
        if not recurrent_lm.held_out(i):
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = [(i, recurrent_lm.held_out(i), len(w), sum(x in counts for x in w), n, round(sum(log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key) == sorted(want, key=key)
    assert all(r.score < 0 for r in got)
    assert recurrent_lm.language_model(none).count() == 0


def test_network_probabilities_sum_to_one_and_carry_state():
    params = recurrent_lm.initial(np.arange(recurrent_lm.SYMBOLS, 0, -1.0))
    each = np.exp([recurrent_lm.score(params, [np.array([s], np.int32)])[0] * np.log(10) for s in range(recurrent_lm.SYMBOLS)])
    assert abs(each.sum() - 1) < 1e-3
    s = np.random.default_rng(1).integers(0, recurrent_lm.SYMBOLS, 200).astype(np.int32)
    together = recurrent_lm.score(params, [s, s[:50], s[:130]])
    assert np.allclose(together, [recurrent_lm.score(params, [x])[0] for x in (s, s[:50], s[:130])], rtol=1e-4)


def test_gradient_agrees_with_differences():
    params = {k: v.astype(np.float64) for k, v in recurrent_lm.initial(np.ones(recurrent_lm.SYMBOLS)).items()}
    r = np.random.default_rng(2)
    targets = r.integers(0, recurrent_lm.SYMBOLS, (4, 3))
    inputs = np.vstack([np.full((1, 3), recurrent_lm.START), targets[:-1]])
    mask = np.ones((4, 3), bool)

    def loss(p):
        h, states = np.zeros((3, recurrent_lm.HIDDEN)), []
        for t in range(4):
            h = recurrent_lm.step(p, inputs[t], h)[0]
            states.append(h)
        return -recurrent_lm.log_likelihood(p, np.concatenate(states), targets.ravel()).mean()

    g, _ = recurrent_lm.gradient(params, inputs, targets, mask, np.zeros((3, recurrent_lm.HIDDEN)))
    for name, at in (("u", (2, 5)), ("u", (1, 40)), ("x", (recurrent_lm.START, 3)), ("c", (0, 1)), ("x", (int(targets[0, 0]), 20))):
        moved = {k: v.copy() for k, v in params.items()}
        moved[name][at] += 1e-5
        assert abs((loss(moved) - loss(params)) / 1e-5 - g[name][at]) < 1e-4


def test_language_fusion(spark, docs, none):
    got = {}
    for r in language_fusion.identify(language_fusion.evidence(docs)).collect():
        got.setdefault(r.doc_id, r)
    assert len(got) == len({i for i, *_ in ROWS})
    for i in (1, 2, 3):
        assert got[i].language == "und" and not got[i].kept and got[i].text_language is None
    assert got[5].language == "en" and got[5].kept
    assert language_fusion.identify(language_fusion.evidence(none)).count() == 0
    rows = []
    for i in range(40):
        rows.append((i, "the cat and the dog with that house " * 3, "en", "site.uk"))
        rows.append((100 + i, "le chat et le chien avec cette maison " * 3, "fr", "site.fr"))
    rows += [(900, "qz", None, "site.fr"), (901, "qz", None, "new.uk"), (902, "le chat et le chien avec cette maison", "en", "site.fr")]
    out = {r.doc_id: r for r in language_fusion.identify(language_fusion.evidence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert (out[900].language, out[901].language, out[902].language) == ("fr", "en", "fr")  # by host, by suffix, by text against the declaration


def test_page_evidence_reads_markup_and_address(spark):
    pages = spark.createDataFrame([(1, "https://www.Site.fr:443/a", '<html lang="fr-CA"><script>x</script><p>le chat</p>'), (2, None, None)], "page_id long, url string, html string")
    rows = {r.doc_id: r for r in language_fusion.page_evidence(pages).collect()}
    assert (rows[1].declared, rows[1].host, rows[1].suffix) == ("fr", "www.site.fr", "fr") and b"chat" in rows[1].text and b"x" not in rows[1].text
    assert rows[2].declared is None and rows[2].host is None


def test_language_query_has_documents_and_pages(spark):
    import pyarrow.parquet as pq

    from cuefold.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op5_language_fusion"](spark, folder).collect()
    for name, key in (("documents", "doc_id"), ("pages", "page_id")):
        want = pq.read_table(f"{folder}/{name}.parquet", columns=[key]).column(key).to_pylist()
        assert sorted(r.doc_id for r in rows if r.table == name) == sorted(want)
    assert {r.declared for r in rows if r.table == "pages"} & set(language_fusion.LANGUAGES)


def test_license_rules(spark, none):
    grant = next(k for k, v in license_rules.SENTENCES.items() if v == "mit_grant")
    notice = next(k for k, v in license_rules.SENTENCES.items() if v == "mit_notice")
    rows = [(1, f"MIT License\nCopyright (c) 2020 A. Person\n{grant}. {notice}."), (2, None), (3, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."), (4, notice + "."), (4, "plain")]
    got = sorted(tuple(r) for r in license_rules.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0][3:] == ("MIT", "permissive", 2)  # title and copyright are known sentences that no rule took: the copyright parts them from the grant
    assert got[1] == (2, 0, "", "", "", 0)
    assert got[2][3:] == ("All-rights-reserved,Apache-2.0", "permissive,reserved", 0)
    assert sorted(x[3:] for x in got[3:]) == [("", "", 0), ("", "", 1)]
    assert license_rules.scan_licenses(none).count() == 0
    assert all(s == spark.range(1).select(license_rules.normalised(F.lit(s))).first()[0] for s in list(license_rules.SENTENCES)[:5])


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.""",
    "Apache-2.0": """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Some Company, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
}


def test_wrapped_licences(spark):
    forms = (lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */", *(lambda t, m=m: "".join(f"{m} {x}\n" for x in t.split("\n")) for m in ("#", "//", "--", "!", "REM")))
    rows = [(f"{name}{i}", name, form(text)) for name, text in WRAPPED.items() for i, form in enumerate(forms)]
    rows += [("r1", "MIT", "words before\nThis project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details."), ("r2", "GPL-2.0-only", "All of it is licensed under the terms\nof the GNU General Public License, version 2."), ("r3", "", "This is not licensed under the MIT License."), ("r4", "", "None of it is licensed under the MIT License."), ("r5", "", "Permission is hereby granted,\n\nfree of charge")]
    got = {r.doc_id: r for r in license_rules.scan_licenses(spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id string, text string")).collect()}
    assert {k: got[k].licenses for k, _, _ in rows} == {k: name for k, name, _ in rows}
    assert got["Apache-2.00"].sentence_ids == "copyright apache2_ref apache2_use apache2_copy apache2_warranty apache2_see"
    assert got["MIT0"].sentence_ids == "mit_title copyright mit_grant mit_notice mit_warranty"


CAPTURE = "record_id long, url string, at timestamp, kind string, etag string, last_modified string, digest string, headers map<string,string>, canonical string, range int"


def test_revisits_match_a_plain_search(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        url = rng.choice(["http://A.com/x/", "https://www.a.com:443/x#f", "http://a.com/y", None])
        at = rng.choice([None] + [t0 + timedelta(seconds=k) for k in range(40)])
        kind = rng.choice(["response", "revisit"])
        rows.append((i, url, at, kind, rng.choice([None, "e1", "W/e1", "e2"]), rng.choice([None, "m1", "m2"]), f"d{i}", rng.choice([None, {"date": str(i), "server": "s", "etag": "e"}]), "clash", 9))
    got = {r.record_id: r for r in revisits.resolve_revisits(spark.createDataFrame(rows, CAPTURE)).collect()}
    same = lambda u: None if u is None else "a.com/y" if u.endswith("y") else "a.com/x"
    weak = lambda e: e and e.removeprefix("W/")
    assert set(got) == {r[0] for r in rows if r[3] == "revisit"}
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [s for s in rows if s[3] == "response" and r[1] and r[2] and same(s[1]) == same(r[1]) and s[2] and s[2] < r[2]]
        s = max(before, key=lambda s: (s[2], s[0]), default=None)
        assert got[r[0]].source_id == (s and s[0])
        if s is None:
            want = "no_source"
        elif r[4] is None and r[5] is None:
            want = "unvalidated"
        elif r[4] is not None:
            want = "resolved" if weak(r[4]) == weak(s[4]) else "mismatch"
        else:
            want = "resolved" if r[5] == s[5] else "mismatch"
        assert got[r[0]].outcome == want
        if want in ("resolved", "unvalidated"):
            assert got[r[0]].digest == s[6] and got[r[0]].headers == {**(s[7] or {}), **{k: v for k, v in (r[7] or {}).items() if k != "server"}}
    assert revisits.resolve_revisits(spark.createDataFrame([], CAPTURE)).count() == 0


def test_wrappers_leave_the_article(spark):
    page = lambda n, body: f'<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class="ad">buy {n}</div>{body}<div class="user-comments"><p>nice</p></div><footer>&copy; {n}</footer></body></html>'
    rows = [(i, f"http://h.com/{i}", page(i, f"<article><h1>Title {i}</h1><p>one&nbsp;<b>bo</b>ld &lt;{i}&gt;<br>two<p>three<form>f</form></article>")) for i in range(4)]
    rows += [(10 + i, f"http://plain.com/{i}", page(i, f"<div><p>same words everywhere</p></div><div><p>own words {i}</p></div>")) for i in range(4)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://h.com/9", "<p>broken <b>tags <"), (22, "http://h.com/9", "<p>broken <b>tags <")]
    got = [(r.page_id, r.text, r.n_chars) for r in wrapper_induction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    by = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert all(by[i] == f"Title {i} one bold <{i}> two three" for i in range(4))
    assert all(by[10 + i] == f"own words {i}" for i in range(4))
    assert by[20] == by[21] == "" and by[22] == "broken tags <"
    assert wrapper_induction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching_aligns_in_order():
    a = wrapper_induction.squeezed(wrapper_induction.parsed("<div><h1>x</h1><p>a<p>b<ul><li>c</ul></div>"))
    b = wrapper_induction.shape(wrapper_induction.squeezed(wrapper_induction.parsed("<div><p>z<ul><li>c<li>d</ul></div>")))
    pairs = []
    assert wrapper_induction.tree_match(a, b, pairs) == 5
    assert {n[0] for n, _ in pairs} == {"#root", "div", "p", "ul", "li"}


def test_constant_slots_leave_the_article(spark):
    page = lambda i, inner, beside="": f"<html><body>{beside}<article><h1>Title {i}</h1>{inner}<div>Share this story</div></article></body></html>"
    rows = [(i, f"http://h.com/{i}", page(i, f"<p>words of {i}</p>")) for i in range(4)]
    rows += [(10 + i, f"http://copies.com/{i}", page(0, "<p>one text</p>", f"<nav>{i}</nav>")) for i in range(4)]
    rows += [(14, "http://copies.com/5", page(5, "<p>another text</p>"))]
    rows += [(20 + i, f"http://cards.com/{i}", f"<body><article><p>promotion of the week</p></article><div>all alike</div><section><p>{'own words ' * 20}{i}</p></section></body>") for i in range(4)]
    got = {r.page_id: r.text for r in wrapper_induction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} words of {i}" for i in range(4))
    assert {got[10 + i] for i in range(4)} == {"Title 0 one text Share this story"} and got[14] == "Title 5 another text Share this story"  # two articles tell nothing
    assert all(got[20 + i] == f"promotion of the week {'own words ' * 20}{i}" for i in range(4))  # far more beside the article than in it


def test_tree_matching_has_no_size_limit():
    names = ["".join(chr(97 + i // 26**k % 26) for k in (2, 1, 0)) for i in range(1100)]
    tree = lambda names: wrapper_induction.squeezed(wrapper_induction.parsed("".join(f'<div class="x{n}"><p>t</p></div>' for n in names)))
    a, b = tree(names), wrapper_induction.shape(tree(names[1:]))
    pairs = wrapper_induction.aligned(a, b)
    of = {id(node): number for node, number in pairs}
    assert len(pairs) == 2 * 1099 + 1 and id(a[1][0]) not in of and id(a[1][0][1][0]) not in of
    assert all(of[id(c[1][0])] == of[id(c)] + 1 for c in a[1][1:])


def test_tree_matching_is_as_heavy_as_plain_matching():
    def plain(a, b):
        if a[0] != b[0]:
            return 0
        best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1]):
            for j, y in enumerate(b[1]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(x, y))
        return 1 + best[-1][-1]

    draw = random.Random(5)
    tree = lambda depth: (draw.choice("ab"), [tree(depth - 1) for _ in range(draw.randint(0, 4) if depth else 0)], [])
    for _ in range(200):
        a, b = ("r", tree(3)[1], []), ("r", tree(3)[1], [])
        pairs = []
        assert wrapper_induction.tree_match(a, b, pairs) == plain(a, b) == len(pairs)
        assert len({id(n) for n, _ in pairs}) == len({k for _, k in pairs}) == len(pairs)
