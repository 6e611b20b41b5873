"""Order-dependent folds, packing and graph operators against plain loops on random input."""

import random
import time
import re

import pytest
from pyspark.sql import functions as F

from cuefold.functions import requests as rq
from cuefold.operators import duplicates, graph, packing, ranking
from cuefold.operators.grounding import keep_first_of_both

ITEM = "episode_id string, ref string, category string, start_ms bigint, end_ms bigint, characters array<string>, summary string, item_type string"


def words_of(text):
    return {w for w in re.findall(r"\w+", text.lower()) if len(w) > 1}


def alike(a, b):
    """Restated from the survey: half of the shorter time or ends within 5 s, and words or one text in the other."""
    (s, e, x), (t, f, y) = a, b
    over = max(0, min(e, f) - max(s, t)) / min(max(100, e - s), max(100, f - t))
    if over < 0.5 and max(abs(s - t), abs(e - f)) > 5_000:
        return False
    one, two = words_of(x), words_of(y)
    return bool(one | two) and len(one & two) / len(one | two) >= 0.35 or min(len(x), len(y)) > 8 and (x.lower() in y.lower() or y.lower() in x.lower())


def merge_loop(rows):
    kept = []
    for _, ref, cat, s, e, chars, text, kind in sorted(rows, key=lambda r: (r[3], r[4], r[2], r[1])):
        hit = next((k for k in kept if alike((s, e, text), (k[3], k[4], k[5]))), None)
        if hit is None:
            kept.append([{ref}, {cat}, set(chars), s, e, text, kind])
            continue
        old, new = hit[5].lower(), text.lower()
        joined = hit[5] if new in old else text if old in new else (hit[5] + " | " + text)[:300]
        strong = kind in duplicates.STRONG and hit[6] not in duplicates.STRONG
        hit[:] = [hit[0] | {ref}, hit[1] | {cat}, hit[2] | set(chars), min(s, hit[3]), max(e, hit[4]), joined, kind if strong else hit[6]]
    return sorted((sorted(k[0]), sorted(k[1]), sorted(k[2]), *k[3:]) for k in kept)


def merged(spark, rows):
    got = {}
    for r in duplicates.merge_duplicates(spark.createDataFrame(rows, ITEM).repartition(7)).collect():
        got.setdefault(r.episode_id, []).append((list(r.refs), list(r.categories), list(r.characters), r.start_ms, r.end_ms, r.summary, r.item_type))
    return {k: sorted(v) for k, v in got.items()}


def test_duplicate_fold_equals_the_unsplit_loop(spark):
    rng = random.Random(3)
    words = "alice bob finds hidden papers under old house tonight again a 42".split()
    texts = ["ouse tonight again", "x", "", "|", "b | ho", "ab", "foo", "foob", "foo foobar", "?!?!?!?!?!?!", "aaaaaaaaaaaaaaaa", "aaaaaaaaaa", "Übergabe der Papiere", "übergabe DER"]
    rows = []
    for ep in range(25):
        for i in range(rng.randint(0, 60)):
            s = rng.randint(0, 120_000)
            text = rng.choice(texts) if rng.random() < 0.3 else " ".join(rng.sample(words, rng.randint(1, 6)))
            rows.append((f"e{ep}", f"r{i:03d}", rng.choice(["a", "b"]), s, s + rng.randint(0, 9_000), [rng.choice("xyz")], text, rng.choice(["scene", "reveal"])))
    got = merged(spark, rows)
    assert got == {ep: merge_loop([r for r in rows if r[0] == ep]) for ep in {r[0] for r in rows}}
    assert merged(spark, rows[:0]) == {}


def test_a_capped_text_still_meets_by_its_cut_word(spark):
    """Texts of dots join up to the cap, which cuts `foobar` to `foob`; an item of that word alone then meets it."""
    rows = [("e", "r0", "a", 0, 1_000, [], "foo" + "." * 290, "scene"), ("e", "r1", "a", 10, 1_000, [], "foo foobar", "scene"), ("e", "r2", "a", 20, 1_000, [], "foo", "scene")]
    for cut in ("f", "fo", "foo", "foob", "fooba"):
        rows.append(("e", f"s{cut}", "a", 30, 1_000, [], cut, "scene"))
    assert merged(spark, rows) == {"e": merge_loop(rows)}


def test_items_of_one_chain_without_common_words_are_folded_apart(spark):
    rows = [(i, "e", 0, f"word{i // 2} other{i // 2} third{i // 2} fourth{i // 2}") for i in range(40)]
    groups = duplicates.text_components(spark.createDataFrame(rows, "id bigint, episode_id string, chain bigint, summary string"), ["episode_id"])
    assert {r.id: r.group for r in groups.collect()} == {i: i // 2 * 2 for i in range(40)}


ANSWER = "episode_id string, category string, ordinal bigint, start_ms bigint, end_ms bigint, characters array<string>, summary string"


def answers_loop(base, found):
    kept = [[list(r), False] for r in base]
    for r in found:
        text = lambda row: (row[3], row[4], row[6].strip())
        hit = next((k for k in kept if k[0][:2] == list(r[:2]) and alike(text(r), text(k[0]))), None)
        if hit is None:
            kept.append([list(r), True])
        elif r[5]:
            hit[0][5] = sorted(set(hit[0][5]) | set(r[5]))
    return sorted((*map(repr, k[0]), k[1]) for k in kept)


def test_answers_equal_the_walk(spark):
    rng = random.Random(12)
    words = "alice bob finds hidden papers under old house tonight again".split()
    texts = ["", " ", "x!", "same text told twice ", "ouse tonight again", "told twice again", "?!?!?!?!?!?!"]

    def make(n, first):
        rows = []
        for i in range(n):
            s = rng.choice([0, 1_000, rng.randint(0, 60_000)])
            text = rng.choice(texts) if rng.random() < 0.4 else " ".join(rng.sample(words, rng.randint(1, 6)))
            rows.append((f"e{rng.randint(0, 4)}", rng.choice("ab"), first + i, s, s + rng.choice([0, 900, rng.randint(0, 9_000)]), rng.sample("zyxw", rng.randint(0, 2)), text))
        return rows

    base, found = make(150, 0), make(250, 1_000)
    got = duplicates.add_answers(spark.createDataFrame(base, ANSWER).repartition(5), spark.createDataFrame(found, ANSWER).repartition(3)).collect()
    assert sorted((*map(repr, [*r[:5], list(r[5]), r[6]]), bool(r[7])) for r in got) == answers_loop(base, found)


def test_answers_that_all_repeat_each_other_make_no_pairs(spark, monkeypatch):
    """Only the first of a stretch of time are compared with each other, over rounds; spans of any length and without times."""
    rng = random.Random(5)
    found = [("e", "a", i, s := rng.randint(0, 400_000), s + rng.randint(0, 90_000), ["x"], f"error by u{i} again") for i in range(400)]
    found += [("e", "a", 400 + i, s := rng.randint(0, 400_000), s + rng.choice([500, 4_000_000]), [], f"word{i % 9} other{i % 7} third{i % 2}") for i in range(60)]
    rng.shuffle(found)
    found = [(*r[:2], i, *r[3:]) for i, r in enumerate(found)]
    base = [("e", "a", 0, 50_000, 60_000, [], "error by u0")]
    timeless = [("e", "a", 500, None, None, ["y"], "error by u1 again"), ("e", "a", 501, None, None, ["y"], "error by u2 again")]
    most, durable = [], duplicates.durable

    def counted(df):
        table = durable(df)
        most.append(table.count())
        return table

    monkeypatch.setattr(duplicates, "durable", counted)
    monkeypatch.setattr(duplicates, "FRONT", 2, raising=False)
    got = duplicates.add_answers(spark.createDataFrame(base, ANSWER), spark.createDataFrame(found + timeless, ANSWER)).collect()
    assert sum(r.start_ms is None for r in got) == 2
    assert sorted((*map(repr, [*r[:5], list(r[5]), r[6]]), bool(r[7])) for r in got if r.start_ms is not None) == answers_loop(base, found)
    # Block rows, a few to an item, are the most that is stored.
    assert max(most) < 30 * len(found)


def test_second_pass_case(spark):
    base = spark.createDataFrame([("e", "conflicts", 0, 10_000, 20_000, ["Alice", "Bob"], "Alice confronts Bob about the missing documents")], ANSWER)
    new = spark.createDataFrame(
        [("e", "conflicts", 0, 11_000, 20_500, ["Charlie"], "Alice confronts Bob about missing documents"), ("e", "conflicts", 1, 50_000, 60_000, [], "A storm begins")], ANSWER
    )
    rows = {r.start_ms: r for r in duplicates.add_answers(base, new).collect()}
    assert sorted(rows) == [10_000, 50_000]
    assert list(rows[10_000].characters) == ["Alice", "Bob", "Charlie"] and rows[10_000].summary.startswith("Alice confronts Bob about the")


def greedy_loop(sizes, room, most):
    groups, n, used, count = [], -1, 0, 0
    for size in sizes:
        if n >= 0 and used + size <= room and count < most:
            used, count = used + size, count + 1
        else:
            n, used, count = n + 1, size, 1
        groups.append(n)
    return groups


@pytest.mark.parametrize("most", [1, 4, 50])
def test_greedy_groups_equal_a_walk_across_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(packing, "BLOCK", 64)
    monkeypatch.setattr(packing, "FAN", 3)
    rng = random.Random(most)
    data = {"hot": [rng.randint(1, 120) for _ in range(900)], "b": [200], "c": [rng.randint(1, 30) for _ in range(64)]}
    rows = [(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)]
    got = {}
    for r in packing.greedy_groups(spark.createDataFrame(rows, "k string, pos bigint, bytes bigint").repartition(5), ["k"], 150, most).collect():
        got.setdefault(r.k, {})[r.pos] = r.group_no
    for k, sizes in data.items():
        assert [got[k][i] for i in range(len(sizes))] == greedy_loop(sizes, 150, most)


def halve_loop(cues, start, end, cap, base):
    if base + sum(c[2] for c in cues) <= cap or len(cues) <= 1:
        return [(start, end, len(cues))]
    mid = len(cues) // 2
    r0, l1 = cues[mid][0], cues[mid - 1][1]
    cut = r0 if start < r0 < end else l1 if start < l1 < end else (start + end) // 2 if end > start else start
    return halve_loop(cues[:mid], start, cut, cap, base) + halve_loop(cues[mid:], cut, end, cap, base)


def test_halving_equals_the_recursion(spark):
    rng = random.Random(9)
    units, nodes, want = [], [], {}
    for ep in range(20):
        cues = sorted((rng.randint(0, 5_000), 0, rng.randint(1, 100)) for _ in range(rng.randint(0, 40)))
        cues = [(s, s + rng.randint(0, 900), b) for s, _, b in cues]
        nodes.append((f"e{ep}", 0, 5_000))
        units += [(f"e{ep}", i, b, s, e) for i, (s, e, b) in enumerate(cues)]
        want[f"e{ep}"] = halve_loop(cues, 0, 5_000, 300, 50)
    out = packing.halve_until_fit(
        spark.createDataFrame(nodes, "k string, start_ms bigint, end_ms bigint"), spark.createDataFrame(units, "k string, pos bigint, bytes bigint, start_ms bigint, end_ms bigint"),
        ["k"], 300, lambda: F.lit(50).cast("bigint"),
    )
    got = {}
    for r in out.collect():
        got.setdefault(r.k, []).append((r.lo, r.start_ms, r.end_ms, r.hi - r.lo))
        assert r.size <= 300 or r.hi - r.lo <= 1
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == want


def test_chunk_plan_keeps_every_cue_and_the_cap(spark):
    eps = spark.createDataFrame([("e", "/v/e.mkv", 1_200_000)], "episode_id string, source_video string, duration_ms bigint")
    chunks = spark.createDataFrame([("e", 0, 0, 600_000), ("e", 1, 600_000, 1_200_000)], "episode_id string, chunk_index int, start_ms bigint, end_ms bigint")
    text = 'say "x"\n' * 40
    cues = spark.createDataFrame([("e", i, i * 20_000, i * 20_000 + 9_000, text) for i in range(60)], "episode_id string, ordinal bigint, start_ms bigint, end_ms bigint, text string")
    plan = packing.chunk_plan(eps, chunks, cues, rq.envelope_bytes("m"), 4_000).collect()
    assert all(p.size <= 4_000 and not p.capped for p in plan) and len(plan) > 2
    # Bounds are inclusive: the cue that starts at the border serves both chunks.
    assert sum(p.hi - p.lo for p in plan) == 31 + 30
    one = cues.limit(0).unionByName(spark.createDataFrame([("e", 0, 0, 5_000, "é" * 9_000)], cues.schema))
    whole = packing.chunk_plan(eps, chunks, one, rq.envelope_bytes("m"), 4_000).where("capped").collect()
    assert [(p.lo, p.hi) for p in whole] == [(0, 1)]


def joined_rows(df):
    """The most rows that a join of the plan, once run, gave out."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            todo.append(node.executedPlan() if name.startswith("Adaptive") else node.plan())
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_second_pass_plan_meets_no_more_anchors_than_fit(spark):
    """Anchors of each piece equal a walk over them; a piece does not meet those that never fit."""
    rng = random.Random(8)
    groups = [("e", 0, 0, 900_000), ("f", 5_000, 5_000, 90_000), ("g", 0, 0, 10_000)]
    cues = [(ep, i, s := rng.randint(0, 80_000), s + 500, "x" * rng.randint(60, 120)) for ep in "ef" for i in range(40)]
    sizes = {("e", 0): [(rng.randint(20, 60), rng.randint(0, 20)) for _ in range(3_000)], ("f", 5_000): [(9, 4), (7, 5)]}
    anchors = [(*key, i, full, short) for key, many in sizes.items() for i, (full, short) in enumerate(many)]
    out = packing.second_pass_plan(
        spark.createDataFrame(groups, "episode_id string, group_start_ms bigint, start_ms bigint, end_ms bigint"),
        spark.createDataFrame(cues, "episode_id string, ordinal bigint, start_ms bigint, end_ms bigint, text string"),
        spark.createDataFrame(anchors, "episode_id string, group_start_ms bigint, rank bigint, bytes int, short_bytes int"), 100, 400,
    )
    # Collecting counts the metrics of the plan that `out` holds.
    rows = out.collect()
    assert {r.episode_id for r in rows} == set("efg") and len(rows) > 30
    for r in rows:
        many = sizes.get((r.episode_id, r.group_start_ms), [])
        if r.size + sum(full for full, _ in many) <= 400:
            assert (r.anchors, r.shortened) == (len(many), False)
        else:
            fits = [i for i in range(len(many)) if r.size + sum(short for _, short in many[: i + 1]) <= 400]
            assert (r.anchors, r.shortened) == (len(fits), True)
    assert joined_rows(out) < len(rows) * 400


def cap_loop(text, room):
    size = lambda s: len(__import__("json").dumps(s, ensure_ascii=False).encode()) - 2
    if size(text) <= room:
        return text
    best = ""
    for n in range(len(text)):
        if size(text[:n] + rq.CAPPED) <= room:
            best = text[:n] + rq.CAPPED
    return best


def test_capped_text_is_the_longest_that_fits(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice('aé"\\\n\t\x01漢') for _ in range(rng.randint(0, 60))), rng.randint(0, 90)) for _ in range(200)]
    got = spark.createDataFrame(rows, "t string, room int").select("t", "room", rq.cap_text(F.col("t"), F.col("room")).alias("c"), rq.escaped_bytes(F.col("t")).alias("b")).collect()
    for r in got:
        assert r.b == len(__import__("json").dumps(r.t, ensure_ascii=False).encode()) - 2
        assert r.c == cap_loop(r.t, r.room)


def test_capped_text_looks_no_further_than_its_room(spark):
    """Characters past the room are not walked: a long text costs what a short one does."""
    rows = [(c * 3_000_000,) for c in ("a", '"', "\x01", "漢", "a\n")]
    began = time.time()
    got = spark.createDataFrame(rows, "t string").select(rq.cap_text(F.col("t"), F.lit(300)).alias("c")).collect()
    assert [r.c for r in got] == [cap_loop(t[:1000], 300) for t, in rows]
    assert time.time() - began < 15


def first_free(base, seen, limit):
    """Restated from the survey: the base, or the first of its numbered forms that is not taken."""
    forms = (base if n == 0 else (base if limit is None else base[: limit - len(f"_{n}")].rstrip(" ._")) + f"_{n}" for n in range(10**6))
    return next(f for f in forms if f not in seen)


@pytest.mark.parametrize("limit", [120, None])
def test_unique_names_equal_the_walk(spark, limit):
    rng = random.Random(6)
    rows, want = [], {}
    many = [f"x_{n}" for n in range(30)]
    for p in range(8):
        seen = set()
        for i in range(120):
            base = rng.choice(["x", "x", "x_1", "x_2", "x_1_1", "other", "y" * 120, "y" * 119 + "z", "y" * 118 + "_1", "y" * 117 + " _", f"solo{i}", *many[: p * 4]])
            rows.append((p, i, base))
            want[(p, i)] = first_free(base, seen, limit)
            seen.add(want[(p, i)])
    # Numbered namesakes first, the repeated base after them; and the other way round.
    for p, bases in ((8, [*many[1:], *["x"] * 30]), (9, [*["x"] * 30, *many[1:]]), (10, ["x", "x_1", "x", "x", "x_2", "x_1", "x"])):
        seen = set()
        for i, base in enumerate(bases):
            rows.append((p, i, base))
            want[(p, i)] = first_free(base, seen, limit)
            seen.add(want[(p, i)])
    got = ranking.unique_names(spark.createDataFrame(rows, "p int, i int, base string").repartition(6), ["p"], "i", "base", "name", limit)
    assert {(r.p, r.i): r.name for r in got.collect()} == want


def test_components_and_chains(spark):
    rng = random.Random(8)
    ids = [f"n{i:03d}" for i in range(120)]
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(90)]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = graph.connected_components(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(links, "a string, b string")).collect()
    assert {r.id: r.group for r in got} == {i: find(i) for i in ids}
    line = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    cycle = [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("t1", "c1"), ("s", "s")]
    target = dict(line + cycle)

    def walk(i):
        at, seen = target[i], {i}
        while at in target and target[at] not in seen:
            seen.add(at)
            at = target[at]
        return at

    got = graph.resolve_chains(spark.createDataFrame(line + cycle, "id string, target string")).collect()
    assert {r.id: r.target for r in got} == {i: walk(i) for i in target}
    target = {f"r{i}": f"r{rng.randint(0, 149)}" for i in range(150)}
    keyed = spark.createDataFrame([(k, i, t) for k in "ab" for i, t in target.items()] + [("c", "r0", "r1")], "k string, id string, target string")
    assert {(r.k, r.id): r.target for r in graph.resolve_chains(keyed, ("k",)).collect()} == {**{(k, i): walk(i) for k in "ab" for i in target}, ("c", "r0"): "r1"}


def test_a_long_cycle_is_found_in_few_rounds(spark, monkeypatch):
    rounds, plain = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: rounds.append(1) or plain(df))
    ring = spark.range(100_000).select(F.format_string("n%06d", "id").alias("id"), F.format_string("n%06d", (F.col("id") + 1) % 100_000).alias("target"))
    ends = graph.resolve_chains(ring)
    assert ends.count() == 100_000 and ends.where("int(substring(target, 2)) <> (int(substring(id, 2)) + 99999) % 100000").isEmpty()
    assert len(rounds) <= 20


def test_keep_first_of_both_equals_the_walk(spark):
    rng = random.Random(10)
    rows = [(i, f"i{rng.randint(0, 40)}", rng.choice(["", f"t{rng.randint(0, 40)}"])) for i in range(200)]
    ids, titles, want = set(), set(), []
    for i, a, t in rows:
        if a in ids or (t and t in titles):
            continue
        ids.add(a)
        titles.add(t)
        want.append(i)
    got = keep_first_of_both(spark.createDataFrame(rows, "i int, a string, t string"), "a", "t", "i").collect()
    assert sorted(r.i for r in got) == want


def test_merge_rounds_end_in_one(spark):
    rows = [("a", i, 40) for i in range(23)] + [("b", 0, 5)] + [("c", i, 90) for i in range(5)]
    out = packing.merge_rounds(spark.createDataFrame(rows, "k string, pos bigint, bytes bigint"), ["k"], 100).collect()
    for key, n in (("a", 23), ("c", 5)):
        level, left = 0, n
        while left > 1:
            step = [r for r in out if r.k == key and r.level == level]
            assert len(step) == left
            level, left = level + 1, len({r.into for r in step})
    assert not [r for r in out if r.k == "b"]
