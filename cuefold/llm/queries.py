"""The registered queries of this subpackage, thin over its operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefold.llm.bbit_minhash import near_duplicates
from cuefold.llm.best_fit import packed_documents
from cuefold.llm.common import table, tokenizer_path
from cuefold.llm.host_rules import RULES, host_quality
from cuefold.llm.language_fusion import identify_tables
from cuefold.llm.host_words import judge_urls
from cuefold.llm.license_rules import LOWER, RULES as LICENSE_RULES, SENTENCES, UPPER, scan_licenses
from cuefold.llm.merkle_manifest import manifest, record_digest
from cuefold.llm.positional_index import decontaminate
from cuefold.llm.ranked_search import ranked_search
from cuefold.llm.recurrent_lm import language_model
from cuefold.llm.revisits import page_captures, resolve_revisits
from cuefold.llm.token_counts import token_counts
from cuefold.llm.wrapper_induction import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def _broken(measure: str, bound: float) -> str:
    above, below = measure.split(" / ")
    return f"coalesce({above}::DOUBLE / nullif({below}, 0) > {bound}, false)"


HOST_RULES_SQL = """
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE NOT regexp_full_match(line, '[ \\t\\n\\x0b\\f\\r]*')
  GROUP BY doc_id
), m AS (
  SELECT w.doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)
), h AS (
  SELECT host, count(*) AS n_docs, """ + ", ".join(f"count(*) FILTER ({_broken(r.measure, r.soft)}) AS f_{r.name}" for r in RULES) + """
  FROM m GROUP BY host
), p AS (
  SELECT sum(n_docs) AS n, count(*) AS h, """ + ", ".join(f"sum(f_{r.name}) / sum(n_docs) AS mu_{r.name}, sum(f_{r.name} * f_{r.name} / n_docs) / sum(n_docs) AS q_{r.name}" for r in RULES) + """
  FROM h
), s AS (
  SELECT n, """ + ", ".join(
    f"mu_{r.name}, CASE WHEN mu_{r.name} * (1 - mu_{r.name}) <= 0 OR q_{r.name} - mu_{r.name} * mu_{r.name} - mu_{r.name} * (1 - mu_{r.name}) * h / n <= 0 THEN 1e6"
    f" ELSE least(greatest(mu_{r.name} * (1 - mu_{r.name}) / (q_{r.name} - mu_{r.name} * mu_{r.name} - mu_{r.name} * (1 - mu_{r.name}) * h / n) - 1, 1), 1e6) END AS k_{r.name}"
    for r in RULES) + """
  FROM p
), v AS (
  SELECT host, """ + ", ".join(f"(f_{r.name} + mu_{r.name} * k_{r.name}) / (n_docs + k_{r.name}) > {r.host_limit} AS bad_{r.name}" for r in RULES) + """
  FROM h, s
), j AS (
  SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         """ + " OR ".join(f"bad_{r.name}" for r in RULES) + """ AS bad_host,
         """ + " OR ".join(f"{_broken(r.measure, r.hard)} OR (bad_{r.name} AND {_broken(r.measure, r.soft)})" for r in RULES) + """ AS broken
  FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT broken AS kept, bad_host FROM j
"""


@query("op2_host_quality", HOST_RULES_SQL)
def op2_host_quality(spark, folder):
    judged = host_quality(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bad_host")


NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY words) AS rep FROM w WHERE len(words) > 0
), rs AS (SELECT s.* FROM s WHERE doc_id IN (SELECT rep FROM rep)
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM rs a JOIN rs b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), edge AS (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT DISTINCT u AS root, u AS node FROM edge UNION SELECT root, v FROM reach JOIN edge ON u = node
), comp AS (SELECT root, min(node) AS component FROM reach GROUP BY root)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, rep.rep, w.doc_id) AS component_id,
       coalesce(c.component, rep.rep, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN comp c ON c.root = rep.rep
"""


@query("op8_bbit_minhash", NEAR_SQL)
def op8_bbit_minhash(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))


DECONTAMINATION_SQL = """
WITH folded AS (
  SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL
  SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT side, id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM folded
), windows AS (
  SELECT DISTINCT id AS item_id, len(words[i : i + 9]) AS width, array_to_string(words[i : i + 9], ' ') AS phrase
  FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM w WHERE side = 'i' AND len(words) > 0)
), widths AS (SELECT DISTINCT width FROM windows
), hits AS (
  SELECT d.id AS doc_id, item_id, i, windows.width
  FROM (SELECT id, width, unnest(range(1, len(words) - width + 2)) AS i, words FROM w, widths WHERE side = 'd' AND len(words) >= width) d
  JOIN windows ON windows.width = d.width AND phrase = array_to_string(words[i : i + d.width - 1], ' ')
), n_hit AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + width)) AS k FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT id AS doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n IS NOT NULL AS contaminated
FROM w LEFT JOIN n_hit ON n_hit.doc_id = id LEFT JOIN found ON found.doc_id = id WHERE side = 'd'
"""


@query("op3_positional_index", DECONTAMINATION_SQL)
def op3_positional_index(spark, folder):
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query("op10_best_fit")
def op10_best_fit(spark, folder):
    return packed_documents(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op5_language_fusion")
def op5_language_fusion(spark, folder):
    return identify_tables(table(spark, folder, "documents"), table(spark, folder, "pages"))


@query("op4_token_counts")
def op4_token_counts(spark, folder):
    return token_counts(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op9_recurrent_lm")
def op9_recurrent_lm(spark, folder):
    return language_model(table(spark, folder, "documents"))


def _license_sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    steps, last = [], "r0"
    for i, (_, _, pattern) in enumerate(LICENSE_RULES):
        # RE2 has no look-behind: an identifier starts the string or follows a space.
        whole = f"(^|[^a-z0-9_]){pattern}"
        steps.append(f"s{i + 1} AS (SELECT * EXCLUDE (rest), regexp_matches(rest, '{whole}') AS hit{i}, regexp_replace(regexp_replace(rest, '{whole}', '\\1; ', 'g'), '{whole}', '\\1; ', 'g') AS rest FROM s{i})")
        last = f"s{i + 1}"
    names = ", ".join(f"CASE WHEN hit{i} THEN '{name}' END" for i, (name, _, _) in enumerate(LICENSE_RULES))
    kinds = ", ".join(f"CASE WHEN hit{i} THEN '{kind}' END" for i, (_, kind, _) in enumerate(LICENSE_RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {known}
), parts AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS sentence
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\f\\x0B]+', '\\1' || chr(10), 'g'), chr(10)) AS p FROM documents)
), plain AS (
  SELECT doc_id, i, regexp_replace(regexp_replace(translate(sentence, '{UPPER}', '{LOWER}'), '[^a-z0-9.+\\-]+', ' ', 'g'), '^[ .\\-]+|[ .\\-]+$', '', 'g') AS sentence FROM parts
), ids AS (
  SELECT doc_id, list(id ORDER BY i) AS ids FROM (
    SELECT doc_id, i, CASE WHEN regexp_matches(plain.sentence, '^copyright (c )?[0-9]{{4}}\\b.*') THEN 'copyright' ELSE id END AS id FROM plain LEFT JOIN known USING (sentence)
  ) WHERE id IS NOT NULL GROUP BY doc_id
), s0 AS (
  SELECT doc_id, coalesce(ids, []) AS ids, CASE WHEN ids IS NULL THEN '' ELSE array_to_string(ids, ' ') || ' ' END AS rest FROM documents LEFT JOIN ids USING (doc_id)
), {", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ' ') AS sentence_ids,
       array_to_string(list_sort(list_distinct([{names}])), ',') AS licenses,
       array_to_string(list_sort(list_distinct([{kinds}])), ',') AS classes,
       len(list_filter(string_split(rest, ' '), lambda x: x NOT IN ('', ';')))::BIGINT AS unmatched
FROM {last}
"""


@query("op7_license_rules", _license_sql())
def op7_license_rules(spark, folder):
    return scan_licenses(table(spark, folder, "documents"))


REVISITS_SQL = """
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS tag, make_timestamp((1700000000 + page_id * 37) * 1000000) AS t FROM pages
), c AS (
  SELECT page_id * 8 AS record_id, url, t AS ts, 'response' AS kind, tag AS etag, strftime(t, '%Y-%m-%d %H:%M:%S') AS modified, tag AS digest, 0 AS delay, 'max-age=60' AS cache, NULL AS vary, NULL AS expires, 'one' AS server FROM p
  UNION ALL SELECT page_id * 8 + 1, url, t + INTERVAL 3600 SECOND, 'revisit', tag, NULL, NULL, 3600, 'max-age=600', NULL, NULL, 'two' FROM p
  UNION ALL SELECT page_id * 8 + 2, url, t + INTERVAL 7200 SECOND, 'revisit', md5(tag), NULL, NULL, 7200, NULL, 'accept', NULL, NULL FROM p WHERE page_id % 5 = 0
  UNION ALL SELECT page_id * 8 + 3, url, t + INTERVAL 86400 SECOND, 'revisit', NULL, strftime(t, '%Y-%m-%d %H:%M:%S'), NULL, 86400, NULL, NULL, 'never', NULL FROM p WHERE page_id % 7 = 0
  UNION ALL SELECT page_id * 8 + 4, url, t + INTERVAL 90000 SECOND, 'revisit', NULL, NULL, NULL, 90000, NULL, '*', NULL, NULL FROM p WHERE page_id % 11 = 0
  UNION ALL SELECT page_id * 8 + 5, url, t - INTERVAL 60 SECOND, 'revisit', tag, NULL, NULL, -60, NULL, '*', NULL, NULL FROM p WHERE page_id % 13 = 0
), b AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?', ''), '#.*$', '') AS bare FROM c
), k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '')
            || regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '/+$', '') AS canonical, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date FROM b
), one AS (
  SELECT * FROM k WHERE kind = 'response' QUALIFY row_number() OVER (PARTITION BY canonical, ts ORDER BY record_id DESC) = 1
), j AS (
  SELECT r.*, s.record_id AS source_id, s.ts AS source_ts, s.etag AS s_etag, s.modified AS s_modified, s.digest AS s_digest, s.cache AS s_cache, s.server AS s_server
  FROM (SELECT * FROM k WHERE kind = 'revisit') r ASOF LEFT JOIN one s ON r.canonical = s.canonical AND r.ts > s.ts
), o AS (
  SELECT *, CASE WHEN source_id IS NULL THEN 'no_source' WHEN etag IS NULL AND modified IS NULL THEN 'unvalidated'
    WHEN coalesce(CASE WHEN etag IS NOT NULL THEN etag = s_etag ELSE modified = s_modified END, false) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j
)
SELECT record_id, canonical, date AS seen, source_id, strftime(source_ts, '%Y-%m-%d %H:%M:%S') AS source_seen, outcome,
       CASE WHEN outcome IN ('resolved', 'unvalidated') THEN s_digest END AS digest,
       concat_ws(';', 'cache-control=' || CASE WHEN outcome IN ('resolved', 'unvalidated') THEN coalesce(cache, s_cache) ELSE cache END,
         'content-type=text/html', 'date=' || date, 'expires=' || expires,
         'server=' || CASE WHEN outcome IN ('resolved', 'unvalidated') THEN s_server ELSE server END, 'vary=' || vary) AS headers
FROM o
"""


@query("op1_revisit_resolution", REVISITS_SQL)
def op1_revisit_resolution(spark, folder):
    found = resolve_revisits(page_captures(table(spark, folder, "pages")))
    pairs = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.element_at("headers", k)))
    seen = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select("record_id", "canonical", seen("at").alias("seen"), "source_id", seen("source_at").alias("source_seen"), "outcome", "digest", F.concat_ws(";", pairs).alias("headers"))


@query("op6_wrapper_induction")
def op6_wrapper_induction(spark, folder):
    return extract(table(spark, folder, "pages"))


RANKED_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM benchmark
), size AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
), tf AS (SELECT doc_id, len(terms) AS n, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), qf AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(terms) AS term FROM i) GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, sum(qf * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM qf JOIN df USING (term) JOIN tf USING (term), size GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


@query("op11_ranked_search", RANKED_SQL)
def op11_ranked_search(spark, folder):
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_host_words")
def op12_host_words(spark, folder):
    judged = judge_urls(table(spark, folder, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score", "words")


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RECORD = lambda names: "sha256(" + " || ".join(f"coalesce(octet_length(encode({n}::VARCHAR))::VARCHAR || ':' || {n}::VARCHAR, '-')" for n in names) + ")"
MANIFEST_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT *, row_number() OVER () AS row, coalesce('1' || source, '0') AS tree,
         xor(4294967295, list_reduce([4294967295::UBIGINT] || flatten([[x::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256] for x in list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c))]),
             lambda c, s: CASE WHEN s < 256 THEN xor(c, s) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) END)) AS crc
  FROM documents
), leaf AS (
  SELECT row, doc_id, tree, {_RECORD(_FIELDS)} AS h, CASE WHEN crc % 5 = 0 THEN {_RECORD((*_FIELDS[:-1], _FOLDED))} END AS changed FROM rows
), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h, row) - 1 AS i FROM leaf
), low AS (
  SELECT tree, 0 AS lvl, i, h FROM placed
  UNION ALL
  SELECT tree, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, lvl, i // 16
), lows AS (SELECT *, max(lvl) OVER (PARTITION BY tree) AS top FROM low
), subroot AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i FROM lows WHERE lvl = top
), high AS (
  SELECT 0 AS lvl, i, h FROM subroot
  UNION ALL
  SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY lvl, i // 16
), highs AS (SELECT *, max(lvl) OVER () AS top FROM high
), way AS (
  -- Every leaf with its place on each level, from its own to the root; step counts levels over both trees.
  SELECT row, lvl AS step, n.tree, n.i AS j, n.h, p.i // (16::BIGINT ** lvl)::BIGINT AS own
  FROM placed p JOIN lows n ON n.tree = p.tree AND n.lvl < n.top AND n.i // 16 = p.i // (16::BIGINT ** (n.lvl + 1))::BIGINT
  UNION ALL
  SELECT row, l.top + n.lvl, '', n.i, n.h, s.i // (16::BIGINT ** n.lvl)::BIGINT
  FROM placed p JOIN subroot s USING (tree) JOIN (SELECT DISTINCT tree, top FROM lows) l USING (tree)
  JOIN highs n ON n.lvl < n.top AND n.i // 16 = s.i // (16::BIGINT ** (n.lvl + 1))::BIGINT
), run AS (
  SELECT row, step, coalesce(string_agg(h, '' ORDER BY j) FILTER (j < own), '') AS l, coalesce(string_agg(h, '' ORDER BY j) FILTER (j > own), '') AS r FROM way GROUP BY row, step
), proof AS (SELECT row, string_agg(l || r, '' ORDER BY step) AS proof FROM run GROUP BY row
), fold AS (
  SELECT row, 0 AS step, coalesce(changed, h) AS h FROM leaf
  UNION ALL
  SELECT fold.row, fold.step + 1, sha256(l || h || r) FROM fold JOIN run ON run.row = fold.row AND run.step = fold.step
), last AS (SELECT row, arg_max(h, step) AS h FROM fold GROUP BY row)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, root.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, last.h AS folded_root, last.h = root.h AS verified
FROM placed p JOIN subroot s USING (tree) JOIN last USING (row) LEFT JOIN proof USING (row), (SELECT h FROM highs WHERE lvl = top) root
"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    fields = [F.col(n) for n in _FIELDS]
    changed = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, record_digest(*fields[:-1], changed))
    return manifest(docs.select("doc_id", "source", record_digest(*fields).alias("leaf"), tampered.alias("tampered")))
