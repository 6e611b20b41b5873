"""Requests, answers, evidence, plans and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuefold.functions import answers as an
from cuefold.functions import policy as po
from cuefold.functions import requests as rq
from cuefold.operators import checks as ck
from cuefold.operators import compaction as cm
from cuefold.operators import coverage as cov
from cuefold.operators import duplicates, gaps, packing, projects, ranking, scenes, selection
from cuefold.operators import signatures as sg
from cuefold.plans import bindings as b
from cuefold.plans.registry import query
from cuefold.plans.timeline_queries import DETECTED
from cuefold.session import durable
from cuefold.sources import evidence as ev
from cuefold.sources import transport
from cuefold.streaming import progress as pg

T, TALK = b.TIMELINE_SQL, b.TALK_SQL


@query("request_bytes", "SELECT doc_id, CAST(strlen(CAST(to_json(text) AS VARCHAR)) - 2 AS BIGINT) AS bytes FROM documents")
def request_bytes(spark, folder):
    return b.table(spark, folder, "documents").select("doc_id", rq.escaped_bytes(F.col("text")).alias("bytes"))


BY_LANG = "u AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, n_chars AS bytes FROM documents)"


def _by_language(spark, folder):
    """Documents in order per language, one of which holds most of them."""
    docs = b.table(spark, folder, "documents").select("lang", "doc_id", F.col("n_chars").alias("bytes"))
    return ranking.ranked(docs, ["lang"], ["doc_id"], "_n").withColumn("pos", F.col("_n") - 1).drop("_n")


@query("greedy_groups", f"""WITH RECURSIVE {BY_LANG}, g(lang, pos, used, n, group_no) AS (SELECT lang, pos, bytes, 1, CAST(0 AS BIGINT) FROM u WHERE pos = 0
 UNION ALL SELECT u.lang, u.pos, CASE WHEN g.used + u.bytes <= 9000 AND g.n < 4 THEN g.used + u.bytes ELSE u.bytes END, CASE WHEN g.used + u.bytes <= 9000 AND g.n < 4 THEN g.n + 1 ELSE 1 END,
  CASE WHEN g.used + u.bytes <= 9000 AND g.n < 4 THEN g.group_no ELSE g.group_no + 1 END FROM g JOIN u ON u.lang = g.lang AND u.pos = g.pos + 1)
SELECT lang, pos, group_no FROM g""")
def greedy_groups(spark, folder):
    return packing.greedy_groups(_by_language(spark, folder), ["lang"], 9000, 4).select("lang", "pos", "group_no")


@query("season_batches", f"""WITH {BY_LANG}, c AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM u),
k AS (SELECT *, CASE WHEN n % 4 = 0 THEN n // 4 WHEN n % 4 = 1 THEN n // 4 - 2 WHEN n % 4 = 2 THEN n // 4 - 1 ELSE n // 4 END AS fours FROM c)
SELECT lang, pos, CASE WHEN n <= 4 THEN 0 WHEN n = 5 THEN pos // 3 WHEN pos < fours * 4 THEN pos // 4 ELSE fours + (pos - fours * 4) // 3 END AS batch_no FROM k""")
def season_batches(spark, folder):
    return packing.season_batches(_by_language(spark, folder), ["lang"]).select("lang", "pos", "batch_no")


@query("forced_pairs", f"WITH {BY_LANG} SELECT lang, pos, pos // 2 AS pair_no FROM u")
def forced_pairs(spark, folder):
    return packing.forced_pairs(_by_language(spark, folder)).select("lang", "pos", "pair_no")


@query("node_split", f"""WITH RECURSIVE {BY_LANG}, t AS (SELECT lang, pos, bytes, sum(bytes) OVER (PARTITION BY lang ORDER BY pos) - bytes AS before FROM u),
s(lang, lo, hi, path) AS (SELECT lang, CAST(0 AS BIGINT), count(*), '' FROM u GROUP BY lang
 UNION ALL SELECT s.lang, CASE h.i WHEN 1 THEN lo ELSE lo + (hi - lo) // 2 END, CASE h.i WHEN 1 THEN lo + (hi - lo) // 2 ELSE hi END, path || '_f' || h.i FROM s, (VALUES (1), (2)) h(i)
  WHERE hi - lo > 1 AND (hi - lo > 10 OR (SELECT sum(bytes) FROM t WHERE t.lang = s.lang AND pos >= lo AND pos < hi) > 20000))
SELECT lang, lo, hi, path, CAST((SELECT sum(bytes) FROM t WHERE t.lang = s.lang AND pos >= lo AND pos < hi) AS BIGINT) AS size FROM s
WHERE NOT (hi - lo > 1 AND (hi - lo > 10 OR (SELECT sum(bytes) FROM t WHERE t.lang = s.lang AND pos >= lo AND pos < hi) > 20000))""")
def node_split(spark, folder):
    return packing.node_split(_by_language(spark, folder), ["lang"], 20000, 0)


@query("merge_rounds")
def merge_rounds(spark, folder):
    return packing.merge_rounds(_by_language(spark, folder), ["lang"], 9000)


@query("proposal_groups")
def proposal_groups(spark, folder):
    """Documents as proposals whose texts can be cut to 120, 80, 40 or no characters."""
    docs = _by_language(spark, folder)
    sizes = {cap: f"b{cap}" for cap in (120, 80, 40, 0)}
    sized = docs.withColumns({name: F.least(F.col("bytes"), F.lit(cap)) + 200 for cap, name in sizes.items()}).withColumn("bytes", F.col("bytes") + 200)
    return packing.capped_groups(sized, ["lang"], sizes, "bytes", 4000, 200)


def _talk_episodes(spark, folder):
    eps = b.talk(spark, folder).groupBy("episode_id").agg(F.max("end_ms").alias("duration_ms"))
    return eps.withColumn("source_video", F.concat(F.lit("/lib/"), "episode_id", F.lit(".mkv")))


@query("scan_chunk_plan")
def scan_chunk_plan(spark, folder):
    """Scan requests of conversations held to three kilobytes."""
    eps, cues = _talk_episodes(spark, folder), b.talk(spark, folder)
    return packing.chunk_plan(eps, cov.fixed_chunks(eps), cues, rq.envelope_bytes("m"), 3000)


@query("second_pass_plan")
def second_pass_plan(spark, folder):
    """Requests for the open gaps of each day, with what is known near them as anchors."""
    eps, cues, evidence = b.episodes(spark, folder), b.cues(spark, folder), b.evidence(spark, folder)
    found = cov.detect_gaps(cues, b.visual(spark, folder), evidence, eps, cov.fixed_chunks(eps)).where("is_actionable and status = 'PENDING'")
    from cuefold.operators.intervals import merge_intervals

    # Found once: three steps of the plan read the groups.
    groups = durable(merge_intervals(found, cov.EP, 15_000).select("episode_id", F.col("start_ms").alias("group_start_ms"), "start_ms", "end_ms"))
    named = groups.withColumn("gap_id", F.col("group_start_ms").cast("string"))
    near = gaps.gap_anchors(named, evidence, eps).withColumn("group_start_ms", F.col("gap_id").cast("bigint"))
    anchors = ranking.ranked(near, ["episode_id", "group_start_ms"], ["category", "idx"], "_n").select(
        "episode_id", "group_start_ms", (F.col("_n") - 1).alias("rank"), (rq.escaped_bytes(F.col("anchor")) + 30).alias("bytes"),
        (rq.escaped_bytes(F.substring("anchor", 1, 40)) + 33).alias("short_bytes"),
    )
    return packing.second_pass_plan(groups, cues, anchors, rq.envelope_bytes("m") + 400, 6000)


@query("capped_texts", "SELECT doc_id, CASE WHEN strlen(CAST(to_json(text) AS VARCHAR)) - 2 <= 2000 THEN 0 ELSE 1 END AS capped FROM documents")
def capped_texts(spark, folder):
    docs = b.table(spark, folder, "documents")
    # A one-row generator keeps the cut from being worked out at each of its uses.
    cut = docs.select("doc_id", "text", F.explode(F.array(rq.cap_text(F.col("text"), F.lit(2000)))).alias("cut"))
    fits = rq.escaped_bytes(F.col("cut")) <= 2000
    return cut.select("doc_id", F.when(F.col("cut") == F.col("text"), 0).when(F.endswith("cut", F.lit(rq.CAPPED)) & fits, 1).otherwise(-1).alias("capped"))


# Answers: an event's properties in an outer envelope, damaged in six ways by its number.
def _raw_answers(spark, folder):
    e = b.table(spark, folder, "events")
    good = F.concat(F.lit('{"choices":[{"message":{"content":'), F.to_json(F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n```")).cast("variant")), F.lit("}}]}"))
    shapes = {
        0: F.lit("  "), 1: F.substring(good, 1, 40), 2: F.lit('{"choices":[]}'), 3: F.lit('{"choices":[{"message":{}}]}'), 4: F.lit('{"choices":[{"message":{"content":null}}]}'),
        5: F.lit('{"choices":[{"message":{"content":"no object here"}}]}'), 6: F.concat(F.lit('{"choices":[{"message":{"content":[{"type":"text","text":'), F.to_json(F.col("props").cast("variant")), F.lit("}]}}]}")),
    }
    raw = None
    for digit, shape in shapes.items():
        test = F.col("event_id") % 10 == digit
        raw = F.when(test, shape) if raw is None else raw.when(test, shape)
    return e.select("event_id", "props", raw.otherwise(good).alias("raw"))


@query("response_defects", "SELECT event_id, ['empty_body', 'outer_json_malformed', 'choices_missing', 'message_content_missing', 'content_empty', 'malformed_model_json'][event_id % 10 + 1] AS defect FROM events")
def response_defects(spark, folder):
    return _raw_answers(spark, folder).select("event_id", an.response_defect(F.col("raw")).alias("defect"))


@query("loose_json", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def loose_json(spark, folder):
    e = b.table(spark, folder, "events")
    n = F.col("event_id") % 4
    text = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("Sure!\n```JSON\n"), "props", F.lit("\n``` done"))).when(n == 2, F.concat(F.lit("it is "), "props", F.lit(" as asked"))).otherwise(F.concat(F.lit("["), "props", F.lit("")))
    text = F.when(n == 3, F.concat(F.lit("[1, 2] "), F.substring("props", 2, 100))).otherwise(text)
    return e.select("event_id", F.try_variant_get(an.loose_json(text), "$.k", "bigint").alias("k"))


@query("gap_answer_shapes", "SELECT event_id, event_id % 5 IN (0, 1, 4) AS valid FROM events")
def gap_answer_shapes(spark, folder):
    e = b.table(spark, folder, "events")
    n = F.col("event_id") % 5
    text = (
        F.when(n == 0, F.lit("{}")).when(n == 1, F.concat(F.lit('{"conflicts":['), "props", F.lit('],"note":3}'))).when(n == 2, F.concat(F.lit('{"conflicts":'), "props", F.lit("}")))
        .when(n == 3, F.concat(F.lit('{"dialogue":['), "props", F.lit(",7]}"))).otherwise(F.lit('{"episode_id":"x","other":[1]}'))
    )
    return e.select("event_id", an.lists_of_objects(F.try_parse_json(text), b.CATEGORIES).alias("valid"))


@query("stage_answer_shapes", "SELECT event_id, event_id % 4 = 0 AS valid FROM events")
def stage_answer_shapes(spark, folder):
    e = b.table(spark, folder, "events")
    n = F.col("event_id") % 4
    text = (
        F.when(n == 0, F.concat(F.lit('{"decisions":['), "props", F.lit('],"consolidated_candidates":[]}'))).when(n == 1, F.concat(F.lit('{"decisions":['), "props", F.lit("]}")))
        .when(n == 2, F.lit('{"decisions":[1],"consolidated_candidates":[]}')).otherwise(F.lit("[]"))
    )
    return e.select("event_id", an.has_lists(F.try_parse_json(text), ["decisions", "consolidated_candidates"]).alias("valid"))


@query("ocr_gate", "SELECT event_id, ['EMPTY', 'NO_WORDS', 'REPEATED_SYMBOLS', 'LOW_CONFIDENCE'][event_id % 6 + 1] AS issue FROM events")
def ocr_gate(spark, folder):
    n = F.col("event_id") % 6
    text = F.when(n == 0, "  ").when(n == 1, "?! ...").when(n == 2, F.lit("1l1l 1l1l")).otherwise(F.col("props"))
    return b.table(spark, folder, "events").select("event_id", an.ocr_issue(text, F.when(n == 3, 0.4).otherwise(0.9)).alias("issue"))


# Clause texts by a part's size, and where each must go.
CLAUSES = (
    ("Keep background music low.", "audio", ""), ("Burn subtitles into clip.mp4;", "file", ""), ("Post it to YouTube!", "output", ""), ("Never hallucinate facts.", "validation", ""),
    ("Skip episode 3.", "coverage", ""), ("Follow overarching threads.", "connection", ""), ("Propose single-scene candidates.", "candidate,scanner", ""),
    ("Show every reveal and conflict.", "scanner,editorial", "conflicts,reveals"), ("List the clues.", "scanner,editorial", ""), ("Use a warm tone.", "output", ""),
    ("Be kind to the hero.", "scanner,editorial", ""), ("Link cross-episode rivalries.", "connection,scanner", "relationships"),
)


@query("policy_routes", "WITH c(n, clause, routes, cats) AS (VALUES " + ", ".join(f"({i}, '{c}', '{r}', '{k}')" for i, (c, r, k) in enumerate(CLAUSES)) + f""")
SELECT p_partkey, CAST(x.i AS INTEGER) AS position, clause, routes, cats AS schema_categories FROM part, (VALUES (0), (1), (2)) x(i), c WHERE c.n = (p_size + x.i * 5) % {len(CLAUSES)}""")
def policy_routes(spark, folder):
    texts = F.array(*[F.lit(c) for c, _, _ in CLAUSES])
    at = lambda i: F.element_at(texts, ((F.col("p_size") + i * 5) % len(CLAUSES) + 1).cast("int"))
    prompt = F.concat(F.lit("# remark\r\n- "), at(0), F.lit("  "), at(1), F.lit("   \r\n\r\n 2) "), at(2))
    clauses = po.prompt_clauses(b.table(spark, folder, "part").select("p_partkey", prompt.alias("prompt")), "p_partkey")
    return po.route_clauses(clauses).select("p_partkey", "position", "clause", F.array_join("routes", ",").alias("routes"), F.array_join("schema_categories", ",").alias("schema_categories"))


@query("capped_directives", """WITH c AS (SELECT conv_id, turn, '- ' || replace(text, chr(10), ' ') AS line FROM conversations),
s AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM c),
d AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS whole, count(*) AS clauses FROM s WHERE upto <= 600 OR r = 1 GROUP BY conv_id),
k AS (SELECT *, CASE WHEN strlen(whole) <= 600 THEN whole ELSE left(whole, list_max(list_filter(range(0, 601), lambda n: strlen(left(whole, n)) <= 600))) END AS directive FROM d)
SELECT conv_id, directive, CAST(strlen(directive) AS BIGINT) AS bytes, clauses FROM k""")
def capped_directives(spark, folder):
    """Every conversation's directive; where the first clause alone is too long, what fits of it."""
    clauses = b.table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("position"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("clause"))
    out = po.capped_directive(clauses, "conv_id", 600)
    return out.select("conv_id", "directive", F.octet_length("directive").cast("bigint").alias("bytes"), F.size(F.split("directive", "\n")).cast("bigint").alias("clauses"))


# Scan answers: two turns become an answer of one list each, in seconds or milliseconds.
def _scan_answers(spark, folder):
    c = b.table(spark, folder, "conversations")
    key = F.element_at(F.array(*[F.lit(k) for k in ("reveals", "strengths", "events", "no_such_key", "character_decisions")]), (F.col("turn") % 5 + 1).cast("int"))
    item = F.to_json(F.struct(
        F.when(F.col("turn") % 2 == 0, F.col("turn") * 4000.5).alias("start_ms"), (F.col("turn") * 4.25).alias("start_sec"), F.when(F.col("turn") % 3 == 0, F.col("turn") * 4 + 90.0).alias("end_sec"),
        F.col("text").alias("summary"), F.col("role").alias("character"), F.array("role", F.lit("narrator")).alias("characters"), F.when(F.col("role") == "user", "Dialogue").otherwise("odd").alias("category"),
        (F.col("turn") == 7).alias("exclude"),
    ))
    content = F.concat(F.lit('{"'), key, F.lit('":['), item, F.lit(', 5],"note":"x"}'))
    return c.select(
        F.concat(F.lit("c"), "conv_id").alias("episode_id"), F.col("turn").alias("chunk_index"), (F.col("turn") * 4000).alias("chunk_start_ms"), (F.col("turn") * 4000 + 4000).alias("chunk_end_ms"),
        F.lit(60000).cast("bigint").alias("duration_ms"), content.alias("content"),
    )


ANSWERS = """base AS (SELECT 'c' || conv_id AS episode_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN CAST(round_even(turn * 4000.5::DOUBLE, 0) AS BIGINT) ELSE turn * 4250 END AS s,
  CASE WHEN turn % 3 = 0 THEN turn * 4000 + 90000 ELSE turn * 4000 + 4000 END AS e, turn % 5 AS k, turn = 7 AS ex FROM conversations),
routed AS (SELECT *, 'reveals' AS category FROM base WHERE k = 0 UNION ALL SELECT *, unnest(['strengths', 'strengths_weaknesses']) FROM base WHERE k = 1
  UNION ALL SELECT *, CASE WHEN role = 'user' THEN 'dialogue' ELSE 'major_scenes' END FROM base WHERE k = 2 AND NOT ex UNION ALL SELECT *, 'character_decisions' FROM base WHERE k = 4),
timed AS (SELECT *, s AS start_ms, CASE WHEN greatest(s, e) > 61000 THEN 60000 ELSE greatest(s, e) END AS end_ms,
  row_number() OVER (PARTITION BY episode_id, category ORDER BY turn) - 1 AS idx FROM routed)"""


@query("answer_evidence", f"WITH {ANSWERS} SELECT episode_id, turn AS chunk_index, category, idx, start_ms, end_ms FROM timed")
def answer_evidence(spark, folder):
    return ev.answer_evidence(_scan_answers(spark, folder)).select("episode_id", "chunk_index", "category", "idx", "start_ms", "end_ms")


@query("summary_items", f"""WITH {ANSWERS} SELECT episode_id, category || ':' || idx AS ref, s2 AS start_ms, least(CASE WHEN turn % 3 = 0 THEN greatest(s2, turn * 4000 + 90000) ELSE s2 + 5000 END, 60000) AS end_ms,
  CASE category WHEN 'reveals' THEN 'Reveal: ' || t WHEN 'dialogue' THEN '"' || t || '"' WHEN 'major_scenes' THEN t WHEN 'character_decisions' THEN role || ' decides: ' || t WHEN 'strengths_weaknesses' THEN role || ' (' || t || ')'
   ELSE t || '; ' || role || '; ' || CASE role WHEN 'user' THEN 'Dialogue' ELSE 'odd' END END AS summary,
  CASE category WHEN 'reveals' THEN 'reveal' WHEN 'major_scenes' THEN 'scene' WHEN 'character_decisions' THEN 'decision' WHEN 'strengths_weaknesses' THEN 'trait' ELSE category END AS item_type, role || ',narrator' AS characters
FROM (SELECT *, turn * 4250 AS s2, trim(text, E' \\n\\t') AS t FROM timed)""")
def summary_items(spark, folder):
    rows = ev.answer_evidence(_scan_answers(spark, folder))
    eps = rows.groupBy("episode_id").agg(F.max("duration_ms").alias("duration_ms"))
    return ev.summary_items(rows.drop("duration_ms"), eps).select("episode_id", "ref", "start_ms", "end_ms", "summary", "item_type", F.array_join("characters", ",").alias("characters"))


def _summary_rows(spark, folder):
    """Evidence of the days as summary items."""
    e = b.evidence(spark, folder)
    return e.select("episode_id", F.concat("category", F.lit(":"), "idx").alias("ref"), "category", "start_ms", "end_ms", "characters", "summary", F.col("category").alias("item_type"))


_LONG = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]+')), lambda w: len(w) > 1)"
_ALIKE = """((2 * (least({x}b, {y}b) - greatest({x}a, {y}a)) >= greatest(100, least({x}b - {x}a, {y}b - {y}a)) OR (abs({x}a - {y}a) <= 5000 AND abs({x}b - {y}b) <= 5000))
  AND (coalesce(len(list_intersect({x}w, {y}w)) / nullif(len(list_distinct(list_concat({x}w, {y}w))), 0), 0) >= 0.35::DOUBLE
    OR (len({x}t) > 8 AND len({y}t) > 8 AND (contains(lower({x}t), lower({y}t)) OR contains(lower({y}t), lower({x}t))))))"""
_BOTH = lambda c: f"list_sort(list_distinct(list_concat(x.{c}, i.{c})))"


@query("merged_summaries", f"""{T}, item AS (SELECT episode_id, [category || ':' || idx] AS refs, [category] AS cats, characters AS chars, start_ms AS a, end_ms AS b, summary AS t, category AS kind, {_LONG.format('summary')} AS w,
  row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, category, idx) AS n FROM evidence),
last AS (SELECT episode_id, max(n) AS n FROM item GROUP BY 1),
walk(episode_id, n, s) AS (SELECT episode_id, 1::BIGINT, [{{'refs': refs, 'cats': cats, 'chars': chars, 'a': a, 'b': b, 't': t, 'kind': kind, 'w': w}}] FROM item WHERE n = 1
  UNION ALL SELECT episode_id, n, CASE WHEN spot IS NULL THEN list_append(s, {{'refs': i.refs, 'cats': i.cats, 'chars': i.chars, 'a': i.a, 'b': i.b, 't': i.t, 'kind': i.kind, 'w': i.w}})
      ELSE list_concat(list_append(s[1 : spot - 1], {{'refs': {_BOTH('refs')}, 'cats': {_BOTH('cats')}, 'chars': {_BOTH('chars')}, 'a': least(x.a, i.a), 'b': greatest(x.b, i.b), 't': joined, 'kind': x.kind, 'w': {_LONG.format('joined')}}}), s[spot + 1 :]) END
    FROM (SELECT *, CASE WHEN contains(lower(x.t), lower(i.t)) THEN x.t WHEN contains(lower(i.t), lower(x.t)) THEN i.t ELSE left(x.t || ' | ' || i.t, 300) END AS joined
      FROM (SELECT *, s[spot] AS x FROM (SELECT w.episode_id, i.n, w.s, i, list_filter(range(1, len(w.s) + 1), lambda k: {_ALIKE.format(x='w.s[k].', y='i.')})[1] AS spot
        FROM walk w JOIN last l ON l.episode_id = w.episode_id AND w.n < l.n JOIN item i ON i.episode_id = w.episode_id AND i.n = w.n + 1)))),
done AS (SELECT w.episode_id, unnest(w.s) AS x FROM walk w JOIN last l ON l.episode_id = w.episode_id AND l.n = w.n)
SELECT episode_id, array_to_string(x.refs, ',') AS refs, array_to_string(x.cats, ',') AS categories, array_to_string(x.chars, ',') AS characters, x.a AS start_ms, x.b AS end_ms, x.t AS summary, x.kind AS item_type FROM done""")
def merged_summaries(spark, folder):
    out = duplicates.merge_duplicates(_summary_rows(spark, folder))
    return out.withColumns({c: F.array_join(c, ",") for c in ("refs", "categories", "characters")})


@query("second_pass_evidence", f"""{T}, item AS (SELECT episode_id, idx, characters AS c, start_ms AS a, end_ms AS b, summary AS t, {_LONG.format('summary')} AS w, starts_with(summary, 'error') AS found FROM evidence),
pair AS (SELECT f.episode_id, f.idx AS f, x.idx AS x, x.found FROM item f JOIN item x ON f.episode_id = x.episode_id AND f.found AND (NOT x.found OR x.idx < f.idx) WHERE {_ALIKE.format(x='f.', y='x.')}),
first AS (SELECT episode_id, idx AS f, row_number() OVER (PARTITION BY episode_id ORDER BY idx) AS n, (SELECT min(x) FROM pair p WHERE p.episode_id = i.episode_id AND p.f = i.idx AND NOT p.found) AS base,
  (SELECT coalesce(list(x ORDER BY x), []) FROM pair p WHERE p.episode_id = i.episode_id AND p.f = i.idx AND p.found) AS xs FROM item i WHERE found),
last AS (SELECT episode_id, max(n) AS n FROM first GROUP BY 1),
walk(episode_id, n, kept, f, target) AS (SELECT episode_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM last
  UNION ALL SELECT episode_id, n, CASE WHEN target IS NULL THEN list_append(kept, f) ELSE kept END, f, target FROM (
    SELECT w.episode_id, i.n, w.kept, i.f, coalesce(i.base, list_filter(i.xs, lambda x: list_contains(w.kept, x))[1]) AS target
    FROM walk w JOIN last l ON l.episode_id = w.episode_id AND w.n < l.n JOIN first i ON i.episode_id = w.episode_id AND i.n = w.n + 1)),
told AS (SELECT w.episode_id, target, list_distinct(flatten(list(c))) AS people FROM walk w JOIN item i ON i.episode_id = w.episode_id AND i.idx = w.f WHERE target IS NOT NULL GROUP BY ALL)
SELECT i.episode_id, 'dialogue' AS category, i.idx AS ordinal, i.a AS start_ms, i.b AS end_ms, array_to_string(list_sort(list_distinct(list_concat(i.c, coalesce(people, [])))), ',') AS characters, i.t AS summary, i.found::INTEGER AS found
FROM item i LEFT JOIN told ON told.episode_id = i.episode_id AND told.target = i.idx
WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.episode_id = i.episode_id AND w.f = i.idx AND w.target IS NOT NULL)""")
def second_pass_evidence(spark, folder):
    """Purchases as first-pass evidence, errors as the answers of the second pass, in one category."""
    rows = b.evidence(spark, folder).withColumn("ordinal", F.col("idx"))
    one = lambda kind: rows.where(F.startswith("summary", F.lit(kind))).withColumn("category", F.lit("dialogue"))
    out = duplicates.add_answers(one("purchase"), one("error"))
    return out.withColumn("characters", F.array_join("characters", ","))


@query("reconciled_gaps", f"""{T}, all_evidence AS (SELECT * FROM evidence),
old AS (WITH evidence AS (SELECT * FROM all_evidence WHERE category <> 'failures'), {DETECTED}
  SELECT episode_id, n AS p, 'old_' || printf('gap_%s_%02d', kind, n) AS gap_id, gap_type, start_ms, end_ms, cats, chars, act, CASE WHEN n % 2 = 0 THEN 'RESOLVED' ELSE status END AS status FROM gaps),
found AS (WITH evidence AS (SELECT * FROM all_evidence), {DETECTED} SELECT episode_id, n AS d, printf('gap_%s_%02d', kind, n) AS gap_id, gap_type, start_ms, end_ms, cats, chars, act, status FROM gaps),
same AS (SELECT f.episode_id, d, list(p ORDER BY p) AS ps FROM found f JOIN old o ON f.episode_id = o.episode_id AND f.gap_type = o.gap_type AND CASE f.gap_type WHEN 'CATEGORY_DEFICIT' THEN f.cats = o.cats
  WHEN 'CHARACTER_DEFICIT' THEN f.chars = o.chars ELSE greatest(f.start_ms, o.start_ms) < least(f.end_ms, o.end_ms) OR abs(f.start_ms - o.start_ms) <= 10000 AND abs(f.end_ms - o.end_ms) <= 10000 END GROUP BY ALL),
last AS (SELECT episode_id, max(d) AS d FROM found GROUP BY 1),
walk(episode_id, d, used, p) AS (SELECT episode_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM last
  UNION ALL SELECT episode_id, d, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (
    SELECT w.episode_id, w.d + 1 AS d, used, list_filter(coalesce(ps, []), lambda x: NOT list_contains(used, x))[1] AS pick
    FROM walk w JOIN last l ON l.episode_id = w.episode_id AND w.d < l.d LEFT JOIN same s ON s.episode_id = w.episode_id AND s.d = w.d + 1)),
met AS (SELECT episode_id, d, p FROM walk WHERE p IS NOT NULL)
SELECT f.episode_id, coalesce(o.gap_id, f.gap_id) AS gap_id, f.gap_type, f.d::INTEGER AS ordinal, f.start_ms, f.end_ms, f.cats AS target_categories, f.chars AS target_characters,
  CASE WHEN o.status <> 'PENDING' THEN o.act ELSE f.act END AS is_actionable, coalesce(o.status, f.status) AS status
FROM found f LEFT JOIN met m USING (episode_id, d) LEFT JOIN old o ON o.episode_id = f.episode_id AND o.p = m.p
UNION ALL SELECT episode_id, gap_id, gap_type, p::INTEGER, start_ms, end_ms, cats, chars, act, status FROM old WHERE status IN ('RESOLVED', 'PERSISTENT_EMPTY') AND NOT EXISTS (SELECT 1 FROM met m WHERE m.episode_id = old.episode_id AND m.p = old.p)""")
def reconciled_gaps(spark, folder):
    """Gaps found with all evidence against those found with the purchases only, every second settled."""
    eps, cues, vis, evidence = b.episodes(spark, folder), b.cues(spark, folder), b.visual(spark, folder), b.evidence(spark, folder)
    chunks = cov.fixed_chunks(eps)
    prior = cov.detect_gaps(cues, vis, evidence.where("category <> 'failures'"), eps, chunks)
    prior = prior.withColumns({"status": F.when(F.col("ordinal") % 2 == 0, "RESOLVED").otherwise(F.col("status")), "gap_id": F.concat(F.lit("old_"), "gap_id")})
    known = gaps.reconcile_gaps(cov.detect_gaps(cues, vis, evidence, eps, chunks), prior)
    return known.withColumns({c: F.array_join(c, ",") for c in ("target_categories", "target_characters")})


@query("resolved_gaps", """WITH g AS (SELECT o_orderkey AS gap_id, o_custkey AS episode_id FROM orders), r AS (SELECT l_orderkey AS gap_id, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n FROM lineitem GROUP BY 1)
SELECT 'e' || episode_id AS episode_id, 'g' || g.gap_id AS gap_id, CASE WHEN n IS NULL THEN 'PENDING' WHEN n > 0 THEN 'RESOLVED' ELSE 'PERSISTENT_EMPTY' END AS status FROM g LEFT JOIN r USING (gap_id)""")
def resolved_gaps(spark, folder):
    o = b.table(spark, folder, "orders").select(F.concat(F.lit("e"), "o_custkey").alias("episode_id"), F.concat(F.lit("g"), "o_orderkey").alias("gap_id"), F.lit("PENDING").alias("status"))
    lines = b.table(spark, folder, "lineitem").select(F.concat(F.lit("g"), "l_orderkey").alias("gap_id"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("items"))
    requests = lines.join(o.select("episode_id", "gap_id"), "gap_id").select("episode_id", F.array("gap_id").alias("gap_ids"), "items")
    return gaps.resolve_gaps(o, requests)


@query("offline_evidence", f"{T} SELECT episode_id, 'dialogue' AS category, ordinal AS idx, substring(text, 1, 200) AS summary FROM cues")
def offline_evidence(spark, folder):
    return ev.offline_evidence(b.cues(spark, folder)).select("episode_id", "category", "idx", "summary")


@query("compact_items", f"""{T}, i AS (SELECT episode_id, category, idx, summary, category IN ('setup_payoff', 'reveals', 'reversals', 'character_decisions', 'consequences', 'failures', 'conflicts', 'unresolved', 'supporting_developments', 'relationships', 'subplots', 'recurring_behavior', 'contradictions',
  'counter_evidence', 'dilemmas', 'power_shifts', 'reactions', 'visual_storytelling', 'strengths_weaknesses') AS p FROM evidence), f AS (SELECT episode_id, bool_or(p) AS a FROM i GROUP BY 1)
SELECT episode_id, idx, substring(summary, 1, 100) AS summary FROM i JOIN f USING (episode_id) WHERE p OR NOT a""")
def compact_items(spark, folder):
    items = b.evidence(spark, folder).select(
        "episode_id", "idx", "summary", F.array("category").alias("categories"), F.array().cast("array<string>").alias("characters"), F.array(F.col("idx").cast("string")).alias("refs"), F.lit("scene").alias("item_type")
    )
    return cm.compact_items(items, "PRIORITY").select("episode_id", "idx", "summary")


@query("fitting_levels", """WITH d AS (SELECT doc_id, text, least(n_chars, 140) AS t, least(n_chars, 100) AS p FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 120 THEN 'FULL' WHEN t <= 120 THEN 'TRIMMED' WHEN p <= 120 THEN 'PRIORITY' END AS level FROM d""")
def fitting_levels(spark, folder):
    d = b.table(spark, folder, "documents")
    sizes = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(l).alias("level"), F.least(F.length("text"), F.lit(cm.TEXT.get(l, 2**31 - 1))).alias("bytes")) for i, l in enumerate(cm.LEVELS)])
    return selection.first_fitting(d.select("doc_id", F.explode(sizes).alias("s")).select("doc_id", "s.*"), ["doc_id"], 120)


@query("compact_candidates", "SELECT printf('d%07d', doc_id) AS proposal_id, substring('About ' || source, 1, 80) AS title, substring(text, 1, 120) AS thesis FROM documents")
def compact_candidates(spark, folder):
    text = b.candidates(spark, folder).select("proposal_id", F.try_parse_json(cm.compact_candidate("SKELETON")).alias("v"))
    return text.select("proposal_id", F.try_variant_get("v", "$.title", "string").alias("title"), F.try_variant_get("v", "$.thesis", "string").alias("thesis"))


@query("verification_digest", f"""WITH {b.DECISIONS_SQL}, r AS (SELECT substring(candidate_id, 1, 6) AS project, candidate_id, ordinal, row_number() OVER (PARTITION BY substring(candidate_id, 1, 6) ORDER BY candidate_id, ordinal) AS n FROM dec WHERE action = 'REJECT')
SELECT project, 'REJECTED PROPOSALS DURING CONSOLIDATION (' || count(*) || '):' || chr(10) || string_agg('- ID: ' || candidate_id || ', Code: c, Reason: r', chr(10) ORDER BY n) FILTER (n <= 5) || chr(10) || 'COVERAGE & EVIDENCE SUMMARY:' AS digest FROM r GROUP BY project""")
def verification_digest(spark, folder):
    d = b.decisions(spark, folder).withColumns({"project": F.substring("candidate_id", 1, 6), "ordinal": F.struct("candidate_id", "ordinal"), "reason_code": F.lit("c"), "reason": F.lit("r")})
    none = d.limit(0).select("project", "ordinal", F.col("candidate_id").alias("episode_id"), F.lit("").alias("status"))
    return cm.verification_digest(d, none, "PRIORITY")


@query("clip_heads", """WITH e AS (SELECT o_custkey AS project, 'e' || o_orderkey AS episode_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal, CAST(floor(o_totalprice) AS BIGINT) % 40000 AS d, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT project, 'out_season_arc' AS output_id, ordinal, episode_id, CAST(0 AS BIGINT) AS start_ms, least(30000, greatest(d, 1000)) AS end_ms FROM e
UNION ALL SELECT project, 'out_supporting_arc', ordinal, episode_id, 0, least(15000, greatest(d, 1000)) FROM e WHERE n >= 2 AND ordinal < 3""")
def clip_heads(spark, folder):
    o = b.table(spark, folder, "orders").select(F.col("o_custkey").alias("project"), F.concat(F.lit("e"), "o_orderkey").alias("episode_id"), "o_orderkey", (F.floor("o_totalprice") % 40000).alias("duration_ms"))
    return scenes.clip_heads(packing.dense(o, ["project"], ["o_orderkey"], "ordinal"))


@query("scene_dialogue", f"""{TALK}, e AS (SELECT episode_id, greatest(max(end_ms), 3000) AS t, count(*) AS n FROM talk GROUP BY 1), k AS (SELECT *, CASE WHEN n <= 4 THEN greatest(n, 2) ELSE 3 END AS k FROM e),
bins AS (SELECT episode_id, i AS scene, k AS scenes, CAST(round_even(i * t / k, 0) AS BIGINT) AS s, least(CAST(round_even((i + 1) * t / k, 0) AS BIGINT), t) AS e FROM k, range(0, 4) r(i) WHERE i < k),
said AS (SELECT b.episode_id, scene, string_agg(text, ' ' ORDER BY ordinal) AS said FROM bins b JOIN talk c ON b.episode_id = c.episode_id AND ((c.start_ms >= s AND c.start_ms < e) OR (c.end_ms > s AND c.end_ms <= e) OR (c.start_ms <= s AND c.end_ms >= e)) GROUP BY ALL)
SELECT b.episode_id, b.scene, b.scenes, s AS start_ms, e AS end_ms, coalesce(array_to_string(list_slice(list_filter(regexp_split_to_array(said, '\\s+'), lambda w: w <> ''), 1, 14), ' '), '') AS quote FROM bins b LEFT JOIN said USING (episode_id, scene)""")
def scene_dialogue(spark, folder):
    cues = b.talk(spark, folder)
    return scenes.scene_dialogue(scenes.scene_bins(cues, _talk_episodes(spark, folder)), cues)


@query("silent_scenes", """WITH e AS (SELECT o_orderkey AS episode_id, greatest(CAST(floor(o_totalprice) AS BIGINT) % 40000, 3000) AS t FROM orders), k AS (SELECT *, CASE WHEN t >= 15000 THEN 3 ELSE 2 END AS k FROM e)
SELECT episode_id, i AS scene, CAST(k AS BIGINT) AS scenes, CAST(round_even(i * t / k, 0) AS BIGINT) AS start_ms, least(CAST(round_even((i + 1) * t / k, 0) AS BIGINT), t) AS end_ms FROM k, range(0, 3) r(i) WHERE i < k""")
def silent_scenes(spark, folder):
    o = b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("episode_id"), (F.floor("o_totalprice") % 40000).alias("duration_ms"))
    return scenes.silent_bins(o)


@query("chunk_transcripts", f"""{TALK}, e AS (SELECT episode_id, max(end_ms) AS d FROM talk GROUP BY 1)
SELECT episode_id, string_agg('[' || printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' - ' || printf('%02d:%02d:%02d.%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || '] ' || text, chr(10) ORDER BY ordinal) AS transcript FROM talk GROUP BY episode_id""")
def chunk_transcripts(spark, folder):
    cues = b.talk(spark, folder).withColumn("pos", F.col("ordinal"))
    whole = cues.groupBy("episode_id").agg(F.lit(0).cast("bigint").alias("lo"), (F.max("pos") + 1).alias("hi"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return scenes.transcripts(whole, cues, ["episode_id"]).select("episode_id", "transcript")


@query("scan_events", f"""{T}, n AS (SELECT *, start_ms // 600000 AS chunk, row_number() OVER (PARTITION BY episode_id, start_ms // 600000 ORDER BY idx) - 1 AS rk FROM evidence),
m AS (SELECT *, chunk * 600000 AS lo, least((chunk + 1) * 600000, 86400000) AS hi FROM n WHERE rk < 50)
SELECT episode_id, chunk, rk AS "at", greatest(lo, least(hi, start_ms)) AS start_ms, greatest(greatest(lo, least(hi, start_ms)), least(hi, end_ms)) AS end_ms, summary FROM m""")
def scan_events(spark, folder):
    """The evidence of a day as the answers to its ten-minute chunks."""
    chunk = F.floor(F.col("start_ms") / 600_000).cast("bigint")
    e = packing.dense(b.evidence(spark, folder).withColumn("chunk", chunk), ["episode_id", "chunk"], ["idx"], "at")
    bounds = {"chunk_start_ms": F.col("chunk") * 600_000, "chunk_end_ms": F.least((F.col("chunk") + 1) * 600_000, F.lit(b.DAY_MS).cast("bigint")), "quotes": F.array("summary"), "exclude": F.lit(False)}
    return scenes.scan_events(e.withColumns(bounds)).select("episode_id", "chunk", "at", "start_ms", "end_ms", "summary")


# Final plans: an order is a plan of one output whose lines are segments of one clip each.
def _plans(spark, folder):
    li = b.clips(spark, folder).withColumn("project", F.col("output_id"))
    odd = F.col("start_ms")
    seg = F.struct(
        F.col("ordinal"), F.concat(F.lit("s"), F.when(odd % 7 == 0, F.lit(0)).otherwise(F.col("ordinal"))).alias("segment_id"), F.lit("story").alias("segment_type"),
        F.when(odd % 11 == 0, "loud").when(odd % 3 == 0, "ORIGINAL_ONLY").otherwise("duck").alias("audio_policy"), F.when(odd % 5 == 0, "").otherwise("words").alias("narration_text"),
        F.when(odd % 17 == 0, "one").otherwise("both").alias("subtitle_policy"), F.when(odd % 13 == 0, 1.5).alias("recommended_visual_speed"),
        F.array(F.struct("episode_id", F.concat(F.lit("/LIB/"), "episode_id", F.when(odd % 19 == 0, ".avi").otherwise(".MKV")).alias("source_file"), "start_ms",
                         F.when(odd % 23 == 0, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"))).alias("source_clips"),
    )
    plan = li.groupBy("project").agg(F.array_sort(F.collect_list(seg)).alias("segments"))
    out = F.struct(
        F.when(F.col("project") % 29 == 0, "").otherwise("o1").alias("output_id"), F.lit("T").alias("title"), F.when(F.col("project") % 31 == 0, "a:b.mp4").otherwise("a.mp4").alias("file_name"),
        F.lit("recap").alias("output_type"), F.lit("en").alias("language"), "segments",
    )
    content = F.when(F.col("project") % 37 == 0, F.lit('{"outputs":7}')).when(F.col("project") % 41 == 0, F.lit("[1]")).when(F.col("project") % 43 == 0, F.lit('{"outputs":[]}')).otherwise(
        F.to_json(F.struct(F.array(out, out).alias("outputs")))
    )
    return plan.select("project", content.alias("content"))


def _plan_episodes(spark, folder):
    days = b.clips(spark, folder).select(F.col("output_id").alias("project"), "episode_id").distinct()
    return days.where("episode_id <> '2024-01-30'").select(
        "project", "episode_id", F.lit(0).alias("ordinal"), F.concat(F.lit("/lib/"), "episode_id", F.lit(".mkv")).alias("source_video"), F.lit(86_000_000).cast("bigint").alias("duration_ms")
    )


PLAN_ISSUES = f"""WITH {b.CLIPS_SQL}, c AS (SELECT output_id AS project, ordinal, episode_id, start_ms AS s, CASE WHEN start_ms % 23 = 0 THEN start_ms ELSE end_ms END AS e, row_number() OVER (PARTITION BY output_id, CASE WHEN start_ms % 7 = 0 THEN 0 ELSE ordinal END ORDER BY ordinal) AS dup FROM clips),
p AS (SELECT DISTINCT project FROM c), ok AS (SELECT project FROM p WHERE project % 37 <> 0 AND project % 41 <> 0 AND project % 43 <> 0), o AS (SELECT project, i FROM ok, (VALUES (0), (1)) v(i)),
x AS (SELECT c.*, o.i, '$.outputs[' || o.i || ']' AS op, '$.outputs[' || o.i || '].segments[' || c.ordinal || ']' AS sp FROM c JOIN o USING (project)),
issues AS (SELECT project, '$.outputs' AS path, 'SCHEMA_ERROR' AS code FROM p WHERE project % 37 = 0 UNION ALL SELECT project, '$', 'SCHEMA_ERROR' FROM p WHERE project % 37 <> 0 AND project % 41 = 0
 UNION ALL SELECT project, '$.outputs[' || i || '].output_id', 'REQUIRED_FIELD' FROM o WHERE project % 29 = 0 UNION ALL SELECT project, '$.outputs[1].output_id', 'DUPLICATE_ID' FROM ok WHERE project % 29 <> 0
 UNION ALL SELECT project, '$.outputs[1].file_name', 'DUPLICATE_FILE_NAME' FROM ok UNION ALL SELECT project, '$.outputs[' || i || '].file_name', 'INVALID_FILE_NAME' FROM o WHERE project % 31 = 0
 UNION ALL SELECT project, sp || '.segment_id', 'DUPLICATE_ID' FROM x WHERE dup > 1
 UNION ALL SELECT project, sp || '.audio_policy', 'UNSUPPORTED_AUDIO_POLICY' FROM x WHERE s % 11 = 0
 UNION ALL SELECT project, sp || '.narration_text', 'REQUIRED_FIELD' FROM x WHERE s % 5 = 0 AND (s % 11 = 0 OR s % 3 <> 0)
 UNION ALL SELECT project, sp || '.subtitle_policy', 'UNSUPPORTED_SUBTITLE_POLICY' FROM x WHERE s % 17 = 0
 UNION ALL SELECT project, sp || '.recommended_visual_speed', 'UNSUPPORTED_VISUAL_SPEED' FROM x WHERE s % 13 = 0
 UNION ALL SELECT project, sp || '.source_clips[0].episode_id', 'SOURCE_RESOLUTION_ERROR' FROM x WHERE episode_id = '2024-01-30'
 UNION ALL SELECT project, sp || '.source_clips[0].source_file', 'SOURCE_RESOLUTION_ERROR' FROM x WHERE episode_id <> '2024-01-30' AND s % 19 = 0
 UNION ALL SELECT project, sp || '.source_clips[0]', CASE WHEN e <= s THEN 'TIMESTAMP_ERROR' ELSE 'TIMESTAMP_OUT_OF_RANGE' END FROM x WHERE episode_id <> '2024-01-30' AND (e <= s OR e > 86000000))"""


@query("final_json_issues", f"{PLAN_ISSUES} SELECT * FROM issues")
def final_json_issues(spark, folder):
    return ck.final_json_issues(_plans(spark, folder), _plan_episodes(spark, folder))


@query("manifest_issues", f"""WITH {b.CLIPS_SQL}, c AS (SELECT *, output_id % 500 AS project FROM clips)
SELECT project, output_id || '/' || ordinal AS path, CASE WHEN episode_id = '2024-01-30' THEN 'UNKNOWN_EPISODE' ELSE 'PAST_DURATION' END AS code FROM c WHERE episode_id = '2024-01-30' OR end_ms > 86000500
UNION ALL SELECT project, output_id || '/' || ordinal, 'SOURCE_MISMATCH' FROM c WHERE episode_id <> '2024-01-30' AND start_ms % 19 = 0
UNION ALL SELECT DISTINCT project, 'output:' || output_id % 5000, 'DUPLICATE_ID' FROM (SELECT output_id % 500 AS project, output_id FROM (SELECT DISTINCT output_id FROM clips)) WHERE (project, output_id % 5000) IN
  (SELECT (output_id % 500, output_id % 5000) FROM (SELECT DISTINCT output_id FROM clips) GROUP BY 1 HAVING count(*) > 1)""")
def manifest_issues(spark, folder):
    clips = b.clips(spark, folder).withColumns({"project": F.col("output_id") % 500, "source_file": F.when(F.col("start_ms") % 19 == 0, "other.mkv").otherwise(F.concat("episode_id", F.lit(".mkv")))})
    outputs = clips.select("project", "output_id").distinct().withColumn("output_id", F.col("output_id") % 5000)
    eps = clips.select("project", "episode_id").distinct().where("episode_id <> '2024-01-30'").withColumns({"source_video": F.concat("episode_id", F.lit(".mkv")), "duration_ms": F.lit(86_000_000).cast("bigint")})
    return ck.manifest_issues(outputs, clips, eps)


@query("lenient_outputs", f"""WITH {b.CLIPS_SQL} SELECT output_id, ordinal, printf('seg_%02d', ordinal + 1) AS segment_id, CASE start_ms % 4 WHEN 0 THEN 'duck' WHEN 1 THEN 'keep' WHEN 2 THEN 'original_only' ELSE 'duck' END AS audio_policy,
  CASE WHEN start_ms % 4 <> 2 AND start_ms % 5 = 0 THEN 'NARRATION_MISSING' END AS segment_issue, start_ms + CASE WHEN start_ms % 3 = 0 THEN 5000 ELSE end_ms - start_ms END AS end_ms,
  CASE WHEN episode_id = '2024-01-30' THEN 'UNKNOWN_EPISODE' WHEN start_ms + CASE WHEN start_ms % 3 = 0 THEN 5000 ELSE end_ms - start_ms END > 86000500 THEN 'PAST_DURATION' END AS clip_issue FROM clips""")
def lenient_outputs(spark, folder):
    n = F.col("start_ms") % 4
    c = b.clips(spark, folder)
    raw = c.withColumns({
        "segment_id": F.lit(None).cast("string"), "audio_policy": F.when(n == 0, " Mute").when(n == 1, "keep").when(n == 2, "ORIGINAL_ONLY").otherwise("loud"),
        "narration": F.lit(""), "narration_text": F.when(F.col("start_ms") % 5 == 0, " ").otherwise("words"), "source_file": F.lit(None).cast("string"),
    })
    raw = raw.withColumn("end_ms", F.when(F.col("start_ms") % 3 != 0, F.col("end_ms")))
    segments = ck.lenient_segments(raw).withColumnRenamed("issue", "segment_issue")
    eps = c.select("episode_id").distinct().where("episode_id <> '2024-01-30'").withColumns({"source_video": F.concat("episode_id", F.lit(".mkv")), "duration_ms": F.lit(86_000_000).cast("bigint")})
    return ck.lenient_clips(segments, eps).select("output_id", "ordinal", "segment_id", "audio_policy", "segment_issue", "end_ms", F.col("issue").alias("clip_issue"))


@query("srt_issues", f"""{TALK} SELECT episode_id, CAST(ordinal AS INTEGER) AS block, CASE ordinal % 3 WHEN 0 THEN 'NO_TIME_LINE' WHEN 1 THEN 'END_BEFORE_START' ELSE 'PAST_DURATION' END AS code FROM talk WHERE ordinal % 3 < 2 OR start_ms > 8000 + 1000""")
def srt_issues(spark, folder):
    """Conversations written with a fault in most blocks: no time line, ends before starts, or past eight seconds."""
    from cuefold.functions.timecode import stamp

    n = F.col("ordinal") % 3
    times = F.when(n == 0, "00:00 to 00:01").when(n == 1, F.concat(stamp(F.col("end_ms")), F.lit(" --> "), stamp(F.col("start_ms")))).otherwise(F.concat(stamp(F.col("start_ms")), F.lit(" --> "), stamp(F.col("end_ms"))))
    block = F.concat("ordinal", F.lit("\n"), times, F.lit("\n"), "text", F.lit("\n"))
    docs = b.talk(spark, folder).withColumn("_b", block).groupBy("episode_id").agg(F.expr("listagg(_b, '\n') WITHIN GROUP (ORDER BY ordinal)").alias("content"))
    return ck.srt_issues(docs.withColumn("duration_ms", F.lit(8000)))


@query("publication_issues", """WITH p AS (SELECT p_partkey AS k, 'f' || p_partkey AS folder, 't' || p_partkey AS title FROM part)
SELECT folder, title || '.narration.srt' AS name, 'MISSING_FILE' AS code FROM p WHERE k % 3 = 0 UNION ALL SELECT folder, 'run.log', 'EXTRA_FILE' FROM p WHERE k % 4 = 0
UNION ALL SELECT folder, 'tmp', 'SUB_FOLDER' FROM p WHERE k % 5 = 0 UNION ALL SELECT folder, title || '.mp4', 'WRONG_DURATION' FROM p WHERE k % 7 = 0""")
def publication_issues(spark, folder):
    k = F.col("p_partkey")
    p = b.table(spark, folder, "part").select(k, F.concat(F.lit("f"), k).alias("folder"), F.concat(F.lit("t"), k).alias("title"))
    names = F.array(
        F.concat("title", F.lit(".mp4")), F.concat("title", F.lit(".original.srt")), F.when(k % 3 != 0, F.concat("title", F.lit(".narration.srt"))),
        F.when(k % 4 == 0, F.lit("run.log")), F.when(k % 5 == 0, F.lit("tmp")),
    )
    files = p.select("folder", F.explode(names).alias("name")).where("name is not null").withColumn("is_dir", F.col("name") == "tmp")
    expected = p.select("folder", "title", F.lit(100_000).alias("expected_ms"), F.when(k % 7 == 0, 97_999).otherwise(98_000).alias("actual_ms"))
    return ck.publication_issues(files, expected)


@query("media_issues", """WITH p AS (SELECT p_partkey AS k, 'm' || p_partkey AS path FROM part)
SELECT path, 'BAD_DIMENSIONS' AS code FROM p WHERE k % 11 = 0 UNION ALL SELECT path, 'NO_VIDEO_DATA' FROM p WHERE k % 7 = 0 UNION ALL SELECT path, 'BAD_LAYOUT' FROM p WHERE k % 5 = 0 AND k % 13 <> 0
UNION ALL SELECT path, 'NO_AUDIO' FROM p WHERE k % 13 = 0 UNION ALL SELECT path, 'NEGATIVE_START' FROM p WHERE k % 17 = 0 UNION ALL SELECT path, 'WRONG_DURATION' FROM p WHERE k % 19 = 0""")
def media_issues(spark, folder):
    k = F.col("p_partkey")
    p = b.table(spark, folder, "part").select(k, F.concat(F.lit("m"), k).alias("path"))
    stream = lambda kind: p.select(
        "path", F.lit(kind).alias("kind"), F.lit(0).alias("ordinal"), F.when(k % 11 == 0, 0).otherwise(640).alias("width"), F.lit(480).alias("height"), F.lit(2).alias("channels"),
        F.when(k % 5 == 0, "Unknown").otherwise("stereo").alias("channel_layout"), F.lit(48000).alias("sample_rate"), F.lit(0.0).alias("start_s"), F.lit(10.0).alias("duration_s"),
        (F.when(k % 7 == 0, "0").otherwise("N/A") if kind == "video" else F.lit("9")).alias("packets"), F.lit("5").alias("frames"), k.alias("k"),
    )
    rows = stream("video").unionByName(stream("audio").where("k % 13 <> 0"))
    formats = p.select("path", F.lit(1).alias("size"), F.lit(10.0).alias("duration_s"), F.when(k % 17 == 0, -0.06).otherwise(-0.05).alias("start_s"), F.when(k % 19 == 0, 11.0).otherwise(10.7).alias("expected_s"))
    return ck.media_issues(rows, formats)


@query("recap_checks", f"""WITH {b.CLIPS_SQL} SELECT output_id, ordinal, CASE WHEN start_ms % 9 = 0 THEN 'NEGATIVE_START' WHEN start_ms % 10 = 1 THEN 'END_BEFORE_START' WHEN end_ms > 80001000 THEN 'PAST_DURATION' WHEN start_ms % 4 = 0 THEN 'NARRATION_MISSING' END AS issue FROM clips""")
def recap_checks(spark, folder):
    s = F.col("start_ms")
    c = b.clips(spark, folder).withColumn("s0", s)
    rows = c.withColumns({"start_ms": F.when(s % 9 == 0, -1).otherwise(s), "end_ms": F.when(F.col("s0") % 10 == 1, F.when(s % 9 == 0, -1).otherwise(s)).otherwise(F.col("end_ms")),
                          "total_ms": F.lit(80_000_000), "audio_policy": F.lit("mute"), "narration": F.when(F.col("s0") % 4 == 0, " ").otherwise("x")})
    return ck.recap_issues(rows).select("output_id", "ordinal", "issue")


@query("recap_segments", f"""WITH {b.CLIPS_SQL}, c AS (SELECT *, least(40000000, start_ms) AS s FROM clips)
SELECT output_id, ordinal, s AS start_ms, greatest(s + 100, least(40000000, end_ms)) AS end_ms, printf('scene_%02d', ordinal + 1) AS segment_id, CASE WHEN start_ms % 4 = 0 THEN 'NARRATION_MISSING' WHEN start_ms % 3 = 0 THEN 'UNSUPPORTED_AUDIO_POLICY' END AS issue FROM c WHERE ordinal < 50""")
def recap_segments(spark, folder):
    s = F.col("start_ms")
    raw = b.clips(spark, folder).withColumns({"narration_text": F.when(s % 4 == 0, "").otherwise("x"), "audio_policy": F.when(s % 3 == 0, "loud").otherwise("Mute"), "total_ms": F.lit(40_000_000).cast("bigint"), "segment_id": F.lit(None).cast("string")})
    return ck.recap_segments(raw).select("output_id", "ordinal", "start_ms", "end_ms", "segment_id", "issue")


@query("stale_episodes", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def stale_episodes(spark, folder):
    """Stored results lack pending orders, know another price of every fifth, and an older file of every seventh."""
    k = F.col("o_orderkey")
    o = b.table(spark, folder, "orders").select(k, "o_totalprice", "o_orderstatus", F.lit(1000).alias("mtime_ms"))
    sign = lambda df: df.withColumn("sig", sg.signature(price=F.col("o_totalprice"), version=F.lit("v1")))
    stored = o.where("o_orderstatus <> 'P'").withColumns({"o_totalprice": F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "mtime_ms": F.when(k % 7 == 0, 990).otherwise(1001)})
    return sg.stale(sign(o), sign(stored), ["o_orderkey"], ["sig"], "mtime_ms").select("o_orderkey")


@query("transcript_changes", "SELECT 'c' || conv_id AS episode_id FROM conversations GROUP BY conv_id HAVING conv_id % 4 = 0 OR (conv_id % 4 = 1 AND count(*) > 1)")
def transcript_changes(spark, folder):
    """Episodes whose transcript hash moved: a changed word in every fourth, two turns swapped in the next."""
    cues = b.talk(spark, folder)
    number = F.substring("episode_id", 2, 20).cast("bigint") % 4
    edited = cues.withColumn("text", F.when((number == 0) & (F.col("ordinal") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    swap = (number == 1) & (F.col("ordinal") < 2) & (F.col("_n") > 1)
    n = cues.groupBy("episode_id").agg(F.count(F.lit(1)).alias("_n"))
    moved = edited.join(n, "episode_id").withColumn("ordinal", F.when(swap, 1 - F.col("ordinal")).otherwise(F.col("ordinal"))).withColumn("start_ms", F.col("ordinal") * 4000)
    before, after = sg.transcript_hash(cues), sg.transcript_hash(moved).withColumnRenamed("transcript_hash", "_h")
    return before.join(after, "episode_id").where("transcript_hash <> _h").select("episode_id")


TREE = """own AS (SELECT 'l' || l_orderkey || '-' || l_linenumber AS id, 'o' || l_orderkey AS parent, l_linenumber AS k, min(l_returnflag || l_linestatus) AS own, 0 AS lvl FROM lineitem GROUP BY l_orderkey, l_linenumber
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, o_orderstatus, 1 FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, c_name, 2 FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name, 3 FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, r_regionkey, r_name, 4 FROM region),
node AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY k) - 1 AS at FROM own)"""


def _tree_sql() -> str:
    """Signatures level by level; children in runs of 256 where there are more."""
    steps = ["s0 AS (SELECT id, parent, \"at\", sha256(own) AS h FROM node WHERE lvl = 0)"]
    for i in range(1, 5):
        steps.append(f"""r{i} AS (SELECT parent, "at" // 256 AS run, count(*) AS n, sha256(string_agg(h, '' ORDER BY "at")) AS h FROM s{i - 1} GROUP BY ALL),
d{i} AS (SELECT parent, CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY run)) END AS d FROM r{i} GROUP BY parent),
s{i} AS (SELECT id, node.parent, "at", CASE WHEN d IS NULL THEN sha256(own) ELSE sha256(own || '|' || d) END AS h FROM node LEFT JOIN d{i} ON d{i}.parent = id WHERE lvl = {i})""")
    return ", ".join(steps)


def _tree(spark, folder):
    """Lines under orders under customers under nations under regions, each in key order."""
    t = lambda name: b.table(spark, folder, name)
    mark = lambda letter, *columns: F.concat(F.lit(letter), *[c for pair in zip([F.lit("-")] * len(columns), map(F.col, columns)) for c in pair][1:])
    node = lambda df, i, parent, k, own: df.select(i.alias("id"), parent.alias("parent"), F.col(k).cast("bigint").alias("k"), own.alias("own"))
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("flags"))
    whole = (
        node(lines, mark("l", "l_orderkey", "l_linenumber"), mark("o", "l_orderkey"), "l_linenumber", F.col("flags"))
        .unionByName(node(t("orders"), mark("o", "o_orderkey"), mark("c", "o_custkey"), "o_orderkey", F.col("o_orderstatus")))
        .unionByName(node(t("customer"), mark("c", "c_custkey"), mark("n", "c_nationkey"), "c_custkey", F.col("c_name")))
        .unionByName(node(t("nation"), mark("n", "n_nationkey"), mark("r", "n_regionkey"), "n_nationkey", F.col("n_name")))
    )
    inner = ranking.ranked(whole, ["parent"], ["k"], "at").withColumn("at", F.col("at") - 1).drop("k")
    roots = t("region").select(mark("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("own"), F.lit(0).cast("bigint").alias("at"))
    return durable(inner.unionByName(roots))


@query("node_signatures", f"WITH {TREE}, {_tree_sql()} SELECT id, h AS signature FROM s0 UNION ALL SELECT id, h FROM s1 UNION ALL SELECT id, h FROM s2 UNION ALL SELECT id, h FROM s3 UNION ALL SELECT id, h FROM s4")
def node_signatures(spark, folder):
    return sg.node_signatures(_tree(spark, folder))


@query("stale_nodes", f"""WITH RECURSIVE {TREE}, up(id) AS (SELECT id FROM node WHERE lvl = 0 AND own LIKE 'R%' AND k = 4 UNION SELECT parent FROM up JOIN node USING (id) WHERE parent IS NOT NULL) SELECT id FROM up""")
def stale_nodes(spark, folder):
    """What is to be computed anew when all fourth lines that were returned change."""
    nodes = _tree(spark, folder)
    return sg.stale_nodes(nodes, nodes.where("id LIKE 'l%-4' AND own LIKE 'R%'").select("id"))


@query("layered_signatures", "SELECT count(DISTINCT o_orderkey) AS plans, count(DISTINCT (o_orderkey, o_orderpriority)) AS renders FROM orders")
def layered_signatures(spark, folder):
    """Analysis and render keys: a render setting moves only the second."""
    o = b.table(spark, folder, "orders")
    plan = sg.signature(key=F.col("o_orderkey"), version=F.lit("v1"))
    render = sg.signature(plan=plan, voice=F.col("o_orderpriority"))
    return o.select(plan.alias("p"), render.alias("r")).agg(F.count_distinct("p").alias("plans"), F.count_distinct("r").alias("renders"))


@query("stale_outputs", "SELECT o_orderkey AS output_id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 4 <> 0 AND o_orderpriority <> '5-LOW')")
def stale_outputs(spark, folder):
    k = F.col("o_orderkey")
    o = b.table(spark, folder, "orders")
    current = o.select(k.alias("output_id"), sg.signature(a=F.col("o_totalprice")).alias("render_signature"))
    stored = o.select(k.alias("output_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("ERROR").alias("status"), sg.signature(a=F.when(k % 4 == 0, 0.0).otherwise(F.col("o_totalprice"))).alias("render_signature"))
    return sg.stale_outputs(current, stored, o.where("o_orderpriority <> '5-LOW'").select(k.alias("output_id"))).select("output_id")


@query("upserted_outputs", """SELECT coalesce(a.o_orderkey, b.o_orderkey) AS output_id, CASE WHEN b.o_orderkey IS NOT NULL THEN 'COMPLETED' ELSE 'WAITING' END AS status, coalesce(a.o_custkey, b.o_custkey) AS owner,
  CASE WHEN b.o_orderkey IS NOT NULL THEN CAST(b.o_orderkey % 100 AS BIGINT) ELSE 0 END AS progress FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT * FROM orders WHERE o_orderpriority < '3') b USING (o_orderkey)""")
def upserted_outputs(spark, folder):
    o = b.table(spark, folder, "orders")
    rows = lambda df, status, progress: df.select(F.lit("p").alias("project"), F.col("o_orderkey").alias("output_id"), F.lit(status).alias("status"), progress.cast("bigint").alias("progress"), F.col("o_custkey").alias("owner"))
    stored = rows(o.where("o_orderstatus <> 'P'"), "WAITING", F.lit(0))
    current = rows(o.where("o_orderpriority < '3'"), "COMPLETED", F.col("o_orderkey") % 100)
    return projects.upsert_outputs(stored, current).drop("project")


@query("missing_and_extra", """WITH x AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT p_partkey FROM part WHERE p_size < 25)
SELECT p_partkey AS key, 'missing' AS side FROM p WHERE p_partkey NOT IN (SELECT * FROM x) UNION ALL SELECT l_partkey, 'extra' FROM x WHERE l_partkey NOT IN (SELECT * FROM p)""")
def missing_and_extra(spark, folder):
    expected = b.table(spark, folder, "part").where("p_size < 25").select(F.col("p_partkey").alias("key"))
    actual = b.table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("key"))
    return projects.missing_and_extra(expected, actual, ["key"])


@query("evidence_totals", f"{T} SELECT substring(episode_id, 1, 9) AS project, count(*) AS items, count(DISTINCT episode_id) AS episodes FROM evidence GROUP BY 1")
def evidence_totals(spark, folder):
    return projects.evidence_totals(b.evidence(spark, folder).withColumn("project", F.substring("episode_id", 1, 9)))


def _transport_documents(spark, folder):
    """What a user's day says, as one document of a project that reuses its episodes: objects, other members, nesting, empties, scalars."""
    e = b.evidence(spark, folder).withColumn("project", F.col("characters")[0])
    item = F.struct(
        "characters", "episode_id", "start_ms", "end_ms", (F.col("start_ms") / 1000).alias("start_sec"), F.when(F.col("idx") % 2 == 0, F.col("end_ms") / 1000).alias("end_sec"),
        F.col("summary"), F.col("summary").alias("detail"), F.when(F.col("idx") % 3 == 0, F.concat(F.lit("~"), F.col("idx"))).otherwise("^same words").alias("note"),
        F.struct("characters", F.array(F.struct("summary")).alias("list")).alias("nested"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.to_json(item).alias("item")))), lambda x: x["item"])
    lists = e.groupBy("project", "episode_id", "category").agg(listed.alias("_l"), F.count(F.lit(1)).alias("_n"))
    member = F.concat(F.lit('"'), F.col("category"), F.lit('":["~'), F.col("category"), F.lit('",'), F.array_join("_l", ","), F.lit(",null]"))
    days = lists.groupBy("project", "episode_id").agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias("_m"), F.sum("_n").alias("_n"))
    return days.select("project", "episode_id", F.concat(F.lit('{"$empty":[],"$note":"^scalar","$total":'), "_n", F.lit(","), "_m", F.lit("}")).alias("content"))


TRANSPORT = f"""{T}, item AS (SELECT characters[1] AS project, *, CASE WHEN idx % 3 = 0 THEN '~' || idx ELSE '^same words' END AS note FROM evidence)"""
_SECONDS = r"regexp_replace(printf('%.3f', {0} / 1000.0), '\.?0+$', '')"


@query("string_dictionary", f"""{TRANSPORT}, v AS (SELECT project, unnest([episode_id, summary, summary, summary, note, characters[1], characters[1]]) AS v FROM item
  UNION ALL SELECT DISTINCT ON (project, episode_id, category) project, '~' || category FROM item UNION ALL SELECT DISTINCT ON (project, episode_id) project, '^scalar' FROM item),
c AS (SELECT project, to_json(v)::VARCHAR AS v, count(*) AS n, strlen(to_json(v)::VARCHAR) AS size FROM v GROUP BY ALL)
SELECT project, v AS value, CAST((size - 4) * n - size AS BIGINT) AS saving, row_number() OVER (PARTITION BY project ORDER BY (size - 4) * n - size DESC, v) - 1 AS code FROM c WHERE n >= 2 AND size >= 8 AND (size - 4) * n - size > 0""")
def string_dictionary(spark, folder):
    return transport.dictionary(transport.fields_of(transport.shred(_transport_documents(spark, folder))))


@query("transport_round_trip", f"""{TRANSPORT}, lists AS (SELECT project, episode_id, category, count(*) AS n, string_agg('{{"characters":' || to_json(characters) || ',"detail":' || to_json(summary) || ',"end_ms":' || end_ms
    || CASE WHEN idx % 2 = 0 THEN ',"end_sec":' || {_SECONDS.format('end_ms')} ELSE '' END || ',"episode_id":' || to_json(episode_id) || ',"nested":{{"characters":' || to_json(characters) || ',"list":[{{"summary":' || to_json(summary)
    || '}}]}},"note":' || to_json(note) || ',"start_ms":' || start_ms || ',"start_sec":' || {_SECONDS.format('start_ms')} || ',"summary":' || to_json(summary) || '}}', ',' ORDER BY idx) AS l FROM item GROUP BY ALL)
SELECT project, episode_id, '{{"$empty":[],"$note":"^scalar","$total":' || CAST(sum(n) AS BIGINT) || ',' || string_agg('"' || category || '":["~' || category || '",' || l || ',null]', ',' ORDER BY category) || '}}' AS content
FROM lists GROUP BY project, episode_id""")
def transport_round_trip(spark, folder):
    """Whole documents after shredding, packing, unpacking and assembling."""
    return transport.assemble(transport.unpack(*transport.pack(transport.shred(_transport_documents(spark, folder)))))


@query("project_progress", """WITH e AS (SELECT user_id AS project, event_id AS seq, CASE event_type WHEN 'view' THEN 'scanner' WHEN 'click' THEN 'candidate_discovery' WHEN 'signup' THEN 'finalizer' WHEN 'purchase' THEN 'json_validation' ELSE 'idle' END AS phase, props FROM events)
SELECT project, CAST(max(CASE phase WHEN 'scanner' THEN 20 + floor((seq % 10) / 10 * 35) WHEN 'candidate_discovery' THEN 65 + floor((seq % 10) / 10 * 7) WHEN 'finalizer' THEN 70 WHEN 'json_validation' THEN 80 ELSE 0 END) AS INTEGER) AS progress,
 arg_max(props, seq) AS message, arg_max(phase, seq) AS phase, max(seq) AS seq FROM e GROUP BY project""")
def project_progress(spark, folder):
    e = b.table(spark, folder, "events")
    kind = F.col("event_type")
    phase = F.when(kind == "view", "scanner").when(kind == "click", "candidate_discovery").when(kind == "signup", "finalizer").when(kind == "purchase", "json_validation").otherwise("idle")
    events = e.select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), phase.alias("phase"), (F.col("event_id") % 10).alias("done"), F.lit(10).alias("total"), F.col("props").alias("message"))
    return pg.fold_progress(events).drop("retried")
