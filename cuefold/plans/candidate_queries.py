"""Story candidates: similarity, groups, decisions, grounding, breadth."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuefold.operators import decisions as dc
from cuefold.operators import graph
from cuefold.operators import grounding as gr
from cuefold.operators import similarity as sim
from cuefold.operators import verification as vf
from cuefold.plans import bindings as b
from cuefold.plans.registry import ORACLES, query
from cuefold.sources import candidates as candidates_source

C = f"WITH RECURSIVE {b.CANDIDATES_SQL}"
SCORES = """w AS (SELECT id, unnest(words) AS w FROM cand), r AS (SELECT id, unnest(refs) AS r FROM cand),
wj AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
rj AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM r a JOIN r b ON a.r = b.r AND a.id < b.id GROUP BY ALL),
pair AS (SELECT a.id AS a, b.id AS b, coalesce(wj.n, 0) / (len(a.words) + len(b.words) - coalesce(wj.n, 0)) AS jw,
  len(list_intersect(a.tags, b.tags)) / (len(a.tags) + len(b.tags) - len(list_intersect(a.tags, b.tags))) AS jt,
  coalesce(rj.n, 0) / greatest(1, len(a.refs) + len(b.refs) - coalesce(rj.n, 0)) AS jr, coalesce(rj.n, 0) > 0 AS proof,
  CASE WHEN a.chars = b.chars THEN 1.0 ELSE 0.0 END::DOUBLE AS jc, a.prim = b.prim AS same, list_has_any(a.eps, b.eps) AS shared,
  list_sort(a.tags) = list_sort(b.tags) AS eq_tags, coalesce(wj.n, 0) = len(a.words) AND len(a.words) = len(b.words) AS eq_words
  FROM cand a JOIN cand b ON a.id < b.id LEFT JOIN wj ON wj.a = a.id AND wj.b = b.id LEFT JOIN rj ON rj.a = a.id AND rj.b = b.id),
scored AS (SELECT a, b, proof, eq_tags, eq_words, least(1.0::DOUBLE, greatest(jw * 0.40::DOUBLE + jt * 0.25::DOUBLE + jr * 0.20::DOUBLE + jc * 0.15::DOUBLE,
  CASE WHEN same AND jw >= 0.35 THEN 0.70 WHEN same AND shared AND jw >= 0.2 THEN 0.55 WHEN same AND jt >= 0.3 THEN 0.50 ELSE 0.0 END::DOUBLE,
  CASE WHEN proof THEN 0.65 ELSE 0.0 END::DOUBLE)) AS score FROM pair)"""


def _components_sql(links: str, name: str) -> str:
    return f"""{name}_e AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
{name}_w(id, low) AS (SELECT id, id FROM cand UNION SELECT e.b, w.low FROM {name}_w w JOIN {name}_e e ON w.id = e.a WHERE w.low < e.b),
{name} AS (SELECT id, min(low) AS grp FROM {name}_w GROUP BY id)"""


@query("candidate_groups", f"{C}, {SCORES}, linked AS MATERIALIZED (SELECT a, b FROM scored WHERE score >= 0.25), {_components_sql('linked', 'comp')} SELECT id AS proposal_id, grp AS group_id FROM comp")
def candidate_groups(spark, folder):
    return sim.candidate_groups(b.candidates(spark, folder)).drop("project")


@query("similar_links", f"""{C}, {SCORES}, marks AS (SELECT id, 'r' || unnest(refs) AS k FROM cand UNION ALL SELECT id, 't' || array_to_string(list_sort(tags), '|') FROM cand
  UNION ALL SELECT id, 'w' || array_to_string(list_sort(words), '|') FROM cand WHERE len(words) > 0
  UNION ALL SELECT id, 'p' || prim || '|' || unnest(tags) FROM cand WHERE prim <> '' AND len(tags) <= 2),
hubs AS (SELECT DISTINCT h.hub AS a, m.id AS b FROM marks m JOIN (SELECT k, min(id) AS hub FROM marks GROUP BY k) h USING (k) WHERE m.id <> h.hub),
alone AS (SELECT DISTINCT h.hub AS a, m.id AS b FROM marks m JOIN (SELECT k, min(id) AS hub FROM marks GROUP BY k) h USING (k) WHERE m.id <> h.hub AND m.k NOT LIKE 'p%'),
{_components_sql('alone', 'hc')}
SELECT s.a, s.b, floor(s.score * 1000000000 + 0.5) AS score_nano FROM scored s JOIN hubs USING (a, b)
UNION ALL SELECT s.a, s.b, floor(s.score * 1000000000 + 0.5) FROM scored s JOIN hc x ON x.id = s.a JOIN hc y ON y.id = s.b WHERE x.grp <> y.grp AND s.score >= 0.25
  AND NOT EXISTS (SELECT 1 FROM hubs h WHERE h.a = s.a AND h.b = s.b)""")
def similar_links(spark, folder):
    links = sim.similar_links(b.candidates(spark, folder))
    return links.select("a", "b", F.floor(F.col("score") * 1000000000 + 0.5).cast("double").alias("score_nano"))


EPS = "eps AS (SELECT printf('2024-01-%02d', i) AS episode_id, CAST(40000000 + i * 1000000 AS BIGINT) AS duration_ms FROM (SELECT DISTINCT day(ts) AS i FROM events))"


def _episodes(spark, folder):
    """Days of the events with a duration that grows with the day, so that some ranges overrun."""
    day = b.table(spark, folder, "events").groupBy(F.dayofmonth("ts").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return day.select(F.format_string("2024-01-%02d", F.col("i")).alias("episode_id"), (F.col("i").cast("bigint") * 1000000 + 40000000).alias("duration_ms"))


GROUNDED = """rng AS (SELECT c.id, c.eps[1] AS ep, c.start_ms, least(c.end_ms, e.duration_ms) AS end_ms FROM cand c JOIN eps e ON c.eps[1] = e.episode_id WHERE c.start_ms <= e.duration_ms),
keps AS (SELECT id, list_filter(eps, lambda x: x IN (SELECT episode_id FROM eps)) AS k FROM cand)"""


@query("grounded_candidates", f"""{C}, {EPS}, ke AS (SELECT id, unnest(eps) AS ep, unnest(range(len(eps))) AS i FROM cand),
kk AS (SELECT id, string_agg(ep, ',' ORDER BY i) AS episodes, count(*) AS n FROM ke JOIN eps ON ep = episode_id GROUP BY id),
rng AS (SELECT c.id, c.start_ms, least(c.end_ms, e.duration_ms) AS end_ms FROM cand c JOIN eps e ON c.eps[1] = e.episode_id WHERE c.start_ms <= e.duration_ms)
SELECT c.id AS proposal_id, coalesce(kk.episodes, '') AS episodes, r.start_ms, r.end_ms,
  CASE WHEN kk.n = 1 AND scope IN ('CROSS_EPISODE', 'SEASON_ARC') THEN 'SINGLE_EPISODE' WHEN kk.n > 1 AND scope = 'SINGLE_EPISODE' THEN 'CROSS_EPISODE' ELSE scope END AS scope,
  CASE WHEN kk.n IS NULL AND r.id IS NULL THEN 'NO_VALID_EPISODES' END AS issue FROM cand c LEFT JOIN kk USING (id) LEFT JOIN rng r USING (id)""")
def grounded_candidates(spark, folder):
    out = gr.ground_candidates(b.candidates(spark, folder), _episodes(spark, folder))
    span = F.get("ranges", F.lit(0))
    return out.select("proposal_id", F.array_join("episodes", ",").alias("episodes"), span["start_ms"].alias("start_ms"), span["end_ms"].alias("end_ms"), "scope", "issue")


# Two projects with the same proposal and episode ids; the second has only the first days.
FEWER = ORACLES["grounded_candidates"].replace("JOIN eps ", "JOIN (SELECT * FROM eps WHERE episode_id <= '2024-01-12') ")


@query("project_grounding", f"SELECT 'p0' AS project, * FROM ({ORACLES['grounded_candidates']}) UNION ALL SELECT 'p1' AS project, * FROM ({FEWER})")
def project_grounding(spark, folder):
    both = F.explode(F.array(F.lit("p0"), F.lit("p1"))).alias("project")
    eps = _episodes(spark, folder).select(both, "*").where("project = 'p0' OR episode_id <= '2024-01-12'")
    out = gr.ground_candidates(b.candidates(spark, folder).drop("project").select(both, "*"), eps)
    span = F.get("ranges", F.lit(0))
    return out.select("project", "proposal_id", F.array_join("episodes", ",").alias("episodes"), span["start_ms"].alias("start_ms"), span["end_ms"].alias("end_ms"), "scope", "issue")


@query("recovered_candidates", f"""{C}, {EPS}, rr AS (SELECT DISTINCT id, unnest(refs) AS ref FROM cand),
known AS (SELECT ref FROM rr GROUP BY ref HAVING count(*) > 1), held AS (SELECT id, count(*) AS n FROM rr WHERE ref IN (SELECT ref FROM known) GROUP BY id),
kk AS (SELECT c.id, count(*) AS n FROM (SELECT id, unnest(list_distinct(eps)) AS ep FROM cand) c JOIN eps ON ep = episode_id GROUP BY id)
SELECT c.id AS proposal_id, coalesce(h.n, 0) AS refs, CASE WHEN doc_id % 17 = 0 OR contains(lower(thesis), 'fallback') THEN 'GENERIC' WHEN kk.n IS NULL THEN 'NO_VALID_EPISODES' WHEN h.n IS NULL THEN 'NOT_GROUNDED' END AS issue
FROM cand c LEFT JOIN held h USING (id) LEFT JOIN kk USING (id)""")
def recovered_candidates(spark, folder):
    """References that more than one document holds count as evidence; some titles are generic."""
    c = b.candidates(spark, folder)
    c = c.withColumn("title", F.when(F.substring("proposal_id", 2, 7).cast("bigint") % 17 == 0, "A Default Recap").otherwise(F.col("title")))
    refs = c.select(F.explode("refs").alias("ref")).groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ref")
    out = gr.ground_recovered(c, _episodes(spark, folder), refs)
    return out.select("proposal_id", F.size("refs").cast("bigint").alias("refs"), "issue")


_DECIDED = """fd AS (SELECT candidate_id, arg_min(action, ordinal) AS action, arg_min(reason_code, ordinal) AS reason_code, arg_min(target_id, ordinal) AS target_id FROM dec GROUP BY 1),
ch(id, hop, n) AS (SELECT candidate_id, target_id, 0 FROM fd WHERE action = 'MERGE' AND target_id <> '' UNION ALL SELECT ch.id, fd.target_id, n + 1 FROM ch JOIN fd ON fd.candidate_id = ch.hop AND fd.action = 'MERGE' AND fd.target_id <> ''),
ends AS (SELECT id, arg_max(hop, n) AS hop FROM ch GROUP BY id),
cd AS (SELECT candidate_id, action, reason_code, coalesce(hop, target_id) AS target_id FROM fd LEFT JOIN ends ON id = candidate_id),
d1 AS (SELECT c.id AS candidate_id, coalesce(action, 'KEEP') AS action, CASE WHEN action IS NULL THEN 'conservative_keep' WHEN action = 'REJECT' AND reason_code = '' THEN 'weak_evidence' ELSE reason_code END AS reason_code,
  coalesce(target_id, '') AS target_id FROM cand c LEFT JOIN given ON c.id = given.candidate_id),
d2 AS (SELECT d.candidate_id, d.target_id, d.action, d.reason_code, action = 'MERGE' AND a.prim = t.prim AND trim(a.thesis) <> trim(t.thesis)
   AND len(list_intersect(a.words, t.words)) / len(list_distinct(list_concat(a.words, t.words))) < 0.20 AS apart
  FROM d1 d JOIN cand a ON a.id = d.candidate_id LEFT JOIN cand t ON t.id = d.target_id),
decided AS (SELECT candidate_id, CASE WHEN coalesce(apart, false) THEN 'KEEP' ELSE action END AS action, CASE WHEN coalesce(apart, false) THEN 'distinct_thesis' ELSE reason_code END AS reason_code,
  CASE WHEN coalesce(apart, false) THEN '' ELSE target_id END AS target_id FROM d2)"""
#: Decisions as given, and with merges followed to their ends.
DECIDED, CHAINED = (f"{b.DECISIONS_SQL}, {_DECIDED.replace('given', name)}" for name in ("fd", "cd"))


@query("first_decisions", f"{C}, {DECIDED} SELECT * FROM decided")
def first_decisions(spark, folder):
    return dc.first_decisions(b.candidates(spark, folder), b.decisions(spark, folder))


def _consolidated(spark, folder):
    """Answers for every document that closes a ten: its own range moved a little, one invented, one made-up row."""
    c = b.candidates(spark, folder)
    number = F.substring("proposal_id", 2, 7).try_cast("bigint")
    moved = F.transform("ranges", lambda r: F.struct(r["episode_id"].alias("episode_id"), (r["start_ms"] + 1500).alias("start_ms"), r["end_ms"].alias("end_ms"), r["ref"].alias("ref")))
    invented = F.array(F.struct(F.lit("2024-01-01").alias("episode_id"), F.lit(90000000).cast("bigint").alias("start_ms"), F.lit(90001000).cast("bigint").alias("end_ms"), F.lit("made up").alias("ref")))
    real = c.where((number % 10).isin(0, 2)).withColumn("ranges", F.concat(moved, invented)).withColumn("characters", F.array(F.lit("zed"))).withColumn("facts", F.array(F.concat(F.lit("fact of "), "proposal_id")))
    fake = c.where(number % 10 == 5).withColumn("facts", F.array().cast("array<string>")).withColumn("proposal_id", F.concat(F.lit("x"), "proposal_id")).withColumn("title", F.lit("No such title"))
    return real.unionByName(fake).select("proposal_id", "title", "scope", "episodes", "characters", "refs", "ranges", "facts")


SURVIVED = """cons AS (SELECT * FROM cand WHERE doc_id % 10 IN (0, 2)),
parts AS (SELECT id AS pid, id AS input FROM cons UNION SELECT target_id, candidate_id FROM decided JOIN cons ON cons.id = target_id WHERE action = 'MERGE'),
live AS (SELECT pid FROM parts JOIN decided ON candidate_id = input GROUP BY pid HAVING NOT bool_and(action = 'REJECT')),
lp AS (SELECT * FROM parts WHERE pid IN (SELECT pid FROM live)),
epu AS (SELECT pid, unnest(c.eps) AS v FROM lp JOIN cand c ON c.id = input UNION SELECT id, unnest(eps) FROM cons WHERE id IN (SELECT pid FROM live)),
chu AS (SELECT pid, unnest(list_append(c.chars, c.prim)) AS v FROM lp JOIN cand c ON c.id = input UNION SELECT pid, 'zed' FROM live),
rfu AS (SELECT DISTINCT pid, unnest(c.refs) AS v FROM lp JOIN cand c ON c.id = input),
m AS (SELECT l.pid AS id, c.scope, (SELECT string_agg(v, ',' ORDER BY v) FROM epu WHERE epu.pid = l.pid) AS episodes, (SELECT count(*) FROM epu WHERE epu.pid = l.pid) AS n_eps,
  (SELECT string_agg(v, ',' ORDER BY v) FROM chu WHERE chu.pid = l.pid) AS characters, (SELECT count(*) FROM rfu WHERE rfu.pid = l.pid) AS n_refs,
  1 + (SELECT count(DISTINCT (k.eps[1], round_even(k.start_ms / 100, 0), round_even(k.end_ms / 100, 0))) FROM lp JOIN cand k ON k.id = lp.input WHERE lp.pid = l.pid) AS n_ranges
  , c.prim, (SELECT string_agg(v, ',' ORDER BY v) FROM chu WHERE chu.pid = l.pid AND v <> c.prim) AS supporting FROM live l JOIN cons c ON c.id = l.pid),
alone AS (SELECT c.id, c.scope, array_to_string(c.eps, ',') AS episodes, len(c.eps) AS n_eps, c.chars[1] AS characters, len(c.refs) AS n_refs, 1 AS n_ranges, c.confidence < 0.35 AS weak, c.prim
  FROM decided JOIN cand c ON c.id = candidate_id WHERE action = 'KEEP' AND candidate_id NOT IN (SELECT id FROM m)),
final AS (SELECT d.candidate_id, CASE WHEN coalesce(a.weak, false) THEN 'REJECT' ELSE action END AS action, CASE WHEN coalesce(a.weak, false) THEN 'weak_evidence' ELSE reason_code END AS reason_code, target_id
  FROM decided d LEFT JOIN alone a ON a.id = d.candidate_id),
survivors AS (SELECT id AS proposal_id, CASE WHEN n_eps > 1 AND scope = 'SINGLE_EPISODE' THEN 'CROSS_EPISODE' WHEN n_eps = 1 AND scope <> 'SINGLE_EPISODE' THEN 'SINGLE_EPISODE' ELSE scope END AS scope, episodes, characters,
    CAST(n_refs AS BIGINT) AS refs, CAST(n_ranges AS BIGINT) AS ranges, prim AS primary_character, supporting AS supporting_characters, 'fact of ' || id AS facts FROM m
  UNION ALL SELECT id, scope, episodes, characters, CAST(n_refs AS BIGINT), n_ranges, prim, '', '' FROM alone WHERE NOT weak)"""


def _reconciled(spark, folder):
    return dc.reconcile(b.candidates(spark, folder), b.decisions(spark, folder), _consolidated(spark, folder))


@query("final_decisions", f"{C}, {CHAINED}, {SURVIVED} SELECT * FROM final")
def final_decisions(spark, folder):
    return _reconciled(spark, folder)[0]


@query("surviving_candidates", f"{C}, {CHAINED}, {SURVIVED} SELECT * FROM survivors")
def surviving_candidates(spark, folder):
    s = _reconciled(spark, folder)[1]
    flat = {c: F.array_join(c, ",") for c in ("episodes", "characters", "supporting_characters", "facts")}
    s = s.drop("hooks")
    sizes = {c: F.size(c).cast("bigint") for c in ("refs", "ranges")}
    return s.withColumns({**flat, **sizes})


@query("decision_counts", f"{C}, {CHAINED}, {SURVIVED} SELECT count(*) FILTER (action = 'KEEP') AS kept, count(*) FILTER (action = 'MERGE') AS merged, count(*) FILTER (action = 'REJECT') AS rejected, (SELECT count(*) FROM survivors) AS eligible FROM final")
def decision_counts(spark, folder):
    return dc.decision_counts(*_reconciled(spark, folder))


@query("quality_issues", f"{C} SELECT id AS proposal_id, CASE WHEN confidence < 0.35 THEN 'weak_evidence' END AS issue FROM cand")
def quality_issues(spark, folder):
    return b.candidates(spark, folder).select("proposal_id", dc.quality_issue().alias("issue"))


@query("merge_chains", f"""{C}, {b.DECISIONS_SQL}, t AS (SELECT candidate_id AS id, target_id FROM dec WHERE action = 'MERGE'),
walk(id, hop, n) AS (SELECT id, target_id, 0 FROM t UNION ALL SELECT w.id, t.target_id, n + 1 FROM walk w JOIN t ON w.hop = t.id)
SELECT id, arg_max(hop, n) AS target FROM walk GROUP BY id""")
def merge_chains(spark, folder):
    merges = b.decisions(spark, folder).where("action = 'MERGE'").select(F.col("candidate_id").alias("id"), F.col("target_id").alias("target"))
    return graph.resolve_chains(merges)


@query("candidate_breadth", f"""{C}, p AS (SELECT source AS project, c.* FROM cand c JOIN documents USING (doc_id)),
e AS (SELECT project, count(DISTINCT v) AS episodes FROM (SELECT project, unnest(eps) AS v FROM p) GROUP BY 1), r AS (SELECT project, count(DISTINCT v) AS refs FROM (SELECT project, unnest(refs) AS v FROM p) GROUP BY 1),
a AS (SELECT project, count(*) AS candidates, bool_or(scope = 'SEASON_ARC' AND prim < 'src15') AS season_arc FROM p GROUP BY 1)
SELECT project, candidates, episodes, refs, episodes / 60 AS episode_ratio, refs / (refs * 0 + 900) AS evidence_ratio, season_arc, NOT season_arc AND (episodes / 60 < 0.4 OR refs / 900 < 0.1) AS suspicious FROM a JOIN e USING (project) JOIN r USING (project)""")
def candidate_breadth(spark, folder):
    c = b.candidates(spark, folder).withColumn("project", F.split("primary_character", "/")[0])
    c = c.withColumn("scope", F.when(F.col("primary_character") < "src15", F.col("scope")).otherwise("CROSS_EPISODE"))
    totals = c.groupBy("project").agg(F.lit(60).alias("total_episodes"), F.lit(900).alias("total_items"))
    return vf.breadth(c, totals)


HEALTH = """led AS (SELECT o_custkey AS project, CASE o_orderstatus WHEN 'O' THEN 'COMPLETE' WHEN 'F' THEN 'COMPLETE_TRANSCRIPT_ONLY' ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'PARTIAL_WITH_GAPS' ELSE 'complete' END END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS open_gaps FROM orders),
lf AS (SELECT project, count(*) AS ledgers, bool_or(status = 'PARTIAL_WITH_GAPS') AS any_incomplete, bool_and(status <> 'PARTIAL_WITH_GAPS' AND open_gaps = 0) AS all_complete FROM led GROUP BY 1),
h AS (SELECT c_custkey AS project, c_custkey % 31 = 0 AS parser_failed, c_custkey % 29 = 0 AS schema_rejected, c_custkey % 23 <> 0 AS discovery_completed, c_custkey % 19 = 0 AS fin_bad, c_custkey % 3 AS consolidated,
  c_custkey % 4 AS discovered, c_custkey % 6 AS decided, c_custkey % 5 AS rejected, c_custkey % 2 AS items, lf.* EXCLUDE (project) FROM customer LEFT JOIN lf ON project = c_custkey),
z AS (SELECT *, CASE WHEN parser_failed THEN 'PARSER_FAILURE' WHEN schema_rejected THEN 'MALFORMED_AI_RESPONSE' WHEN NOT discovery_completed THEN 'CANDIDATE_DISCOVERY_FAILED' WHEN fin_bad THEN 'FINALIZER_FAILED'
   WHEN coalesce(any_incomplete, false) THEN 'COVERAGE_INCOMPLETE' WHEN (discovered > 0 OR rejected > 0) AND consolidated = 0 AND decided > 0 AND rejected >= decided THEN 'CANDIDATES_REJECTED_BY_VALIDATION'
   WHEN items = 0 AND coalesce(ledgers, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' END AS reason FROM h)"""


@query("zero_output_reasons", f"""WITH {HEALTH} SELECT project, reason, NOT parser_failed AND NOT schema_rejected AND discovery_completed AND consolidated = 0 AND NOT (items = 0 AND coalesce(ledgers, 0) = 0) AND coalesce(all_complete, true) AS genuine_zero,
  coalesce(reason, '') IN ('', 'CANDIDATES_REJECTED_BY_VALIDATION') AND consolidated = 0 AS trigger FROM z""")
def zero_output_reasons(spark, folder):
    o = b.table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "COMPLETE").when(F.col("o_orderstatus") == "F", "COMPLETE_TRANSCRIPT_ONLY").when(F.col("o_orderkey") % 7 == 0, "PARTIAL_WITH_GAPS").otherwise("complete")
    flags = vf.ledger_flags(o.select(F.col("o_custkey").alias("project"), status.alias("status"), F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0).alias("open_gaps")))
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    h = b.table(spark, folder, "customer").select(
        k.alias("project"), (k % 31 == 0).alias("parser_failed"), none.alias("parser_error"), (k % 29 == 0).alias("schema_rejected"), none.alias("schema_error"),
        F.lit(True).alias("discovery_schema_valid"), F.lit(True).alias("consolidation_schema_valid"), none.alias("discovery_error"), (k % 23 != 0).alias("discovery_completed"),
        F.lit(True).alias("finalizer_attempted"), F.when(k % 19 == 0, "broken").alias("finalizer_error"), F.lit(True).alias("finalizer_completed"), F.lit(0).alias("finalizer_results"),
        F.lit(True).alias("consolidation_completed"), none.alias("consolidation_error"), (k % 3).alias("consolidated_count"), (k % 4).alias("discovered_count"),
        (k % 6).alias("decision_count"), (k % 5).alias("rejected_count"), (k % 2).alias("total_items"), F.lit(False).alias("suspicious"),
    )
    return vf.zero_output_reason(h.join(flags, "project", "left")).select("project", "reason", "genuine_zero", "trigger")


@query("first_proposals", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS i FROM part) SELECT p_partkey, p_name, p_brand FROM t WHERE i = 1")
def first_proposals(spark, folder):
    p = b.table(spark, folder, "part")
    return gr.keep_first(p, F.lower(F.trim("p_name")), ["p_partkey"], ["p_partkey", "p_name", "p_brand"])


@query("merged_proposals", """WITH s AS (SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand || '/' || p_size END AS pid, 0 AS nw, p_name FROM part WHERE p_partkey % 3 > 0
 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand || '/' || p_size END, 1, p_name FROM part WHERE p_partkey % 3 = 0)
SELECT pid AS proposal_id, arg_max(p_name, {a: nw, b: ordinal}) AS p_name, min({a: nw, b: ordinal}).b AS first_ordinal FROM s WHERE pid <> '' GROUP BY pid
UNION ALL SELECT pid, p_name, ordinal FROM s WHERE pid = ''""")
def merged_proposals(spark, folder):
    pid = F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.concat("p_brand", F.lit("/"), "p_size"))
    rows = b.table(spark, folder, "part").select(F.col("p_partkey").alias("ordinal"), pid.alias("proposal_id"), "p_name")
    out = gr.merge_proposals(rows.where("ordinal % 3 > 0"), rows.where("ordinal % 3 = 0"))
    return out.select("proposal_id", "p_name", F.col("position.ordinal").alias("first_ordinal"))


@query("group_context", """WITH g AS (SELECT DISTINCT o_custkey AS group_id, strftime(o_orderdate, '%Y-%m') AS ep, o_orderpriority AS ch FROM orders),
c AS (SELECT s_suppkey AS context_id, printf('%d-%02d', 1992 + s_suppkey % 8, s_suppkey % 12 + 1) AS ep, CASE WHEN s_suppkey % 50 = 0 THEN '1-URGENT' END AS ch FROM supplier)
SELECT DISTINCT group_id, context_id FROM g JOIN c ON g.ep = c.ep OR g.ch = c.ch""")
def group_context(spark, folder):
    o = b.table(spark, folder, "orders").select(F.col("o_custkey").alias("group_id"), F.array(F.date_format("o_orderdate", "yyyy-MM")).alias("episodes"), F.array("o_orderpriority").alias("characters"))
    k = F.col("s_suppkey")
    context = b.table(spark, folder, "supplier").select(
        k.alias("context_id"), F.array(F.format_string("%d-%02d", k % 8 + 1992, k % 12 + 1)).alias("episodes"), F.when(k % 50 == 0, "1-URGENT").alias("character")
    )
    return gr.relevant_context(o, context)


@query("output_attribution", """WITH p AS (SELECT CASE WHEN p_partkey % 25 = 0 THEN -p_partkey ELSE p_partkey // 5 END AS group_id, p_partkey AS ordinal, 'p' || p_partkey AS pid, p_name AS title FROM part),
o AS (SELECT CASE WHEN l_partkey % 25 = 0 THEN -l_partkey ELSE l_partkey // 5 END AS group_id, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS output_id,
  CASE l_linenumber WHEN 1 THEN 'p' || l_partkey WHEN 2 THEN 'q' || l_partkey ELSE '' END AS cid, CASE WHEN l_linenumber > 5 THEN '' ELSE 'The ' || x.p_name || ' story' END AS title FROM lineitem JOIN part x ON x.p_partkey = l_partkey),
n AS (SELECT group_id, count(*) AS n, min(pid) AS only FROM p GROUP BY 1),
m AS (SELECT o.output_id, arg_min(p.pid, p.ordinal) AS t FROM o JOIN p USING (group_id) WHERE o.title <> '' AND contains(lower(o.title), lower(p.title)) GROUP BY 1),
j AS (SELECT o.group_id, o.output_id, cid, CASE WHEN cid <> '' THEN CASE WHEN cid IN (SELECT pid FROM p) THEN cid END WHEN n.n = 1 THEN n.only ELSE m.t END AS candidate_id FROM o LEFT JOIN n USING (group_id) LEFT JOIN m USING (output_id))
SELECT group_id, output_id, candidate_id, CASE WHEN candidate_id IS NULL THEN CASE WHEN cid <> '' THEN 'UNKNOWN_CANDIDATE' ELSE 'AMBIGUOUS_CANDIDATE' END END AS issue FROM j""")
def output_attribution(spark, folder):
    part = b.table(spark, folder, "part")
    # Every 25th part has a group of its own.
    group = lambda c: F.when(F.col(c) % 25 == 0, -F.col(c)).otherwise(F.floor(F.col(c) / 5)).alias("group_id")
    proposals = part.select(group("p_partkey"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("p"), "p_partkey").alias("proposal_id"), F.col("p_name").alias("title"))
    order = b.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    lines = b.table(spark, folder, "lineitem").withColumn("n", F.row_number().over(order)).join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    named = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("p"), "l_partkey")).when(F.col("l_linenumber") == 2, F.concat(F.lit("q"), "l_partkey")).otherwise("")
    outputs = lines.select(
        group("l_partkey"), (F.col("l_orderkey") * 1000 + F.col("n")).alias("output_id"), named.alias("candidate_id"),
        F.when(F.col("l_linenumber") > 5, "").otherwise(F.concat(F.lit("The "), "p_name", F.lit(" story"))).alias("title"),
    )
    return gr.attribute_outputs(outputs, proposals)


@query("accepted_candidates", "SELECT p_partkey AS candidate_id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS accepted FROM part")
def accepted_candidates(spark, folder):
    attempted = b.table(spark, folder, "part").select(F.col("p_partkey").alias("candidate_id"))
    accepted = b.table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("candidate_id"))
    return dc.accepted_and_rejected(attempted, accepted)


@query("candidate_reader", """SELECT doc_id, 'd' || doc_id AS proposal_id, CASE WHEN doc_id % 2 = 0 THEN 'CROSS_EPISODE' ELSE 'SEASON_ARC' END AS scope, 'r' || doc_id AS refs, doc_id * 1500 AS start_ms, 'turn' AS turning,
  CAST(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence, text AS thesis FROM documents""")
def candidate_reader(spark, folder):
    """Whole documents written as candidate objects under their second names, read back."""
    d = b.table(spark, folder, "documents")
    span = F.struct(F.lit("E01").alias("episode_id"), (F.col("doc_id") * 1.5).alias("start"), F.lit(9e6).alias("end"), F.lit("x").alias("ref"))
    obj = F.struct(
        F.concat(F.lit("d"), "doc_id").alias("proposal_id"), F.when(F.col("doc_id") % 2 == 1, "SEASON_ARC").alias("candidate_scope"), F.concat(F.lit("r"), "doc_id").alias("supporting_evidence_refs"),
        F.array(span).alias("source_ranges"), F.lit("turn").alias("turning_point"), F.when(F.col("doc_id") % 3 > 0, 0.5).alias("confidence"), F.col("text").alias("central_thesis"),
    )
    rows = candidates_source.candidate_rows(d.select("doc_id", F.try_parse_json(F.to_json(obj)).alias("item")))
    return rows.select("doc_id", "proposal_id", "scope", F.array_join("refs", ",").alias("refs"), F.get("ranges", F.lit(0))["start_ms"].alias("start_ms"), "turning", "confidence", "thesis")


@query("nested_merge_lists", "SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'links' ELSE 'proposals' END AS list, role AS title FROM conversations")
def nested_merge_lists(spark, folder):
    """Turns nested as batch results, each under a list name of its own, flattened again."""
    c = b.table(spark, folder, "conversations")
    node = F.concat(F.lit('{"'), F.when(F.col("turn") % 4 == 0, "links").when(F.col("turn") % 4 == 1, "proposals").when(F.col("turn") % 4 == 2, "narrative_links").otherwise("candidate_proposals"), F.lit('":[{"title":"'), "role", F.lit('"},4]}'))
    docs = c.withColumn("_n", node).groupBy("conv_id").agg(F.concat(F.lit('{"batch_results":[{"batch_results":['), F.expr("listagg(_n, ',') WITHIN GROUP (ORDER BY turn)"), F.lit("]},7]}")).alias("content"))
    rows = candidates_source.merge_lists(docs, ["conv_id"])
    return rows.select("conv_id", "list", F.try_variant_get("item", "$.title", "string").alias("title"))


@query("distinct_proposals", """WITH RECURSIVE t AS (SELECT p_partkey, 'i' || (p_partkey * 7919 % 700) AS pid, p_name || p_size AS title FROM part),
w(n, ids, titles, kept) AS (SELECT CAST(-1 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT)
 UNION ALL SELECT t.p_partkey, CASE WHEN list_contains(ids, pid) OR list_contains(titles, title) THEN ids ELSE list_append(ids, pid) END, CASE WHEN list_contains(ids, pid) OR list_contains(titles, title) THEN titles ELSE list_append(titles, title) END,
  CASE WHEN list_contains(ids, pid) OR list_contains(titles, title) THEN NULL ELSE t.p_partkey END FROM w JOIN t ON t.p_partkey = w.n + 1)
SELECT kept AS p_partkey FROM w WHERE kept IS NOT NULL""")
def distinct_proposals(spark, folder):
    rows = b.table(spark, folder, "part").select("p_partkey", F.concat(F.lit("i"), F.col("p_partkey") * 7919 % 700).alias("pid"), F.concat("p_name", "p_size").alias("title"))
    return gr.keep_first_of_both(rows, "pid", "title", "p_partkey").select("p_partkey")
