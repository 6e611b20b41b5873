"""Interval and coverage queries over the season of day-long episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuefold.operators import coverage as cov
from cuefold.operators import intervals as iv
from cuefold.operators.overlap import overlap_join
from cuefold.plans import bindings as b
from cuefold.plans.registry import query

T = b.TIMELINE_SQL
CUE_ISLANDS = b.islands_sql("cues", "ci")
EV_ISLANDS = b.islands_sql("evidence", "ei")
VIS_ISLANDS = b.islands_sql("visual", "vi")
SEEN = "seen AS (SELECT episode_id, start_ms, end_ms FROM cues UNION ALL SELECT episode_id, start_ms, end_ms FROM visual)"
OBSERVED = f"{SEEN},\n{b.islands_sql('seen', 'oi')},\n{b.gaps_sql('oi', 'unobs')}"
CHUNKS = """chunks AS (SELECT episode_id, CAST(i AS INTEGER) AS chunk_index, i * 600000 AS start_ms,
                   least((i + 1) * 600000, duration_ms) AS end_ms
            FROM episodes, range(0, 144) r(i))"""


@query("interval_merge", f"{T},\n{CUE_ISLANDS} SELECT episode_id, start_ms, end_ms, CAST(n AS BIGINT) AS n FROM ci")
def interval_merge(spark, folder):
    return iv.merge_intervals(b.cues(spark, folder), cov.EP, count_as="n")


@query("unobserved_ranges", f"{T},\n{OBSERVED} SELECT * FROM unobs")
def unobserved_ranges(spark, folder):
    return cov.unobserved(b.cues(spark, folder), b.visual(spark, folder), b.episodes(spark, folder))


@query("silence_gaps", f"{T},\n{OBSERVED} SELECT * FROM unobs WHERE end_ms - start_ms >= 30000")
def silence_gaps(spark, folder):
    return cov.silence_gaps(b.cues(spark, folder), b.visual(spark, folder), b.episodes(spark, folder))


@query(
    "interval_subtract",
    f"""{T},\n{EV_ISLANDS},
cut AS (SELECT c.episode_id, c.ordinal, c.start_ms AS s, c.end_ms AS e, i.start_ms, i.end_ms
        FROM cues c JOIN ei i ON c.episode_id = i.episode_id AND i.end_ms > i.start_ms
         AND greatest(c.start_ms, i.start_ms) < least(c.end_ms, i.end_ms)),
allr AS (SELECT episode_id, ordinal, s, e, start_ms, end_ms, 1 AS o FROM cut
         UNION ALL SELECT episode_id, ordinal, start_ms, end_ms, start_ms, start_ms, 0 FROM cues),
pieces AS (SELECT episode_id, ordinal, greatest(end_ms, s) AS lo,
                  least(coalesce(lead(start_ms) OVER (PARTITION BY ordinal ORDER BY o, start_ms), e), e) AS hi FROM allr)
SELECT episode_id, ordinal, lo AS start_ms, hi AS end_ms FROM pieces WHERE hi - lo > 100""",
)
def interval_subtract(spark, folder):
    return iv.subtract_intervals(b.cues(spark, folder), b.evidence(spark, folder), cov.EP, "ordinal")


@query(
    "timeline_coverage",
    f"""{T},\n{CUE_ISLANDS},\n{VIS_ISLANDS},\n{EV_ISLANDS},
lane AS (SELECT 't' AS k, * FROM ci UNION ALL SELECT 'v', * FROM vi UNION ALL SELECT 'e', * FROM ei),
agg AS (SELECT e.episode_id, e.duration_ms,
  CAST(coalesce(sum(end_ms - start_ms) FILTER (k = 't'), 0) AS BIGINT) AS transcript_ms,
  CAST(coalesce(sum(end_ms - start_ms) FILTER (k = 'v'), 0) AS BIGINT) AS visual_ms,
  CAST(coalesce(sum(end_ms - start_ms) FILTER (k = 'e'), 0) AS BIGINT) AS evidence_ms,
  count(*) FILTER (k = 't') AS transcript_islands, count(*) FILTER (k = 'v') AS visual_islands,
  count(*) FILTER (k = 'e') AS evidence_islands
  FROM episodes e LEFT JOIN lane l USING (episode_id) GROUP BY ALL)
SELECT *, least(1.0::DOUBLE, transcript_ms / duration_ms) AS transcript_ratio,
       least(1.0::DOUBLE, visual_ms / duration_ms) AS visual_ratio,
       least(1.0::DOUBLE, evidence_ms / duration_ms) AS evidence_ratio FROM agg""",
)
def timeline_coverage(spark, folder):
    return cov.timeline_coverage(b.cues(spark, folder), b.visual(spark, folder), b.evidence(spark, folder), b.episodes(spark, folder))


DROPPED = """dropped AS (SELECT * FROM ci WHERE end_ms - start_ms >= 30000 AND n >= 3 AND NOT EXISTS (
  SELECT 1 FROM ei WHERE ei.episode_id = ci.episode_id AND greatest(ei.start_ms, ci.start_ms) < least(ei.end_ms, ci.end_ms)))"""


@query("dropped_speech", f"{T},\n{CUE_ISLANDS},\n{EV_ISLANDS},\n{DROPPED} SELECT episode_id, start_ms, end_ms, CAST(n AS BIGINT) AS n_cues FROM dropped")
def dropped_speech(spark, folder):
    return cov.dropped_speech(b.cues(spark, folder), b.evidence(spark, folder))


@query("fixed_chunks", f"{T},\n{CHUNKS} SELECT * FROM chunks")
def fixed_chunks(spark, folder):
    return cov.fixed_chunks(b.episodes(spark, folder))


@query(
    "chunk_cues",
    f"""{T},\n{CHUNKS} SELECT h.episode_id, chunk_index, ordinal, c.start_ms, c.end_ms FROM chunks h JOIN cues c
ON h.episode_id = c.episode_id AND c.start_ms <= h.end_ms AND c.end_ms >= h.start_ms""",
)
def chunk_cues(spark, folder):
    met = cov.chunk_cues(cov.fixed_chunks(b.episodes(spark, folder)), b.cues(spark, folder))
    return met.select("episode_id", "chunk_index", F.col("r_ordinal").alias("ordinal"), F.col("r_start_ms").alias("start_ms"), F.col("r_end_ms").alias("end_ms"))


CHUNK_COV = """cc AS (SELECT h.episode_id, chunk_index, count(*) AS n FROM chunks h JOIN cues c
  ON h.episode_id = c.episode_id AND c.start_ms <= h.end_ms AND c.end_ms >= h.start_ms GROUP BY ALL),
ce AS (SELECT h.episode_id, chunk_index, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS cats,
              string_agg(DISTINCT characters[1], ',' ORDER BY characters[1]) AS people FROM chunks h JOIN evidence c
  ON h.episode_id = c.episode_id AND c.start_ms <= h.end_ms AND c.end_ms >= h.start_ms GROUP BY ALL),
chunk_cov AS (SELECT h.*, coalesce(cc.n, 0) AS cues_count, coalesce(ce.n, 0) AS items_count,
  coalesce(cats, '') AS categories, coalesce(people, '') AS characters,
  CASE WHEN coalesce(cc.n, 0) = 0 THEN 'EMPTY_TRANSCRIPT' WHEN cc.n >= 15 AND coalesce(ce.n, 0) <= 1 THEN 'SPARSE_EVIDENCE' ELSE 'OK' END AS status
  FROM chunks h LEFT JOIN cc USING (episode_id, chunk_index) LEFT JOIN ce USING (episode_id, chunk_index))"""


@query("chunk_coverage", f"{T},\n{CHUNKS},\n{CHUNK_COV} SELECT * FROM chunk_cov")
def chunk_coverage(spark, folder):
    out = cov.chunk_coverage(cov.fixed_chunks(b.episodes(spark, folder)), b.cues(spark, folder), b.evidence(spark, folder))
    return out.withColumns({c: F.array_join(c, ",") for c in ("categories", "characters")})


SPEAKERS = """speakers AS (SELECT episode_id, split_part(text, ':', 1) AS name, count(*) AS lines, min(start_ms) AS first_ms,
  max(end_ms) AS last_ms, min(ordinal) AS first_ordinal FROM cues GROUP BY ALL),
people AS (SELECT episode_id, characters[1] AS name, count(*) AS items, min(start_ms) AS e_first, max(end_ms) AS e_last,
  string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
  bool_or(category IN ('supporting_developments', 'relationships', 'character_decisions')) AS has_depth,
  bool_or(category IN ('character_decisions', 'failures', 'consequences')) AS has_action FROM evidence GROUP BY ALL),
char_def AS (SELECT s.* FROM speakers s LEFT JOIN people p USING (episode_id, name)
  WHERE lines >= 4 AND coalesce(items, 0) <= 1 AND NOT coalesce(has_depth, false))"""


@query("character_deficit", f"{T},\n{SPEAKERS} SELECT * FROM char_def")
def character_deficit(spark, folder):
    return cov.character_deficit(b.cues(spark, folder), b.evidence(spark, folder))


CAT_DEF = """cat_def AS (SELECT e.episode_id, e.duration_ms, c.position, c.category FROM episodes e,
  (VALUES (0, 'major_scenes'), (1, 'character_decisions'), (2, 'conflicts'), (3, 'reveals'), (4, 'setup_payoff')) c(position, category)
  WHERE (SELECT count(*) FROM cues q WHERE q.episode_id = e.episode_id) >= 20 AND e.duration_ms >= 300000
    AND NOT EXISTS (SELECT 1 FROM evidence v WHERE v.episode_id = e.episode_id AND v.category = c.category))"""


@query("category_deficit", f"{T},\n{CAT_DEF} SELECT * FROM cat_def")
def category_deficit(spark, folder):
    return cov.category_deficit(b.cues(spark, folder), b.evidence(spark, folder), b.episodes(spark, folder))


DETECTED = f"""{OBSERVED},\n{CUE_ISLANDS},\n{EV_ISLANDS},\n{DROPPED},\n{CHUNKS},\n{CHUNK_COV},\n{SPEAKERS},\n{CAT_DEF},
raw_gaps AS (
  SELECT episode_id, 'silence' AS kind, 1 AS rk, 'UNOBSERVED_SILENCE' AS gap_type, start_ms AS pos, start_ms, end_ms,
         '' AS cats, '' AS chars, false AS act, 'RESOLVED' AS status FROM unobs WHERE end_ms - start_ms >= 30000
  UNION ALL SELECT episode_id, 'dropped', 2, 'DROPPED_TRANSCRIPT', start_ms, start_ms, end_ms, 'major_scenes,dialogue', '', true, 'PENDING' FROM dropped
  UNION ALL SELECT episode_id, 'sparse', 3, 'CHUNK_SPARSITY', chunk_index, start_ms, end_ms, 'major_scenes,dialogue,character_decisions', '', true, 'PENDING'
            FROM chunk_cov WHERE status = 'SPARSE_EVIDENCE'
  UNION ALL SELECT episode_id, 'char', 4, 'CHARACTER_DEFICIT', first_ordinal, first_ms, last_ms, 'supporting_developments,relationships,character_decisions', name, true, 'PENDING' FROM char_def
  UNION ALL SELECT episode_id, 'cat', 5, 'CATEGORY_DEFICIT', position, 0, duration_ms, category, '', true, 'PENDING' FROM cat_def),
gaps AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY rk, pos) AS n FROM raw_gaps)"""


@query(
    "coverage_gaps",
    f"""{T},\n{DETECTED} SELECT episode_id, printf('gap_%s_%02d', kind, n) AS gap_id, gap_type, CAST(n AS INTEGER) AS ordinal, start_ms, end_ms,
  cats AS target_categories, chars AS target_characters, act AS is_actionable, status FROM gaps""",
)
def coverage_gaps(spark, folder):
    eps = b.episodes(spark, folder)
    gaps = cov.detect_gaps(b.cues(spark, folder), b.visual(spark, folder), b.evidence(spark, folder), eps, cov.fixed_chunks(eps))
    return gaps.withColumns({c: F.array_join(c, ",") for c in ("target_categories", "target_characters")})


# Two projects that both have every day; an episode is a day of a project.
OF_PROJECT = T.replace("strftime(ts, '%Y-%m-%d') AS episode_id", "'p' || user_id % 2 || '/' || strftime(ts, '%Y-%m-%d') AS episode_id")
_APART = "split_part(episode_id, '/', 1) AS project, split_part(episode_id, '/', 2) AS episode_id"


def _of_projects(spark, folder):
    return [table(spark, folder, ("project",)) for table in (b.cues, b.visual, b.evidence, b.episodes)]


@query(
    "project_gaps",
    f"""{OF_PROJECT},\n{DETECTED} SELECT {_APART}, printf('gap_%s_%02d', kind, n) AS gap_id, gap_type, CAST(n AS INTEGER) AS ordinal, start_ms, end_ms,
  cats AS target_categories, chars AS target_characters, act AS is_actionable, status FROM gaps""",
)
def project_gaps(spark, folder):
    cues, visual, evidence, eps = _of_projects(spark, folder)
    gaps = cov.detect_gaps(cues, visual, evidence, eps, cov.fixed_chunks(eps))
    return gaps.withColumns({c: F.array_join(c, ",") for c in ("target_categories", "target_characters")})


@query(
    "project_status",
    f"""{OF_PROJECT},\n{DETECTED},\n{VIS_ISLANDS},
vr AS (SELECT episode_id, sum(end_ms - start_ms) / 86400000 AS ratio FROM vi GROUP BY ALL),
og AS (SELECT episode_id, count(*) AS n FROM gaps WHERE act AND status = 'PENDING' GROUP BY ALL)
SELECT {_APART.replace('episode_id,', 'e.episode_id,')}, coalesce(og.n, 0) AS open_gaps,
  CASE WHEN NOT EXISTS (SELECT 1 FROM seen s WHERE s.episode_id = e.episode_id) THEN 'EMPTY_NO_DATA'
       WHEN og.n > 0 THEN 'PARTIAL_WITH_GAPS' WHEN vr.ratio >= 0.85 THEN 'COMPLETE' ELSE 'COMPLETE_TRANSCRIPT_ONLY' END AS status
FROM episodes e LEFT JOIN og USING (episode_id) LEFT JOIN vr USING (episode_id)""",
)
def project_status(spark, folder):
    cues, visual, evidence, eps = _of_projects(spark, folder)
    return cov.episode_status(cov.timeline_coverage(cues, visual, evidence, eps), cov.detect_gaps(cues, visual, evidence, eps, cov.fixed_chunks(eps)))


@query(
    "category_coverage",
    f"""{T},\n{DETECTED},
cats AS (SELECT unnest([{', '.join(f"'{c}'" for c in b.CATEGORIES)}]) AS category),
seen_cat AS (SELECT episode_id, category, count(*) AS items, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM evidence GROUP BY ALL),
verdict AS (SELECT episode_id, unnest(string_split(g.cats, ',')) AS category, status FROM gaps g),
verdict2 AS (SELECT episode_id, category, bool_and(status = 'PERSISTENT_EMPTY') AS ok FROM verdict GROUP BY ALL)
SELECT e.episode_id, c.category, coalesce(items, 0) AS items,
  coalesce(items, 0) / greatest(0.1::DOUBLE, e.duration_ms / 60000.0::DOUBLE) AS density_per_minute, first_ms, last_ms, coalesce(items, 0) = 0 AS is_empty,
  CASE WHEN coalesce(items, 0) > 0 THEN 'PRESENT' WHEN NOT EXISTS (SELECT 1 FROM seen s WHERE s.episode_id = e.episode_id) THEN 'VERIFIED_EMPTY'
       WHEN coalesce(ok, false) THEN 'VERIFIED_EMPTY' ELSE 'SUSPECT_EMPTY' END AS verification_status
FROM episodes e CROSS JOIN cats c LEFT JOIN seen_cat USING (episode_id, category) LEFT JOIN verdict2 USING (episode_id, category)""",
)
def category_coverage(spark, folder):
    eps, cues, vis, ev = b.episodes(spark, folder), b.cues(spark, folder), b.visual(spark, folder), b.evidence(spark, folder)
    gaps = cov.detect_gaps(cues, vis, ev, eps, cov.fixed_chunks(eps))
    return cov.category_coverage(ev, cues, vis, eps, gaps, b.CATEGORIES)


@query(
    "character_coverage",
    f"""{T},\n{SPEAKERS},
names AS (SELECT episode_id, name FROM speakers UNION SELECT episode_id, name FROM people),
ment AS (SELECT n.episode_id, n.name, min(c.start_ms) AS mf, max(c.end_ms) AS ml FROM names n JOIN cues c
         ON n.episode_id = c.episode_id AND contains(lower(c.text), lower(n.name)) GROUP BY ALL),
j AS (SELECT n.episode_id, n.name, coalesce(lines, 0) AS lines, coalesce(items, 0) AS items, least(mf, e_first) AS f, greatest(ml, e_last) AS l,
       coalesce(categories, '') AS categories, coalesce(has_action, false) AS has_action
  FROM names n LEFT JOIN speakers USING (episode_id, name) LEFT JOIN people USING (episode_id, name) LEFT JOIN ment USING (episode_id, name))
SELECT episode_id, name, lines, items, CASE WHEN f <= l THEN f ELSE 0 END AS first_ms, CASE WHEN f <= l THEN l ELSE 0 END AS last_ms,
  categories, lines < 10 AS is_supporting, has_action FROM j""",
)
def character_coverage(spark, folder):
    return cov.character_coverage(b.cues(spark, folder), b.evidence(spark, folder)).withColumn("categories", F.array_join("categories", ","))


@query(
    "episode_status",
    f"""{T},\n{DETECTED},\n{VIS_ISLANDS},
vr AS (SELECT episode_id, sum(end_ms - start_ms) / 86400000 AS ratio FROM vi GROUP BY ALL),
og AS (SELECT episode_id, count(*) AS n FROM gaps WHERE act AND status = 'PENDING' GROUP BY ALL)
SELECT e.episode_id, coalesce(og.n, 0) AS open_gaps,
  CASE WHEN NOT EXISTS (SELECT 1 FROM seen s WHERE s.episode_id = e.episode_id) THEN 'EMPTY_NO_DATA'
       WHEN og.n > 0 THEN 'PARTIAL_WITH_GAPS' WHEN vr.ratio >= 0.85 THEN 'COMPLETE' ELSE 'COMPLETE_TRANSCRIPT_ONLY' END AS status
FROM episodes e LEFT JOIN og USING (episode_id) LEFT JOIN vr USING (episode_id)""",
)
def episode_status(spark, folder):
    eps, cues, vis, ev = b.episodes(spark, folder), b.cues(spark, folder), b.visual(spark, folder), b.evidence(spark, folder)
    return cov.episode_status(cov.timeline_coverage(cues, vis, ev, eps), cov.detect_gaps(cues, vis, ev, eps, cov.fixed_chunks(eps)))


@query(
    "gap_groups",
    f"""{T},\n{DETECTED},
act AS (SELECT * FROM gaps WHERE act AND status = 'PENDING'),
gr AS (SELECT *, max(end_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM act),
gg AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + 15000 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, n ROWS UNBOUNDED PRECEDING) AS g FROM gr)
SELECT episode_id, min(start_ms) OVER (PARTITION BY episode_id, g) AS group_start_ms, max(end_ms) OVER (PARTITION BY episode_id, g) AS group_end_ms,
       printf('gap_%s_%02d', kind, n) AS gap_id FROM gg""",
)
def gap_groups(spark, folder):
    eps = b.episodes(spark, folder)
    gaps = cov.detect_gaps(b.cues(spark, folder), b.visual(spark, folder), b.evidence(spark, folder), eps, cov.fixed_chunks(eps))
    pending = gaps.where("is_actionable and status = 'PENDING'").select("episode_id", "gap_id", "start_ms", "end_ms")
    return iv.chain_groups(pending, cov.EP, 15_000).select("episode_id", "group_start_ms", "group_end_ms", "gap_id")


@query(
    "gap_context",
    f"""{T},\n{DETECTED},
act AS (SELECT * FROM gaps WHERE act AND status = 'PENDING')
SELECT a.episode_id, printf('gap_%s_%02d', kind, n) AS gap_id, v.category, v.idx,
       trim(substring(v.summary, 1, 80)) AS anchor
FROM act a JOIN evidence v ON a.episode_id = v.episode_id
 AND v.start_ms <= least(a.end_ms + 10000, 86400000) AND v.end_ms >= greatest(a.start_ms - 10000, 0)""",
)
def gap_context(spark, folder):
    eps, ev = b.episodes(spark, folder), b.evidence(spark, folder)
    gaps = cov.detect_gaps(b.cues(spark, folder), b.visual(spark, folder), ev, eps, cov.fixed_chunks(eps))
    from cuefold.operators.gaps import gap_anchors

    return gap_anchors(gaps.where("is_actionable and status = 'PENDING'"), ev, eps).select("episode_id", "gap_id", "category", "idx", "anchor")
