"""The driver's tables seen as episodes, cues, evidence, clips, tracks and candidates.

`events` is a season of day-long episodes: an event spans from its time of day for
``value`` seconds. Views and clicks are spoken cues ("u17: click ..."), sign-ups are visual
spans, purchases and errors are evidence items. Each binding has a SQL twin for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# The 25 evidence categories.
CATEGORIES = (
    "major_scenes", "dialogue", "character_decisions", "conflicts", "reveals", "reversals",
    "setup_payoff", "character_relationships", "relationships", "supporting_developments",
    "continuity_anchors", "recurring_elements", "failures", "consequences",
    "performance_moments", "unresolved", "subplots", "strengths_weaknesses", "contradictions",
    "dilemmas", "visual_storytelling", "recurring_behavior", "power_shifts", "reactions",
    "counter_evidence",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    start = F.expr("cast((hour(ts) * 60 + minute(ts)) * 60000 + floor(extract(SECOND FROM ts) * 1000) as bigint)")
    length = F.round(F.col("value") * 1000).cast("bigint")
    return table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.col("user_id") % 2).alias("project"), F.date_format("ts", "yyyy-MM-dd").alias("episode_id"),
        "event_id", "user_id", "event_type", "props",
        start.alias("start_ms"),
        F.least(start + length, F.lit(DAY_MS).cast("bigint")).alias("end_ms"),
    )


def episodes(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per day: episode_id, duration_ms. Counted from the table, with map-side combine; `by` project, per project and day."""
    days = _spans(spark, folder).groupBy(*by, "episode_id").agg(F.count(F.lit(1)).alias("_n"))
    return days.select(*by, "episode_id", F.lit(DAY_MS).cast("bigint").alias("duration_ms"))


def cues(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    text = F.concat(F.lit("u"), F.col("user_id"), F.lit(": "), F.col("event_type"), F.lit(" "), F.col("props"))
    return (
        _spans(spark, folder)
        .where(F.col("event_type").isin("view", "click"))
        .select(*by, "episode_id", F.col("event_id").alias("ordinal"), "start_ms", "end_ms", text.alias("text"))
    )


def visual(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    return _spans(spark, folder).where(F.col("event_type") == "signup").select(*by, "episode_id", "start_ms", "end_ms")


def category_of(user: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CATEGORIES)), (user % len(CATEGORIES) + 1).cast("int"))


def evidence(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Purchases fall in the category of their buyer, errors are failures."""
    category = F.when(F.col("event_type") == "error", F.lit("failures")).otherwise(category_of(F.col("user_id")))
    return (
        _spans(spark, folder)
        .where(F.col("event_type").isin("purchase", "error"))
        .select(
            *by, "episode_id", category.alias("category"), F.col("event_id").alias("idx"), "start_ms", "end_ms",
            F.array(F.concat(F.lit("u"), F.col("user_id"))).alias("characters"),
            F.concat(F.col("event_type"), F.lit(" by u"), F.col("user_id"), F.lit(" "), F.col("props")).alias("summary"),
        )
    )


_CATEGORY_LIST = ", ".join(f"'{c}'" for c in CATEGORIES)

SPANS_SQL = """spans AS (
  SELECT strftime(ts, '%Y-%m-%d') AS episode_id, event_id, user_id, event_type, props,
         (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000 AS start_ms,
         least((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000
               + CAST(round(value * 1000) AS BIGINT), 86400000) AS end_ms
  FROM events)"""
TIMELINE_SQL = f"""WITH RECURSIVE {SPANS_SQL},
episodes AS (SELECT DISTINCT episode_id, CAST(86400000 AS BIGINT) AS duration_ms FROM spans),
cues AS (SELECT episode_id, event_id AS ordinal, start_ms, end_ms,
                'u' || user_id || ': ' || event_type || ' ' || props AS text
         FROM spans WHERE event_type IN ('view', 'click')),
visual AS (SELECT episode_id, start_ms, end_ms FROM spans WHERE event_type = 'signup'),
evidence AS (SELECT episode_id,
                CASE WHEN event_type = 'error' THEN 'failures'
                     ELSE [{_CATEGORY_LIST}][user_id % {len(CATEGORIES)} + 1] END AS category,
                event_id AS idx, start_ms, end_ms, ['u' || user_id] AS characters,
                event_type || ' by u' || user_id || ' ' || props AS summary
             FROM spans WHERE event_type IN ('purchase', 'error'))"""


def islands_sql(source: str, name: str, tolerance: int = 50) -> str:
    """Oracle text: gaps-and-islands of `source` as CTEs ending in `name`."""
    return f"""{name}_r AS (
  SELECT *, max(end_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name}_f AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + {tolerance} THEN 1 ELSE 0 END)
            OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms
                  ROWS UNBOUNDED PRECEDING) AS island FROM {name}_r),
{name} AS (SELECT episode_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n
           FROM {name}_f GROUP BY episode_id, island)"""


def gaps_sql(islands: str, name: str, drop: int = 100) -> str:
    """Oracle text: what is left of [0, day] once the islands are cut out."""
    return f"""{name} AS (
  SELECT episode_id, lo AS start_ms, hi AS end_ms FROM (
    SELECT episode_id, end_ms AS lo,
           least(coalesce(lead(start_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms), {DAY_MS}), {DAY_MS}) AS hi
    FROM (SELECT episode_id, start_ms, end_ms FROM {islands} WHERE end_ms > start_ms
          UNION ALL SELECT episode_id, -1, 0 FROM episodes))
  WHERE hi - lo > {drop})"""


def talk(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as episodes: a turn is a cue of its speaker, every four seconds."""
    start = F.col("turn") * 4000
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("episode_id"), F.col("turn").alias("ordinal"),
        start.alias("start_ms"), (start + 1000 + F.least(F.length("text"), F.lit(2500)).cast("bigint") ).alias("end_ms"),
        F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("text"),
    )


TALK_SQL = """WITH RECURSIVE talk AS (SELECT 'c' || conv_id AS episode_id, turn AS ordinal, turn * 4000 AS start_ms,
  turn * 4000 + 1000 + least(length(text), 2500) AS end_ms, role || ': ' || text AS text FROM conversations),
tidy AS (SELECT * EXCLUDE (text), array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM talk)"""


def clips(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as clips of an output (the order), numbered in line order."""
    line = table(spark, folder, "lineitem")
    start = (F.col("l_suppkey") * 7919 + F.col("l_partkey") * 104729) % 86_300_000
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
    )
    return line.select(
        F.col("l_orderkey").alias("output_id"), (F.row_number().over(order) - 1).cast("bigint").alias("ordinal"),
        F.format_string("2024-01-%02d", F.col("l_partkey") % 30 + 1).alias("episode_id"),
        start.alias("start_ms"), (start + F.col("l_quantity").cast("bigint") * 1000).alias("end_ms"),
    )


CLIPS_SQL = """clips AS (SELECT l_orderkey AS output_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS ordinal,
  printf('2024-01-%02d', l_partkey % 30 + 1) AS episode_id,
  (l_suppkey * 7919 + l_partkey * 104729) % 86300000 AS start_ms,
  (l_suppkey * 7919 + l_partkey * 104729) % 86300000 + CAST(l_quantity AS BIGINT) * 1000 AS end_ms FROM lineitem)"""


def shelf(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as a media shelf: a video and a sidecar per part, a hundred parts to a folder."""
    p = table(spark, folder, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    root = F.format_string("/lib/%04d/", F.floor(key / 100))
    show = F.concat(F.lit("Show"), key % 7)
    video = (
        F.when(key % 5 == 0, F.concat(F.lit("film_"), F.char(F.lit(97) + key % 7), F.lit(".mkv")))
        .when(key % 2 == 0, F.format_string("%s.S%02dE%02d.%s.mkv", show, size % 3 + 1, key % 40 + 1, F.lower("p_type")))
        .otherwise(F.format_string("%s.%dx%02d.mp4", show, size % 3 + 1, key % 40 + 1))
    )
    side_show = F.concat(F.lit("show"), size % 7)
    words = F.element_at(F.array(*[F.lit(w) for w in ("", ".en", ".fr", ".en.forced", "_ger")]), (size % 5 + 1).cast("int"))
    ending = F.element_at(F.array(*[F.lit(w) for w in (".srt", ".ass", ".vtt", ".idx", ".sub", ".txt")]), (key % 6 + 1).cast("int"))
    side = (
        F.when(key % 5 == 0, F.concat(F.lit("Film_"), F.char(F.lit(97) + size % 7)))
        .otherwise(F.format_string("%s.S%02dE%02d", side_show, key % 3 + 1, size % 40 + 1))
    )
    return p.select(
        key.alias("key"), size.alias("size"), F.floor(key / 100).alias("dir"), F.concat(root, video).alias("video"),
        F.concat(root, side, words, ending).alias("sidecar"), "p_brand", "p_type", "p_name", "p_retailprice",
    )


SHELF_SQL = """WITH RECURSIVE shelf AS (SELECT p_partkey AS key, p_size AS size, p_partkey // 100 AS dir,
  printf('/lib/%04d/', p_partkey // 100) || CASE
    WHEN p_partkey % 5 = 0 THEN 'film_' || chr(CAST(97 + p_partkey % 7 AS INTEGER)) || '.mkv'
    WHEN p_partkey % 2 = 0 THEN printf('Show%d.S%02dE%02d.%s.mkv', p_partkey % 7, p_size % 3 + 1, p_partkey % 40 + 1, lower(p_type))
    ELSE printf('Show%d.%dx%02d.mp4', p_partkey % 7, p_size % 3 + 1, p_partkey % 40 + 1) END AS video,
  printf('/lib/%04d/', p_partkey // 100) || CASE WHEN p_partkey % 5 = 0 THEN 'Film_' || chr(CAST(97 + p_size % 7 AS INTEGER))
    ELSE printf('show%d.S%02dE%02d', p_size % 7, p_partkey % 3 + 1, p_size % 40 + 1) END
    || ['', '.en', '.fr', '.en.forced', '_ger'][p_size % 5 + 1]
    || ['.srt', '.ass', '.vtt', '.idx', '.sub', '.txt'][p_partkey % 6 + 1] AS sidecar,
  ['.srt', '.ass', '.vtt', '.idx', '.sub', '.txt'][p_partkey % 6 + 1] AS ending,
  p_brand, p_type, p_name, p_retailprice FROM part)"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as story candidates: the whole text is the thesis, every line is a reference."""
    d = table(spark, folder, "documents")
    size = F.col("n_chars")
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    refs = F.transform(lines, F.md5)
    start = (F.col("doc_id") * 7919) % 86_000_000
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    source, lang = F.col("source"), F.col("lang")
    day = F.format_string("2024-01-%02d", F.col("doc_id") % 35 + 1)
    spans = F.array(F.struct(
        day.alias("episode_id"), start.alias("start_ms"), (start + size * 500).alias("end_ms"), F.lit(None).cast("string").alias("ref")
    ))
    return d.select(
        F.lit("season").alias("project"), F.format_string("d%07d", F.col("doc_id")).alias("proposal_id"),
        text("About ", source).alias("title"), F.col("text").alias("thesis"), F.lit("").alias("subject"),
        F.when(F.col("doc_id") % 3 == 0, "SEASON_ARC").when(F.col("doc_id") % 3 == 1, "CROSS_EPISODE").otherwise("SINGLE_EPISODE").alias("scope"),
        F.array(day, F.format_string("2024-01-%02d", F.col("doc_id") % 13 + 1)).alias("episodes"),
        F.array(text(source, "/", lang, "/", F.floor(size / 300))).alias("characters"),
        text(source, "/", lang, "/", F.floor(size / 1000)).alias("primary_character"),
        F.array(text("len", F.floor(size / 20)), text(lang, F.floor(size / 500))).alias("tags"),
        F.array_distinct(refs).alias("refs"), spans.alias("ranges"),
        ((F.col("doc_id") % 10) / 10).alias("confidence"), F.lit("new").alias("status"),
    )


CANDIDATES_SQL = """cand AS (SELECT doc_id, printf('d%07d', doc_id) AS id, 'About ' || source AS title, text AS thesis,
  list_distinct(regexp_extract_all(lower('About ' || source || ' ' || text || ' '), '[\\p{L}\\p{N}_]+')) AS words,
  ['len' || n_chars // 20, lang || n_chars // 500] AS tags,
  list_distinct(list_transform(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> ''), lambda s: md5(s))) AS refs,
  [source || '/' || lang || '/' || n_chars // 300] AS chars, source || '/' || lang || '/' || n_chars // 1000 AS prim,
  [printf('2024-01-%02d', doc_id % 35 + 1), printf('2024-01-%02d', doc_id % 13 + 1)] AS eps,
  CASE doc_id % 3 WHEN 0 THEN 'SEASON_ARC' WHEN 1 THEN 'CROSS_EPISODE' ELSE 'SINGLE_EPISODE' END AS scope,
  (doc_id % 10) / 10 AS confidence, doc_id * 7919 % 86000000 AS start_ms, doc_id * 7919 % 86000000 + n_chars * 500 AS end_ms FROM documents)"""


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Answers about candidates: merges into the document before, bare rejections, repeats, gaps."""
    d = table(spark, folder, "documents").select("doc_id")
    digit = F.col("doc_id") % 10
    name = lambda i: F.format_string("d%07d", i)
    first = d.where(digit != 0).select(
        name(F.col("doc_id")).alias("candidate_id"), F.lit(0).alias("ordinal"),
        F.when(digit.isin(1, 3, 4), "MERGE").when(digit == 2, "REJECT").otherwise("KEEP").alias("action"),
        F.when(digit.isin(1, 3, 4), "duplicate_thesis_evidence").otherwise("").alias("reason_code"),
        F.when(digit.isin(1, 3, 4), name(F.col("doc_id") - 1)).otherwise("").alias("target_id"),
    )
    again = d.where(digit >= 8).select(
        name(F.col("doc_id")).alias("candidate_id"), F.lit(1).alias("ordinal"), F.lit("REJECT").alias("action"),
        F.lit("weak_evidence").alias("reason_code"), F.lit("").alias("target_id"),
    )
    return first.unionByName(again)


DECISIONS_SQL = """dec AS (SELECT printf('d%07d', doc_id) AS candidate_id, 0 AS ordinal,
  CASE WHEN doc_id % 10 IN (1, 3, 4) THEN 'MERGE' WHEN doc_id % 10 = 2 THEN 'REJECT' ELSE 'KEEP' END AS action,
  CASE WHEN doc_id % 10 IN (1, 3, 4) THEN 'duplicate_thesis_evidence' ELSE '' END AS reason_code,
  CASE WHEN doc_id % 10 IN (1, 3, 4) THEN printf('d%07d', doc_id - 1) ELSE '' END AS target_id FROM documents WHERE doc_id % 10 <> 0
  UNION ALL SELECT printf('d%07d', doc_id), 1, 'REJECT', 'weak_evidence', '' FROM documents WHERE doc_id % 10 >= 8)"""
