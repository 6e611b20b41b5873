"""Offline plans and texts made from cues: scenes, clip heads, transcripts, scan events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.functions.requests import no_dialogue, transcript_line
from cuefold.operators.projects import per_project
from cuefold.operators.overlap import overlap_join
from cuefold.operators.ranking import ranked

EP = ["episode_id"]
QUOTE_WORDS = 14


@per_project("episode_id")
def scene_bins(cues: DataFrame, episodes: DataFrame) -> DataFrame:
    """Two to four equal scenes per episode: as many as cues up to four, else three."""
    n = cues.groupBy(*EP).agg(F.count(F.lit(1)).alias("_n"))
    sized = episodes.select(*EP, F.greatest("duration_ms", F.lit(3000)).alias("_t")).join(n, EP)
    sized = sized.withColumn("_k", F.when(F.col("_n") <= 4, F.greatest("_n", F.lit(2))).otherwise(3))
    return _bins(sized)


@per_project("episode_id")
def silent_bins(episodes: DataFrame) -> DataFrame:
    """Scenes of an episode without speech: three from fifteen seconds on, else two."""
    sized = episodes.select(*EP, F.greatest("duration_ms", F.lit(3000)).alias("_t"))
    return _bins(sized.withColumn("_k", F.when(F.col("_t") >= 15000, 3).otherwise(2).cast("bigint")))


def _bins(sized: DataFrame) -> DataFrame:
    rows = sized.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)).alias("scene"))
    edge = lambda i: F.bround(i * F.col("_t") / F.col("_k")).cast("bigint")
    return rows.select(*EP, "scene", F.col("_k").alias("scenes"), edge(F.col("scene")).alias("start_ms"), F.least(edge(F.col("scene") + 1), F.col("_t")).alias("end_ms"))


@per_project("episode_id")
def scene_dialogue(bins: DataFrame, cues: DataFrame) -> DataFrame:
    """First words said in each scene: a cue belongs where it starts, ends, or spans the whole.

    Only the cues that can hold the first fourteen words are gathered: every cue has a word, so
    fourteen cues are enough.
    """
    slim = cues.where(F.trim("text") != "").select(*EP, "ordinal", "start_ms", "end_ms", "text")
    met = overlap_join(bins, slim, EP, inclusive=True)
    s, e, a, z = (F.col(c) for c in ("start_ms", "end_ms", "r_start_ms", "r_end_ms"))
    inside = ((a >= s) & (a < e)) | ((z > s) & (z <= e)) | ((a <= s) & (z >= e))
    keys = [*EP, "scene"]
    heads = ranked(met.where(inside).select(*keys, "r_ordinal", "r_text"), keys, ["r_ordinal"], "_r").where(F.col("_r") <= QUOTE_WORDS)
    said = heads.groupBy(*keys).agg(F.expr("listagg(r_text, ' ') WITHIN GROUP (ORDER BY r_ordinal)").alias("_said"))
    words = F.filter(F.split("_said", r"\s+"), lambda w: w != "")
    quoted = said.select(*keys, F.array_join(F.slice(words, 1, QUOTE_WORDS), " ").alias("quote"))
    return bins.join(quoted, keys, "left").withColumn("quote", F.coalesce("quote", F.lit("")))


def clip_heads(episodes: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Offline outputs: the first 30 s of every episode, and 15 s of the first three where there are two.

    episodes: keys, episode_id, ordinal (from 0), duration_ms.
    """
    by = list(keys)
    length = lambda cap: F.least(F.lit(cap), F.greatest("duration_ms", F.lit(1000))).cast("bigint")
    clip = lambda df, output, cap: df.select(*by, F.lit(output).alias("output_id"), "ordinal", "episode_id", F.lit(0).cast("bigint").alias("start_ms"), length(cap).alias("end_ms"))
    counts = episodes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    heads = episodes.where(F.col("ordinal") < 3).join(counts, by, "left_semi")
    return clip(episodes, "out_season_arc", 30_000).unionByName(clip(heads, "out_supporting_arc", 15_000))


def transcripts(pieces: DataFrame, placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Transcript text of each request piece. A piece is bounded in bytes, so its text is too.

    pieces: keys, lo, hi, start_ms, end_ms; placed: keys, pos, start_ms, end_ms, text.
    """
    by = [*keys, "lo"]
    spans = pieces.select(*keys, "lo", "hi", "start_ms", "end_ms")
    # A position is met through blocks of 256 that a piece covers.
    blocks = spans.where("hi > lo").withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / 256), F.floor((F.col("hi") - 1) / 256))))
    lines = placed.select(*keys, "pos", F.floor(F.col("pos") / 256).alias("_b"), transcript_line(F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("_line"))
    met = blocks.drop("start_ms", "end_ms").join(lines, [*keys, "_b"]).where("pos >= lo and pos < hi")
    texts = met.groupBy(*by).agg(F.expr("listagg(_line, '\n') WITHIN GROUP (ORDER BY pos)").alias("transcript"))
    return spans.join(texts, by, "left").withColumn("transcript", F.coalesce("transcript", no_dialogue(F.col("start_ms"), F.col("end_ms"))))


def scan_events(events: DataFrame) -> DataFrame:
    """Events of a single-video scan answer: the first 50 of a chunk, moved into it, texts cut.

    events: keys with `at` (position in the answer), chunk_start_ms, chunk_end_ms, start_ms, end_ms
    (may be null), summary, quotes, exclude.
    """
    lo, hi = F.col("chunk_start_ms"), F.col("chunk_end_ms")
    start = F.greatest(lo, F.least(hi, F.coalesce("start_ms", lo)))
    end = F.greatest(start, F.least(hi, F.coalesce("end_ms", hi)))
    return events.where(F.col("at") < 50).withColumns({
        "start_ms": start, "end_ms": end, "summary": F.substring(F.trim("summary"), 1, 300),
        "quotes": F.transform(F.slice("quotes", 1, 5), lambda q: F.substring(q, 1, 200)), "exclude": F.coalesce("exclude", F.lit(False)),
    })
