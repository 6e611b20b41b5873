"""Coverage ledger of an episode: timelines, gaps, categories, characters, chunks, status.

Tables may have a `project` column: then episodes are those of their project.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefold.functions.text import speaker
from cuefold.operators.intervals import complement, merge_intervals
from cuefold.operators.overlap import overlap_join, overlap_semi
from cuefold.operators.projects import per_project
from cuefold.session import spread

EP = ["episode_id"]
SILENCE_MS = 30_000
SPEECH_MS = 30_000
SPEECH_CUES = 3
SPARSE_CUES = 15
DEFICIT_LINES = 4
DEFICIT_CUES = 20
DEFICIT_DURATION_MS = 300_000
# Categories whose absence counts, categories that give a character depth.
CRITICAL = ("major_scenes", "character_decisions", "conflicts", "reveals", "setup_payoff")
DEPTH = ("supporting_developments", "relationships", "character_decisions")
ACTION = ("character_decisions", "failures", "consequences")
GAP_ORDER = {"silence": 1, "dropped": 2, "sparse": 3, "char": 4, "cat": 5}

GAP_SCHEMA = (
    "episode_id string, gap_id string, gap_type string, ordinal int, start_ms bigint, end_ms bigint, "
    "target_categories array<string>, target_characters array<string>, is_actionable boolean, status string"
)


def spoken(cues: DataFrame) -> DataFrame:
    """Cues that say something."""
    return cues.where(F.trim("text") != "")


def duration_of(episodes: DataFrame) -> DataFrame:
    """Durations floor at one second."""
    return episodes.select("episode_id", F.greatest("duration_ms", F.lit(1000)).alias("duration_ms"))


def observed(cues: DataFrame, visual: DataFrame) -> DataFrame:
    seen = spoken(cues).select(*EP, "start_ms", "end_ms").unionByName(visual.select(*EP, "start_ms", "end_ms"))
    return merge_intervals(seen, EP)


def unobserved(cues: DataFrame, visual: DataFrame, episodes: DataFrame) -> DataFrame:
    return complement(observed(cues, visual), duration_of(episodes), EP)


@per_project("episode_id")
def silence_gaps(cues: DataFrame, visual: DataFrame, episodes: DataFrame) -> DataFrame:
    """Long stretches that nothing covers."""
    return unobserved(cues, visual, episodes).where(F.col("end_ms") - F.col("start_ms") >= SILENCE_MS)


@per_project("episode_id")
def timeline_coverage(cues: DataFrame, visual: DataFrame, evidence: DataFrame, episodes: DataFrame) -> DataFrame:
    """Union length of each timeline and its share of the duration, capped at 1.

    The three timelines are merged in one pass, keyed by (episode, lane).
    """
    lanes = [
        spoken(cues).select(*EP, F.lit("transcript").alias("lane"), "start_ms", "end_ms"),
        visual.select(*EP, F.lit("visual").alias("lane"), "start_ms", "end_ms"),
        evidence.where(F.col("end_ms") >= F.col("start_ms")).select(*EP, F.lit("evidence").alias("lane"), "start_ms", "end_ms"),
    ]
    islands = merge_intervals(lanes[0].unionByName(lanes[1]).unionByName(lanes[2]), [*EP, "lane"])

    def of(lane: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("lane") == lane, value)), F.lit(0)).cast("bigint")

    length = F.col("end_ms") - F.col("start_ms")
    sums = islands.groupBy(*EP).agg(
        *[of(lane, length).alias(f"{lane}_ms") for lane in ("transcript", "visual", "evidence")],
        *[of(lane, F.lit(1)).alias(f"{lane}_islands") for lane in ("transcript", "visual", "evidence")],
    )
    names = [c for c in sums.columns if c not in EP]
    full = duration_of(episodes).join(sums, EP, "left").na.fill(0, names)
    ratio = lambda lane: F.least(F.lit(1.0), F.col(f"{lane}_ms") / F.col("duration_ms"))
    return full.select("*", *[ratio(lane).alias(f"{lane}_ratio") for lane in ("transcript", "visual", "evidence")])


@per_project("episode_id")
def dropped_speech(cues: DataFrame, evidence: DataFrame) -> DataFrame:
    """Speech islands of at least 30 s and 3 cues that no evidence island intersects.

    A cue touches its own island and no other, so the cue count is the island's own count.
    """
    islands = merge_intervals(spoken(cues), EP, count_as="n_cues")
    long = islands.where((F.col("end_ms") - F.col("start_ms") >= SPEECH_MS) & (F.col("n_cues") >= SPEECH_CUES))
    proof = merge_intervals(evidence.where(F.col("end_ms") >= F.col("start_ms")), EP)
    return overlap_semi(long, proof, EP, ["start_ms"], anti=True, inclusive=False)


@per_project("episode_id")
def fixed_chunks(episodes: DataFrame, step_ms: int = 600_000, lo: int = 60_000, hi: int = 900_000) -> DataFrame:
    """Equal steps over each episode; the step is clamped, the last chunk is short."""
    step = max(lo, min(hi, step_ms))
    base = episodes.select(*EP, F.greatest("duration_ms", F.lit(1000)).cast("bigint").alias("duration_ms"))
    last = F.greatest(F.col("duration_ms") - 1, F.lit(0))
    begun = base.select(*EP, "duration_ms", F.posexplode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(step).cast("bigint"))).alias("chunk_index", "start_ms"))
    return begun.select(*EP, "chunk_index", "start_ms", F.least(F.col("start_ms") + step, F.col("duration_ms")).alias("end_ms"))


@per_project("episode_id")
def chunk_cues(chunks: DataFrame, cues: DataFrame) -> DataFrame:
    """Cues touching each chunk (bounds included), so a cue may serve two chunks."""
    return overlap_join(chunks, spoken(cues), EP, inclusive=True)


@per_project("episode_id")
def chunk_coverage(chunks: DataFrame, cues: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per chunk: cues, evidence items, categories, characters, status."""
    ids = [*EP, "chunk_index"]
    slim = chunks.select(*ids, "start_ms", "end_ms")
    n_cues = chunk_cues(slim, cues.select(*EP, "start_ms", "end_ms", "text")).groupBy(*ids).agg(F.count(F.lit(1)).alias("cues_count"))
    met = overlap_join(slim, evidence.select(*EP, "start_ms", "end_ms", "category", "characters"), EP, inclusive=True)
    items = met.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("items_count"),
        F.sort_array(F.collect_set("r_category")).alias("categories"),
    )
    people = (
        met.select(*ids, F.explode("r_characters").alias("name")).distinct()
        .groupBy(*ids).agg(F.sort_array(F.collect_list("name")).alias("characters"))
    )
    full = slim.join(n_cues, ids, "left").join(items, ids, "left").join(people, ids, "left")
    full = full.na.fill(0, ["cues_count", "items_count"])
    none = F.array().cast("array<string>")
    status = (
        F.when(F.col("cues_count") == 0, "EMPTY_TRANSCRIPT")
        .when((F.col("cues_count") >= SPARSE_CUES) & (F.col("items_count") <= 1), "SPARSE_EVIDENCE")
        .otherwise("OK")
    )
    return full.select(
        *ids, "start_ms", "end_ms", "cues_count", "items_count",
        F.coalesce("categories", none).alias("categories"), F.coalesce("characters", none).alias("characters"),
        status.alias("status"),
    )


def chunk_sparsity(chunks: DataFrame, cues: DataFrame, evidence: DataFrame) -> DataFrame:
    return chunk_coverage(chunks, cues, evidence).where("status = 'SPARSE_EVIDENCE'")


@per_project("episode_id")
def speaker_lines(cues: DataFrame) -> DataFrame:
    """Tagged lines per (episode, speaker), with the span and the first position."""
    return (
        spoken(cues).withColumn("name", speaker(F.col("text"))).where("name is not null")
        .groupBy(*EP, "name")
        .agg(
            F.count(F.lit(1)).alias("lines"), F.min("start_ms").alias("first_ms"),
            F.max("end_ms").alias("last_ms"), F.min("ordinal").alias("first_ordinal"),
        )
    )


@per_project("episode_id")
def evidence_people(evidence: DataFrame) -> DataFrame:
    """Evidence items per (episode, name)."""
    named = evidence.select(*EP, "category", "start_ms", "end_ms", F.explode(F.array_distinct("characters")).alias("name"))
    return named.groupBy(*EP, "name").agg(
        F.count(F.lit(1)).alias("items"),
        F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"),
        F.sort_array(F.collect_set("category")).alias("categories"),
        F.max(F.col("category").isin(*DEPTH)).alias("has_depth"),
        F.max(F.col("category").isin(*ACTION)).alias("has_action"),
    )


@per_project("episode_id")
def character_deficit(cues: DataFrame, evidence: DataFrame) -> DataFrame:
    """Speakers with several lines whom the evidence hardly knows."""
    lines = speaker_lines(cues).where(F.col("lines") >= DEFICIT_LINES)
    people = evidence_people(evidence).select(*EP, "name", "items", "has_depth")
    known = lines.join(people, [*EP, "name"], "left")
    return known.where((F.coalesce("items", F.lit(0)) <= 1) & ~F.coalesce("has_depth", F.lit(False))).select(
        *EP, "name", "lines", "first_ms", "last_ms", "first_ordinal"
    )


@per_project("episode_id")
def category_deficit(cues: DataFrame, evidence: DataFrame, episodes: DataFrame, critical: Sequence[str] = CRITICAL) -> DataFrame:
    """Critical categories without an item, where there is enough dialogue and time to expect one."""
    talk = spoken(cues).groupBy(*EP).agg(F.count(F.lit(1)).alias("n_cues")).where(F.col("n_cues") >= DEFICIT_CUES)
    long = duration_of(episodes).where(F.col("duration_ms") >= DEFICIT_DURATION_MS).join(talk, EP, "left_semi")
    wanted = long.select(*EP, "duration_ms", F.posexplode(F.array(*map(F.lit, critical))).alias("position", "category"))
    have = evidence.where(F.col("category").isin(*critical)).select(*EP, "category").distinct()
    return wanted.join(have, [*EP, "category"], "left_anti")


@per_project("episode_id")
def detect_gaps(
    cues: DataFrame, visual: DataFrame, evidence: DataFrame, episodes: DataFrame, chunks: DataFrame | None = None
) -> DataFrame:
    """All five gap types with ids from one counter per episode."""
    none = F.array().cast("array<string>")

    def shape(df: DataFrame, kind: str, gap_type: str, start: str, end: str, position: Column, cats: Column, chars: Column, pending: bool) -> DataFrame:
        return df.select(
            *EP, F.lit(kind).alias("kind"), F.lit(GAP_ORDER[kind]).alias("rank"), F.lit(gap_type).alias("gap_type"),
            position.cast("bigint").alias("position"), F.col(start).alias("start_ms"), F.col(end).cast("bigint").alias("end_ms"),
            cats.alias("target_categories"), chars.alias("target_characters"),
            F.lit(pending).alias("is_actionable"), F.lit("PENDING" if pending else "RESOLVED").alias("status"),
        )

    words = lambda *names: F.array(*map(F.lit, names))
    rows = shape(silence_gaps(cues, visual, episodes), "silence", "UNOBSERVED_SILENCE", "start_ms", "end_ms", F.col("start_ms"), none, none, False)
    rows = rows.unionByName(shape(dropped_speech(cues, evidence), "dropped", "DROPPED_TRANSCRIPT", "start_ms", "end_ms", F.col("start_ms"), words("major_scenes", "dialogue"), none, True))
    if chunks is not None:
        rows = rows.unionByName(shape(chunk_sparsity(chunks, cues, evidence), "sparse", "CHUNK_SPARSITY", "start_ms", "end_ms", F.col("chunk_index"), words("major_scenes", "dialogue", "character_decisions"), none, True))
    rows = rows.unionByName(shape(character_deficit(cues, evidence), "char", "CHARACTER_DEFICIT", "first_ms", "last_ms", F.col("first_ordinal"), words(*DEPTH), F.array("name"), True))
    whole = category_deficit(cues, evidence, episodes).withColumn("start_ms", F.lit(0).cast("bigint"))
    rows = rows.unionByName(shape(whole, "cat", "CATEGORY_DEFICIT", "start_ms", "duration_ms", F.col("position"), F.array("category"), none, True))
    # Gaps per episode are bounded: disjoint spans of 30 s, chunks, critical names, and speakers.
    counter = F.row_number().over(Window.partitionBy(*EP).orderBy("rank", "position"))
    numbered = rows.withColumn("ordinal", counter)
    return numbered.select(
        *EP, F.format_string("gap_%s_%02d", F.col("kind"), F.col("ordinal")).alias("gap_id"), "gap_type", "ordinal",
        "start_ms", "end_ms", "target_categories", "target_characters", "is_actionable", "status",
    )


@per_project("episode_id")
def category_coverage(
    evidence: DataFrame, cues: DataFrame, visual: DataFrame, episodes: DataFrame, gaps: DataFrame, categories: Sequence[str]
) -> DataFrame:
    """Count, density and span per category; empty ones are verified or suspect."""
    seen = evidence.groupBy(*EP, "category").agg(
        F.count(F.lit(1)).alias("items"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms")
    )
    lanes = spoken(cues).select(*EP).unionByName(visual.select(*EP)).distinct().withColumn("any_signal", F.lit(True))
    verdict = (
        gaps.select(*EP, F.explode("target_categories").alias("category"), "status")
        .groupBy(*EP, "category").agg(F.bool_and(F.col("status") == "PERSISTENT_EMPTY").alias("all_empty"))
    )
    frame = duration_of(episodes).select(*EP, "duration_ms", F.explode(F.array(*map(F.lit, categories))).alias("category"))
    full = (
        frame.join(seen, [*EP, "category"], "left").join(verdict, [*EP, "category"], "left").join(lanes, EP, "left")
    )
    items = F.coalesce("items", F.lit(0))
    minutes = F.greatest(F.lit(0.1), F.col("duration_ms") / F.lit(60000.0))
    status = (
        F.when(items > 0, "PRESENT").when(F.col("any_signal").isNull(), "VERIFIED_EMPTY")
        .when(F.coalesce("all_empty", F.lit(False)), "VERIFIED_EMPTY").otherwise("SUSPECT_EMPTY")
    )
    return full.select(
        *EP, "category", items.alias("items"), (items / minutes).alias("density_per_minute"),
        "first_ms", "last_ms", (items == 0).alias("is_empty"), status.alias("verification_status"),
    )


# A task's automaton holds at most so many names; an episode's cues go to tasks in blocks of so many.
NAMES_A_BLOCK = 20_000
CUES_A_BLOCK = 200_000
MENTION_SCHEMA = "episode_id string, needle string, m_first bigint, m_last bigint"


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last mention of each needle per tile; rows come tile by tile, its needles before its cues."""
    tile, automaton, spans, open_for_names = None, ahocorasick.Automaton(), {}, False

    def told() -> pd.DataFrame:
        return pd.DataFrame([(tile[0], needle, first, last) for needle, (first, last) in spans.items()], columns=["episode_id", "needle", "m_first", "m_last"])

    for frame in frames:
        for episode, names, cues, is_cue, low, start, end in frame.itertuples(index=False, name=None):
            if (episode, names, cues) != tile:
                if spans:
                    yield told()
                tile, automaton, spans, open_for_names = (episode, names, cues), ahocorasick.Automaton(), {}, True
            if not is_cue:
                automaton.add_word(low, low)
                continue
            if open_for_names:
                automaton.make_automaton()
                open_for_names = False
            for needle in {found for _, found in automaton.iter(low)} if len(automaton) else ():
                first, last = spans.get(needle, (start, end))
                spans[needle] = (min(first, start), max(last, end))
    if spans:
        yield told()


@per_project("episode_id")
def mention_spans(names: DataFrame, cues: DataFrame) -> DataFrame:
    """First and last cue whose text contains each name, ignoring case, within the episode.

    Containment is not an equality. An episode is cut to tiles, blocks of its names times blocks of its cues, one of each
    but for a very large one; a task reads a tile's names into an automaton, then lets its cues stream past. A text
    travels once a block of names, and what comes out of a tile is a row a name. Cues without times mention nobody.
    """
    named = names.select(*EP, "name", F.lower("name").alias("needle")).where(F.trim("name") != "")
    needles = named.select(*EP, "needle").distinct()
    texts = spoken(cues).where("start_ms IS NOT NULL AND end_ms IS NOT NULL").select(*EP, F.lower("text").alias("low"), "start_ms", "end_ms")
    sizes = lambda rows, limit, name: rows.groupBy(*EP).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias(name))
    blocks = sizes(needles, NAMES_A_BLOCK, "n_names").join(sizes(texts, CUES_A_BLOCK, "n_cues"), EP)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    zero = F.lit(0).cast("bigint")
    left = needles.join(blocks, EP).select(*EP, own("n_names", "needle").alias("names"), every("n_cues").alias("cues"), F.lit(False).alias("is_cue"), F.col("needle").alias("low"), zero.alias("start_ms"), zero.alias("end_ms"))
    right = texts.join(blocks, EP).select(*EP, every("n_names").alias("names"), own("n_cues", "start_ms", "end_ms", "low").alias("cues"), F.lit(True).alias("is_cue"), "low", "start_ms", "end_ms")
    tile = [*EP, "names", "cues"]
    rows = spread(left.unionByName(right), *tile).sortWithinPartitions(*tile, "is_cue")
    met = rows.mapInPandas(_found, MENTION_SCHEMA).groupBy(*EP, "needle").agg(F.min("m_first").alias("m_first"), F.max("m_last").alias("m_last"))
    return named.join(met, [*EP, "needle"]).select(*EP, "name", "m_first", "m_last")


@per_project("episode_id")
def character_coverage(cues: DataFrame, evidence: DataFrame) -> DataFrame:
    """Lines, mentions and evidence per character."""
    lines = speaker_lines(cues).select(*EP, "name", "lines")
    people = evidence_people(evidence).withColumnsRenamed({"first_ms": "e_first", "last_ms": "e_last"})
    names = lines.select(*EP, "name").unionByName(people.select(*EP, "name")).distinct()
    spans = mention_spans(names, cues)
    keys = [*EP, "name"]
    full = names.join(lines, keys, "left").join(people, keys, "left").join(spans, keys, "left")
    first = F.least("m_first", "e_first")
    last = F.greatest("m_last", "e_last")
    ok = first <= last
    n_lines = F.coalesce("lines", F.lit(0))
    return full.where(F.trim("name") != "").select(
        *keys, n_lines.alias("lines"), F.coalesce("items", F.lit(0)).alias("items"),
        F.when(ok, first).otherwise(F.lit(0)).alias("first_ms"), F.when(ok, last).otherwise(F.lit(0)).alias("last_ms"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        (n_lines < 10).alias("is_supporting"), F.coalesce("has_action", F.lit(False)).alias("has_action"),
    )


@per_project("episode_id")
def episode_status(timeline: DataFrame, gaps: DataFrame) -> DataFrame:
    """One status per episode from its timelines and its open gaps."""
    open_gaps = gaps.where("is_actionable and status = 'PENDING'").groupBy(*EP).agg(F.count(F.lit(1)).alias("open_gaps"))
    full = timeline.join(open_gaps, EP, "left").na.fill(0, ["open_gaps"])
    status = (
        F.when((F.col("transcript_islands") == 0) & (F.col("visual_islands") == 0), "EMPTY_NO_DATA")
        .when(F.col("open_gaps") > 0, "PARTIAL_WITH_GAPS")
        .when((F.col("visual_islands") > 0) & (F.col("visual_ratio") >= 0.85), "COMPLETE")
        .otherwise("COMPLETE_TRANSCRIPT_ONLY")
    )
    return full.select(*EP, "open_gaps", status.alias("status"))
