"""Consolidation answers reconciled with their inputs: decisions, survivors, unions, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.functions.text import jaccard, tokens
from cuefold.operators.graph import resolve_chains
from cuefold.operators.grounding import corrected_scope
from cuefold.session import durable

DISTINCT_BELOW = 0.20
MIN_CONFIDENCE = 0.35
BAND_MS = 2_000


def quality_issue() -> Column:
    """Why a candidate is too weak to keep, or null. Columns: confidence, ranges, refs, episodes, thesis, title."""
    proof = (F.size("ranges") > 0) | (F.size("refs") > 0)
    return (
        F.when((F.col("confidence") < MIN_CONFIDENCE) | ~proof, "weak_evidence")
        .when((F.size("episodes") == 0) | ((F.trim("thesis") == "") & (F.trim("title") == "")), "invalid_grounding")
    )


def first_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """One decision per candidate: the first given, or a conservative keep; bare rejections get a code.

    Merges of two theses of the same primary character that share hardly a word are undone.
    """
    said = decisions.withColumn("candidate_id", F.trim("candidate_id")).where("candidate_id <> ''")
    first = said.groupBy("candidate_id").agg(F.min_by(F.struct("action", "reason_code", "target_id"), "ordinal").alias("_d"))
    ids = candidates.select(F.col("proposal_id").alias("candidate_id")).where("candidate_id <> ''")
    full = ids.join(first, "candidate_id", "left").select(
        "candidate_id", F.coalesce("_d.action", F.lit("KEEP")).alias("action"),
        F.when(F.col("_d").isNull(), "conservative_keep")
        .when((F.col("_d.action") == "REJECT") & (F.coalesce("_d.reason_code", F.lit("")) == ""), "weak_evidence")
        .otherwise(F.coalesce("_d.reason_code", F.lit(""))).alias("reason_code"),
        F.coalesce("_d.target_id", F.lit("")).alias("target_id"),
    )
    # Only merged rows fetch texts, so the long theses move once per merge.
    merged = full.where("action = 'MERGE' and target_id <> ''").select("candidate_id", "target_id")
    about = candidates.select(
        F.col("proposal_id").alias("id"), F.lower(F.trim("primary_character")).alias("primary"), F.trim("thesis").alias("thesis"),
        tokens(F.concat_ws(" ", "thesis", "title")).alias("words"),
    )
    pair = merged.join(about.select(F.col("id").alias("candidate_id"), F.struct("primary", "thesis", "words").alias("c")), "candidate_id").join(
        about.select(F.col("id").alias("target_id"), F.struct("primary", "thesis", "words").alias("t")), "target_id"
    )
    apart = pair.where(
        (F.col("c.primary") != "") & (F.col("c.primary") == F.col("t.primary")) & (F.col("c.thesis") != F.col("t.thesis"))
        & (jaccard(F.col("c.words"), F.col("t.words")) < DISTINCT_BELOW)
    ).select("candidate_id", F.lit(True).alias("_apart"))
    split = F.coalesce("_apart", F.lit(False))
    return full.join(apart, "candidate_id", "left").select(
        "candidate_id", F.when(split, "KEEP").otherwise(F.col("action")).alias("action"),
        F.when(split, "distinct_thesis").otherwise(F.col("reason_code")).alias("reason_code"),
        F.when(split, "").otherwise(F.col("target_id")).alias("target_id"),
    )


def chained(decisions: DataFrame) -> DataFrame:
    """One decision per candidate, the first given, in which a merge names where its target was merged to in the end.

    A merge into a cycle ends where the walk would come back to an id.
    """
    said = decisions.withColumn("candidate_id", F.trim("candidate_id")).where("candidate_id <> ''")
    first = durable(said.groupBy("candidate_id").agg(F.min_by(F.struct("ordinal", "action", "reason_code", "target_id"), "ordinal").alias("_d")).select("candidate_id", "_d.*"))
    merges = first.where("action = 'MERGE' AND target_id <> ''")
    ends = resolve_chains(merges.select(F.col("candidate_id").alias("id"), F.col("target_id").alias("target"))).select(F.col("id").alias("candidate_id"), F.col("target").alias("_end"))
    return first.join(ends, "candidate_id", "left").withColumn("target_id", F.coalesce("_end", "target_id")).drop("_end")


def constituents(candidates: DataFrame, decisions: DataFrame, consolidated: DataFrame) -> DataFrame:
    """(proposal_id, input_id): inputs behind each consolidated candidate.

    Its own id, the inputs merged into it, else the first input of the same title.
    """
    ids = candidates.select(F.col("proposal_id").alias("input_id"))
    named = consolidated.select("proposal_id", F.lower(F.trim("title")).alias("title"))
    own = named.select("proposal_id", F.col("proposal_id").alias("input_id")).join(ids, "input_id", "left_semi")
    merged = decisions.where("action = 'MERGE' and target_id <> ''").select(F.col("target_id").alias("proposal_id"), F.col("candidate_id").alias("input_id"))
    known = own.select("proposal_id", "input_id").unionByName(merged.join(named, "proposal_id", "left_semi")).distinct()
    order = "ordinal" if "ordinal" in candidates.columns else "proposal_id"
    titles = candidates.groupBy(F.lower(F.trim("title")).alias("title")).agg(F.min_by("proposal_id", order).alias("input_id"))
    guessed = named.join(known, "proposal_id", "left_anti").join(titles, "title").select("proposal_id", "input_id")
    return known.unionByName(guessed)


def _tenth(ms: str) -> Column:
    return F.bround(F.col(ms) / 100).cast("bigint")


PEOPLE = {"primary_character": "string", "supporting_characters": "array<string>", "facts": "array<string>", "hooks": "array<string>"}


def _with_people(df: DataFrame) -> DataFrame:
    """The table with every column of `PEOPLE`, none of them null."""
    empty = {c: F.lit("") if t == "string" else F.array().cast(t) for c, t in PEOPLE.items()}
    return df.withColumns({c: F.coalesce(F.col(c), e) if c in df.columns else e for c, e in empty.items()})


def merge_unions(parts: DataFrame, candidates: DataFrame, consolidated: DataFrame) -> DataFrame:
    """Grounded union of each consolidated candidate and its inputs.

    Its own ranges count only near an input's range in the same episode (starts within two
    seconds) or with a reference of an input; every input range is kept once per tenth of a second. The characters
    are those of the inputs, the primary and supporting ones too, and its own; so are facts and hooks. Without a
    primary character it takes that of its first input, itself before others; without supporting ones all others.
    Columns that a table lacks count as empty.
    """
    candidates, consolidated = (_with_people(df) for df in (candidates, consolidated))
    inputs = parts.join(candidates.withColumnRenamed("proposal_id", "input_id"), "input_id")
    led = F.filter(F.array("primary_character"), lambda c: c != "")
    inputs = inputs.withColumn("characters", F.array_distinct(F.concat("characters", led, "supporting_characters")))
    refs = inputs.select("proposal_id", F.explode("refs").alias("ref")).distinct()
    allowed = inputs.select("proposal_id", F.explode("ranges").alias("r")).select("proposal_id", "r.episode_id", "r.start_ms", "r.end_ms")
    allowed = allowed.groupBy("proposal_id", "episode_id", _tenth("start_ms").alias("s"), _tenth("end_ms").alias("e")).agg(
        F.min(F.struct("start_ms", "end_ms")).alias("_r")
    ).select("proposal_id", "episode_id", "s", "e", "_r.*")
    own = consolidated.select("proposal_id", F.posexplode("ranges").alias("at", "r")).select("proposal_id", "at", "r.*").where("episode_id <> ''")
    # Band join on two-second cells: the cell of the start and both neighbours.
    cells = own.withColumn("cell", F.explode(F.array(*[F.floor(F.col("start_ms") / BAND_MS) + d for d in (-1, 0, 1)])))
    near = cells.alias("o").join(
        allowed.select("proposal_id", "episode_id", F.floor(F.col("start_ms") / BAND_MS).alias("cell"), F.col("start_ms").alias("a")).alias("x"),
        ["proposal_id", "episode_id", "cell"],
    ).where(F.abs(F.col("a") - F.col("start_ms")) <= BAND_MS).select("proposal_id", "at")
    proven = own.join(refs, ["proposal_id", "ref"], "left_semi").select("proposal_id", "at")
    valid = own.join(near.unionByName(proven).distinct(), ["proposal_id", "at"], "left_semi")
    valid = valid.select("proposal_id", "episode_id", _tenth("start_ms").alias("s"), _tenth("end_ms").alias("e"), "start_ms", "end_ms")
    extra = allowed.join(valid.select("proposal_id", "episode_id", "s", "e").distinct(), ["proposal_id", "episode_id", "s", "e"], "left_anti")
    spans = valid.unionByName(extra.select(*valid.columns)).groupBy("proposal_id").agg(
        F.array_sort(F.collect_list(F.struct("episode_id", "start_ms", "end_ms"))).alias("ranges")
    )

    def union(column: str) -> DataFrame:
        rows = inputs.select("proposal_id", F.explode(column).alias("v"))
        if column != "refs":
            rows = rows.unionByName(consolidated.join(parts.select("proposal_id").distinct(), "proposal_id", "left_semi").select("proposal_id", F.explode(column).alias("v")))
        return rows.distinct().groupBy("proposal_id").agg(F.array_sort(F.collect_list("v")).alias(column))

    unions = ("episodes", "characters", "refs", "facts", "hooks")
    first = inputs.groupBy("proposal_id").agg(F.min_by("primary_character", F.struct(F.col("input_id") != F.col("proposal_id"), "input_id")).alias("_led"))
    out = consolidated.select("proposal_id", "scope", "primary_character", "supporting_characters").join(parts.select("proposal_id").distinct(), "proposal_id", "left_semi")
    out = out.join(spans, "proposal_id", "left").join(first, "proposal_id", "left")
    for column in unions:
        out = out.join(union(column), "proposal_id", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in unions})
    out = out.withColumn("primary_character", F.when(F.col("primary_character") != "", F.col("primary_character")).otherwise(F.coalesce("_led", F.lit("")))).drop("_led")
    others = F.array_except("characters", F.array("primary_character"))
    out = out.withColumn("supporting_characters", F.when(F.size("supporting_characters") > 0, F.col("supporting_characters")).otherwise(others))
    return out.withColumn("scope", corrected_scope(F.col("scope"), F.size("episodes")))


def reconcile(candidates: DataFrame, decisions: DataFrame, consolidated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final decisions, survivors). Every input is decided once; nothing made up survives.

    Merges are followed to their end first, so A into B into C gives A's ranges and people to C.
    """
    # Decisions and parts are narrow and used several times: made durable, not recomputed.
    decided = durable(first_decisions(candidates, chained(decisions)))
    parts = constituents(candidates, decided, consolidated)
    actions = decided.select(F.col("candidate_id").alias("input_id"), "action")
    dead = parts.join(actions, "input_id", "left").groupBy("proposal_id").agg(F.bool_and(F.col("action") == "REJECT").alias("dead")).where("dead")
    parts = durable(parts.join(dead, "proposal_id", "left_anti"))
    merged = durable(merge_unions(parts, candidates, consolidated))
    kept = decided.where("action = 'KEEP'").join(merged.select(F.col("proposal_id").alias("candidate_id")), "candidate_id", "left_anti")
    judged = kept.select(F.col("candidate_id").alias("proposal_id")).join(_with_people(candidates), "proposal_id").withColumn("_issue", quality_issue())
    alone = judged.where("_issue is null").select(
        "proposal_id", "scope", F.transform("ranges", lambda r: F.struct(r["episode_id"].alias("episode_id"), r["start_ms"].alias("start_ms"), r["end_ms"].alias("end_ms"))).alias("ranges"),
        "episodes", "characters", "refs", *PEOPLE,
    )
    weak = judged.where("_issue is not null").select(F.col("proposal_id").alias("candidate_id"), F.lit(True).alias("_weak"))
    bad = F.coalesce("_weak", F.lit(False))
    final = decided.join(weak, "candidate_id", "left").select(
        "candidate_id", F.when(bad, "REJECT").otherwise(F.col("action")).alias("action"),
        F.when(bad, "weak_evidence").otherwise(F.col("reason_code")).alias("reason_code"), "target_id",
    )
    return final, merged.unionByName(alone)


def decision_counts(decisions: DataFrame, survivors: DataFrame) -> DataFrame:
    """Kept, merged, rejected decisions and eligible survivors, in one row."""
    eligible = survivors.agg(F.count(F.lit(1))).scalar()
    acted = decisions.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("KEEP", "kept"), ("MERGE", "merged"), ("REJECT", "rejected"))])
    return acted.withColumn("eligible", eligible)


def accepted_and_rejected(attempted: DataFrame, accepted: DataFrame) -> DataFrame:
    """Each attempted id with whether some accepted output names it."""
    hit = accepted.select("candidate_id").distinct().withColumn("accepted", F.lit(True))
    return attempted.join(hit, "candidate_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
