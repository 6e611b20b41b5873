"""Breadth of what the candidates cover, and why a project has no outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_EPISODES, MIN_EPISODE_RATIO = 3, 0.40
MIN_EVIDENCE, MIN_EVIDENCE_RATIO = 20, 0.10


def breadth(candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of a project's episodes and evidence its candidates touch, and whether that is suspicious.

    totals: project, total_episodes, total_items. A season arc over two episodes, or half of
    them, or in a project of at most two, exempts it. Distinct counts are exact: values are made
    distinct per (project, value) before they are counted.
    """
    spans = F.transform("ranges", lambda r: r["episode_id"])
    named = lambda values: F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")
    eps = candidates.select("project", F.explode(F.array_union("episodes", named(spans))).alias("v")).distinct()
    held = named(F.transform("ranges", lambda r: r["ref"]))
    refs = candidates.select("project", F.explode(F.array_union("refs", held)).alias("v")).distinct()
    n_eps = eps.groupBy("project").agg(F.count(F.lit(1)).alias("episodes"))
    n_refs = refs.groupBy("project").agg(F.count(F.lit(1)).alias("refs"))
    own = F.when(F.size("episodes") > 0, F.size("episodes")).otherwise(F.size(F.array_distinct(named(spans))))
    total = F.col("total_episodes")
    arc = (F.col("scope") == "SEASON_ARC") & ((total <= 2) | (own >= 2) | ((total > 0) & (own / F.greatest(total, F.lit(1)) >= 0.5)))
    exempt = candidates.join(totals, "project").groupBy("project").agg(F.max(arc).alias("season_arc"), F.count(F.lit(1)).alias("candidates"))
    full = totals.join(exempt, "project").join(n_eps, "project", "left").join(n_refs, "project", "left").na.fill(0, ["episodes", "refs"])
    all_eps = F.when(total > 0, total).otherwise(F.col("episodes"))
    ep_ratio = F.when(all_eps > 0, F.col("episodes") / F.greatest(all_eps, F.lit(1))).otherwise(F.lit(1.0))
    ev_ratio = F.when(F.col("total_items") > 0, F.col("refs") / F.greatest(F.col("total_items"), F.lit(1))).otherwise(F.lit(1.0))
    thin = ((all_eps >= MIN_EPISODES) & (ep_ratio < MIN_EPISODE_RATIO)) | ((F.col("total_items") >= MIN_EVIDENCE) & (ev_ratio < MIN_EVIDENCE_RATIO))
    return full.select(
        "project", "candidates", "episodes", "refs", ep_ratio.alias("episode_ratio"), ev_ratio.alias("evidence_ratio"), "season_arc",
        (~F.col("season_arc") & thin).alias("suspicious"),
    )


def says_complete(status: Column) -> Column:
    """Substring test: INCOMPLETE also says complete. Kept as the reference has it."""
    return F.contains(F.upper(status), F.lit("COMPLETE"))


def ledger_flags(ledgers: DataFrame) -> DataFrame:
    """Per project: ledgers, any incomplete one, all of them complete without open gaps.

    ledgers: project, status, open_gaps.
    """
    upper = F.upper("status")
    broken = upper.rlike("PARTIAL|EMPTY|FAILED|INCOMPLETE") | ((F.col("open_gaps") > 0) & ~says_complete(F.col("status")))
    sound = says_complete(F.col("status")) & (F.col("open_gaps") == 0)
    return ledgers.groupBy("project").agg(
        F.count(F.lit(1)).alias("ledgers"), F.max(broken).alias("any_incomplete"), F.min(sound).alias("all_complete")
    )


def zero_output_reason(health: DataFrame) -> DataFrame:
    """First reason, in order of precedence, why a project has nothing to show; null when healthy.

    Also `genuine_zero` (no outputs is the true result) and `trigger` (ask again). health: one
    row per project with the stage flags, counts and `ledger_flags`.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    parser = yes("parser_failed") | text("parser_error")
    schema = yes("schema_rejected") | text("schema_error") | ~yes("discovery_schema_valid") | ~yes("consolidation_schema_valid")
    discovery = text("discovery_error") | ~yes("discovery_completed")
    finalizer = yes("finalizer_attempted") & (text("finalizer_error") | (~yes("finalizer_completed") & (count("finalizer_results") == 0)))
    had = (count("discovered_count") > 0) | (count("rejected_count") > 0)
    refused = had & (count("consolidated_count") == 0) & (count("decision_count") > 0) & (count("rejected_count") >= count("decision_count"))
    blind = (count("total_items") == 0) & (count("ledgers") == 0)
    reason = (
        F.when(parser, "PARSER_FAILURE").when(schema, "MALFORMED_AI_RESPONSE").when(discovery, "CANDIDATE_DISCOVERY_FAILED")
        .when(finalizer, "FINALIZER_FAILED").when(yes("any_incomplete"), "COVERAGE_INCOMPLETE")
        .when(refused, "CANDIDATES_REJECTED_BY_VALIDATION").when(blind, "INSUFFICIENT_EVIDENCE")
    )
    consolidation = yes("consolidation_completed") & ~text("consolidation_error")
    genuine = (
        ~parser & ~schema & ~discovery & consolidation & (count("consolidated_count") == 0) & ~blind
        & F.coalesce(F.col("all_complete"), F.lit(True))
    )
    stops = reason.isNotNull() & (reason != "CANDIDATES_REJECTED_BY_VALIDATION")
    trigger = ~stops & ((count("consolidated_count") == 0) | yes("suspicious"))
    return health.withColumns({"reason": reason, "genuine_zero": genuine, "trigger": F.coalesce(trigger, F.lit(False))})
