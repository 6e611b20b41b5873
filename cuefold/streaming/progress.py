"""Progress of running projects, folded from their phase events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.operators.intervals import running_sum

# Where each phase stands in the whole, from its first step to its last.
BANDS = {
    "episode_summarizing": (58, 58), "batch_summarizing": (58, 58), "season_barrier": (60, 60), "season_connecting": (60, 60),
    "season_batch": (60, 65), "season_merging": (65, 65), "candidate_discovery": (65, 72), "candidate_consolidation": (72, 77),
    "candidate_verifying": (77, 80), "zero_output_verification": (77, 80), "finalizer": (70, 70), "json_validation": (80, 80),
    "json_repair": (80, 80), "season_mining": (80, 85), "output_plan_ready": (85, 85),
}
SCANNER = (20, 55)
RETRY = "Thử lại|Retrying|(?i:retry)"


def phase_progress(phase: Column, done: Column, total: Column) -> Column:
    """Progress an event stands for: its share of its phase's band; 0 for other phases.

    For the scanner `done` of `total` is the mean share of its episodes.
    """
    share = F.when(F.coalesce(total, F.lit(0)) > 0, F.coalesce(done, F.lit(1)) / total).otherwise(F.lit(1.0))
    at = lambda lo, hi: F.least(F.lit(hi), F.lit(lo) + F.floor(share * (hi - lo))).cast("int")
    value = F.when(phase == "scanner", at(*SCANNER))
    for name, band in BANDS.items():
        value = value.when(phase == name, at(*band))
    return value.otherwise(0)


def fold_progress(events: DataFrame) -> DataFrame:
    """Latest state per project: progress never falls, the last message and phase stand.

    events: project, seq, phase, done, total, message. The same plan serves a batch and, in update
    mode, a stream whose state is one small row per project.
    """
    scored = events.withColumn("_p", phase_progress(F.col("phase"), F.col("done"), F.col("total")))
    return scored.groupBy("project").agg(
        F.max("_p").alias("progress"), F.max_by("message", "seq").alias("message"), F.max_by("phase", "seq").alias("phase"),
        F.max(F.col("message").rlike(RETRY)).alias("retried"), F.max("seq").alias("seq"),
    )


def scanner_progress(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Scanner events with the progress each brings: done episodes count whole, the event's own by
    its stage, others that run by half.

    events: project, seq (dense from 0), episode_id, stage, chunk, chunks; projects: project,
    episodes. Counts so far are running sums cut in blocks, so a busy project is no matter.
    """
    keys = ["project", "episode_id"]
    finished = F.col("stage").isin("complete", "cached")
    marks = events.groupBy(*keys).agg(F.min("seq").alias("_seen"), F.min(F.when(finished, F.col("seq"))).alias("_done"))
    told = events.join(marks, keys)
    one = lambda test: F.when(test, 1).otherwise(0)
    seen = running_sum(told, ["project"], "seq", one(F.col("seq") == F.col("_seen")), "_s")
    both = running_sum(seen, ["project"], "seq", one(F.col("seq") == F.col("_done")), "_d")
    n_seen = F.col("_s") + one(F.col("seq") == F.col("_seen"))
    n_done = F.col("_d") + one(F.col("seq") == F.col("_done"))
    own_done = F.coalesce(F.col("_done") <= F.col("seq"), F.lit(False))
    own = F.when(own_done, 0.0).when(F.col("stage").isin("coverage_check", "second_pass"), 0.85).when(
        F.col("chunks") > 0, 0.7 * (F.coalesce("chunk", F.lit(0)) / F.col("chunks"))
    ).otherwise(0.5)
    running = n_seen - n_done - F.when(own_done, 0).otherwise(1)
    mean = (n_done + own + 0.5 * running) / F.greatest(F.col("episodes"), F.lit(1))
    lo, hi = SCANNER
    sized = both.join(projects, "project")
    return sized.select("project", "seq", "episode_id", F.least(F.lit(hi), lo + F.floor((hi - lo) * mean)).cast("int").alias("progress"))
