"""Level measurements over tables of 16-bit sample blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL_SCALE = 32768
SPEECH_FLOOR = 0.001
MIX_FLOOR = 0.0005
PEAK_SLACK_DB = 0.15


def block_levels(blocks: DataFrame, keys: Sequence[str], samples: str = "samples", floor: float = SPEECH_FLOOR) -> DataFrame:
    """RMS, peak and clipping per key from blocks of samples (array<int>).

    Each block is reduced where it lies (integer sum of squares, peak); the partial sums combine
    map-side, so no key is ever gathered.
    """
    low = F.lit(0).cast("bigint")
    squares = F.aggregate(samples, low, lambda s, x: s + x.cast("bigint") * x.cast("bigint"))
    peak = F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("bigint")))), low)
    clipped = F.size(F.filter(samples, lambda x: F.abs(x.cast("bigint")) >= FULL_SCALE - 1))
    part = blocks.select(*keys, squares.alias("_q"), peak.alias("_p"), clipped.alias("_c"), F.size(samples).alias("_n"))
    total = part.groupBy(*keys).agg(
        F.sum("_n").alias("samples"), F.sum("_q").alias("sum_squares"), F.max("_p").alias("peak"), F.sum("_c").cast("bigint").alias("clipped"),
    )
    rms = F.when(F.col("samples") > 0, F.sqrt(F.col("sum_squares") / F.col("samples")) / FULL_SCALE).otherwise(F.lit(0.0))
    return total.withColumn("rms", rms).withColumn("has_sound", F.col("rms") >= floor)


def peak_dbfs(peak: Column) -> Column:
    """Peak in dB below full scale; -100 for silence."""
    return F.when(peak > 0, 20 * F.log10(peak / F.lit(FULL_SCALE))).otherwise(F.lit(-100.0))


def mix_issue(levels: DataFrame, limit_db: float = -1.5) -> DataFrame:
    """First thing wrong with a mix: no samples, silence, clipping, or a peak over the limit."""
    level = peak_dbfs(F.col("peak"))
    issue = (
        F.when(F.col("samples") == 0, "EMPTY").when(F.col("rms") < MIX_FLOOR, "SILENT")
        .when((F.col("peak") >= FULL_SCALE - 1) | (level >= 0), "CLIPPING").when(level > limit_db + PEAK_SLACK_DB, "PEAK_OVER_LIMIT")
    )
    return levels.withColumn("issue", issue)
