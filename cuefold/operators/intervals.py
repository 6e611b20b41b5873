"""Interval algebra on (keys, start_ms, end_ms) tables; everything is BIGINT milliseconds.

Two spans join one island when the later one starts no more than ``tolerance_ms`` after the
end of the earlier. Starts that fall in the same cell of ``tolerance_ms + 1`` ms are therefore
always in the same island, so a map-side combined ``groupBy(keys, cell)`` shrinks the input
without changing the result. What reaches the window is bounded by the media time of a key
(at most one row per cell: 1.7 million for 24 h at 50 ms), however many rows the key holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefold.operators.overlap import overlap_join

TOUCH_MS = 50
DROP_MS = 100


def merge_intervals(
    spans: DataFrame,
    keys: Sequence[str],
    tolerance_ms: int = TOUCH_MS,
    count_as: str | None = None,
) -> DataFrame:
    """Islands of touching spans: keys, start_ms, end_ms (and how many spans each holds)."""
    cell = F.floor(F.col("start_ms") / F.lit(tolerance_ms + 1))
    cells = (
        spans.groupBy(*keys, cell.alias("_cell"))
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    ordered = Window.partitionBy(*keys).orderBy("start_ms")
    reach = F.max("end_ms").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start_ms") > reach + F.lit(tolerance_ms)).cast("int"), F.lit(1))
    flagged = cells.withColumn("_opens", opens)
    numbered = flagged.withColumn("_island", F.sum("_opens").over(ordered))
    islands = numbered.groupBy(*keys, "_island").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.sum("_n").alias("_n"),
    )
    extra = [F.col("_n").alias(count_as)] if count_as else []
    return islands.select(*keys, "start_ms", "end_ms", *extra)


def complement(
    islands: DataFrame,
    bases: DataFrame,
    keys: Sequence[str],
    base_end: str = "duration_ms",
    drop_ms: int = DROP_MS,
) -> DataFrame:
    """What is left of one base span [0, base_end] per key once its islands are cut out.

    `islands` must be merged already. Zero-length islands cut nothing; pieces of `drop_ms` or
    less are dropped.
    """
    cuts = islands.where(F.col("end_ms") > F.col("start_ms")).select(*keys, "start_ms", "end_ms")
    edge = bases.select(
        *keys, F.lit(-1).cast("bigint").alias("start_ms"), F.lit(0).cast("bigint").alias("end_ms"),
        F.col(base_end).cast("bigint").alias("_base"),
    )
    rows = cuts.withColumn("_base", F.lit(None).cast("bigint")).unionByName(edge)
    ordered = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    whole = Window.partitionBy(*keys)
    bounded = (
        rows.withColumn("_next", F.lead("start_ms").over(ordered))
        .withColumn("_base", F.max("_base").over(whole))
        .where(F.col("_base").isNotNull())
    )
    piece_end = F.least(F.coalesce(F.col("_next"), F.col("_base")), F.col("_base"))
    return (
        bounded.select(*keys, F.col("end_ms").alias("start_ms"), piece_end.alias("end_ms"))
        .where(F.col("end_ms") - F.col("start_ms") > F.lit(drop_ms))
    )


def subtract_intervals(
    bases: DataFrame,
    cuts: DataFrame,
    keys: Sequence[str],
    base_id: str,
    drop_ms: int = DROP_MS,
    bucket_ms: int = 60_000,
) -> DataFrame:
    """Each base span minus the union of `cuts` with the same keys; `base_id` names a base within its keys.

    The cuts are merged first, so what meets one base is disjoint and ordered.
    """
    merged = merge_intervals(cuts, keys).where(F.col("end_ms") > F.col("start_ms"))
    met = overlap_join(bases, merged, keys, inclusive=False, bucket_ms=bucket_ms).select(
        *keys, base_id, F.col("r_start_ms").alias("cut_start"), F.col("r_end_ms").alias("cut_end")
    )
    named = bases.select(*keys, base_id, "start_ms", "end_ms")
    head = named.select(
        *keys, base_id, F.col("start_ms").alias("cut_start"), F.col("start_ms").alias("cut_end"), F.lit(0).alias("_o")
    )
    rows = head.unionByName(met.withColumn("_o", F.lit(1)))
    ordered = Window.partitionBy(*keys, base_id).orderBy("_o", "cut_start")
    pieces = rows.withColumn("_next", F.lead("cut_start").over(ordered))
    return (
        pieces.join(named, [*keys, base_id])
        .select(
            *keys,
            base_id,
            F.greatest("cut_end", "start_ms").alias("start_ms"),
            F.least(F.coalesce(F.col("_next"), F.col("end_ms")), F.col("end_ms")).alias("end_ms"),
        )
        .where(F.col("end_ms") - F.col("start_ms") > F.lit(drop_ms))
    )


def running_sum(
    rows: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    value: Column,
    name: str,
    block: int = 4096,
) -> DataFrame:
    """Exclusive running sum of `value` by an integer `ordinal`, safe for a hot key.

    A key is cut in blocks of `block` ordinals: the blocks are summed (map-side combined) and
    only those block totals meet in one window per key; the rows themselves are windowed per
    (key, block), so no task ever holds a whole key.
    """
    blocked = rows.withColumn("_sum_value", value).withColumn("_sum_block", F.floor(F.col(ordinal) / F.lit(block)))
    totals = blocked.groupBy(*keys, "_sum_block").agg(F.sum("_sum_value").alias("_sum_total"))
    upto = Window.partitionBy(*keys).orderBy("_sum_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_sum_block", F.coalesce(F.sum("_sum_total").over(upto), F.lit(0)).alias("_sum_before"))
    inside = Window.partitionBy(*keys, "_sum_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_sum_inside", F.coalesce(F.sum("_sum_value").over(inside), F.lit(0)))
        .join(bases, [*keys, "_sum_block"])
        .withColumn(name, (F.col("_sum_before") + F.col("_sum_inside")).cast("bigint"))
        .drop("_sum_value", "_sum_block", "_sum_inside", "_sum_before")
    )


def chain_groups(spans: DataFrame, keys: Sequence[str], reach_ms: int) -> DataFrame:
    """Tag each span with `group_start_ms`, the start of the chain it belongs to.

    A chain grows while the next span starts no more than `reach_ms` after its furthest end.
    The islands come from the pre-aggregated merge; spans find theirs by a bucketed join.
    """
    groups = merge_intervals(spans, keys, reach_ms).select(*keys, "start_ms", "end_ms")
    met = overlap_join(spans, groups, keys, inclusive=True, bucket_ms=max(4 * reach_ms, 10_000))
    return met.withColumnRenamed("r_start_ms", "group_start_ms").withColumnRenamed("r_end_ms", "group_end_ms")
