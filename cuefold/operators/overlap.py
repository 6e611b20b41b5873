"""Range joins as bucketed equi joins.

Catalyst has no strategy for an overlap predicate other than a nested loop, so both sides are
put in time buckets and joined on (keys, bucket). A pair is kept only in the bucket of its
later start, which both spans always cover, so it appears exactly once.

Spans longer than ``LONG`` buckets would explode without limit; they use buckets ``LONG``
times as wide. The four short/long pairings get different key tags, so two short spans never
meet in a wide bucket. A hot key is spread over its buckets; AQE splits a hot bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 64


def _bucket(ms: Column, width: int) -> Column:
    return F.floor(ms / F.lit(width))


def _cover(start: Column, end: Column, width: int, tag: int) -> Column:
    whole = F.sequence(_bucket(start, width), _bucket(end, width))
    return F.transform(whole, lambda b: F.struct(F.lit(tag).alias("tag"), b.alias("bucket")))


def _slots(start: Column, end: Column, width: int, left: bool) -> Column:
    """Slots of one span; tags: 0 short-short, 1 short-long, 2 long-short, 3 long-long."""
    wide = width * LONG
    short_meets_long, long_meets_short = (1, 2) if left else (2, 1)
    short = F.concat(_cover(start, end, width, 0), _cover(start, end, wide, short_meets_long))
    long = F.concat(_cover(start, end, wide, long_meets_short), _cover(start, end, wide, 3))
    return F.when(end - start <= F.lit(wide), short).otherwise(long)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    inclusive: bool,
    bucket_ms: int = 60_000,
    pad_ms: int = 0,
    bounded: bool = False,
) -> DataFrame:
    """All pairs of spans with equal keys that overlap.

    Both sides carry start_ms/end_ms; the right side's columns come back as ``r_*``.
    `inclusive` also accepts spans that only touch; otherwise the shared time must be positive.
    `pad_ms` widens the left span on both sides. With `bounded` the caller promises that no
    span is longer than ``LONG`` buckets, and the wide slots are left out.
    """
    lo, hi = F.col("start_ms") - F.lit(pad_ms), F.col("end_ms") + F.lit(pad_ms)
    rights = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on])
    r_lo, r_hi = F.col("r_start_ms"), F.col("r_end_ms")
    keep_l, keep_r = F.col("start_ms") <= F.col("end_ms"), r_lo <= r_hi
    if bounded:
        lefts = left.where(keep_l).withColumn("_b", F.explode(F.sequence(_bucket(lo, bucket_ms), _bucket(hi, bucket_ms))))
        rights = rights.where(keep_r).withColumn(
            "_b", F.explode(F.sequence(_bucket(r_lo, bucket_ms), _bucket(r_hi, bucket_ms)))
        )
        slot, bucket, width = ["_b"], F.col("_b"), F.lit(bucket_ms)
    else:
        lefts = left.where(keep_l).withColumn("_s", F.explode(_slots(lo, hi, bucket_ms, True)))
        rights = rights.where(keep_r).withColumn("_s", F.explode(_slots(r_lo, r_hi, bucket_ms, False)))
        split = {"_t": F.col("_s.tag"), "_b": F.col("_s.bucket")}
        lefts, rights = lefts.withColumns(split).drop("_s"), rights.withColumns(split).drop("_s")
        slot, bucket = ["_t", "_b"], F.col("_b")
        width = F.when(F.col("_t") == 0, F.lit(bucket_ms)).otherwise(F.lit(bucket_ms * LONG))
    later = F.greatest(lo, r_lo)
    earlier = F.least(hi, r_hi)
    meets = later <= earlier if inclusive else later < earlier
    return (
        lefts.join(rights, [*on, *slot])
        .where(meets & (bucket == F.floor(later / width)))
        .drop(*slot)
    )


def overlap_semi(
    left: DataFrame, right: DataFrame, on: Sequence[str], row_id: Sequence[str], *, anti: bool = False, **how
) -> DataFrame:
    """Left rows that do (or, with `anti`, do not) overlap any right span of the same keys."""
    ids = [*on, *row_id]
    slim_left = left.select(*ids, "start_ms", "end_ms")
    slim_right = right.select(*on, "start_ms", "end_ms")
    hit = overlap_join(slim_left, slim_right, on, **how).select(*ids).distinct()
    return left.join(hit, ids, "left_anti" if anti else "left_semi")
