"""Row numbers per key that hold when one key has most of the rows, and unique names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefold.session import durable


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """`row_number` per key in `order`, without ever sorting one key in one task.

    Rows are range-partitioned on (keys, order), so a hot key spans many partitions. The
    partitioned rows are made durable first: partition numbers must not change when a lost
    executor's work is redone. Each partition numbers its own rows and adds the key's count in
    the partitions before, which is a table of one row per (key, partition).
    """
    sorts = [F.col(o) if isinstance(o, str) else o for o in order]
    spread = rows.repartitionByRange(*[F.col(k) for k in keys], *sorts).withColumn("_part", F.spark_partition_id())
    fixed = durable(spread)
    counts = fixed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*sorts)
    return (
        fixed.withColumn("_in", F.row_number().over(inside))
        .join(before, [*keys, "_part"])
        .withColumn(name, (F.col("_before") + F.col("_in")).cast("bigint"))
        .drop("_part", "_in", "_before")
    )


def _numbered(base: str, number: Column, limit: int | None) -> Column:
    """The base, or the base with its number at the end; the base is cut for it, and its edge trimmed, under a limit."""
    ending = F.concat(F.lit("_"), number)
    stem = F.col(base)
    if limit is not None:
        stem = F.regexp_replace(F.substr(stem, F.lit(1), F.lit(limit) - F.length(ending)), r"[ ._]+$", "")
    return F.when(number == 0, F.col(base)).otherwise(F.concat(stem, ending))


def _skipped(placed: DataFrame, taken: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, shifts): from which row of a base on each number that it skips shifts the rows.

    taken: on, number, holder. A number is skipped by the row that comes to it if the holder is earlier. The j-th
    number not skipped is j and one more for each shift at or below j.
    """
    marks = taken.select(*on, F.col("holder").alias("_at"), "number", F.lit(1).alias("_mark"))
    rows = placed.join(taken.select(*on).distinct(), list(on), "left_semi").select(*on, "_at", F.lit(None).cast("bigint").alias("number"), F.lit(0).alias("_mark"))
    met = ranked(rows.unionByName(marks), on, ["_at", F.desc("_mark"), "number"], "_both").where("_mark = 1")
    before = F.row_number().over(Window.partitionBy(*on).orderBy("_at", "number"))
    # How many rows of the base are earlier than the holder: they may still take the number.
    told = met.select(*on, "number", (F.col("_both") - before).alias("free_for"))
    step = lambda acc, x: F.when(
        x["number"] - acc["n"] >= x["free_for"],
        F.struct((acc["n"] + 1).alias("n"), F.array_append(acc["shifts"], x["number"] - acc["n"]).alias("shifts")),
    ).otherwise(acc)
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("shifts"))
    numbers = F.array_sort(F.collect_list(F.struct("number", "free_for")))
    return told.groupBy(*on).agg(F.aggregate(numbers, start, step, lambda acc: acc["shifts"]).alias("shifts"))


def unique_names(rows: DataFrame, keys: Sequence[str], ordinal: str, base: str, name: str, limit: int | None = 120) -> DataFrame:
    """First holder of a name keeps it, later ones get '_1', '_2', ... skipping names that earlier rows hold.

    All rows bid at once: the n-th row of a base for the n-th number that is free for it. Where two bases come to one
    name, the earlier row has it and the number counts as taken for later rows of the other base. Names only
    ever go to earlier rows, so bids are never taken back; rounds end when no name is bid for twice. A base
    costs a row number and one array of its taken numbers, however many rows it has.
    """
    on = [*keys, base]
    placed = durable(ranked(ranked(rows, keys, [ordinal, base], "_at"), on, ["_at"], "_rank"))
    shifts, taken = None, None
    while True:
        rank = F.col("_rank") - 1
        if shifts is None:
            bids = placed.withColumn("_number", rank)
        else:
            later = F.size(F.filter("shifts", lambda x: x <= F.col("_rank") - 1))
            bids = placed.join(shifts, on, "left").withColumn("_number", rank + F.coalesce(later, F.lit(0))).drop("shifts")
        bids = durable(bids.withColumn(name, _numbered(base, F.col("_number"), limit)))
        held = bids.groupBy(*keys, name).agg(F.min("_at").alias("holder"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        lost = durable(bids.join(held, [*keys, name]).where("_at <> holder").select(*on, F.col("_number").alias("number"), "holder"))
        if lost.isEmpty():
            return bids.select(*rows.columns, name)
        known = lost if taken is None else taken.unionByName(lost)
        taken = durable(known.groupBy(*on, "number").agg(F.min("holder").alias("holder")))
        shifts = durable(_skipped(placed, taken, on))
