"""Entity tables: versioned snapshots behind one rename, partitions replaced by one job, and a log of batches."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions present in `df`; others stay. Spark commits files by rename."""
    (df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stored table; with a schema, rows are read in exactly that shape."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole snapshots of an entity, oldest first; none where there is no store."""
    files, place = _place(spark, path)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def publish(df: DataFrame, path: str, keep: int = 2) -> int:
    """Write `df` as the entity's next snapshot and return its number.

    The job writes beside the store; only a whole table is renamed into place, so a failed write leaves the snapshot before
    it as it was. `df` may read the snapshot it replaces. Of earlier ones the last `keep` - 1 stay for readers under way.
    One writer at a time: a number taken in the meantime raises.
    """
    spark = df.sparkSession
    before = versions(spark, path)
    number = before[-1] + 1 if before else 0
    files, waiting = _place(spark, f"{path}/_writing-{uuid.uuid4().hex}")
    target = _place(spark, f"{path}/v{number:010d}")[1]
    try:
        df.write.parquet(waiting.toString())
        if files.exists(target) or not files.rename(waiting, target):
            raise RuntimeError(f"snapshot {number} of {path} was written by someone else")
    finally:
        files.delete(waiting, True)
    for old in before[: max(len(before) + 1 - keep, 0)]:
        files.delete(_place(spark, f"{path}/v{old:010d}")[1], True)
    return number


def snapshot(spark: SparkSession, path: str, schema: str | None = None, version: int | None = None) -> DataFrame | None:
    """The entity's newest snapshot, or that of a number; None where nothing was published."""
    found = versions(spark, path)
    if not found:
        return None
    return read_table(spark, f"{path}/v{found[-1] if version is None else version:010d}", schema)


def log_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write a batch's rows of a log; the same batch written again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def last_of(log: DataFrame, keys: Sequence[str], order: Column, *carried: str) -> DataFrame:
    """The row of each key that is greatest in `order`, combined map-side: keys and carried columns."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*carried), order).alias("_last")).select(*keys, "_last.*")


def shape_issues(df: DataFrame, required: dict[str, str]) -> list[str]:
    """Required columns that a stored table lacks or holds in another type: no reuse then."""
    have = dict(df.dtypes)
    return [f"{c}: {have.get(c, 'missing')} is not {t}" for c, t in required.items() if have.get(c) != t]
