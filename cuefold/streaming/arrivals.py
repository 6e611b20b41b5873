"""Arriving subtitle files: cues and coverage of the newest file of each episode, kept as logs of batches.

Files land as `inbox/delivery/folders/stem.srt`, or without a delivery at the top. An episode is (folders, stem), so equal
stems in two folders stay apart, and a file comes again under a new delivery: a path that was read once is not read again.
Each batch appends one folder to three logs, however many episodes it holds and however large one is: cues, coverage, and last the
list of files read. A reader joins the logs to the newest file of each episode in that list. What a broken batch wrote is in no
list; a batch run again replaces its own folders; a file without cues is in the list, so its episode has none.
Spark's file source passes over files of no bytes at all: what clears an episode holds at least a line break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuefold.functions.names import stem
from cuefold.operators.intervals import merge_intervals
from cuefold.session import durable
from cuefold.sources.stores import last_of, log_batch
from cuefold.sources.subtitles import subrip_cues

FILE_SCHEMA = "value string"
KEY = ["folder", "episode_id"]
FILE = [*KEY, "path"]
LOGS = {
    "files": "folder string, episode_id string, path string, modified timestamp, batch bigint",
    "cues": "folder string, episode_id string, path string, start_ms bigint, end_ms bigint, text string, batch bigint",
    "coverage": "folder string, episode_id string, path string, speech_ms bigint, islands bigint, cues bigint, batch bigint",
}


def file_stream(spark: SparkSession, inbox: str, max_files: int = 1000) -> DataFrame:
    """Whole SubRip files as they land: folder, episode_id (the file's stem), path below the inbox, modified, content."""
    raw = spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").text(inbox, wholetext=True)
    root = "/" + inbox.split(":", 1)[-1].strip("/") + "/"
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.substr(whole, F.locate(root, whole) + len(root))
    folders = F.split(below, "/")
    folder = F.array_join(F.slice(folders, F.lit(2), F.greatest(F.size(folders) - 2, F.lit(0))), "/")
    return raw.select(folder.alias("folder"), stem(below).alias("episode_id"), below.alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("content"))


def coverage_rows(cues: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Speech time and islands per file."""
    islands = merge_intervals(cues, keys, count_as="cues")
    return islands.groupBy(*keys).agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).cast("bigint").alias("speech_ms"), F.count(F.lit(1)).alias("islands"), F.sum("cues").cast("bigint").alias("cues")
    )


def store_batch(batch: DataFrame, number: int, store: str) -> None:
    """Append a batch of files to the logs of `store`; the list of files comes last and makes it visible."""
    cues = durable(subrip_cues(batch.select(*FILE, "content")).select(*FILE, "start_ms", "end_ms", "text"))
    log_batch(cues, f"{store}/cues", number)
    log_batch(coverage_rows(cues), f"{store}/coverage", number)
    log_batch(batch.select(*FILE, "modified"), f"{store}/files", number)


def _log(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.schema(LOGS[name]).parquet(f"{store}/{name}")


def current(spark: SparkSession, store: str, name: str) -> DataFrame:
    """Rows of a log (`files`, `cues` or `coverage`) that belong to the newest file of their episode.

    The newest is the one modified last, of equal times the one of the later path. Episodes whose file has no cues have no rows in
    `cues` and `coverage`.
    """
    newest = last_of(_log(spark, store, "files"), KEY, F.struct("modified", "path", "batch"), "path", "batch")
    return _log(spark, store, name).join(newest, [*FILE, "batch"], "left_semi").drop("batch")


def follow(spark: SparkSession, inbox: str, store: str, checkpoint: str) -> StreamingQuery:
    """Start the job: every file that has come since the last run goes to the logs of `store`."""
    return (
        file_stream(spark, inbox).writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, store))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
