"""Media catalogue: video files, episode numbers by natural order, sidecar subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefold.functions import names as n
from cuefold.operators.ranking import ranked

# Extensions of videos and of sidecar subtitles.
VIDEO = (".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".ts")
SIDECAR = (".srt", ".ass", ".ssa", ".vtt", ".idx")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Direct children of a folder (or one file): path, size, modified. File contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def videos(files: DataFrame) -> DataFrame:
    return files.where(n.suffix(F.col("path")).isin(*VIDEO))


def number_episodes(files: DataFrame, project: str = "project") -> DataFrame:
    """E01, E02, ... in natural order of the file names; the title is the name's stem.

    A folder may hold most of the archive, so ranks come from a range partitioning.
    """
    keyed = files.withColumn("_key", n.natural_key(F.col("path")))
    numbered = ranked(keyed, [project], ["_key", "path"], "ordinal")
    return numbered.select(
        *[c for c in files.columns], "ordinal",
        F.format_string("E%02d", F.col("ordinal")).alias("episode_id"), n.stem(F.col("path")).alias("title"),
    )


def _stem_heads(stem: Column) -> Column:
    """The stem itself and each head of it that a dot, underscore or dash follows."""
    at = F.sequence(F.lit(2), F.greatest(F.length(stem), F.lit(2)))
    heads = F.transform(at, lambda i: F.when(F.substr(stem, i, F.lit(1)).isin(".", "_", "-"), F.substr(stem, F.lit(1), i - 1)))
    return F.array_distinct(F.concat(F.array(stem), F.filter(heads, lambda h: h.isNotNull())))


def match_sidecars(media: DataFrame, files: DataFrame) -> DataFrame:
    """(video, sidecar) pairs of one folder that belong together.

    A sidecar that states numbers must share an episode (and the season where both state one)
    and must not name another show. One without numbers must carry the video's stem. Both rules
    are equi joins: on (folder, episode) and on (folder, head of the stem).

    media: video (path), optional episode_id; files: path.
    """
    given = F.col("episode_id") if "episode_id" in media.columns else F.lit("")
    own = F.array_union(n.episode_numbers(n.file_name(F.col("video"))), n.episode_numbers(F.coalesce(given, F.lit(""))))
    left = media.select(
        "video", folder(F.col("video")).alias("dir"), own.alias("_own"),
        n.show_prefix(F.col("video")).alias("_v_show"), F.lower(n.stem(F.col("video"))).alias("_v_stem"),
    )
    side = files.where(n.suffix(F.col("path")).isin(*SIDECAR))
    right = side.select(
        F.col("path").alias("sidecar"), folder(F.col("path")).alias("dir"),
        n.episode_numbers(n.file_name(F.col("path"))).alias("_has"),
        n.show_prefix(F.col("path")).alias("_s_show"), F.lower(n.stem(F.col("path"))).alias("_s_stem"),
    )
    numbered_v = left.select("video", "dir", "_v_show", F.explode("_own").alias("_v")).withColumn("episode", F.col("_v.episode"))
    numbered_s = right.select("sidecar", "dir", "_s_show", F.explode("_has").alias("_s")).withColumn("episode", F.col("_s.episode"))
    seasons = F.col("_v.season").isNull() | F.col("_s.season").isNull() | (F.col("_v.season") == F.col("_s.season"))
    shows = (
        (F.col("_v_show") == "") | (F.col("_s_show") == "")
        | F.contains("_v_show", "_s_show") | F.contains("_s_show", "_v_show")
    )
    by_number = numbered_v.join(numbered_s, ["dir", "episode"]).where(seasons & shows & (F.col("video") != F.col("sidecar")))
    heads = right.where(F.size("_has") == 0).select("sidecar", "dir", F.explode(_stem_heads(F.col("_s_stem"))).alias("_v_stem"))
    by_stem = left.select("video", "dir", "_v_stem").join(heads, ["dir", "_v_stem"]).where(F.col("video") != F.col("sidecar"))
    return by_number.select("video", "sidecar").unionByName(by_stem.select("video", "sidecar")).distinct()


def sidecar_tracks(media: DataFrame, files: DataFrame) -> DataFrame:
    """Track rows of the matching sidecars; an .idx counts only with its .sub beside it."""
    pairs = match_sidecars(media, files)
    subs = files.where(n.suffix(F.col("path")) == ".sub").select(F.regexp_replace("path", r"\.[^.]+$", "").alias("_base"))
    idx = pairs.where(n.suffix(F.col("sidecar")) == ".idx").withColumn("_base", F.regexp_replace("sidecar", r"\.[^.]+$", ""))
    whole = pairs.where(n.suffix(F.col("sidecar")) != ".idx").unionByName(idx.join(subs, "_base", "left_semi").drop("_base"))
    words = n.name_tokens(F.col("sidecar"), n.stem(F.col("video")))
    shaped = whole.withColumns({
        "source_format": n.sidecar_format(F.col("sidecar")), "is_forced": n.sidecar_forced(words), "language": n.sidecar_language(words),
    })
    bitmap = F.col("source_format") == "vobsub"
    v, s = F.lower(n.stem(F.col("video"))), F.lower(n.stem(F.col("sidecar")))
    score = F.when(bitmap, 50).otherwise(100) + F.when(s == v, 15).when(F.startswith(s, v), 10).otherwise(0)
    return shaped.select(
        "video", F.concat(F.lit("sidecar:"), n.file_name(F.col("sidecar"))).alias("track_id"), F.lit("sidecar").alias("source_type"),
        "source_format", "language", "is_forced", bitmap.alias("is_bitmap"), score.cast("double").alias("score"),
    )
