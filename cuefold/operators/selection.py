"""Choosing one row of a group: subtitle track, audio stream, first level that fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.functions.names import language_code

# Codecs by subtitle format, and those that hold pictures.
TEXT_FORMATS = {"subrip": "srt", "srt": "srt", "ass": "ass", "ssa": "ass", "webvtt": "vtt"}
PICTURE_FORMATS = {"hdmv_pgs_subtitle": "pgs", "pgs": "pgs", "dvd_subtitle": "vobsub", "dvdsub": "vobsub"}


def embedded_tracks(streams: DataFrame) -> DataFrame:
    """Track rows of embedded subtitle streams.

    streams: video, idx, codec, language, title, is_default, is_forced.
    """
    low = F.lower("codec")
    table = F.create_map(*[F.lit(x) for pair in {**TEXT_FORMATS, **PICTURE_FORMATS}.items() for x in pair])
    fmt = F.coalesce(F.try_element_at(table, low), low)
    bitmap = low.isin(*PICTURE_FORMATS)
    title = F.lower("title")
    forced = F.col("is_forced") | F.contains(title, F.lit("forced")) | F.contains(title, F.lit("foreign"))
    score = F.when(bitmap, 50).otherwise(100) + F.when(F.col("is_default"), 10).otherwise(0) + F.when(fmt == "ass", 5).otherwise(0)
    return streams.select(
        "video", F.format_string("embedded:%d:%s", F.col("idx"), fmt).alias("track_id"), F.lit("embedded").alias("source_type"),
        fmt.alias("source_format"), language_code(F.col("language")).alias("language"), forced.alias("is_forced"),
        bitmap.alias("is_bitmap"), score.cast("double").alias("score"), F.col("idx").cast("bigint").alias("ordinal"),
    )


def best_subtitles(tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best full English track per key: text before pictures, then score, then sidecars, then first.

    One map-side combined aggregation; `stt_required` where there is none.
    """
    full = ~F.col("is_forced") & (F.col("language") == "eng")
    text = ~F.col("is_bitmap")
    rank = F.struct(text, F.col("score"), text & (F.col("source_type") == "sidecar"), -F.col("ordinal"))
    best = F.max_by(F.when(full, F.col("track_id")), F.when(full, rank))
    return tracks.groupBy(*keys).agg(
        best.alias("track_id"), F.count_if("is_forced").alias("forced_tracks"),
        (~F.max(full)).alias("stt_required"),
    )


def best_audio(streams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Programme audio per key: clean English, else clean, else the lowest index, with a reason.

    streams: keys, idx, language, is_default, channels, bitrate, is_commentary, is_descriptive.
    """
    clean = ~F.col("is_commentary") & ~F.col("is_descriptive")
    tier = F.when(clean & (F.col("language") == "eng"), 2).when(clean, 1).otherwise(0)
    quality = lambda c: F.when(tier > 0, c).otherwise(F.lit(0))
    rank = F.struct(tier, quality(F.col("is_default").cast("int")), quality(F.col("channels")), quality(F.col("bitrate")), -F.col("idx"))
    best = streams.groupBy(*keys).agg(F.max_by(F.struct("idx", tier.alias("tier")), rank).alias("_b"))
    reason = F.when(F.col("_b.tier") == 2, "english").when(F.col("_b.tier") == 1, "fallback_non_english").otherwise("fallback_commentary")
    return best.select(*keys, F.col("_b.idx").alias("idx"), reason.alias("reason"), (F.col("_b.tier") < 2).alias("has_warning"))


def first_fitting(levels: DataFrame, keys: Sequence[str], cap: int, rank: str = "rank", size: str = "bytes", value: str = "level") -> DataFrame:
    """First level in rank order whose size fits under `cap`; null where none does."""
    fits = F.col(size) <= cap
    return levels.groupBy(*keys).agg(F.min_by(F.when(fits, F.col(value)), F.when(fits, F.col(rank))).alias(value))


def cap_list(values: Column, items: int) -> Column:
    """The head of an array."""
    return F.slice(values, 1, items)
