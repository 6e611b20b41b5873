"""Decisions over the streams of an ordered list of clips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = ("", "unknown", "none")


def _unknown(name: str, *more: str) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).isin(*UNKNOWN, *more)


def concat_differences(clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per reason why clips cannot be joined by stream copy: keys, ordinal, code.

    clips carry an `ordinal` from 0 and the signature columns; every property must be known and
    equal to the first clip's. The first clip is found by an aggregation and joined back.
    """
    v = ("video_codec", "video_profile", "width", "height", "pix_fmt", "fps", "video_time_base", "sar")
    a = ("audio_codec", "sample_rate", "sample_fmt", "channels", "channel_layout", "audio_time_base")
    base = clips.groupBy(*keys).agg(F.min_by(F.struct(*v, "has_audio", *a), "ordinal").alias("_b"), F.min("ordinal").alias("_first"))
    met = clips.join(base, list(keys))
    known = [
        (_unknown("video_codec"), "video_codec_unknown"), (_unknown("video_profile", "und"), "video_profile_unknown"),
        ((F.col("width") <= 0) | (F.col("height") <= 0), "invalid_dimensions"), (_unknown("pix_fmt"), "pix_fmt_unknown"),
        (F.col("fps").isin("", "0/0", "0/1", "0"), "fps_unknown"), (_unknown("video_time_base", "0/0", "0"), "video_timebase_unknown"),
        (_unknown("sar", "0:1", "0/1", "0:0", "0/0"), "sar_unknown"),
    ]
    heard = [
        (_unknown("channel_layout"), "audio_channel_layout_unknown"), (_unknown("audio_codec"), "audio_codec_unknown"),
        (F.col("sample_rate") <= 0, "sample_rate_unknown"), (_unknown("sample_fmt"), "sample_fmt_unknown"),
        (F.col("channels") <= 0, "channels_unknown"), (_unknown("audio_time_base", "0/0", "0"), "audio_timebase_unknown"),
    ]
    later = F.col("ordinal") > F.col("_first")
    exact = lambda c: F.col(c) != F.col(f"_b.{c}")
    folded = lambda c: F.lower(c) != F.lower(F.col(f"_b.{c}"))
    seen = [
        (folded("video_codec"), "video_codec_mismatch"), (folded("video_profile"), "video_profile_mismatch"),
        (exact("width") | exact("height"), "resolution_mismatch"), (folded("pix_fmt"), "pix_fmt_mismatch"), (exact("fps"), "fps_mismatch"),
        (exact("video_time_base"), "video_timebase_mismatch"), (exact("sar"), "sar_mismatch"),
    ]
    both = F.col("has_audio") & F.col("_b.has_audio")
    sound = [
        (folded("audio_codec"), "audio_codec_mismatch"), (exact("sample_rate"), "sample_rate_mismatch"),
        (folded("sample_fmt"), "sample_fmt_mismatch"), (exact("channels"), "channels_mismatch"),
        (folded("channel_layout"), "channel_layout_mismatch"), (exact("audio_time_base"), "audio_timebase_mismatch"),
    ]
    tests = [F.when(t, F.lit(code)) for t, code in known]
    tests += [F.when(F.col("has_audio") & t, F.lit(code)) for t, code in heard]
    tests += [F.when(later & exact("has_audio"), F.lit("audio_presence_mismatch"))]
    tests += [F.when(later & t, F.lit(code)) for t, code in seen]
    tests += [F.when(later & both & t, F.lit(code)) for t, code in sound]
    codes = F.filter(F.array(*tests), lambda c: c.isNotNull())
    return met.select(*keys, "ordinal", F.explode(codes).alias("code"))


def concat_decision(clips: DataFrame, keys: Sequence[str], require_audio: bool = False) -> DataFrame:
    """Whether each list of clips can be joined by stream copy, and how many reasons speak against it."""
    found = concat_differences(clips, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("differences"))
    lists = clips.groupBy(*keys).agg(F.max("has_audio").alias("_any"))
    mute = F.when(F.lit(require_audio) & ~F.col("_any"), 1).otherwise(0)
    total = F.coalesce("differences", F.lit(0)) + mute
    return lists.join(found, list(keys), "left").select(*keys, (total == 0).alias("compatible"), total.cast("bigint").alias("differences"))


def normalisation_profile(clips: DataFrame, keys: Sequence[str], synthesize_audio: bool = True) -> DataFrame:
    """Common canvas and rate: the first valid size floored to even, the first known rate."""
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    rated = ~F.col("fps").isin("", "0/0", "0/1", "0")
    first = lambda value, test: F.min_by(F.when(test, value), F.when(test, F.col("ordinal")))
    even = lambda c: F.greatest(F.lit(2), F.floor(F.col(c) / 2).cast("int") * 2)
    out = clips.groupBy(*keys).agg(
        first(F.struct(even("width").alias("w"), even("height").alias("h")), sized).alias("_c"),
        first(F.col("fps"), rated).alias("fps"), F.max("has_audio").alias("_any"),
    )
    return out.select(
        *keys, F.coalesce("_c.w", F.lit(1920)).alias("width"), F.coalesce("_c.h", F.lit(1080)).alias("height"),
        F.coalesce("fps", F.lit("24/1")).alias("fps"), (F.col("_any") | F.lit(synthesize_audio)).alias("requires_audio"),
    )
