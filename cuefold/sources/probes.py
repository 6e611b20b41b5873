"""Probe documents (JSON stream lists) to typed stream rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuefold.functions.names import language_code
from cuefold.functions.rational import aspect_ratio, frame_rate, time_base

# Title words that mark commentary and described audio, and picture codecs.
COMMENTARY = ("commentary", "director", "comment", "cast", "crew", "reaction", "trivia", "riff", "spoilers")
DESCRIBED = ("audio description", "visual description", "dvs", "descriptive", "visually impaired", "hearing impaired")
PICTURES = ("hdmv_pgs_subtitle", "dvd_subtitle", "dvdsub", "pgs")

STREAM = (
    "index string, codec_type string, codec_name string, profile string, width string, height string, pix_fmt string, "
    "avg_frame_rate string, r_frame_rate string, time_base string, sample_aspect_ratio string, sar string, "
    "channels string, channel_layout string, bit_rate string, sample_rate string, sample_fmt string, "
    "start_time string, duration string, nb_read_packets string, nb_frames string, "
    "tags struct<title:string, language:string>, "
    "disposition struct<default:string, forced:string, commentary:string, descriptions:string, visual_impaired:string, hearing_impaired:string>"
)


def probe_streams(documents: DataFrame) -> DataFrame:
    """One row per stream with per-type ordinals: path, kind, ordinal and the typed fields.

    documents: path, content (a JSON object with `streams`).
    """
    parsed = documents.select("path", F.from_json("content", f"streams array<struct<{_nested()}>>").alias("_d"))
    rows = parsed.select("path", F.posexplode("_d.streams").alias("_at", "_s"))
    typed = rows.where(F.col("_s.codec_type").isin("video", "audio", "subtitle"))
    number = lambda c, t="int": F.coalesce(F.col(f"_s.{c}").try_cast(t), F.lit(0).cast(t))
    text = lambda c: F.coalesce(F.col(f"_s.{c}"), F.lit(""))
    flag = lambda c: F.coalesce(F.col(f"_s.disposition.{c}").isin("1", "true"), F.lit(False))
    title = F.coalesce(F.col("_s.tags.title"), F.lit(""))
    low = F.lower(title)
    says = lambda words: low.rlike("|".join(words))
    avg, real = frame_rate(F.col("_s.avg_frame_rate")), frame_rate(F.col("_s.r_frame_rate"))
    kind = F.col("_s.codec_type")
    ordinal = F.row_number().over(Window.partitionBy("path", kind).orderBy("_at")) - 1
    return typed.select(
        "path", kind.alias("kind"), ordinal.alias("ordinal"), number("index").alias("idx"), text("codec_name").alias("codec"),
        title.alias("title"), language_code(F.col("_s.tags.language")).alias("language"), flag("default").alias("is_default"),
        (flag("forced") | ((kind == "subtitle") & F.contains(low, F.lit("forced")))).alias("is_forced"),
        ((kind == "audio") & (flag("commentary") | says(COMMENTARY))).alias("is_commentary"),
        ((kind == "audio") & (flag("descriptions") | flag("visual_impaired") | flag("hearing_impaired") | says(DESCRIBED))).alias("is_descriptive"),
        ((kind == "subtitle") & F.lower(text("codec_name")).isin(*PICTURES)).alias("is_bitmap"),
        text("profile").alias("profile"), number("width").alias("width"), number("height").alias("height"), text("pix_fmt").alias("pix_fmt"),
        F.when(avg != "", avg).otherwise(real).alias("fps"), time_base(F.col("_s.time_base")).alias("time_base"),
        aspect_ratio(F.coalesce(F.nullif(F.col("_s.sample_aspect_ratio"), F.lit("")), F.col("_s.sar"))).alias("sar"),
        number("channels").alias("channels"), text("channel_layout").alias("channel_layout"), number("bit_rate", "bigint").alias("bitrate"),
        number("sample_rate").alias("sample_rate"), text("sample_fmt").alias("sample_fmt"),
        number("start_time", "double").alias("start_s"), number("duration", "double").alias("duration_s"),
        F.col("_s.nb_read_packets").alias("packets"), F.col("_s.nb_frames").alias("frames"),
    )


def _nested() -> str:
    """The stream schema in the colon form that nested struct fields take."""
    out, depth = [], 0
    for piece in STREAM.split(", "):
        depth_before = depth
        depth += piece.count("<") - piece.count(">")
        out.append(piece if depth_before else piece.replace(" ", ": ", 1))
    return ", ".join(out)
