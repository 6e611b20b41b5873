"""Readers that turn subtitle documents into cue rows, and the SubRip sink.

Each reader takes a table with one document per row (`content`) and adds nothing but array
expressions and one explode, so no shuffle is needed; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuefold.functions.text import strip_formatting
from cuefold.functions.timecode import ass_ms, loose_ms, srt_ms, stamp, vtt_ms

BLOCK_BREAK = r"\n\s*\n+"
LINE_BREAK = "\\n|[\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
# The cue timing lines, and the column order assumed without a Format line.
SRT_TIMES = r"(\d{1,2}:\d{2}:\d{2}[,\.]\d{1,3})\s*-->\s*(\d{1,2}:\d{2}:\d{2}[,\.]\d{1,3})"
VTT_TIMES = r"((?:\d{1,2}:)?\d{2}:\d{2}[,\.]\d{1,3})\s*-->\s*((?:\d{1,2}:)?\d{2}:\d{2}[,\.]\d{1,3})"
LOOSE_TIMES = r"(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)\r?\n"
ASS_FIELDS = ("layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text")


def read_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Whole text files: path, content. A byte order mark is dropped."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("content"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n|\r", "\n")


def _block_cues(documents: DataFrame, body: Column, times: str, parse, skip_notes: bool) -> DataFrame:
    carried = [c for c in documents.columns if c != "content"]
    blocks = documents.select(*carried, F.posexplode(F.split(_strip(body), BLOCK_BREAK)).alias("block", "_b"))
    lines = F.filter(F.transform(F.split("_b", LINE_BREAK), _strip), lambda s: s != "")
    at = F.array_position(F.transform("_l", lambda s: s.rlike(times)), True)
    timed = blocks.withColumn("_l", lines).withColumn("_at", at).where(F.col("_at") > 0)
    if skip_notes:
        timed = timed.where(~F.startswith(F.get("_l", F.lit(0)), F.lit("NOTE")))
    # `get` and not `element_at`: the filter may be evaluated after this.
    line = F.get("_l", F.col("_at").cast("int") - 1)
    text = F.array_join(F.slice("_l", F.col("_at").cast("int") + 1, F.size("_l")), "\n")
    cues = timed.select(
        *carried, "block",
        parse(F.regexp_extract(line, times, 1)).alias("start_ms"), parse(F.regexp_extract(line, times, 2)).alias("end_ms"),
        text.alias("_raw"),
    ).where(F.col("end_ms") > F.col("start_ms"))
    return _clean(cues)


def _clean(cues: DataFrame) -> DataFrame:
    # Behind a generator the text is worked out once, not again for the filter.
    return cues.withColumn("text", F.explode(F.array(strip_formatting(F.col("_raw"))))).drop("_raw").where(F.col("text") != "")


def subrip_cues(documents: DataFrame) -> DataFrame:
    """SubRip: blocks between blank lines, the first timing line, the text after it."""
    return _block_cues(documents, _unix_lines(F.col("content")), SRT_TIMES, srt_ms, False)


def webvtt_cues(documents: DataFrame) -> DataFrame:
    """WebVTT: the header block goes, NOTE blocks are skipped, hours are optional."""
    text = _unix_lines(F.col("content"))
    body = F.when(F.startswith(text, F.lit("WEBVTT")), F.coalesce(F.get(F.split(text, BLOCK_BREAK, 2), F.lit(1)), F.lit(""))).otherwise(text)
    return _block_cues(documents, body, VTT_TIMES, vtt_ms, True)


def ass_cues(documents: DataFrame) -> DataFrame:
    """ASS/SSA: the [Events] section; the last Format line before a Dialogue names its columns."""
    carried = [c for c in documents.columns if c != "content"]
    lines = F.filter(
        F.transform(F.split(_unix_lines(F.col("content")), LINE_BREAK), _strip),
        lambda s: (s != "") & ~F.startswith(s, F.lit(";")),
    )
    numbered = F.transform(lines, lambda s, i: F.struct(i.alias("at"), s.alias("line"), F.lower(s).alias("low")))
    is_events = lambda r: F.startswith(r["low"], F.lit("[events]"))
    opened = F.get(F.transform(F.filter("_rows", is_events), lambda r: r["at"]), F.lit(0))
    docs = documents.select(*carried, numbered.alias("_rows")).withColumn("_open", opened).where("_open is not null")
    closes = F.filter("_rows", lambda r: (r["at"] > F.col("_open")) & F.startswith(r["line"], F.lit("[")) & ~is_events(r))
    docs = docs.withColumn("_close", F.coalesce(F.get(F.transform(closes, lambda r: r["at"]), F.lit(0)), F.lit(2**31 - 1)))
    section = F.filter("_rows", lambda r: (r["at"] > F.col("_open")) & (r["at"] < F.col("_close")))
    docs = docs.withColumn("_rows", section)
    formats = F.transform(
        F.filter("_rows", lambda r: F.startswith(r["low"], F.lit("format:"))),
        lambda r: F.struct(r["at"].alias("at"), F.transform(F.split(F.substr(r["low"], F.lit(8)), ","), _strip).alias("names")),
    )
    docs = docs.withColumn("_formats", formats)
    spoken = docs.select(*carried, "_formats", F.explode(F.filter("_rows", lambda r: F.startswith(r["low"], F.lit("dialogue:")))).alias("_r"))
    before = F.filter("_formats", lambda f: f["at"] < F.col("_r.at"))
    names = F.coalesce(F.try_element_at(before, F.lit(-1))["names"], F.array(*map(F.lit, ASS_FIELDS)))
    payload = _strip(F.substr(F.col("_r.line"), F.lit(10)))
    split = spoken.withColumn("_names", names).withColumn("_parts", F.split(payload, ",", F.size("_names")))
    whole = split.where(F.size("_parts") == F.size("_names"))
    field = lambda name: F.coalesce(F.get("_parts", (F.array_position("_names", name) - 1).cast("int")), F.lit(""))
    present = lambda name: F.when(F.array_position("_names", name) > 0, field(name)).otherwise(F.lit(""))
    cues = whole.select(
        *carried, F.col("_r.at").alias("block"), ass_ms(present("start")).alias("start_ms"),
        ass_ms(present("end")).alias("end_ms"), present("text").alias("_raw"),
    ).where(F.col("end_ms") > F.col("start_ms"))
    return _clean(cues)


def loose_cues(documents: DataFrame) -> DataFrame:
    """The forgiving SubRip reader: tags go, line breaks become blanks, end may precede start."""
    carried = [c for c in documents.columns if c != "content"]
    whole = LOOSE_TIMES + r"([\s\S]*?)(?=\r?\n\r?\n|\z)"
    found = F.regexp_extract_all("content", F.lit(whole), F.lit(0))
    rows = documents.select(*carried, F.posexplode(found).alias("block", "_m"))
    text = F.replace(F.regexp_replace(F.regexp_extract("_m", "^" + LOOSE_TIMES + r"([\s\S]*)$", 3), "<[^>]+>", ""), F.lit("\n"), F.lit(" "))
    return rows.select(
        *carried, "block", loose_ms(F.regexp_extract("_m", LOOSE_TIMES, 1)).alias("start_ms"),
        loose_ms(F.regexp_extract("_m", LOOSE_TIMES, 2)).alias("end_ms"), _strip(text).alias("text"),
    ).where(F.col("text") != "")


def companion_cues(videos: DataFrame, documents: DataFrame) -> DataFrame:
    """Cues of the first companion file, in order of preference, that yields any.

    videos: video, stem (path without its extension); documents: path, content.
    """
    # The companion endings, best first.
    endings = (".srt", ".vtt", "_en.srt")
    wanted = videos.select("video", F.posexplode(F.array(*[F.concat("stem", F.lit(e)) for e in endings])).alias("rank", "path"))
    cues = loose_cues(documents).join(wanted, "path")
    best = cues.groupBy("video").agg(F.min("rank").alias("rank"))
    return cues.join(best, ["video", "rank"], "left_semi")


def cue_fields(cue: Column) -> Column:
    """struct(start_sec, end_sec, text) of a cue's JSON text: an object in seconds, else in milliseconds, or a list of start, end, text.

    A time that is absent is 0, one that is no number is null; anything else is a cue of no length and no text.
    """
    value = F.try_parse_json(cue)
    parts = F.try_variant_get(value, "$", "array<variant>")
    listed = F.size(parts) >= 3
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    given = lambda name: F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", "double")
    has = lambda name: F.coalesce(F.map_contains_key(fields, name), F.lit(False))
    at = lambda place, edge: (
        F.when(listed, F.try_variant_get(F.get(parts, F.lit(place)), "$", "double")).when(has(f"{edge}_sec"), given(f"{edge}_sec"))
        .when(has(f"{edge}_ms"), given(f"{edge}_ms") / 1000).otherwise(0.0)
    )
    text = F.when(listed, F.try_variant_get(F.get(parts, F.lit(2)), "$", "string")).otherwise(F.try_variant_get(F.try_element_at(fields, F.lit("text")), "$", "string"))
    return F.struct(at(0, "start").alias("start_sec"), at(1, "end").alias("end_sec"), F.coalesce(text, F.lit("")).alias("text"))


def srt_text(cues: DataFrame, keys: Sequence[str], order: Sequence[str] = ("start_ms", "end_ms")) -> DataFrame:
    """One SubRip document per key: numbered blocks of the cues that say something."""
    kept = cues.where(F.trim("text") != "")
    numbered = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    block = F.concat(
        F.col("_n"), F.lit("\n"), stamp(F.col("start_ms")), F.lit(" --> "), stamp(F.col("end_ms")), F.lit("\n"), _strip(F.col("text")), F.lit("\n"),
    )
    return (
        numbered.withColumn("_block", block).groupBy(*keys)
        .agg(F.expr("listagg(_block, '\n') WITHIN GROUP (ORDER BY _n)").alias("content"))
    )


def write_srt(cues: DataFrame, keys: Sequence[str], path: str) -> None:
    """Write one text document per key, in folders partitioned by the keys."""
    srt_text(cues, keys).withColumnRenamed("content", "value").write.mode("overwrite").partitionBy(*keys).text(path)
