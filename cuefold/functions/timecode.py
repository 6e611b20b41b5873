"""Time stamps of subtitle formats to BIGINT milliseconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stamp shapes of the three formats.
SRT = r"^(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{1,3})"
VTT = r"^(?:(?:(\d+):)?(\d{2}):)?(\d{2})[.,](\d{1,3})"
ASS = r"^(\d+):(\d{2}):(\d{2})[.,](\d{1,3})"


def _parse(text: Column, shape: str) -> Column:
    stamp = F.trim(text)
    part = lambda i: F.coalesce(F.regexp_extract(stamp, shape, i).try_cast("bigint"), F.lit(0).cast("bigint"))
    millis = F.rpad(F.regexp_extract(stamp, shape, 4), 3, "0").try_cast("bigint")
    return F.when(stamp.rlike(shape), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + millis)


def srt_ms(text: Column) -> Column:
    """'HH:MM:SS,mmm' with hours optional; null when malformed."""
    return _parse(text, SRT)


def vtt_ms(text: Column) -> Column:
    """'HH:MM:SS.mmm' with hours and minutes optional; null when malformed."""
    return _parse(text, VTT)


def ass_ms(text: Column) -> Column:
    """'H:MM:SS.cc'; one digit counts tenths, two hundredths, three thousandths."""
    return _parse(text, ASS)


def loose_ms(text: Column) -> Column:
    """Any 'H:M:S.fff', 'M:S.fff' or 'S.fff', rounded to the millisecond."""
    parts = F.reverse(F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":"))
    number = lambda i: F.coalesce(F.get(parts, i).try_cast("decimal(20,6)"), F.lit(0))
    seconds = number(0) + number(1) * 60 + number(2) * 3600
    return F.bround(seconds * 1000).cast("bigint")


def stamp(ms: Column, mark: str = ",") -> Column:
    """'HH:MM:SS,mmm' (or with '.' for `mark`)."""
    whole = F.greatest(ms, F.lit(0)).cast("bigint")
    part = lambda size, wrap: F.floor(whole / F.lit(size)) % F.lit(wrap) if wrap else F.floor(whole / F.lit(size))
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), whole % 1000)
