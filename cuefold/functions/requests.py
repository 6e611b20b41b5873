"""Byte sizes of model requests and the texts they carry."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuefold.functions.timecode import stamp

TARGET_BYTES = 480_000
HARD_BYTES = 500_000
CAPPED = "... [capped]"


def escaped_bytes(text: Column) -> Column:
    """UTF-8 bytes of `text` inside a JSON string; escapes count per character, so sizes add up."""
    short = F.regexp_count(text, F.lit(r'["\\\n\r\t\x08\x0c]'))
    long = F.regexp_count(text, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]"))
    return (F.octet_length(text) + short + long * 5).cast("bigint")


def envelope_bytes(model: str, system: str = "", thinking: str = "auto", max_tokens: int = 32_000) -> int:
    """Bytes of a request whose user text is empty. One constant per run, taken once on the driver."""
    body = {
        "model": model.strip(),
        "messages": [{"role": "system", "content": system}, {"role": "user", "content": [{"type": "text", "text": ""}]}],
        "temperature": 0.1, "max_tokens": max_tokens, "stream": False, "response_format": {"type": "json_object"},
    }
    if thinking and thinking.casefold() != "auto":
        body["reasoning_effort"] = thinking.casefold()
    return len(json.dumps(body, ensure_ascii=False).encode())


def seconds(ms: Column) -> Column:
    """Seconds with one decimal."""
    return F.format_string("%.1f", ms / F.lit(1000.0))


def transcript_line(start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("["), stamp(start, "."), F.lit(" - "), stamp(end, "."), F.lit("] "), text)


def no_dialogue(start: Column, end: Column) -> Column:
    return F.concat(F.lit("[No spoken dialogue in range "), seconds(start), F.lit("s - "), seconds(end), F.lit("s]"))


def scan_header(episode: Column, video: Column, start: Column, end: Column, duration: Column) -> Column:
    """What a scan request says before its transcript."""
    return F.concat(
        F.lit("Episode ID: "), episode, F.lit("\nSource Video: "), video, F.lit("\nAbsolute Range: "), start.cast("string"), F.lit(" to "),
        end.cast("string"), F.lit(" ms ("), seconds(start), F.lit("s - "), seconds(end), F.lit("s) ("), stamp(start, "."), F.lit(" - "), stamp(end, "."),
        F.lit(")\nEpisode Duration: "), seconds(duration), F.lit("s\n\nTimestamped Transcript Excerpt:\n"),
    )


def cap_text(text: Column, room: Column) -> Column:
    """Longest prefix that fits `room` escaped bytes with the capped mark; the mark alone, or '', below that.

    A character takes a byte at least: nothing longer than the room is looked at, and what is too large by n bytes fits without its
    last n characters. Sizes grow with the prefix, so how many of these n still fit is found by halving.
    """
    mark = len(CAPPED)
    limit = room - mark
    # A one-element array works a value out once, however often it is used.
    once = lambda value, use: F.transform(F.array(value), use)[0]
    head = F.substr(text, F.lit(1), F.greatest(limit, F.lit(0)).cast("int"))
    sized = lambda h: F.struct(h.alias("head"), F.greatest(escaped_bytes(h) - limit, F.lit(0)).cast("int").alias("over"))
    parted = lambda s: F.struct(
        F.substr(s["head"], F.lit(1), F.greatest(F.char_length(s["head"]) - s["over"], F.lit(0))).alias("sure"),
        F.substr(s["head"], F.greatest(F.char_length(s["head"]) - s["over"], F.lit(0)) + 1, s["over"]).alias("rest"),
    )
    measured = lambda p: F.struct(F.char_length(p["sure"]).alias("kept"), (limit - escaped_bytes(p["sure"])).alias("room"), p["rest"].alias("rest"))

    def halved(m: Column) -> Column:
        n_bits = F.floor(F.log2(F.greatest(F.char_length(m["rest"]), F.lit(1)).cast("double"))).cast("int")
        steps = F.transform(F.sequence(n_bits, F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
        fits = lambda n: (n <= F.char_length(m["rest"])) & (escaped_bytes(F.substr(m["rest"], F.lit(1), n)) <= m["room"])
        return m["kept"] + F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))

    kept = once(head, lambda h: once(sized(h), lambda s: once(parted(s), lambda p: once(measured(p), halved))))
    short = F.when(limit >= 0, F.concat(F.substr(text, F.lit(1), kept), F.lit(CAPPED))).otherwise(F.lit(""))
    return F.when(escaped_bytes(text) <= room, text).otherwise(short)
