"""File and title names: natural order, episode numbers, languages, safe titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language names and codes to ISO 639-2.
LANGUAGES = {
    "en": "eng", "eng": "eng", "english": "eng", "en-us": "eng", "en-gb": "eng",
    "vi": "vie", "vie": "vie", "vietnamese": "vie",
    "ja": "jpn", "jpn": "jpn", "japanese": "jpn",
    "es": "spa", "spa": "spa", "spanish": "spa",
    "fr": "fra", "fra": "fra", "fre": "fra", "french": "fra",
    "de": "deu", "deu": "deu", "ger": "deu", "german": "deu",
    "zh": "zho", "zho": "zho", "chi": "zho", "chinese": "zho",
    "ko": "kor", "kor": "kor", "korean": "kor",
    "it": "ita", "ita": "ita", "italian": "ita",
    "pt": "por", "por": "por", "portuguese": "por",
    "ru": "rus", "rus": "rus", "russian": "rus",
    "und": "und", "undefined": "und",
}
# The ways a file name states season and episode. "\b" in a class is a backspace.
SEASON_EPISODE = r"[sS](\d+)\s*[-_.]?\s*[eE](\d+)"
CROSS = r"(\d+)x(\d+)"
EPISODE_ONLY = r"(?i)(?:^|[\x08_.\-\[\(])(?:ep|episode|e)\.?\s*(\d+)(?:$|[\x08_.\-\]\)])"
BRACKETED = r"[\[\(](\d{1,3})[\]\)]"
DASHED = r"\s+-\s+(\d{1,3})(?:[\x08_.\-\s]|$)"
MARKER = r"(?i)s\d+\s*[-_.]?\s*e\d+|\d+x\d+|(?:^|[\x08_.\-\[\(])(?:ep|episode|e)\.?\s*\d+"
FORCED = ("forced", "foreign", "supplemental")
FORMATS = {".srt": "srt", ".ass": "ass", ".ssa": "ssa", ".vtt": "vtt", ".idx": "vobsub"}
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)])

_LANGUAGE_MAP = None


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot opens no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def natural_key(path: Column) -> Column:
    """Sort key in which digit runs compare as numbers, and numbers come before text."""
    runs = F.regexp_extract_all(F.lower(file_name(path)), F.lit(r"\d+|\D+"), F.lit(0))
    number = lambda run: run.rlike(r"^\d+$")
    return F.transform(
        runs,
        lambda run: F.struct(
            F.when(number(run), 0).otherwise(1).alias("kind"),
            F.when(number(run), run.try_cast("decimal(38,0)")).alias("num"),
            F.when(~number(run), run).alias("txt"),
        ),
    )


def language_code(raw: Column) -> Column:
    """ISO 639-2 code: by table, by the part before '-' or '_', else the first three letters."""
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    table = F.create_map(*pairs)
    s = F.lower(F.trim(raw))
    known = F.coalesce(F.try_element_at(table, s), F.try_element_at(table, F.get(F.split(s, "[-_]"), F.lit(0))))
    return F.when(F.coalesce(raw, F.lit("")) == "", "und").otherwise(F.coalesce(known, F.substring(s, 1, 3)))


def episode_numbers(name: Column) -> Column:
    """Distinct (season, episode) pairs a name states; the season may be unknown."""
    s = F.trim(name)
    pick = lambda shape, group: F.regexp_extract_all(s, F.lit(shape), F.lit(group))
    pair = lambda season, episode: F.struct(season.cast("int").alias("season"), episode.cast("int").alias("episode"))

    def both(shape: str) -> Column:
        return F.zip_with(pick(shape, 1), pick(shape, 2), pair)

    def alone(shape: str) -> Column:
        return F.transform(pick(shape, 1), lambda e: pair(F.lit(None), e))

    found = F.concat(both(SEASON_EPISODE), both(CROSS), alone(EPISODE_ONLY), alone(BRACKETED), alone(DASHED))
    return F.array_distinct(found)


def show_prefix(name: Column) -> Column:
    """What stands before the first episode marker, tidied; '' when nothing does."""
    before = F.regexp_extract(stem(name), rf"^(.*?)(?:{MARKER.replace('(?i)', '(?i:')}))", 1)
    tidy = F.regexp_replace(F.regexp_replace(before, r"^[._\- ]+|[._\- ]+$", ""), r"[._\- ]+", " ")
    return F.lower(F.trim(tidy))


def name_tokens(name: Column, video_stem: Column) -> Column:
    """Words of a sidecar's name after the video's own stem."""
    low, own = F.lower(stem(name)), F.lower(video_stem)
    rest = F.when(F.startswith(low, own), F.substr(low, F.length(own) + 1)).otherwise(low)
    return F.filter(F.split(rest, r"[\._\-\s]+"), lambda t: t != "")


def sidecar_forced(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, FORCED)))


def sidecar_language(words: Column) -> Column:
    """First word that is not a forced marker and does not read as 'und'; English without one."""
    codes = F.transform(F.filter(words, lambda w: ~w.isin(*FORCED)), language_code)
    return F.coalesce(F.get(F.filter(codes, lambda c: c != "und"), F.lit(0)), F.lit("eng"))


def sidecar_format(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix(name)), F.lit("srt"))


def safe_title(title: Column, limit: int = 120) -> Column:
    """A file-safe title of at most `limit` characters, never empty."""
    t = F.trim(title)
    t = F.replace(t, F.lit(":"), F.lit(" - "))
    # Characters with a friendly stand-in, and those that simply go.
    t = F.translate(t, '/\\|"?*<>', "---'")
    t = F.regexp_replace(t, r"[\x00-\x1f]", " ")
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    edge = r"^[ ._]+|[ ._]+$"
    t = F.regexp_replace(t, edge, "")
    t = F.when(F.coalesce(t, F.lit("")) == "", F.lit("output")).otherwise(t)
    t = F.when(F.upper(F.get(F.split(t, r"\."), F.lit(0))).isin(*RESERVED), F.concat(t, F.lit("_output"))).otherwise(t)
    cut = F.when(F.length(t) > limit, F.regexp_replace(F.substring(t, 1, limit), r"[ ._]+$", "")).otherwise(t)
    return F.when(cut == "", F.lit("output")).otherwise(cut)
