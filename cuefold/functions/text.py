"""Text expressions: tokens, speaker tags, subtitle mark-up, transcript lines."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's \w is Unicode-aware, Java's is not.
WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column, longer_than: int = 0) -> Column:
    """Distinct lower-case words, optionally only those longer than `longer_than` characters."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    return F.filter(words, lambda w: F.length(w) > longer_than) if longer_than else words


def speaker(text: Column) -> Column:
    """Speaker named by '[Alice] ...' or 'Bob: ...', else null.

    Names of 1 to 40 characters that mention none of line, cue, segment, part.
    """
    tag = r"^(?:\[([^\]]+)\]|([^:]+):)\s*"
    trimmed = F.trim(text)
    bracketed = F.regexp_extract(trimmed, tag, 1)
    named = F.trim(F.when(bracketed != "", bracketed).otherwise(F.regexp_extract(trimmed, tag, 2)))
    usable = F.length(named).between(1, 40) & ~F.lower(named).rlike("line|cue|segment|part")
    # The tag counts only when no line break follows it.
    one_line = trimmed.rlike(r"^(?:\[[^\]]+\]|[^:]+:)\s*[^\n]*$")
    return F.when(usable & one_line, named)


#: Character references by name, and those of them that also count without a semicolon.
NAMED = html5
BARE = {name: text for name, text in html5.items() if not name.endswith(";")}
# A reference by number or by name, or what stands between references.
REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32};?)|[^&]++|&"
UNKNOWN = "\ufffd"


def _table(entries: dict[str, str]) -> Column:
    """A map the optimiser folds to one constant."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _character(digits: Column, base: int) -> Column:
    """The character of a number, by the rules of HTML: bytes of the old Windows page, nothing for what is no character."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    n = F.when(F.length(plain) > 7, 0x110000).otherwise(F.conv(F.when(F.length(plain) <= 7, plain), base, 10).cast("bigint"))
    windows = F.array(*[F.lit(bytes([c]).decode("cp1252") if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(c)) for c in range(0x80, 0xA0)])
    none = n.between(1, 8) | n.isin(0x0B, 0x7F) | n.between(0x0E, 0x1F) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    return (
        F.when(n.between(0x80, 0x9F), F.get(windows, (n - 0x80).cast("int"))).when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), UNKNOWN)
        .when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _referred(piece: Column) -> Column:
    """What a reference stands for; of an unknown name its longest head that counts without a semicolon, else the name itself."""
    name = F.substr(piece, F.lit(2))
    longest = F.least(F.length(name) - 1, F.lit(max(map(len, BARE))))
    heads = F.when(longest >= 2, F.filter(F.sequence(longest, F.lit(2), F.lit(-1)), lambda n: F.map_contains_key(_table(BARE), F.substr(name, F.lit(1), n))))
    head = F.get(heads, F.lit(0))
    by_head = F.concat(F.try_element_at(_table(BARE), F.substr(name, F.lit(1), head)), F.substr(name, head + 1))
    return (
        F.when(piece.rlike("^&#[0-9]"), _character(F.regexp_extract(piece, "^&#([0-9]+)", 1), 10))
        .when(piece.rlike("^&#[xX][0-9a-fA-F]"), _character(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+)", 1), 16))
        .when(piece.rlike("^&."), F.coalesce(F.try_element_at(_table(NAMED), name), by_head, piece)).otherwise(piece)
    )


def unescape(text: Column) -> Column:
    """Text with its character references decoded, by number and by name; texts without an '&' are left alone."""
    pieces = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    decoded = F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("&")), _referred(p)).otherwise(p)), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def strip_formatting(text: Column, entities: bool = True) -> Column:
    """Plain text of a subtitle: no overrides, no tags, trimmed lines, single blank lines.

    ``entities=False`` leaves character references as they are.
    """
    # The three escapes of the subtitle format.
    t = F.replace(F.replace(F.replace(text, F.lit(r"\N"), F.lit("\n")), F.lit(r"\n"), F.lit("\n")), F.lit(r"\h"), F.lit(" "))
    t = F.regexp_replace(t, r"\{[^}]*\}", "")
    t = F.regexp_replace(t, r"</?[a-zA-Z0-9_\-.:]+(?:\s+[^>]*)?>", "")
    if entities:
        t = unescape(t)
    lines = F.transform(F.split(F.regexp_replace(t, r"\r\n|\r", "\n"), "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.coalesce(F.regexp_replace(joined, r"^\n+|\n+$", ""), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two distinct arrays, 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))
