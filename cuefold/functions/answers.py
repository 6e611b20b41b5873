"""Model answers as text: loose JSON, damage classes, shape checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuefold.sources.evidence import kind


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def loose_json(text: Column) -> Column:
    """The JSON object in an answer: fenced, bare, or from the first brace to the last; null if none."""
    value = _strip(text)
    fenced = value.rlike(r"(?is)```(?:json)?\s*.*?\s*```")
    body = F.when(fenced, _strip(F.regexp_extract(value, r"(?is)```(?:json)?\s*(.*?)\s*```", 1))).otherwise(value)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    whole = F.try_parse_json(body)
    found = F.when(whole.isNotNull(), whole).otherwise(F.try_parse_json(braces))
    return F.when(kind(found) == "OBJECT", found)


def content_text(content: Column) -> Column:
    """Text of a message: the string itself, or the text parts of a list."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(parts, lambda p: F.when(kind(p) == "STRING", F.try_variant_get(p, "$", "string")).when(kind(p) == "OBJECT", F.try_variant_get(p, "$.text", "string")))
    return F.when(kind(content) == "ARRAY", F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")).otherwise(F.try_variant_get(content, "$", "string"))


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def response_defect(raw: Column) -> Column:
    """What is wrong with a raw response body, or null: six classes, outermost first."""
    blank = lambda text: _strip(F.coalesce(text, F.lit(""))) == ""
    said = lambda content: _let(content_text(content), lambda text: F.when(blank(text), "content_empty").when(loose_json(text).isNull(), "malformed_model_json"))
    inner = lambda content: (
        F.when(content.isNull(), "message_content_missing").when(kind(content) == "VOID", "content_empty").otherwise(said(content))
    )
    first = lambda choices: F.when(F.coalesce(F.size(choices), F.lit(0)) <= 0, "choices_missing").otherwise(
        _let(F.try_variant_get(F.get(choices, F.lit(0)), "$.message.content", "variant"), inner)
    )
    parsed = lambda outer: F.when(F.coalesce(kind(outer), F.lit("")) != "OBJECT", "outer_json_malformed").otherwise(
        _let(F.try_variant_get(outer, "$.choices", "array<variant>"), first)
    )
    return F.when(blank(raw), "empty_body").otherwise(_let(F.try_parse_json(raw), parsed))


def lists_of_objects(answer: Column, keys: Sequence[str] | None = None) -> Column:
    """Whether an answer is an object whose (given) keys hold lists of objects only.

    An empty object is valid. Without `keys`, every key counts.
    """
    fields = F.map_entries(F.try_variant_get(answer, "$", "map<string,variant>"))
    if keys is not None:
        fields = F.filter(fields, lambda e: e["key"].isin(*keys))
    lists = lambda e: (kind(e["value"]) == "ARRAY") & F.forall(F.try_variant_get(e["value"], "$", "array<variant>"), lambda i: kind(i) == "OBJECT")
    return F.coalesce(F.when(kind(answer) == "OBJECT", F.forall(fields, lambda e: F.coalesce(lists(e), F.lit(False)))), F.lit(False))


def has_lists(answer: Column, required: Sequence[str]) -> Column:
    """Whether an answer is an object with each required key holding a list of objects."""
    present = F.lit(True)
    for name in required:
        present = present & F.coalesce(kind(F.try_variant_get(answer, f"$.{name}", "variant")) == "ARRAY", F.lit(False))
    return lists_of_objects(answer, required) & present


def ocr_issue(text: Column, confidence: Column) -> Column:
    """Why recognised text is not usable, or null. `text` is stripped of formatting already."""
    clean = _strip(F.coalesce(text, F.lit("")))
    symbols = F.size(F.array_distinct(F.filter(F.split(F.replace(clean, F.lit(" "), F.lit("")), ""), lambda c: c != "")))
    return (
        F.when(clean == "", "EMPTY").when(confidence < 0.50, "LOW_CONFIDENCE").when(~clean.rlike(r"[a-zA-Z0-9À-ɏẠ-ỹ]"), "NO_WORDS")
        .when((F.length(clean) >= 6) & (symbols <= 2), "REPEATED_SYMBOLS")
    )
