"""Candidate and connection documents, with the names their fields go by, to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.session import durable
from cuefold.sources.evidence import kind

# The keys a merge result may use for each of its lists.
LISTS = {
    "links": ("cross_episode_links", "links", "narrative_links"),
    "proposals": ("candidate_proposals", "candidates", "proposals"),
    "arcs": ("supporting_character_arcs", "supporting_arcs", "character_arcs"),
    "rejected": ("rejected_or_merged", "rejected"),
}


def _first(item: Column | str, *names: str, as_type: str = "string") -> Column:
    """First of the named fields that has a value of the type."""
    return F.coalesce(*[F.try_variant_get(item, f"$.{n}", as_type) for n in names])


def text_list(item: Column | str, *names: str) -> Column:
    """A list of texts under any of the names; a lone non-blank text is a list of one."""
    value = _first(item, *names, as_type="variant")
    lone = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<string>"))
        .when((kind(value) == "STRING") & (F.trim(lone) != ""), F.array(lone)).otherwise(F.array().cast("array<string>"))
    )


def candidate_rows(items: DataFrame, item: str = "item") -> DataFrame:
    """Candidates table rows from variant objects; other columns are carried along."""
    carried = [c for c in items.columns if c != item]
    whole = lambda *names: F.coalesce(_first(item, *names), F.lit(""))
    ms = lambda r, *names: F.bround(F.coalesce(_first(r, *names, as_type="double"), F.lit(0.0)) * 1000).cast("bigint")
    spans = F.transform(
        F.filter(F.coalesce(F.try_variant_get(item, "$.source_ranges", "array<variant>"), F.array().cast("array<variant>")), lambda r: kind(r) == "OBJECT"),
        lambda r: F.struct(
            F.coalesce(_first(r, "episode_id"), F.lit("")).alias("episode_id"), ms(r, "start_seconds", "start").alias("start_ms"),
            ms(r, "end_seconds", "end").alias("end_ms"), F.nullif(_first(r, "evidence_ref", "ref"), F.lit("")).alias("ref"),
        ),
    )
    return items.select(
        *carried, whole("proposal_id").alias("proposal_id"), whole("title").alias("title"), whole("central_thesis").alias("thesis"), whole("subject").alias("subject"),
        F.coalesce(_first(item, "candidate_scope"), F.lit("CROSS_EPISODE")).alias("scope"), text_list(item, "episodes").alias("episodes"),
        text_list(item, "characters").alias("characters"), whole("primary_character").alias("primary_character"), text_list(item, "overlap_tags").alias("tags"),
        text_list(item, "supporting_evidence", "supporting_evidence_refs").alias("refs"), spans.alias("ranges"), text_list(item, "observed_facts").alias("facts"),
        text_list(item, "hooks").alias("hooks"), whole("turning", "turning_point").alias("turning"),
        F.coalesce(_first(item, "estimated_duration", "estimated_duration_seconds", "duration", as_type="double"), F.lit(0.0)).alias("duration_s"),
        F.coalesce(_first(item, "confidence", as_type="double"), F.lit(1.0)).alias("confidence"), F.coalesce(_first(item, "status"), F.lit("keep")).alias("status"),
    )


def merge_lists(documents: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """(keys, list, place, item): objects of every list of merge results, nested `batch_results` included.

    One round per nesting level; `place` (array of numbers) keeps the order of a depth-first walk.
    """
    none = F.array().cast("array<int>")
    level = documents.select(*keys, none.alias("place"), F.try_parse_json(content).alias("node"))
    out = None
    while True:
        rows = None
        for order, (name, fields) in enumerate(LISTS.items()):
            for at, field in enumerate(fields):
                found = level.select(*keys, "place", F.posexplode(F.try_variant_get("node", f"$.{field}", "array<variant>")).alias("_i", "item"))
                found = found.where(kind(F.col("item")) == "OBJECT").select(*keys, F.lit(name).alias("list"), F.concat("place", F.array(F.lit(-1), F.lit(at), "_i")).alias("place"), "item")
                rows = found if rows is None else rows.unionByName(found)
        out = rows if out is None else out.unionByName(rows)
        nested = level.select(*keys, "place", F.posexplode(F.try_variant_get("node", "$.batch_results", "array<variant>")).alias("_i", "node"))
        level = durable(nested.where(kind(F.col("node")) == "OBJECT").select(*keys, F.concat("place", F.array("_i")).alias("place"), "node"))
        if level.isEmpty():
            return out
