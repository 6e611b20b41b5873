"""Shorter forms of summaries, candidates and digests: four levels from full to skeleton."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("FULL", "TRIMMED", "PRIORITY", "SKELETON")
# Text and reference caps by level, and what makes an item worth keeping.
TEXT = {"TRIMMED": 140, "PRIORITY": 100, "SKELETON": 80}
REFS = {"TRIMMED": 3, "PRIORITY": 2, "SKELETON": 2}
KEPT_TYPES = (
    "supporting_development", "trait", "setup", "payoff", "reveal", "reversal", "decision", "consequence", "failure", "conflict", "unresolved",
    "relationship", "subplot", "recurring_behavior", "contradiction", "counter_evidence", "dilemma", "power_shift", "reaction", "visual_storytelling",
)
KEPT_CATEGORIES = (
    "setup_payoff", "reveals", "reversals", "character_decisions", "consequences", "failures", "conflicts", "unresolved", "supporting_developments",
    "relationships", "subplots", "recurring_behavior", "contradictions", "counter_evidence", "dilemmas", "power_shifts", "reactions", "visual_storytelling",
)
DIGEST = {"FULL": (30, 20), "TRIMMED": (15, 10), "PRIORITY": (5, 5), "SKELETON": (2, 2)}


def is_priority() -> Column:
    """Supporting, turning-point and policy items. Columns: item_type, categories, characters."""
    named = F.exists("categories", lambda c: F.contains(F.lower(c), F.lit("supporting")) | F.contains(F.lower(c), F.lit("strengths")) | c.isin(*KEPT_CATEGORIES))
    return F.col("item_type").isin(*KEPT_TYPES) | named | (F.size("characters") > 0)


def compact_items(items: DataFrame, level: str, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Summary items at a level: caps on text and refs; the lower two keep priority items only,
    or all of a summary that has none (one map-side combined flag per summary, joined back).

    items: keys, refs, categories, characters, summary, item_type and times.
    """
    if level == "FULL":
        return items
    short = {"summary": F.substring("summary", 1, TEXT[level]), "refs": F.slice("refs", 1, REFS[level])}
    if level == "TRIMMED":
        return items.withColumns(short)
    marked = items.withColumn("_p", is_priority())
    some = marked.groupBy(*keys).agg(F.max("_p").alias("_any"))
    kept = marked.join(some, list(keys)).where(F.col("_p") | ~F.col("_any")).drop("_p", "_any")
    if level == "SKELETON":
        cut = lambda column, size: F.transform(F.slice(column, 1, 5), lambda v: F.substring(v, 1, size))
        refs = F.transform(short["refs"], lambda r: F.substring(r, 1, 80))
        none = F.array(F.concat(F.coalesce(F.nullif("item_type", F.lit("")), F.lit("ev")), F.lit(":0")))
        short = {"summary": short["summary"], "refs": F.when(F.size("refs") > 0, refs).otherwise(none), "characters": cut("characters", 80), "categories": cut("categories", 50)}
    return kept.withColumns(short)


def compact_candidate(level: str) -> Column:
    """A candidate as a JSON text at a level. Columns of the candidates table."""
    head = lambda c, n: F.slice(c, 1, n).alias(c)
    cut = lambda c, n: F.substring(c, 1, n).alias(c)
    shared = ["proposal_id", "scope", "episodes", "confidence", "status"]
    fields = {
        "FULL": ["title", "thesis", "subject", "characters", "primary_character", "tags", "refs", "ranges"],
        "TRIMMED": ["title", "thesis", "subject", "characters", "primary_character", "tags", head("refs", 5), head("ranges", 3)],
        "PRIORITY": ["title", "thesis", "primary_character", head("tags", 3), head("refs", 3), head("ranges", 2)],
        "SKELETON": [cut("title", 80), cut("thesis", 120), cut("primary_character", 50), head("tags", 2), head("refs", 2)],
    }[level]
    return F.to_json(F.struct(*shared, *fields))


def merge_result(links: DataFrame, proposals: DataFrame, arcs: DataFrame, rejected: DataFrame, level: str) -> tuple[DataFrame, ...]:
    """Rows of a merge result at a level: texts capped at 120 or 80, rejected rows cut or dropped.

    rejected: keys with an `ordinal`.
    """
    cap = {"FULL": None, "TRIMMED": 120, "PRIORITY": 80, "SKELETON": 80}[level]
    if cap is None:
        return links, proposals, arcs, rejected
    cut = lambda df, *columns, size=cap: df.withColumns({c: F.substring(c, 1, size) for c in columns if c in df.columns})
    links, proposals, arcs = cut(links, "summary"), cut(proposals, "editorial_reason", "description"), cut(arcs, "arc_summary")
    if level == "SKELETON":
        links, proposals, arcs = cut(links, "theme", size=50), cut(proposals, "title", size=120), cut(arcs, "character", size=80)
        proposals = proposals.withColumn("characters", F.transform(F.slice("characters", 1, 5), lambda c: F.substring(c, 1, 80)))
    return links, proposals, arcs, rejected.where(F.col("ordinal") < (10 if level == "TRIMMED" else 0))


def cap_texts(df: DataFrame, cap: int, texts: Sequence[str], lists: dict[str, int], ids: Sequence[str] = ()) -> DataFrame:
    """Texts cut to `cap` characters and arrays to their heads; identifiers stay whole."""
    texts = [c for c in texts if c not in ids]
    return df.withColumns({**{c: F.substring(c, 1, cap) for c in texts}, **{c: F.slice(c, 1, n) for c, n in lists.items()}})


def verification_digest(decisions: DataFrame, ledgers: DataFrame, level: str = "FULL", key: str = "project") -> DataFrame:
    """One text per project: the first rejected decisions and ledgers of the level, and their totals.

    decisions: key, ordinal, candidate_id, action, reason_code, reason; ledgers: key, ordinal,
    episode_id, status. The heads are taken by a bounded rank, so texts are bounded too.
    """
    max_rejected, max_ledgers = DIGEST[level]
    refused = decisions.where("action = 'REJECT'")

    def head(df: DataFrame, line: Column, n: int, name: str) -> DataFrame:
        ranked = df.select(key, "ordinal", line.alias("_line")).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("ordinal")))
        return ranked.where(F.col("_r") <= n).groupBy(key).agg(F.expr("listagg(_line, '\n') WITHIN GROUP (ORDER BY ordinal)").alias(name))

    said = F.concat(F.lit("- ID: "), "candidate_id", F.lit(", Code: "), "reason_code", F.lit(", Reason: "), "reason")
    seen = F.concat(F.lit("- Episode "), "episode_id", F.lit(": Status="), "status")
    total = refused.groupBy(key).agg(F.count(F.lit(1)).alias("rejected"))
    both = total.join(head(refused, said, max_rejected, "_a"), key, "full_outer").join(head(ledgers, seen, max_ledgers, "_b"), key, "full_outer")
    lines = F.concat_ws(
        "\n", F.when(F.col("rejected") > 0, F.concat(F.lit("REJECTED PROPOSALS DURING CONSOLIDATION ("), "rejected", F.lit("):"))), "_a",
        F.lit("COVERAGE & EVIDENCE SUMMARY:"), "_b",
    )
    return both.select(key, lines.alias("digest"))
