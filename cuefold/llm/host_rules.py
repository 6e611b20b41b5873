"""Quality rules with host verdicts: document rules, failure rates per host, shrunk by an empirical beta prior."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import CONTINUATION, SPACES, arrow_rows, raw_text
from cuefold.session import durable


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule above `hard`; above `soft` it only counts against its host, and goes
    only where the host's shrunk failure rate is above `host_limit`."""

    name: str
    measure: str
    soft: float
    hard: float
    host_limit: float = 0.5


#: The production rules, on measures of `document_measures`.
RULES = (
    Rule("symbols", "n_symbols / n_words", 0.10, 1.0),
    Rule("repeated_lines", "n_dup_lines / n_lines", 0.30, 0.60),
    Rule("repeated_words", "n_repeat_words / n_words", 0.30, 0.50),
    Rule("long_words", "word_chars / n_words", 10.0, 15.0),
)
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def measures(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    text = text or b""
    words = text.split()
    seen, lines, repeats = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            repeats += line in seen
            seen.add(line)
    return (
        len(words),
        len(text.translate(None, CONTINUATION + SPACES)),
        len(text) - len(text.translate(None, b"#*$%&|<>")),
        lines,
        repeats,
        repeated_words(words),
    )


def document_measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), one row per row."""

    def run(rows):
        for doc_id, at, text in rows:
            yield doc_id, at, *measures(text)

    picked = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), raw_text())
    return picked.mapInArrow(
        arrow_rows(run, SCHEMA),
        "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long",
    )


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def exceeds(rule: Rule, bound: float) -> Column:
    """Whether a measure is above a bound; a document without words breaks no ratio."""
    return F.coalesce(F.expr(f"try_divide({rule.measure.split(' / ')[0]}, {rule.measure.split(' / ')[1]})") > F.lit(bound), F.lit(False))


def host_rates(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(host, n_docs, and per rule <name>_failed, <name>_rate): failures by host with their shrunk rates.

    The beta prior is fitted to all hosts by moments: its mean is the pooled rate, its strength comes
    from the spread of host rates beyond what sampling alone would give. A host of few documents
    leans on the prior, a large one on its own rate. Counts are combined before the shuffle, so one
    host may hold any share of the rows; a null host is a host of its own.
    """
    counts = durable(
        measured.groupBy("host").agg(
            F.count(F.lit(1)).alias("n_docs"),
            *(F.count_if(exceeds(r, r.soft)).alias(f"{r.name}_failed") for r in rules),
        )
    )
    pooled = counts.agg(
        F.sum("n_docs").alias("docs"),
        F.count(F.lit(1)).alias("hosts"),
        *(F.expr(f"sum({r.name}_failed)").alias(f"{r.name}_f") for r in rules),
        *(F.expr(f"sum({r.name}_failed * {r.name}_failed / n_docs)").alias(f"{r.name}_q") for r in rules),
    ).first()
    total, hosts = pooled["docs"] or 0, pooled["hosts"]
    shrunk = []
    for r in rules:
        mean, strength = beta_prior(total, hosts, pooled[f"{r.name}_f"] or 0, pooled[f"{r.name}_q"] or 0.0)
        shrunk.append(((F.col(f"{r.name}_failed") + mean * strength) / (F.col("n_docs") + strength)).alias(f"{r.name}_rate"))
    return counts.select("*", *shrunk)


def beta_prior(total: int, hosts: int, failed: int, squares: float) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the prior.

    squares is the sum over hosts of failures² / documents. The strength is held in [1, 1e6]; where
    hosts do not differ beyond sampling it is 1e6, so every host has the pooled rate.
    """
    if total == 0:
        return 0.0, 1.0
    mean = failed / total
    spread = mean * (1 - mean)
    beyond = squares / total - mean * mean - spread * hosts / total
    if spread <= 0 or beyond <= 0:
        return mean, 1e6
    return mean, min(max(spread / beyond - 1, 1.0), 1e6)


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measured rows with base_failed, bad_host and kept.

    kept is false for a document that fails the base rules, breaks a rule's hard bound, or breaks its
    soft bound on a host whose shrunk failure rate for that rule is above the rule's limit. A document
    inside every soft bound stays whatever its host is.
    """
    verdicts = host_rates(measured, rules).select(
        F.col("host").alias("__host"), *(F.expr(f"{r.name}_rate > {r.host_limit!r}D").alias(f"__{r.name}") for r in rules)
    )
    broken = F.lit(False)
    for r in rules:
        broken = broken | exceeds(r, r.hard) | (F.coalesce(F.col(f"__{r.name}"), F.lit(False)) & exceeds(r, r.soft))
    bad = F.lit(False)
    for r in rules:
        bad = bad | F.coalesce(F.col(f"__{r.name}"), F.lit(False))
    return (
        measured.join(verdicts, F.col("host").eqNullSafe(F.col("__host")), "left")
        .select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
                base_failed().alias("base_failed"), bad.alias("bad_host"), (~base_failed() & ~broken).alias("kept"))
    )


def host_quality(docs: DataFrame, host: str = "source", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its measures, base_failed, bad_host (some rule is common on its host) and kept.

    A null or empty text has no words and fails the base rules. Repeated rows are judged one by one.
    Columns other than doc_id, text and the host column are not read, whatever their names. An empty
    table gives no rows.
    """
    return judge(durable(document_measures(docs, host)), rules)
