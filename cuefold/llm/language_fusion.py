"""Language identification by Bayesian fusion: text likelihood, declared language, and host priors smoothed over suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import arrow_rows, raw_text
from cuefold.session import durable

#: The languages told apart: the model is len(LANGUAGES) times BUCKETS numbers, whatever the corpus.
LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 14
#: Neighbouring trigrams share two of three bytes, so a text counts for a third of its trigrams.
OVERLAP = 1 / 3
#: Pseudo-documents by which a host leans on its suffix and a suffix on the whole corpus.
HOST_STRENGTH, SUFFIX_STRENGTH = 10.0, 100.0
#: Trigrams from which on a text's own vote counts for its host.
VOTE = 20
#: Prior of a text in none of the languages, whose trigrams are taken as evenly spread.
UNKNOWN = 1e-3
UND = "und"
OTHER = "other"

# Letters in lower case and all bytes above ASCII stay, the rest is space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(text: bytes | None) -> np.ndarray:
    """Buckets of the byte trigrams of a text's words, each word with a space on either side; no letters, none."""
    squeezed = b" ".join((text or b"").translate(LETTERS).split())
    if not squeezed:
        return np.empty(0, dtype=np.int64)
    b = np.frombuffer(b" " + squeezed + b" ", np.uint8).astype(np.uint32)
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(18)).astype(np.int64)


def declared_language(column: Column) -> Column:
    """Primary subtag of a declared language in lower case, OTHER if it is none of LANGUAGES, null if none is declared."""
    tag = F.lower(F.regexp_extract(F.trim(column.cast("string")), "^([A-Za-z]+)", 1))
    return F.when(tag == "", None).when(tag.isin(*LANGUAGES), tag).when(tag.isNotNull(), F.lit(OTHER))


def address_suffix(host: Column) -> Column:
    """What follows the last dot of a host name, in lower case; empty for a name without dots, null without host."""
    return F.lower(F.regexp_extract(host, r"\.([^.]*)$", 1))


def evidence(docs: DataFrame, declared: str = "lang", host: str = "source") -> DataFrame:
    """(doc_id, text, declared, host, suffix) of documents."""
    at = F.col(host).cast("string")
    return docs.select(F.col("doc_id").cast("long"), raw_text(), declared_language(F.col(declared)).alias("declared"), at.alias("host"), address_suffix(at).alias("suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """The same of web pages: the language the html element declares, the host and its suffix; tags are dropped."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    tag = F.regexp_extract("html", r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z-]+)""", 1)
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("doc_id"), plain.cast("binary").alias("text"), declared_language(tag).alias("declared"),
        F.when(host != "", host).alias("host"), address_suffix(host).alias("suffix"),
    )


def fit_text_model(seen: DataFrame) -> np.ndarray:
    """log P(bucket | language), a row per language, from all texts whose declared language is one of LANGUAGES.

    Each task adds up its own texts; the sums per language and bucket are added by Spark. One more than
    was counted stands for every bucket, so a language never declared gives evenly spread trigrams.
    """
    schema = pa.schema([("language", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(rows):
        sums = np.zeros((len(LANGUAGES), BUCKETS), dtype=np.int64)
        for declared, text in rows:
            sums[LANGUAGES.index(declared)] += np.bincount(trigrams(text), minlength=BUCKETS)
        for language, bucket in zip(*np.nonzero(sums)):
            yield int(language), int(bucket), int(sums[language, bucket])

    labelled = seen.where(F.col("declared").isin(*LANGUAGES)).select("declared", "text")
    totals = labelled.mapInArrow(arrow_rows(run, schema, 20_000), "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    counts = np.ones((len(LANGUAGES), BUCKETS))
    for row in totals.toLocalIterator():
        counts[row.language, row.bucket] += row.n
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def text_likelihoods(seen: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, declared, host, suffix, n_grams, ll, vote): ll has a log likelihood per language, then that of UND;
    vote is the place of the likeliest language of a text long enough to vote, else null."""
    named = [c for c in ("table",) if c in seen.columns]
    schema = pa.schema([(c, pa.string()) for c in named] + [("doc_id", pa.int64()), ("declared", pa.string()), ("host", pa.string()), ("suffix", pa.string()), ("n_grams", pa.int64()), ("ll", pa.list_(pa.float64())), ("vote", pa.int32())])
    sent = seen.sparkSession.sparkContext.broadcast(np.ascontiguousarray(np.vstack([model, np.full(BUCKETS, -np.log(BUCKETS))]).T))

    def run(rows):
        for *own, doc_id, declared, host, suffix, text in rows:
            codes = trigrams(text)
            ll = np.zeros(len(LANGUAGES) + 1)
            for at in range(0, len(codes), 8192):
                ll += sent.value[codes[at : at + 8192]].sum(axis=0)
            best = int(ll.argmax())
            yield *own, doc_id, declared, host, suffix, len(codes), ll.tolist(), best if len(codes) >= VOTE and best < len(LANGUAGES) else None

    return seen.select(*named, "doc_id", "declared", "host", "suffix", "text").mapInArrow(
        arrow_rows(run, schema), "".join(f"`{c}` string, " for c in named) + "doc_id long, declared string, host string, suffix string, n_grams long, ll array<double>, vote int"
    )


def votes(scored: DataFrame, key: str) -> DataFrame:
    """(key, v0, v1, ...): votes per language; counted before the shuffle, so a key may hold any share of rows."""
    return scored.where("vote IS NOT NULL").groupBy(key).agg(*(F.count_if(F.col("vote") == i).alias(f"v{i}") for i in range(len(LANGUAGES))))


def declared_given(scored: DataFrame) -> dict[str | None, list[float]]:
    """P(declared | language) for each value of declared, by the texts' own votes, one pseudo-count each."""
    values = [*LANGUAGES, OTHER, None]
    seen = {row[0]: row[1:] for row in votes(scored, "declared").collect()}
    table = np.array([seen.get(v, (0,) * len(LANGUAGES)) for v in values], dtype=float) + 1
    return dict(zip(values, (table / table.sum(axis=0)).tolist()))


def fuse(scored: DataFrame) -> DataFrame:
    """Scored rows with language, probability and text_language.

    log posterior = OVERLAP * text + log P(declared | language) + log prior of the host. The prior of a
    host is its votes, without the document's own, with HOST_STRENGTH pseudo-votes spread as its suffix's
    prior; a suffix leans on the corpus in the same way, so the suffix speaks where the host is new.
    """
    n = len(LANGUAGES)
    whole = scored.where("vote IS NOT NULL").agg(*(F.count_if(F.col("vote") == i) for i in range(n))).first()
    corpus = (np.array([whole[i] or 0 for i in range(n)], dtype=float) + 1) / (sum(whole[i] or 0 for i in range(n)) + n)
    table = declared_given(scored)

    def counts(key: str, prefix: str) -> DataFrame:
        return durable(votes(scored, key)).select(F.col(key).alias(f"{prefix}key"), *(F.col(f"v{i}").alias(f"{prefix}{i}") for i in range(n)))

    df = scored.join(counts("suffix", "s"), F.col("suffix").eqNullSafe(F.col("skey")), "left").join(counts("host", "h"), F.col("host").eqNullSafe(F.col("hkey")), "left")
    zero = F.lit(0)
    own = [(F.coalesce(F.col("vote"), F.lit(-1)) == i).cast("int") for i in range(n)]
    s = [F.coalesce(F.col(f"s{i}"), zero) - own[i] for i in range(n)]
    h = [F.coalesce(F.col(f"h{i}"), zero) - own[i] for i in range(n)]
    total = lambda parts: sum(parts[1:], parts[0])
    logs = []
    for i in range(n):
        suffix = (s[i] + SUFFIX_STRENGTH * float(corpus[i])) / (total(s) + SUFFIX_STRENGTH)
        prior = (h[i] + HOST_STRENGTH * suffix) / (total(h) + HOST_STRENGTH)
        said = F.lit(table[None][i])
        for value in (*LANGUAGES, OTHER):
            said = F.when(F.col("declared") == value, F.lit(table[value][i])).otherwise(said)
        logs.append(F.col("ll")[i] * OVERLAP + F.log(prior) + F.log(said) + float(np.log(1 - UNKNOWN)))
    logs.append(F.col("ll")[n] * OVERLAP + float(np.log(UNKNOWN / (n + 2))))
    post = df.withColumn("logs", F.array(*logs)).withColumn("top", F.array_max("logs"))
    names = F.array(*(F.lit(x) for x in (*LANGUAGES, UND)))
    return post.select(
        *(c for c in ("table",) if c in scored.columns), "doc_id", "declared", "n_grams",
        F.when(F.col("n_grams") == 0, F.lit(UND)).otherwise(F.element_at(names, F.array_position("logs", F.col("top")).cast("int"))).alias("language"),
        (F.lit(1.0) / F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))).alias("probability"),
        F.when(F.col("n_grams") == 0, None).otherwise(F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int"))).alias("text_language"),
    )


def identify(seen: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, language, probability, text_language, declared, kept), a row per row of evidence.

    A document is kept if one of LANGUAGES has at least `least` of the posterior. A null or empty text, or
    one without letters, is UND and not kept. Null or unknown declarations, hosts and suffixes speak by
    their own counts. Rows that repeat a doc_id, or have none, are answered one by one. Equal posteriors go
    to the first language by name. A column table of the evidence is kept. Other columns are not read; an empty table gives no rows.
    """
    scored = durable(text_likelihoods(seen, fit_text_model(seen)))
    return fuse(scored).select(
        *(c for c in ("table",) if c in scored.columns), "doc_id", "language", "probability", "text_language", "declared", ((F.col("language") != UND) & (F.col("probability") >= least)).alias("kept")
    )


def identify_tables(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows of identify for documents and pages together, and the table each is of: one model, hosts and suffixes of both."""
    both = evidence(docs).withColumn("table", F.lit("documents")).unionByName(page_evidence(pages).withColumn("table", F.lit("pages")))
    return identify(both)
