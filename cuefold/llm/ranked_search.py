"""Ranked lexical search by blocked matrix products: item weights times document impacts, exact in float64.

A block of items has a compact vocabulary: only the terms its items hold. Documents come in tiles; a tile's
impacts on one stretch of that vocabulary and the items' weights on it are two dense matrices, multiplied by
BLAS. All entries are integers, and a stretch ends where a partial sum could reach 2^53, so each product is
exact; partial sums are added as 64-bit integers. A tile keeps each item's best rows, ties by document id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuefold.llm.common import arrow_rows, raw_text, rows_of
from cuefold.session import durable

#: Items of a block, and distinct terms after which a block ends: what a task holds of the items is bounded by both.
ITEMS, TERMS = 512, 1 << 17
#: Documents and terms of a tile: 1024 x 1024 doubles are 8 MB.
TILE = 1024
#: Bytes of folded text cut into words at once.
CHUNK = 1 << 20
EXACT = 1 << 53
#: An impact is below 1,000,000,000 tf / 1000 tf.
MOST_IMPACT = 1_000_000
#: Letters and digits stay, A-Z as a-z; all other ASCII parts terms. Bytes from 0x80 on belong to terms.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about `CHUNK` bytes."""
    folded, at = (text or b"").translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + CHUNK)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """The query set, block by block: (item_id, its terms' counts) of items that have terms."""
    block, seen = [], set()
    for row in items.select(F.col("item_id").cast("long"), raw_text()).toLocalIterator():
        counts = Counter()
        for words in terms_of(None if row[1] is None else bytes(row[1])):
            counts.update(words)
        if not counts:
            continue
        if block and (len(block) == ITEMS or len(seen) + len(counts) > TERMS):
            yield block
            block, seen = [], set()
        block.append((row[0], counts))
        seen.update(counts)
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): documents with a term; their length, and the vocabulary's terms they hold."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
    number, size = vocabulary.get, len(vocabulary)

    def counted(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            n, found = 0, Counter()
            for words in terms_of(text):
                n += len(words)
                found.update(map(number, words))
            if n:
                found.pop(None, None)
                yield doc_id, n, list(found), list(found.values())

    return docs.select(F.col("doc_id").cast("long"), raw_text()).mapInArrow(
        arrow_rows(counted, schema, 1000), "doc_id long, n long, terms array<int>, tfs array<long>"
    )


def item_weights(block: list[tuple], vocabulary: dict[bytes, int], df: np.ndarray, n_docs: int) -> np.ndarray:
    """int64 (items x vocabulary): a term's weight times its count in the item."""
    idf = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    weights = np.zeros((len(block), len(vocabulary)), dtype=np.int64)
    for row, (_, counts) in enumerate(block):
        for term, count in counts.items():
            weights[row, vocabulary[term]] = count
    return weights * idf


def exact_stretches(weights: np.ndarray, limit: int = EXACT // MOST_IMPACT, width: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, weights on them): stretches of the vocabulary whose partial sums stay below 2^53.

    A weight above the limit of itself is dealt to several stretches over its column.
    """
    left = weights.copy()
    while left.any():
        share = np.minimum(left, limit)
        columns = np.flatnonzero(share.any(axis=0))
        at = 0
        while at < len(columns):
            part = share[:, columns[at : at + width]]
            fits = int(np.searchsorted((np.cumsum(part, axis=1).max(axis=0) > limit).astype(np.int8), 1))
            yield columns[at : at + fits], part[:, :fits].astype(np.float64)
            at += fits
        left -= share


class Best:
    """Each item's best rows so far: score from high to low, then ascending id, a null id last."""

    def __init__(self, items: int, most: int):
        self.most, self.rows = most, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(items)]
        self.floor = np.ones(items, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """scores: documents x items. Rows that tie with an item's floor stay until ids decide."""
        hopeful = scores >= self.floor
        for item in np.flatnonzero(hopeful.any(axis=0)):
            rows = np.flatnonzero(hopeful[:, item])
            old = self.rows[item]
            score, doc, null = (np.concatenate(p) for p in zip(old, (scores[rows, item], ids[rows], nulls[rows])))
            order = np.lexsort((doc, null, -score))[: self.most]
            self.rows[item] = score[order], doc[order], null[order]
            if len(order) == self.most:
                self.floor[item] = score[order[-1]]


def tile_scores(rows: list[tuple], stretches: list, n_docs: int, n_terms: int, size: int, items: int) -> np.ndarray:
    """int64 (documents x items): the scores of a tile of postings."""
    sizes = np.fromiter((len(r[2]) for r in rows), np.int64, len(rows))
    length = np.fromiter((r[1] for r in rows), np.int64, len(rows))
    term = np.fromiter((t for r in rows for t in r[2]), np.int64, int(sizes.sum()))
    tf = np.fromiter((t for r in rows for t in r[3]), np.int64, len(term))
    doc = np.repeat(np.arange(len(rows)), sizes)
    m = 25 + (75 * length * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    scores = np.zeros((len(rows), items), dtype=np.int64)
    place = np.full(size, -1, dtype=np.int64)
    for columns, weights in stretches:
        place[columns] = np.arange(len(columns))
        at = place[term]
        inside = at >= 0
        impacts = np.zeros((len(rows), len(columns)))
        impacts[doc[inside], at[inside]] = impact[inside]
        place[columns] = -1
        scores += (impacts @ weights.T).astype(np.int64)
    return scores


def best_of_block(found: DataFrame, block: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int, first: int, most: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's best rows of each item of a block."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    ids, size = [i for i, _ in block], weights.shape[1]

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        stretches, best, held = list(exact_stretches(weights)), Best(len(ids), most), []

        def close() -> None:
            docs = np.array([r[0] or 0 for r in held], dtype=np.int64)
            nulls = np.array([r[0] is None for r in held], dtype=bool)
            best.add(tile_scores(held, stretches, n_docs, n_terms, size, len(ids)), docs, nulls)
            held.clear()

        for row in rows:
            held.append(row)
            if len(held) == TILE:
                close()
        if held:
            close()
        for item, (score, doc, null) in enumerate(best.rows):
            for s, d, gone in zip(score.tolist(), doc.tolist(), null.tolist()):
                yield first + item, ids[item], None if gone else d, s

    return found.mapInArrow(arrow_rows(run, schema), "item long, item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` best documents of every item with a score above 0.

    Null and empty texts have no terms: such a document is found by no item, such an item finds nothing.
    Equal scores go by ascending doc_id, null ids last. Rows that repeat a doc_id are documents of their own,
    rows that repeat an item_id are items of their own with ranks of their own. Empty tables give no rows.
    Other columns are not read. The query set comes in blocks of up to `ITEMS` items and about `TERMS` terms;
    each block reads all documents once, and a task sends at most `most` rows an item.
    """
    docs = docs.select("doc_id", "text")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts, first = [], 0
    for block in item_blocks(items):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in block))))}
        found = durable(postings(docs, vocabulary))
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        if n_docs:
            # At most one row a term of the block.
            held = found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
            df = np.zeros(len(vocabulary), dtype=np.int64)
            for term, count in held:
                df[term] = count
            weights = item_weights(block, vocabulary, df, n_docs)
            parts.append(durable(best_of_block(found, block, weights, n_docs, n_terms, first, most)))
        first += len(block)
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    # Two steps: however many tasks sent rows of an item, none ranks them all.
    dealt = best.withColumn("deal", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "deal").orderBy(*order))).where(F.col("rank") <= most)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)
    return last.select("item_id", "rank", "doc_id", "score")
