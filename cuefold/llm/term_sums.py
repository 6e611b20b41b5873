"""Sums over the terms of each document of a number that belongs to the term: postings, a look-up, and sums by document.

Documents are taken in blocks, terms in buckets by their hash. A posting row has the terms of one bucket in
one block: the documents of the block that have each and how often. So a term travels once per block instead
of once per document, postings of a frequent term are spread over as many rows as there are blocks, and the
rows of a bucket meet in order, so that every term's number is found there once. What a task holds is bounded
by a block, and by the distinct terms of one bucket; the number of buckets grows with that of partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from heapq import nsmallest
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefold.llm.common import raw_text, rows_of

#: A block ends with this many documents, or with this many different (document, term) pairs.
BLOCK_DOCS, BLOCK_PAIRS = 8192, 2_000_000
#: Buckets of terms for each shuffle partition.
BUCKETS = 4
#: Sums held in a task before they go out as partial sums.
CELLS = 4_000_000
#: Rows of a bucket: its counts (docs, ords, freqs null), then its postings; a block's documents come with terms null.
POSTING_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("terms", pa.binary()), ("lengths", pa.binary()), ("ns", pa.binary()), ("docs", pa.binary()), ("ords", pa.binary()), ("freqs", pa.binary())]
    + [("doc_ids", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64()))]
)
POSTINGS = "bucket int, block long, terms binary, lengths binary, ns binary, docs binary, ords binary, freqs binary, doc_ids array<long>, numbers array<long>"
SUMS = "block long, ords binary, sums binary, doc_ids array<long>, numbers array<long>"
SUM_SCHEMA = pa.schema([("block", pa.int64()), ("ords", pa.binary()), ("sums", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64()))])
COUNTS = "bucket int, terms binary, lengths binary, ns binary, total long, top_terms array<binary>, top_ns array<long>"
COUNT_SCHEMA = pa.schema([("bucket", pa.int32()), ("terms", pa.binary()), ("lengths", pa.binary()), ("ns", pa.binary()), ("total", pa.int64()), ("top_terms", pa.list_(pa.binary())), ("top_ns", pa.list_(pa.int64()))])

#: Texts measured together: about so many bytes.
TOGETHER = 8 << 20
#: Terms of one row of counts.
COUNTED_TOGETHER = 50_000
#: From (id, text) rows: the term frequencies of each and the numbers that go with it.
Measure = Callable[[list[tuple[int | None, bytes | None]]], Iterable[tuple[Counter, tuple[int, ...]]]]
#: From new terms and their counts: their values, one row for each value.
Valued = Callable[[list[bytes], list[int]], np.ndarray]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed_terms(terms: list[bytes]) -> tuple[bytes, bytes]:
    """Terms end to end, and their lengths."""
    return b"".join(terms), np.fromiter(map(len, terms), np.int32, len(terms)).tobytes()


def unpacked_terms(data: bytes, lengths: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, np.int32), dtype=np.int64).tolist()
    return [data[lo:hi] for lo, hi in zip([0, *ends], ends)]


def as_bytes(terms: Iterable[bytes | str]) -> list[bytes]:
    return [t if isinstance(t, bytes) else t.encode() for t in terms]


def bucketed(terms: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of terms by bucket, and where each bucket's end."""
    of = np.fromiter((crc32(t) % buckets for t in terms), np.int64, len(terms))
    return np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=buckets))


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The (id, text) rows of arrow batches in lists of about TOGETHER bytes; a longer text is a list of its own."""
    held, size = [], 0
    for batch in batches:
        for row in rows_of(batch):
            length = len(row[1] or b"") + 64
            if held and size + length > TOGETHER:
                yield held
                held, size = [], 0
            held.append(row)
            size += length
    if held:
        yield held


class Block:
    def __init__(self):
        self.terms: dict = {}
        self.ids, self.freqs, self.ords = [], [], []
        self.doc_ids, self.numbers, self.pairs = [], [], 0

    def add(self, doc_id: int | None, counts: Counter, numbers: tuple[int, ...]) -> None:
        terms = self.terms
        for term in counts:
            if term not in terms:
                terms[term] = len(terms)
        n = len(counts)
        self.ids.append(np.fromiter(map(terms.__getitem__, counts), np.int32, n))
        self.freqs.append(np.fromiter(counts.values(), np.int64, n))
        self.ords.append(np.full(n, len(self.doc_ids), np.uint16))
        self.doc_ids.append(doc_id)
        self.numbers.extend(numbers)
        self.pairs += n

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        """The documents of the block, then a row of postings for every bucket it has terms of."""
        yield block % buckets, block, *[None] * 6, self.doc_ids, self.numbers
        terms = as_bytes(self.terms)
        order, term_ends = bucketed(terms, buckets)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        ids, freqs, ords = place[np.concatenate(self.ids)], np.concatenate(self.freqs), np.concatenate(self.ords)
        while (freqs > 65535).any():  # a frequency beyond two bytes is told in parts
            big = freqs > 65535
            ids, ords = np.append(ids, ids[big]), np.append(ords, ords[big])
            freqs = np.append(np.where(big, 65535, freqs), freqs[big] - 65535)
        by_term = np.argsort(ids, kind="stable")
        ords, freqs = ords[by_term], freqs[by_term].astype(np.uint16)
        docs = np.bincount(ids, minlength=len(terms)).astype(np.int32)
        ends = np.append(0, np.cumsum(docs, dtype=np.int64))
        lo = 0
        for bucket, hi in enumerate(term_ends.tolist()):
            if hi > lo:
                a, b = ends[lo], ends[hi]
                names = packed_terms([terms[i] for i in order[lo:hi].tolist()])
                yield bucket, block, *names, None, docs[lo:hi].tobytes(), ords[a:b].tobytes(), freqs[a:b].tobytes(), None, None
            lo = hi


def batches_of(rows: Iterable[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `most` bytes, or a row of more."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes)) + 100
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def postings(docs: DataFrame, measure: Callable[[], Measure]) -> DataFrame:
    """Posting rows of all documents; `measure()` is called once per task, its result for the texts."""
    buckets = BUCKETS * partitions(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        of, number, held = measure(), TaskContext.get().partitionId() << 32, Block()
        for texts in together(batches):
            for (doc_id, _), measured in zip(texts, of(texts)):
                held.add(doc_id, *measured)
                if len(held.doc_ids) >= BLOCK_DOCS or held.pairs >= BLOCK_PAIRS:
                    yield from held.rows(number, buckets)
                    number, held = number + 1, Block()
        if held.doc_ids:
            yield from held.rows(number, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), POSTING_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), raw_text()).mapInArrow(run, POSTINGS)


def term_counts(docs: DataFrame, measure: Callable[[], Measure], top: int, always: bytes) -> DataFrame:
    """Rows with terms of a bucket and their occurrences, every term once.

    `total` sums a row's occurrences; its `top` most frequent terms, and `always` if it has that, stand apart too.
    """
    buckets = BUCKETS * partitions(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        of, sums = measure(), Counter()

        def out() -> Iterator[tuple]:
            terms, ns = as_bytes(sums), np.fromiter(sums.values(), np.int64, len(sums))
            order, ends = bucketed(terms, buckets)
            lo = 0
            for bucket, hi in enumerate(ends.tolist()):
                if hi > lo:
                    part = order[lo:hi]
                    yield bucket, *packed_terms([terms[i] for i in part.tolist()]), ns[part].tobytes(), None, None, None
                lo = hi

        for texts in together(batches):
            for counts, _ in of(texts):
                sums.update(counts)
            if len(sums) >= BLOCK_PAIRS // 2:
                yield from out()
                sums = Counter()
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bucket, sums = None, {}

        def out() -> Iterator[tuple]:
            terms, ns = list(sums), np.fromiter(sums.values(), np.int64, len(sums))
            for at in range(0, len(terms), COUNTED_TOGETHER):
                names, n = terms[at : at + COUNTED_TOGETHER], ns[at : at + COUNTED_TOGETHER]
                first = nsmallest(top, zip((t != always for t in names), (-n).tolist(), names))
                yield bucket, *packed_terms(names), n.tobytes(), int(n.sum()), [t for _, _, t in first], [-x for _, x, _ in first]

        for batch in batches:
            for at, data, lengths, ns, *_ in rows_of(batch):
                if at != bucket:
                    if sums:
                        yield from out()
                    bucket, sums = at, {}
                for t, n in zip(unpacked_terms(data, lengths), np.frombuffer(ns, np.int64).tolist()):
                    sums[t] = sums.get(t, 0) + n
        if sums:
            yield from out()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(count(batches), COUNT_SCHEMA)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(merge(batches), COUNT_SCHEMA)

    found = docs.select(F.col("doc_id").cast("long"), raw_text()).mapInArrow(counted, COUNTS)
    return found.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(merged, COUNTS)


class Values:
    """The values of the terms of one bucket, each found once; their array doubles as it fills."""

    def __init__(self, find: Valued, k: int):
        self.find, self.k = find, k
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.counts: dict[bytes, int] = {}
        self.held = np.zeros((self.k, 1024))

    def of(self, terms: list[bytes]) -> np.ndarray:
        places = self.places
        new = [t for t in terms if t not in places]
        if new:
            at = len(places)
            if at + len(new) > self.held.shape[1]:
                self.held = np.concatenate([self.held, np.zeros((self.k, at + len(new)))], axis=1)
            self.held[:, at : at + len(new)] = self.find(new, [self.counts.get(t, 0) for t in new])
            places.update(zip(new, range(at, at + len(new))))
        return self.held[:, np.fromiter(map(places.__getitem__, terms), np.int64, len(terms))]


def summed(posted: DataFrame, values: list[str], ids: list[str], value_of: Callable[[], Valued], counts: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, its numbers under the names `ids`, and each of `values` summed over its terms.

    What `value_of()`, called once per task, gives for terms and their counts (0 without `counts`, or for
    a term that they lack) are the values; it is asked once for each term. Rows of a bucket meet in one
    partition, its counts first. Partial sums of each task go to the block's partition and are added up as they
    stream by.
    """
    k, n = len(values), partitions(posted.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[int, np.ndarray] = {}
        known, bucket = Values(value_of(), k), None

        def out() -> Iterator[tuple]:
            for block, sums in held.items():
                at = np.flatnonzero(sums.any(axis=0))
                yield block, at.astype(np.uint16).tobytes(), np.ascontiguousarray(sums[:, at]).tobytes(), None, None
            held.clear()

        for batch in batches:
            for at, block, data, lengths, ns, docs, ords, freqs, doc_ids, numbers in rows_of(batch):
                if at != bucket:
                    bucket = at
                    known.clear()
                if data is None:
                    yield block, None, None, doc_ids, numbers
                    continue
                terms = unpacked_terms(data, lengths)
                if docs is None:
                    known.counts.update(zip(terms, np.frombuffer(ns, np.int64).tolist()))
                    continue
                per = np.repeat(known.of(terms), np.frombuffer(docs, np.int32), axis=1) * np.frombuffer(freqs, np.uint16)
                if block not in held:
                    held[block] = np.zeros((k, BLOCK_DOCS))
                to = np.frombuffer(ords, np.uint16).astype(np.intp)
                for v in range(k):
                    np.add.at(held[block][v], to, per[v])
            if len(held) * BLOCK_DOCS * k > CELLS:
                yield from out()
        yield from out()

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(partial(batches), SUM_SCHEMA)

    schema = pa.schema([("doc_id", pa.int64())] + [(i, pa.int64()) for i in ids] + [(v, pa.float64()) for v in values])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums, docs, numbers = None, None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if docs is not None:
                per = np.asarray(numbers, np.int64).reshape(len(docs), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(per[:, i]) for i in range(len(ids))), *(pa.array(sums[v, : len(docs)]) for v in range(k))], schema=schema)

        for batch in batches:
            for at, ords, part, doc_ids, nums in rows_of(batch):
                if at != block:
                    if block is not None:
                        yield from out()
                    block, sums, docs = at, np.zeros((k, BLOCK_DOCS)), None
                if doc_ids is not None:
                    docs, numbers = doc_ids, nums
                else:
                    sums[:, np.frombuffer(ords, np.uint16)] += np.frombuffer(part, np.float64).reshape(k, -1)
        if block is not None:
            yield from out()

    if counts is not None:
        posted = posted.unionByName(counts.select("bucket", "terms", "lengths", "ns"), allowMissingColumns=True)
    dealt = posted.withColumn("posted", F.col("ns").isNull()).repartition(n, "bucket").sortWithinPartitions("bucket", "posted").drop("posted")
    ddl = ", ".join(["doc_id long", *(f"{i} long" for i in ids), *(f"{v} double" for v in values)])
    return dealt.mapInArrow(partials, SUMS).repartition(n, "block").sortWithinPartitions("block").mapInArrow(whole, ddl)
