"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: a shard holds some documents and, for each term, the ascending positions
at which it stands in them. A phrase is found inside a shard by intersecting its terms' position lists,
each shifted by the term's offset, from the rarest term on. Shards are rows of a table, so the index is
written, pruned by column and searched like any other, and a lost executor costs some of its shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuefold.llm.common import arrow_rows, raw_text
from cuefold.session import durable

WINDOW = 10
#: Words in a shard after which the next document opens a new one.
SHARD_WORDS = 1 << 20
#: Windows in a block of the query set, about; a block is sent to every task.
BLOCK = 20_000
#: Bits of the filter of test terms: its size is fixed, whatever the query set.
FILTER_BITS = 1 << 20

# Bytes of a word stay (digits, letters in lower case, all above ASCII); the rest separates words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
INDEX_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())),
     ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("positions", pa.binary())]
)
INDEX_DDL = "shard long, doc_ids array<long>, starts array<int>, lengths array<int>, terms array<binary>, counts array<int>, positions binary"


def item_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z in lower case; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Every `width` consecutive words; fewer words, but some, are one window."""
    if not words:
        return []
    return list(dict.fromkeys(tuple(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)))


def bit_of(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) & (FILTER_BITS - 1)


def term_filter(windows: DataFrame) -> bytes:
    """A bitmap of fixed size that holds every term of the windows; with many terms it lets more others pass."""

    def run(rows):
        seen = set()
        for (terms,) in rows:
            seen.update(bit_of(t) for t in terms)
        yield from ((bit,) for bit in seen)

    bits = windows.select("terms").mapInArrow(arrow_rows(run, pa.schema([("bit", pa.int32())]), 10_000), "bit int").distinct()
    flags = np.zeros(FILTER_BITS, dtype=np.uint8)
    flags[[row.bit for row in bits.toLocalIterator()]] = 1
    return np.packbits(flags).tobytes()


class Shard:
    """Positions of terms while documents arrive; positions run on over documents with one free place between."""

    def __init__(self, wanted: np.ndarray | None):
        self.wanted = wanted
        self.local: dict[bytes, int] = {}
        self.known: list[bytes] = []
        self.docs, self.starts, self.lengths, self.ids, self.places = [], [], [], [], []
        self.end = 0

    def number(self, term: bytes) -> int:
        if self.wanted is None or self.wanted[bit_of(term)]:
            self.known.append(term)
            number = len(self.known) - 1
        else:
            number = -1
        self.local[term] = number
        return number

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        local = self.local
        for term in set(words).difference(local):
            self.number(term)
        ids = np.fromiter(map(local.__getitem__, words), dtype=np.int32, count=len(words))
        at = np.flatnonzero(ids >= 0)
        self.ids.append(ids[at])
        self.places.append((at + self.end).astype(np.int32))
        self.docs.append(doc_id)
        self.starts.append(self.end)
        self.lengths.append(len(words))
        self.end += len(words) + 1

    def row(self, shard: int) -> tuple:
        ids, places = np.concatenate(self.ids), np.concatenate(self.places)
        order = np.argsort(ids, kind="stable")
        counts = np.bincount(ids, minlength=len(self.known))
        return shard, self.docs, self.starts, self.lengths, self.known, counts.tolist(), places[order].tobytes()


def build_index(docs: DataFrame, windows: DataFrame | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The positional index of all documents, a row per shard; with `windows`, of the terms their filter lets pass.

    A shard holds about `shard_words` words, or one longer document. Documents without words are listed too.
    """
    bits = term_filter(windows) if windows is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from cuefold.llm.common import pack, rows_of

        wanted = np.unpackbits(np.frombuffer(bits, np.uint8)) if bits is not None else None
        shard = TaskContext.get().partitionId() << 32
        held = Shard(wanted)
        for batch in batches:
            for doc_id, text in rows_of(batch):
                held.add(doc_id, item_words(text))
                if held.end >= shard_words:
                    yield pack([held.row(shard)], INDEX_SCHEMA)
                    shard, held = shard + 1, Shard(wanted)
        if held.docs:
            yield pack([held.row(shard)], INDEX_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), raw_text()).mapInArrow(run, INDEX_DDL)


def test_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, terms): the distinct windows of every item's whole text; items without words have none."""
    schema = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])

    def run(rows):
        for item_id, text in rows:
            yield from ((item_id, terms) for terms in windows_of(item_words(text), width))

    return items.select(F.col("item_id").cast("long"), raw_text()).where("item_id IS NOT NULL").mapInArrow(
        arrow_rows(run, schema, 5000), "item_id long, terms array<binary>"
    )


def aligned(lists: list[np.ndarray], slop: int = 0) -> np.ndarray:
    """Places p such that list i has p + i, or with slop some place within `slop` of it; rarest list first."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    first = order[0]
    places = lists[first].astype(np.int64) - first
    if slop:
        places = np.unique((places[:, None] + np.arange(-slop, slop + 1)).ravel())
    for i in order[0 if slop else 1 :]:
        at = np.searchsorted(lists[i], places + i - slop)
        found = lists[i][np.minimum(at, len(lists[i]) - 1)]
        places = places[(at < len(lists[i])) & (found <= places + i + slop)]
        if not len(places):
            break
    return places


def search(index: DataFrame, windows: DataFrame, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """(shard, ord, doc_id, item_id, starts, width): where windows of an item stand in a document.

    With slop 0 these are exact phrases: starts are the first words of all occurrences. With slop k they
    are proximity matches: each term stands within k words of its place in the phrase. ord is the
    document's place in its shard, so rows that share a doc_id stay apart. The query set goes to the
    shards in blocks of about `block` windows, so what a task holds does not grow with it.
    """
    asked = durable(windows.select("item_id", "terms"))
    blocks = max(1, -(-asked.count() // block))
    parts = [
        _search_block(index, [(r.item_id, tuple(map(bytes, r.terms))) for r in asked.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == k).collect()], slop)
        for k in range(blocks)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _search_block(index: DataFrame, asked: list[tuple[int, tuple[bytes, ...]]], slop: int) -> DataFrame:
    schema = pa.schema([("shard", pa.int64()), ("ord", pa.int32()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("starts", pa.list_(pa.int32())), ("width", pa.int32())])
    items: dict[tuple[bytes, ...], list[int]] = {}
    for item_id, terms in asked:
        items.setdefault(terms, []).append(item_id)
    sent = index.sparkSession.sparkContext.broadcast(items)

    def run(rows):
        for shard, doc_ids, starts, lengths, terms, counts, positions in rows:
            places = np.frombuffer(positions, np.int32)
            ends = np.cumsum(counts)
            at = dict(zip(terms, range(len(terms))))
            starts, lengths = np.asarray(starts), np.asarray(lengths)
            found: dict[tuple[int, int, int], set[int]] = {}
            for phrase, owners in sent.value.items():
                numbers = [at.get(t, -1) for t in phrase]
                if min(numbers) < 0:
                    continue
                hits = aligned([places[ends[n] - counts[n] : ends[n]] for n in numbers], slop)
                ords = np.searchsorted(starts, hits, side="right") - 1
                inside = hits - starts[ords]
                whole = (ords >= 0) & (inside + len(phrase) <= lengths[ords])
                for o, p in zip(ords[whole].tolist(), inside[whole].tolist()):
                    for item in owners:
                        found.setdefault((o, item, len(phrase)), set()).add(p)
            for (o, item, width), where in sorted(found.items()):
                yield shard, o, doc_ids[o], item, sorted(where), width

    return index.select("shard", "doc_ids", "starts", "lengths", "terms", "counts", "positions").mapInArrow(
        arrow_rows(run, schema), "shard long, ord int, doc_id long, item_id long, starts array<int>, width int"
    )


def covered(spans) -> F.Column:
    """Length of the union of an array of (lo, hi) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], acc["end"]))).cast("long").alias("n"),
            F.greatest(acc["end"], s["hi"]).alias("end"),
        ),
    )["n"]


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, contaminated) per document row.

    n_hit counts the words inside any occurrence of a window of an item; item_ids are the items with an
    occurring window, as sorted text. Null and empty texts have no words and are clean; rows that repeat
    a doc_id, or have none, are answered one by one. Items without an id or words ask nothing, repeated
    items count once. Columns other than doc_id, item_id and text are not read. An empty table gives no
    rows, and an empty query set leaves every document clean.
    """
    windows = durable(test_windows(items, width).distinct())
    index = durable(build_index(docs, windows))
    hits = search(index, windows)
    spans = F.flatten(F.collect_list(F.expr("transform(starts, s -> named_struct('lo', s, 'hi', s + width))")))
    per_doc = hits.groupBy("shard", "ord").agg(covered(spans).alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    listed = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("ord", "d"))
    none = F.array().cast(T.ArrayType(T.StringType()))
    return listed.join(per_doc, ["shard", "ord"], "left").select(
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.lengths").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
