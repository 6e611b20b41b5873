"""Packing of token sequences: bounded-space best fit, with open bins in a bitset keyed by free space."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import arrow_rows, raw_text
from cuefold.session import durable

CAPACITY = 2048
#: Bins open at once in a packer; one more and the fullest closes.
OPEN_BINS = 256
#: Pieces a packer should get at least, so that the bins left open at its end are few.
PIECES = 20_000
#: Bins of a packer with more free space than this share are emptied and packed again, all packers together.
LOOSE = 0.04
#: Distinct chunks of text whose ids a task remembers: some 60 MB.
REMEMBERED = 300_000
#: ASCII marks that may follow a letter or digit and never belong to it, nor to a special string or a short form as in "it's".
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: How the tokenizer's special strings begin; case is of no account where there is none.
SPECIAL = b"<|"
#: Latin, Greek and Cyrillic beyond ASCII; no letter there joins the one before it.
LETTERS = range(0xC0, 0x530)


class Words:
    """A tokenizer, with the alphabet of which it takes any run as one word, and what its model reads for each letter."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = {}
        for c in map(chr, [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *LETTERS]):
            normal = self.tokenizer.normalizer.normalize_str(c)
            if c.isalpha() and len(normal) == 1:
                self.table[ord(c)] = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)[0][0]
        self.word = re.compile(f"[{''.join(map(chr, self.table))}]+")

    def ends(self, stem: str) -> bool:
        """Whether marks after `stem` are apart from it: after a letter or an ASCII digit."""
        return ord(stem[-1]) in self.table or "0" <= stem[-1] <= "9"

    def ids(self, text: str) -> list[int]:
        if self.word.fullmatch(text):
            return [token.id for token in self.model.tokenize(text.translate(self.table))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def words_by(path: str) -> Words:
    """The tokenizer, kept by a worker from task to task; the ids it gave are a task's own and go with it."""
    return Words(path)


class ChunkIds(dict):
    """Token ids, as little-endian 32-bit bytes, of pieces of text between ASCII spaces.

    The tokenizer folds white space and never joins across it, so the ids of a text are those of its
    chunks in order. It parts letters and digits from marks, so a chunk's ids are those of what stands before the
    marks at its end, then theirs. Chunks met lately are looked up: once half of `REMEMBERED` are held, those not
    met since half of them were are forgotten.
    """

    def __init__(self, path: str):
        super().__init__()
        self.words, self.before = words_by(path), {}

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.before.get(chunk)
        if found is None:
            text = chunk.decode("utf-8", "replace")
            stem = text.rstrip(MARKS)
            if stem and len(stem) < len(text) and self.words.ends(stem):
                found = self[stem.encode()] + self[text[len(stem) :].encode()]
            else:
                ids = self.words.ids(text)
                found = pack(f"<{len(ids)}I", *ids)
        if len(self) >= REMEMBERED // 2:
            self.before = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def of(self, text: bytes) -> bytes:
        """Ids of a whole text. Upper case is folded first where that is all the tokenizer's normalizer would do."""
        if text.isascii() and SPECIAL not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


def word_ids(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the id `end`, cut at every `capacity` ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    last = np.array([end], dtype="<u4").tobytes()

    def run(rows):
        ids = ChunkIds(path)
        for doc_id, text in rows:
            found = ids.of(text or b"") + last
            for piece, at in enumerate(range(0, len(found), 4 * capacity)):
                part = found[at : at + 4 * capacity]
                yield doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)

    return docs.select(F.col("doc_id").cast("long"), raw_text()).mapInArrow(
        arrow_rows(run, schema, 5000, 500), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class OpenBins:
    """Open bins by free space: bit f of `bits` is set while some open bin has f free places."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def put(self, free: int, number: int) -> None:
        if not self.by_free[free]:
            self.bits |= 1 << free
        self.by_free[free].append(number)
        self.open += 1

    def place(self, length: int) -> tuple[int, int, int | None]:
        """Bin and offset for a piece, and the bin that closes: the open bin with the least sufficient space, or a new one.

        A full bin is closed at once; one bin too many closes the fullest.
        """
        enough = self.bits >> length
        if enough:
            free = length + (enough & -enough).bit_length() - 1
            number = self.take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        if free == length:
            return number, self.capacity - free, number
        self.put(free - length, number)
        full = self.take((self.bits & -self.bits).bit_length() - 1) if self.open > self.most else None
        return number, self.capacity - free, full


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"
PLACED_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32())] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset", "fill")]
)


def pack_once(pieces: DataFrame, capacity: int, packers: int, open_bins: int, turn: int) -> DataFrame:
    """Pieces with sequence_id, offset and fill (tokens in their sequence): each packer takes its pieces as they arrive.

    A hash of the piece deals pieces out, so packers are alike even if one source holds a third of the rows. A
    bin's rows go out when it closes: a packer holds its open bins, however many pieces pass.
    """

    def placed(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        base = (turn << 56) | (TaskContext.get().partitionId() << 32)
        bins, held = OpenBins(capacity, open_bins), {}

        def closed(number: int) -> Iterator[tuple]:
            members = held.pop(number)
            fill = members[-1][-1] + members[-1][3]
            return ((*m[:5], base + number, m[5], fill) for m in members)

        for row in rows:
            number, offset, done = bins.place(row[3])
            held.setdefault(number, []).append((*row, offset))
            if done is not None:
                yield from closed(done)
        for number in list(held):
            yield from closed(number)

    dealt = pieces.repartition(packers, F.xxhash64("doc_id", "piece", "start", "ids_crc32"))
    return dealt.sortWithinPartitions("doc_id", "piece", "ids_crc32").mapInArrow(arrow_rows(placed, PLACED_SCHEMA, 20_000), PLACED)


def pack_best_fit(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_packer: int = PIECES, loose: float = LOOSE) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset, no sequence above capacity.

    Pieces are packed as they come, by doc_id, in `open_bins` bins at a time. As many packers as the session
    shuffles into work side by side, fewer if they would get less than `per_packer` pieces; the bins that
    were closed or left loosely filled are emptied and packed again, by fewer packers.
    """
    most = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packers = lambda n: max(1, min(most, ceil(n / per_packer)))
    pieces = durable(pieces)
    first = durable(pack_once(pieces, capacity, packers(pieces.count()), open_bins, 0))
    tight = F.col("fill") >= capacity * (1 - loose)
    rest = durable(first.where(~tight).select("doc_id", "piece", "start", "length", "ids_crc32"))
    again = pack_once(rest, capacity, packers(rest.count()), open_bins, 1)
    return first.where(tight).unionByName(again).drop("fill")


def packed_documents(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents, packed.

    A null or empty text is the one id `end`. A text longer than a sequence is cut into full pieces and a
    rest. Rows that repeat a doc_id, or have none, are packed one by one. Only doc_id and text are read.
    An empty table gives no rows.
    """
    return pack_best_fit(word_ids(docs, path, end, capacity), capacity)
