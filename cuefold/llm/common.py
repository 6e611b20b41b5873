"""What the operators of this subpackage share: bytes of texts, words, arrow rows, shuffle helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefold.operators.ranking import ranked
from cuefold.session import durable

# Upper-case ASCII letters to lower case, on bytes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# The word separators of the quality, duplicate and language-model operators: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_text(column: str = "text") -> Column:
    """A text as its bytes: Python workers then neither decode it nor fail on malformed UTF-8."""
    return F.col(column).cast("string").cast("binary")


def words_of(text: bytes | None, lower: bool = True) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, upper-case ASCII folded; null has none."""
    if not text:
        return []
    return (text.translate(LOWER) if lower else text).split()


class WordHashes(dict):
    """64-bit hash of each word, kept for the words met lately: at most `most` of them."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of an arrow batch as tuples of Python values."""
    return zip(*(column.to_pylist() for column in batch.columns)) if batch.num_columns else iter(())


def arrow_rows(make: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, size: int = 2000, at_once: int | None = None):
    """A function for `mapInArrow` from one over row tuples; output goes out in batches of `size` rows.

    `at_once` rows of a batch are Python values at a time, all if it is None: few for rows of long lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        parts = (batch.slice(i, at_once) for batch in batches for i in range(0, batch.num_rows, at_once)) if at_once else batches
        for row in make(row for part in parts for row in rows_of(part)):
            held.append(row)
            if len(held) >= size:
                yield pack(held, schema)
                held = []
        if held:
            yield pack(held, schema)

    return run


def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


ROW, FILE, PLACE = "__pipeline_row", "__pipeline_file", "__pipeline_place"


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with a number of their own in `ROW`: ids may be null or repeat, these don't.

    Where the documents are read from files, it is the number of the file and the row's place in it, the same in
    every plan; nothing is copied. Other documents are written with numbers first.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))
    except AnalysisException:
        return durable(docs.withColumn(ROW, F.monotonically_increasing_id()))
    files = ranked(placed.select(FILE).distinct().withColumn("all", F.lit(0)), ["all"], [FILE], ROW).select(FILE, ROW)
    return placed.join(durable(files), FILE).withColumn(ROW, F.shiftleft(ROW, 40) + F.col(PLACE)).select(*docs.columns, ROW)


def by_row(rows: DataFrame) -> DataFrame:
    """Numbered documents under their row numbers in place of their ids, so that each row is judged as its own."""
    return rows.withColumn("doc_id", F.col(ROW)).drop(ROW)


def without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """Numbered documents whose row number is not among the `doc_id`s of `rejected`, with their own columns.

    The numbers are written first, so that the planner knows their size: a short list is broadcast by
    its measured size and the texts stay where they are, a long one is joined by a shuffle.
    """
    gone = durable(rejected.select(F.col("doc_id").alias(ROW)))
    return rows.join(gone, ROW, "left_anti").drop(ROW)


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file; it is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)
