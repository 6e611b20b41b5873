"""Token counts: pieces once per distinct pre-token, joined to the pre-token frequencies of documents and summed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.term_sums import Measure, Valued, postings, summed

LIMIT = 512


def load(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


def pre_tokens(path: str) -> Callable[[], Measure]:
    """Measures a text: frequencies of the pre-tokens of several pieces; n_bytes and the tokens of all others.

    Others are the special strings of the tokenizer, which it takes as one token wherever they stand,
    and pre-tokens that the tokenizer gives back as one piece: a fixed list, made once per task by encoding
    the vocabulary. They need no look-up, and they are the frequent ones.
    """

    def start() -> Measure:
        import public_tokenizers
        import regex

        tokenizer = load(path)
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        around = regex.compile("|".join(map(regex.escape, special))) if special else None
        find = regex.compile(public_tokenizers.PATTERN).findall
        known = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
        single = {t for t, e in zip(known, tokenizer.encode_batch_fast(known, add_special_tokens=False)) if len(e.ids) == 1 and find(t) == [t]}

        def one(text: bytes | None) -> tuple[Counter, tuple[int, ...]]:
            plain = (text or b"").decode("utf-8", "replace")
            tokens = 0
            parts = [plain]
            if around is not None and around.search(plain):
                parts = around.split(plain)
                tokens = len(parts) - 1
            counts = Counter()
            for part in parts:
                counts.update(find(part))
            for term in [t for t in counts if t in single]:
                tokens += counts.pop(term)
            return counts, (len(text or b""), tokens)

        return lambda rows: (one(text) for _, text in rows)

    return start


def piece_counts(path: str) -> Callable[[], Valued]:
    """Pieces of terms, by the tokenizer itself."""

    def start() -> Valued:
        tokenizer = load(path)

        def find(terms: list[bytes], _: list[int]) -> np.ndarray:
            return np.array([[len(e.ids) for e in tokenizer.encode_batch_fast([t.decode() for t in terms], add_special_tokens=False)]], dtype=np.float64)

        return find

    return start


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per document row, without ids of a text ever being made.

    A null text is empty and has no tokens. Rows that repeat a doc_id, or have none, are counted one by
    one. Malformed UTF-8 counts as the replacement character, n_bytes as it stands. Only doc_id and text
    are read. An empty table gives no rows.
    """
    # All frequencies of a pre-token meet in its bucket: there its pieces are counted once and joined to them.
    per_doc = summed(postings(docs, pre_tokens(path)), ["pieces"], ["n_bytes", "n_single"], piece_counts(path))
    tokens = F.col("n_single") + F.col("pieces").cast("long")
    return per_doc.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
