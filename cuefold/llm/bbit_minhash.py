"""Near duplicates by b-bit MinHash: bands propose, packed low bits estimate, full shingle sets confirm."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import WordHashes, arrow_rows, mixed, raw_text, words_of
from cuefold.operators.graph import connected_components
from cuefold.session import discard, durable

SHINGLE = 5
BITS = 4
BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
PER_LONG = 64 // BITS
LONGS = HASHES // PER_LONG
#: A pair at the threshold is missed by every band with probability (1 - 0.75^4)^40 = 2.5e-7.
THRESHOLD = 0.75
#: Hubs of a bucket grow by this factor from round to round.
DRAW = 32
#: Members of a bucket that are compared with its hubs at once; those of larger ones stand in blocks of about `TILE`.
BLOCK, TILE = 64, 128

_generator = np.random.default_rng(20_24)
FACTORS = _generator.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _generator.integers(0, 2**63, HASHES, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle, no words are none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashes.of(words)
    n = max(len(h) - SHINGLE + 1, 1)
    width = min(SHINGLE, len(h))
    code = np.full(n, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        code = code * STEP + h[i : i + n]
    return np.unique(mixed(code))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set; blocks of rows stay in the processor's cache."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    return least


def packed_bits(least: np.ndarray) -> list[int]:
    """The low bits of all minima, sixteen to a 64-bit word."""
    low = (mixed(least) & np.uint64((1 << BITS) - 1)).reshape(LONGS, PER_LONG)
    shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64).tolist()


def band_keys(least: np.ndarray) -> list[int]:
    code = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        code = mixed(code * STEP + least.reshape(BANDS, ROWS)[:, i])
    return code.view(np.int64).tolist()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_shingles, code, bands) per row: digest names the word sequence, code packs the low bits and the bands; no words, no bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("code", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(rows):
        hashes = WordHashes()
        for doc_id, text in rows:
            words = words_of(text)
            shingles = shingle_set(words, hashes)
            digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
            if len(shingles):
                least = minima(shingles)
                bands = band_keys(least)
                yield doc_id, digest, len(shingles), np.array([*packed_bits(least), *bands], np.int64).tobytes(), bands
            else:
                yield doc_id, digest, 0, b"", []

    return docs.select(F.col("doc_id").cast("long"), raw_text()).where("doc_id IS NOT NULL").mapInArrow(
        arrow_rows(run, schema), "doc_id long, digest binary, n_shingles long, code binary, bands array<long>"
    )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles): the full set of each row, packed."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(rows):
        hashes = WordHashes()
        for doc_id, text in rows:
            yield doc_id, shingle_set(words_of(text), hashes).tobytes()

    return docs.select("doc_id", raw_text()).mapInArrow(arrow_rows(run, schema, 500), "doc_id long, shingles binary")


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many low bits agree, for each row of packed signatures `a` with each row of `b`: by bit counts of the differing ones."""
    x = a[:, None, :] ^ b[None, :, :]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return HASHES - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities by packed signatures, corrected for chance: low bits of different minima agree once in 2^b."""
    chance = 2.0**-BITS
    return (agreeing(a, b) / HASHES - chance) / (1 - chance)


def missed_by_bands(threshold: float) -> float:
    """The share of pairs exactly at the threshold that share no band."""
    return (1 - threshold**ROWS) ** BANDS


def fewest_agreeing(threshold: float) -> int:
    """The most low bits out of HASHES that may be asked to agree so that, by the exact binomial, no more pairs at the threshold are lost than the bands lose."""
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * threshold
    lost, k = (1 - agree) ** HASHES, 0
    while lost <= missed_by_bands(threshold) and k < HASHES:
        k += 1
        lost += comb(HASHES, k) * agree**k * (1 - agree) ** (HASHES - k)
    return k


def screen(threshold: float) -> float:
    """The estimate below which a candidate is dropped unseen: half a minimum under the fewest that must agree."""
    chance = 2.0**-BITS
    return ((fewest_agreeing(threshold) - 0.5) / HASHES - chance) / (1 - chance)


def blocks(rows: DataFrame, size: str, name: str) -> DataFrame:
    """(bucket, `name`): a bucket's members, together if they are few, else block by block; size: how many the bucket has."""
    at = F.when(F.col(size) > BLOCK, F.col("block")).otherwise(F.lit(0).cast("bigint"))
    return rows.groupBy("bucket", at.alias(f"{name}_at")).agg(F.collect_list(F.struct("rep", "home", "n", "block", "code")).alias(name))


def candidates(live: DataFrame, hubs: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """(one, two, a, b): pairs of members with hubs of their bucket that may reach the threshold, all of two blocks in a row.

    A pair counts in the first bucket it shares, if it is not connected yet, if its sizes allow the threshold and
    its signatures agree often enough. Where everyone is a hub, one of the two asks.
    """
    sizes = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_live")).join(hubs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_hubs"), F.first("everyone").alias("everyone")), "bucket")
    mine = blocks(live.join(sizes.select("bucket", "n_live"), "bucket").join(codes, "rep"), "n_live", "members")
    theirs = blocks(hubs.join(sizes.select("bucket", "n_hubs"), "bucket").join(codes, "rep"), "n_hubs", "hubs")
    met = mine.join(theirs, "bucket").join(sizes.select("bucket", "everyone"), "bucket").select("bucket", "everyone", "members", "hubs")
    schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])
    fewest, per_cent = fewest_agreeing(threshold), round(threshold * 100)

    def unpacked(members: list[dict]) -> tuple[np.ndarray, ...]:
        column = lambda name: np.array([m[name] for m in members], dtype=np.int64)
        codes = np.frombuffer(b"".join(m["code"] for m in members), np.uint64).reshape(len(members), -1)
        return column("rep"), column("home"), column("n"), column("block"), codes[:, :LONGS], codes[:, LONGS:].view(np.int64)

    def run(rows):
        for bucket, everyone, members, heads in rows:
            rep, home, n, block, bits, bands = unpacked(members)
            hub, hub_home, hub_n, hub_block, hub_bits, hub_bands = unpacked(heads)
            other = home[:, None] < hub_home if everyone else home[:, None] != hub_home
            fits = other & (100 * np.minimum(n[:, None], hub_n) >= per_cent * np.maximum(n[:, None], hub_n))
            if not fits.any():
                continue
            i, j = np.nonzero(fits & (agreeing(bits, hub_bits) >= fewest))
            same = bands[i] == hub_bands[j]
            first = bands[i, same.argmax(axis=1)] == bucket
            i, j = i[first], j[first]
            found: dict[tuple[int, int], tuple[list, list]] = {}
            pairs = (np.minimum(block[i], hub_block[j]), np.maximum(block[i], hub_block[j]), np.minimum(rep[i], hub[j]), np.maximum(rep[i], hub[j]))
            for one, two, a, b in zip(*(p.tolist() for p in pairs)):
                lists = found.setdefault((one, two), ([], []))
                lists[0].append(a)
                lists[1].append(b)
            for (one, two), (a, b) in found.items():
                yield one, two, a, b

    pairs = met.mapInArrow(arrow_rows(run, schema, 500, 8), "one long, two long, a array<long>, b array<long>")
    return pairs.groupBy("one", "two").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))


def confirmed(tiles: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of the tiles that reach the threshold, by intersection and union of the full sets.

    A set travels once a tile, however many pairs it is in there.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    per_cent = round(threshold * 100)

    def reaches(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= per_cent * (len(x) + len(y) - both)

    def run(rows):
        for a, b, members in rows:
            # Rows that repeat an id are one document's texts: any of them may link it.
            held: dict[int, list] = {}
            for m in members:
                held.setdefault(m["doc_id"], []).append(np.frombuffer(m["shingles"], np.uint64))
            for one, two in zip(a, b):
                if any(reaches(x, y) for x in held[one] for y in held[two]):
                    yield one, two

    needed = tiles.select("one", "two", F.explode(F.array_union("a", "b")).alias("doc_id"))
    brought = needed.join(sets, "doc_id").groupBy("one", "two").agg(F.collect_list(F.struct("doc_id", "shingles")).alias("members"))
    return tiles.join(brought, ["one", "two"]).select("a", "b", "members").mapInArrow(arrow_rows(run, schema, 10_000, 8), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document: the least doc_id its links reach.

    Documents of one word sequence are one class, named by its least id; only that one goes on. Bands of
    four minima propose: the members of a bucket are compared with hubs, never all with all. A hub that
    has met everybody leaves its bucket, and a bucket whose members are one component is done. The most
    central component of a bucket sends its hub first, then DRAW are drawn and DRAW times as many each round, so every pair that
    shares a band and is not yet connected is compared in the end, in the first bucket it shares, after
    log(components) rounds. Compared means: estimated from packed
    low bits, then confirmed on the full sets.

    A null or empty text, or one without words, has no shingles, links with nothing and is kept. Rows with
    a null doc_id are left out, since links name documents by id; rows that repeat an id are one document's
    texts and share its links. Only doc_id and text are read. An empty table gives no rows.
    """
    signed = durable(signatures(docs))
    copies = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("code").alias("code"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    reps = durable(copies)
    members = reps.where(F.size("bands") > 0).select("rep", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = durable(members.join(full, "bucket"))
    # How many others a document meets over all its buckets: the original of many copies meets the most. Documents
    # whose largest bucket is the same stand in blocks of it, so that those alike stand together.
    top = F.max(F.struct("n", "bucket"))
    weight = shared.groupBy("rep").agg(F.sum("n").alias("weight"), top.alias("top")).select(
        "rep", "weight", F.xxhash64("top.bucket", F.pmod(F.xxhash64("rep"), F.ceil(F.col("top.n") / TILE))).alias("block")
    )
    members = first_members = durable(shared.select("bucket", "rep").join(weight, "rep"))
    discard(shared)
    nodes = durable(members.select(F.col("rep").alias("id")).distinct())
    # Most documents meet nobody; signatures and sets are kept only of the rest.
    codes = durable(reps.where(F.size("bands") > 0).select("rep", "n", "code").join(nodes.withColumnRenamed("id", "rep"), "rep"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = durable(shingle_sets(texts.join(nodes.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")))
    home = durable(nodes.select(F.col("id").alias("rep"), F.col("id").alias("home")))
    before: list[DataFrame] = [first_members]
    turn = 0
    while True:
        homed = members.join(home, "rep")
        open_buckets = homed.groupBy("bucket").agg(F.min("home").alias("lo"), F.max("home").alias("hi"), F.approx_count_distinct("home").alias("homes")).where("lo <> hi")
        live = durable(homed.join(open_buckets.select("bucket", "homes"), "bucket"))
        discard(*before)
        if live.isEmpty():
            break
        # The most central component of a bucket sends its hub first; then more are drawn, alike in all their
        # buckets; once that would be all components, every member is a hub and the bucket is done.
        share = F.lit(float(DRAW**turn if turn else 0))
        heads = live.where(F.col("homes") > share).groupBy("bucket", "home").agg(
            F.max_by(F.struct("rep", "block"), F.struct("weight", "rep")).alias("head"), F.max("weight").alias("weight"), F.first("homes").alias("homes")
        )
        best = heads.groupBy("bucket").agg(F.max(F.struct("weight", "home")).alias("best"))
        drawn = F.pmod(F.xxhash64("home", F.lit(turn)), F.lit(1 << 20)) * F.col("homes") <= F.lit(1 << 20) * share
        heads = heads.join(best, "bucket").where(drawn | (F.col("best.home") == F.col("home"))).select("bucket", "home", "head.*", F.lit(False).alias("everyone"))
        everyone = live.where(F.col("homes") <= share).select("bucket", "home", "rep", "block", F.lit(True).alias("everyone"))
        hubs = durable(heads.unionByName(everyone))
        tiles = durable(candidates(live, hubs, codes, threshold))
        links = confirmed(tiles, sets, threshold)
        # Links join components: only those they touch are resolved anew.
        at = lambda end: home.select(F.col("rep").alias(end), F.col("home").alias(f"{end}_home"))
        joins = durable(links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_home").alias("a"), F.col("b_home").alias("b")).where("a <> b").distinct())
        if not joins.isEmpty():
            touched = joins.select(F.col("a").alias("id")).unionByName(joins.select(F.col("b").alias("id"))).distinct()
            moved = connected_components(touched, joins).select(F.col("id").alias("home"), "group")
            old, home = home, durable(home.join(moved, "home", "left").select("rep", F.coalesce("group", "home").alias("home")))
            discard(old)
        discard(tiles, joins)
        members = live.join(hubs.select("bucket", "rep"), ["bucket", "rep"], "left_anti").select("bucket", "rep", "weight", "block")
        before = [live, hubs]
        turn += 1
    discard(live, sets, codes, nodes)
    joined = reps.select("digest", "rep", F.size("bands").alias("__n")).join(home, "rep", "left").select(
        "digest", F.when(F.col("__n") > 0, F.coalesce("home", "rep")).alias("component")
    )
    component = F.coalesce("component", "doc_id")
    return signed.select("doc_id", "digest", "n_shingles").join(joined, "digest").select(
        "doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )
