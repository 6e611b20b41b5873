"""Signatures of inputs, and which stored results they leave stale.

Equal inputs give equal keys; the canonical text is JSON with sorted fields. Ordered children are
hashed as an ordered list, so keys of keys follow the hierarchy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefold.session import discard, durable

MTIME_MS = 1
#: Children hashed together; more are hashed in runs of as many first.
FAN = 256
#: What stands before a stored signature's own text, longer than a hash.
MARK = bytes(33)


def signature(**parts: Column) -> Column:
    """SHA-256 over named parts in name order; a missing part counts as null."""
    fields = F.struct(*[value.alias(name) for name, value in sorted(parts.items())])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def rolled(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """One hash per key over the ordered values of its rows.

    Every row's digest covers its place in the order, so the digests may be summed in any order:
    four 60-bit slices and the count, combined map-side. No key is ever gathered.
    """
    digest = F.sha2(F.to_json(F.struct(*order, value.alias("_value")), {"ignoreNullFields": "false"}), 256)
    slices = [F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = rows.select(*keys, digest.alias("_d")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_s{i}") for i, s in enumerate(slices)]
    )
    return sums.select(*keys, F.sha2(F.concat_ws("|", "_n", "_s0", "_s1", "_s2", "_s3"), 256).alias(name))


def transcript_hash(cues: DataFrame, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Hash of an episode's cues in order."""
    line = F.concat_ws("|", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), "text")
    return rolled(cues, keys, ["start_ms", "end_ms", "ordinal"], line, "transcript_hash")


def stale(current: DataFrame, stored: DataFrame, keys: Sequence[str], parts: Sequence[str], mtime: str | None = None) -> DataFrame:
    """Current rows without a stored result of equal parts (and a modification time within 1 ms)."""
    left = current.select(*keys, *parts, *([mtime] if mtime else []))
    right = stored.select(*keys, *parts, *([F.col(mtime).alias("_mtime")] if mtime else []), F.lit(True).alias("_hit"))
    met = left.join(right, [*keys, *parts], "left")
    fresh = F.coalesce("_hit", F.lit(False))
    if mtime:
        fresh = fresh & (F.abs(F.col(mtime) - F.col("_mtime")) <= MTIME_MS)
    hits = met.where(fresh).select(*keys).distinct()
    return current.join(hits, list(keys), "left_anti")


def stale_outputs(outputs: DataFrame, stored: DataFrame, sound: DataFrame) -> DataFrame:
    """Outputs to render: not completed under the same render signature, or whose folder has issues.

    outputs, stored: output_id, render_signature (stored also status); sound: output_id of folders without issues.
    """
    done = stored.where("status = 'COMPLETED'").select("output_id", "render_signature").join(sound.select("output_id"), "output_id", "left_semi")
    return outputs.join(done, ["output_id", "render_signature"], "left_anti")


def _bits(text: Column) -> Column:
    """A signature's bytes, half as long as its text; a text that is no SHA-256 in lower case is kept whole behind a mark."""
    other = F.concat(F.lit(MARK), F.encode(text, "UTF-8"))
    return F.when(text.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(text)).otherwise(other)


def _text(bits: Column) -> Column:
    """The inverse of `_bits`."""
    other = F.decode(F.substring(bits, len(MARK) + 1, 1 << 30), "UTF-8")
    return F.when(F.octet_length(bits) == 32, F.lower(F.hex(bits))).otherwise(other)


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _runs(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, at, bits, held): runs of `FAN` rows by position, hashed in order, and how many are held by each.

    rows: keys, at, bits, held. A task holds a run, however many rows a key has.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda c: _text(c["bits"]))
    run = F.floor(F.col("at") / FAN).alias("at")
    return rows.groupBy(*keys, run).agg(_sha(F.array_join(texts, "")).alias("bits"), F.sum("held").alias("held"))


def _many(runs: DataFrame) -> DataFrame:
    """(id, bits): one hash of each id that has all its `n` children in `runs`, more than one: runs of runs, until one is left."""
    level, room, done = runs.select("id", "n", "at", "bits", "held").distinct(), FAN, []
    while True:
        level, room = durable(_runs(level, "id", "n")), room * FAN
        done.append(level.where((F.col("n") <= room) & (F.col("held") == F.col("n"))).select("id", "bits"))
        level = level.where(F.col("n") > room)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, done)


def node_signatures(nodes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(id, signature) of every node of a tree from its own inputs and its children's signatures in order.

    nodes: id, parent (null at a root), at (dense position among its siblings), own (text of its inputs).
    A leaf is the hash of its own text, an inner node that of its own text and the hash of its children.
    Levels are computed from the leaves up, a round each; in a round a parent is computed once all its children
    are. Every node is stored once with its number of children; a child's place goes with its signature, so it travels once,
    to its parent, and only a run's hash is stored there. `stored` (id, signature) gives nodes whose signatures
    still hold, see `stale_nodes`: only the others are computed, from stored ones where they meet them. A node under a
    missing parent is a root; what hangs on a cycle, or above it, has no signature and is left out.
    """
    counts = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    shape = nodes.select("id", "parent", "at", "own").join(counts, "id", "left")
    # Rows of one id are taken for as many children each.
    shape = shape.withColumn("twins", F.count(F.lit(1)).over(Window.partitionBy("id")))
    one = F.lit(1).cast("bigint")
    if stored is not None:
        shape = shape.join(stored.select("id", _bits(F.col("signature")).alias("kept"), F.lit(True).alias("held")), "id", "left")
    else:
        shape = shape.withColumns({"kept": F.lit(None).cast("binary"), "held": F.lit(None).cast("boolean")})
    shape = durable(shape)
    fresh = F.col("held").isNull()
    leaves = shape.where(fresh & F.col("n").isNull())
    inner = shape.where(fresh & F.col("n").isNotNull()).select("id", F.col("parent").alias("above"), F.col("at").alias("above_at"), "own", "n", "twins")

    def told(found: DataFrame) -> DataFrame:
        """(parent, at, bits, held): what found nodes bring their parents."""
        bring = found.where("id IS NOT NULL AND parent IS NOT NULL")
        return bring.select("parent", "at", "bits", F.explode(F.array_repeat(one, F.col("twins").cast("int"))).alias("held"))

    signed = lambda digest: _sha(F.concat_ws("|", "own", _text(digest)))
    by_own = lambda found: found.select("id", "parent", "at", _sha(F.col("own")).alias("bits"), "twins")
    waiting = told(by_own(leaves))
    parts = [leaves.select("id", F.sha2("own", 256).alias("signature"))]
    if stored is not None:
        parts.insert(0, stored.select("id", "signature"))
        waiting = waiting.unionByName(told(shape.where(~fresh).select("id", "parent", "at", F.col("kept").alias("bits"), one.alias("twins"))))
    few, full = F.col("n") <= FAN, F.col("held") == F.col("n")
    rest = None
    while True:
        bits = F.when(few & full, signed(F.col("bits"))).otherwise(F.col("bits"))
        met = durable(_runs(waiting, "parent").withColumnRenamed("parent", "id").join(inner, "id").select("id", "above", "above_at", "n", "twins", "at", "held", bits.alias("bits")))
        found = met.where(few & full).select("id", F.col("above").alias("parent"), F.col("above_at").alias("at"), "bits", "twins")
        late, large = met.where(few & ~full).select("id"), met.where(~few)
        if not large.isEmpty():
            whole = durable(_many(large).join(inner, "id").select("id", F.col("above").alias("parent"), F.col("above_at").alias("at"), signed(F.col("bits")).alias("bits"), "twins"))
            found, late = found.unionByName(whole), late.unionByName(large.select("id").distinct().join(whole, "id", "left_anti"))
        if found.isEmpty():
            break
        parts.append(found.select("id", _text(F.col("bits")).alias("signature")))
        before, rest = rest, None
        if not late.isEmpty():
            rest = durable(waiting.join(late.select(F.col("id").alias("parent")), "parent", "left_semi"))
        discard(before)
        waiting = told(found) if rest is None else rest.unionByName(told(found))
    return reduce(DataFrame.unionByName, parts)


def stale_nodes(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(id): the changed nodes and all above them, a round a level. changed: id."""
    up = nodes.where("parent IS NOT NULL").select("id", "parent")
    front = durable(changed.select("id").distinct().join(nodes.select("id"), "id", "left_semi"))
    parts = []
    while not front.isEmpty():
        parts.append(front)
        seen = reduce(DataFrame.unionByName, parts)
        front = durable(front.join(up, "id").select(F.col("parent").alias("id")).distinct().join(seen, "id", "left_anti"))
    return reduce(DataFrame.unionByName, parts) if parts else front
