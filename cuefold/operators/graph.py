"""Connected components and chain resolution, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.session import discard, durable


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group): each node with the smallest id of its component.

    nodes: id; links: a, b. Large-star and small-star rounds: every node tells its neighbours
    the smallest id it sees, so link counts never grow and stars of any degree need only a
    minimum (map-side combined) and one join. Each round is made durable and checked by an
    order-free fingerprint; it stops when nothing moves, after O(log n) rounds in practice.
    """
    star = durable(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct()
    )
    seen = None
    while True:
        mark = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = star.unionByName(star.select(F.col("m").alias("v"), F.col("v").alias("m")))
        lowest = both.groupBy("v").agg(F.min("m").alias("lo")).select("v", F.least("v", "lo").alias("lo"))
        # Large star: every larger neighbour of v hangs on the lowest id around v.
        hung = both.join(lowest, "v").where(F.col("m") > F.col("v")).select(F.col("m").alias("v"), F.col("lo").alias("m")).where("v <> m").distinct()
        # Small star: v and its smaller neighbours hang on the lowest of them.
        low2 = hung.groupBy("v").agg(F.min("m").alias("lo"))
        kids = hung.join(low2, "v").where(F.col("m") != F.col("lo")).select(F.col("m").alias("v"), F.col("lo").alias("m"))
        before, star = star, durable(kids.unionByName(low2.select("v", F.col("lo").alias("m"))).distinct())
        discard(before)
    roots = star.groupBy(F.col("v").alias("id")).agg(F.min("m").alias("group"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("group", "id").alias("group"))


def resolve_chains(targets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Final target of every merge: A to B and B to C makes A to C.

    targets: keys, id, target with one row per id. Pointer jumping doubles the reach of every
    walk per round, so a chain of n ends after log n rounds; each round ends some walk unless
    only walks into cycles are left. Those stop where the next step would repeat an id: a walk from a cycle
    before its own start, one from outside before the id where it entered.
    """
    on = [*keys, "id"]
    base = targets.select(*on, "target")
    hop = durable(base.select(*on, F.col("target").alias("at"), F.lit(True).alias("open")))
    ended = -1
    while True:
        ahead = hop.select(*keys, F.col("id").alias("at"), F.col("at").alias("far"), F.col("open").alias("far_open"))
        hop = durable(
            hop.join(ahead, [*keys, "at"], "left")
            .select(*on, F.coalesce("far", "at").alias("at"), F.col("far").isNotNull().alias("open"))
        )
        now = hop.where("not open").count()
        if now == ended:
            break
        ended = now
    loose = hop.where("not open").select(*on, F.col("at").alias("target"))
    endless = hop.where("open").select(*on, "at")
    return loose if endless.isEmpty() else loose.unionByName(_cycle_ends(base, endless, keys))


def _cycle_ends(base: DataFrame, endless: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, id, target): where the walks stop that never end.

    They keep doubling until the ids they are at grow no fewer: then those are the ids on cycles, since jumping
    as far again only permutes them. What leads into a cycle is a chain that ends at its first id there.
    """
    on = [*keys, "id"]
    reached = None
    while True:
        n = endless.select(*keys, "at").distinct().count()
        if n == reached:
            break
        reached = n
        ahead = endless.select(*keys, F.col("id").alias("at"), F.col("at").alias("far"))
        endless = durable(endless.join(ahead, [*keys, "at"]).select(*on, F.col("far").alias("at")))
    cycle = durable(endless.select(*keys, F.col("at").alias("id")).distinct())
    steps = durable(base.join(endless, on, "left_semi"))
    last = durable(steps.join(cycle, on, "left_semi").select(*keys, F.col("target").alias("id"), F.col("id").alias("target")))
    outside = steps.join(cycle, on, "left_anti")
    entries = resolve_chains(outside, keys).select(*on, F.col("target").alias("entry"))
    ends = last.select(*keys, F.col("id").alias("entry"), "target")
    return last.select(*on, "target").unionByName(entries.join(ends, [*keys, "entry"]).select(*on, "target"))
