"""Size-bounded plans: halving until a piece fits, greedy left-to-right groups, fixed partitions.

Sizes are additive (see `escaped_bytes`), so plans work on (keys, pos, bytes) tables of running
sums; texts are joined back afterwards and never travel through a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefold.functions import requests as rq
from cuefold.operators.intervals import running_sum
from cuefold.operators.overlap import overlap_join
from cuefold.operators.ranking import ranked
from cuefold.session import durable

BLOCK = 4096
#: Blocks whose functions one task composes.
FAN = 64
EP = ["episode_id"]


def halve_until_fit(
    nodes: DataFrame, units: DataFrame, keys: Sequence[str], cap: int, base: Callable[[], Column], max_items: int | None = None
) -> DataFrame:
    """Pieces of each node's unit list, halved at the middle until they fit.

    nodes: keys, start_ms, end_ms and whatever `base` reads; units: keys, pos (dense from 0),
    bytes, start_ms, end_ms. A piece fits when base + bytes <= cap and it has at most `max_items`
    units; single units are never split. Time is cut at the right half's first start, else the
    left half's last end, else the middle. Adds lo, hi (positions), size, path. A round looks up
    two positions per open piece; the depth is the logarithm of the longest list.
    """
    kept = [c for c in nodes.columns if c not in ("start_ms", "end_ms")]
    sums = running_sum(units.select(*keys, "pos", "bytes", F.col("start_ms").alias("u_start"), F.col("end_ms").alias("u_end")), keys, "pos", F.col("bytes"), "before")
    totals = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("hi"), F.sum("bytes").alias("_to"))
    zero = F.lit(0).cast("bigint")
    first = nodes.join(totals, list(keys), "left").select(
        *kept, "start_ms", "end_ms", zero.alias("lo"), F.coalesce("hi", zero).alias("hi"), zero.alias("_from"), F.coalesce("_to", zero).alias("_to"), F.lit("").alias("path")
    )
    size = F.col("_to") - F.col("_from")
    fits = base() + size <= cap
    if max_items is not None:
        fits = fits & (F.col("hi") - F.col("lo") <= max_items)
    done = fits | (F.col("hi") - F.col("lo") <= 1)
    shown = lambda df: df.select(*kept, "start_ms", "end_ms", "lo", "hi", (base() + size).alias("size"), "path")
    level = durable(first)
    leaves = shown(level.where(done))
    open_ones = level.where(~done)
    if open_ones.isEmpty():
        return leaves
    # Only lists with an open piece are looked into again.
    sums = durable(sums.join(open_ones.select(*keys).distinct(), list(keys), "left_semi"))
    right_edge = sums.select(*keys, F.col("pos").alias("_mid"), F.col("before").alias("_cut"), F.col("u_start").alias("_r0"))
    left_edge = sums.select(*keys, (F.col("pos") + 1).alias("_mid"), F.col("u_end").alias("_l1"))
    while True:
        halved = open_ones.withColumn("_mid", F.expr("lo + (hi - lo) div 2"))
        met = halved.join(right_edge, [*keys, "_mid"]).join(left_edge, [*keys, "_mid"])
        inside = lambda c: (F.col(c) > F.col("start_ms")) & (F.col(c) < F.col("end_ms"))
        cut = (
            F.when(inside("_r0"), F.col("_r0")).when(inside("_l1"), F.col("_l1"))
            .when(F.col("end_ms") > F.col("start_ms"), F.expr("(start_ms + end_ms) div 2")).otherwise(F.col("start_ms"))
        )
        met = met.withColumn("_at", cut)
        side = lambda lo, hi, a, z, s, e, mark: F.struct(
            F.col(s).alias("start_ms"), F.col(e).alias("end_ms"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(a).alias("_from"), F.col(z).alias("_to"),
            F.concat("path", F.lit(mark)).alias("path"),
        )
        both = F.array(
            side("lo", "_mid", "_from", "_cut", "start_ms", "_at", "_f1"), side("_mid", "hi", "_cut", "_to", "_at", "end_ms", "_f2")
        )
        level = durable(met.select(*kept, F.explode(both).alias("_s")).select(*kept, "_s.*"))
        leaves = leaves.unionByName(shown(level.where(done)))
        open_ones = level.where(~done)
        if open_ones.isEmpty():
            return leaves


def greedy_groups(units: DataFrame, keys: Sequence[str], room: int, max_items: int) -> DataFrame:
    """Left-greedy groups: adds `group_no` from 0 per key.

    units: keys, pos (dense from 0), bytes (with separator). A group takes units while their sum
    stays within `room` and their number within `max_items`; a unit too large stands alone.

    Greedy packing is sequential, but a block of positions is a small function from where a group
    starts in it to where the next block is entered. Those functions are found per (key, block)
    in parallel, composed in a tree of `FAN` blocks a node, and applied per block: no task holds a key.
    """
    block = max(BLOCK, max_items)
    at = F.floor(F.col("pos") / block).cast("bigint")
    slim = units.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.col("bytes").cast("bigint").alias("bytes"))
    own = slim.withColumn("_block", at)
    halo = own.where((F.col("pos") % block < max_items) & (F.col("_block") > 0)).withColumn("_block", F.col("_block") - 1)
    rows = own.unionByName(halo)
    by = [*keys, "_block"]
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keys).schema)

    def steps(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int, np.ndarray]:
        pdf = pdf.sort_values("pos", kind="stable")
        n_own = int((pdf["pos"] // block == pdf["_block"].iloc[0]).sum())
        cum = np.concatenate([[0], np.cumsum(pdf["bytes"].to_numpy(np.int64))])
        i = np.arange(n_own)
        reach = np.searchsorted(cum, cum[:n_own] + room, side="right") - 1
        return pdf, n_own, np.maximum(i + 1, np.minimum(reach, i + max_items))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n_own, nxt = steps(pdf)
        out = np.empty(n_own, np.int64)
        for i in range(n_own - 1, -1, -1):
            out[i] = nxt[i] - n_own if nxt[i] >= n_own else out[nxt[i]]
        entry = [int(out[e]) if e < n_own else e - n_own for e in range(max_items)]
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "exits": entry}])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n_own, nxt = steps(pdf)
        flag = np.zeros(n_own, np.int64)
        i = int(pdf["entry"].iloc[0])
        while i < n_own:
            flag[i] = 1
            i = int(nxt[i])
        return pdf.iloc[:n_own][[*keys, "pos"]].assign(opens=flag)

    maps = rows.groupBy(*by).applyInPandas(exits, f"{key_schema}, _block bigint, exits array<bigint>")
    entered = block_entries(maps, keys, key_schema)
    flags = rows.join(entered, by).groupBy(*by).applyInPandas(starts, f"{key_schema}, pos bigint, opens bigint")
    numbered = running_sum(flags, keys, "pos", F.col("opens"), "_before")
    group = numbered.select(*keys, "pos", (F.col("_before") + F.col("opens") - 1).alias("group_no"))
    return units.join(group, [*keys, "pos"])


def block_entries(maps: DataFrame, keys: Sequence[str], key_schema: str) -> DataFrame:
    """(keys, _block, entry): where each block is entered, from 0 into the first.

    maps: keys, _block, exits: for every place where a block may be entered the place in the next one.
    `FAN` neighbours make one such function, these make functions again until one is left; then
    each node, entered at a known place, passes its members theirs.
    """
    maps = durable(maps)
    if maps.where("_block > 0").isEmpty():
        return maps.select(*keys, "_block", F.lit(0).cast("bigint").alias("entry"))
    grouped = maps.withColumn("_node", F.floor(F.col("_block") / FAN))
    at = [*keys, "_node"]

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = [np.asarray(e) for e in pdf.sort_values("_block")["exits"]]
        place = np.arange(len(chain[0]))
        for exits in chain:
            place = exits[place]
        return pdf[at].head(1).assign(exits=[place])

    def passed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        place, entries = int(pdf["entry"].iloc[0]), []
        for exits in pdf["exits"]:
            entries.append(place)
            place = int(exits[place])
        return pdf[[*keys, "_block"]].assign(entry=entries)

    nodes = grouped.groupBy(*at).applyInPandas(joined, f"{key_schema}, _node bigint, exits array<bigint>").withColumnRenamed("_node", "_block")
    higher = block_entries(nodes, keys, key_schema).withColumnRenamed("_block", "_node")
    return grouped.join(higher, at).groupBy(*at).applyInPandas(passed, f"{key_schema}, _block bigint, entry bigint")


def season_batches(items: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Batches of three or four in order (five make three and two); adds `batch_no`.

    Closed form on the position and the count, so nothing is windowed.
    """
    n, p = F.col("_n"), F.col(pos)
    threes = F.when(n % 4 == 0, 0).when(n % 4 == 1, 3).when(n % 4 == 2, 2).otherwise(1)
    fours = F.expr("_n div 4") - F.when(n % 4 == 1, 2).when(n % 4 == 2, 1).otherwise(0)
    by_size = F.when(p < fours * 4, F.floor(p / 4)).otherwise(fours + F.floor((p - fours * 4) / 3))
    number = F.when(n <= 4, 0).when(n == 5, F.when(p < 3, 0).otherwise(1)).otherwise(by_size)
    counts = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return items.join(counts, list(keys)).withColumn("batch_no", number.cast("bigint")).drop("_n")


def forced_pairs(items: DataFrame, pos: str = "pos") -> DataFrame:
    """Neighbours in pairs; adds `pair_no`."""
    return items.withColumn("pair_no", F.floor(F.col(pos) / 2))


def chunk_plan(episodes: DataFrame, chunks: DataFrame, cues: DataFrame, envelope: int, target: int = rq.TARGET_BYTES) -> DataFrame:
    """Scan requests of each time chunk: those that fit stay whole, others are halved by cues.

    episodes: episode_id, source_video, duration_ms; chunks: episode_id, chunk_index, start_ms,
    end_ms; cues: episode_id, ordinal, start_ms, end_ms, text. Returns pieces with the positions
    lo..hi of their cues, bytes, and whether the only cue must be capped.
    """
    keys = [*EP, "chunk_index"]
    line = rq.escaped_bytes(F.col("text")) + 30 + 2
    sized = cues.where(F.trim("text") != "").select(*EP, "ordinal", "start_ms", "end_ms", line.alias("bytes"))
    met = overlap_join(chunks.select(*keys, "start_ms", "end_ms"), sized, EP, inclusive=True).select(
        *keys, F.col("r_ordinal").alias("ordinal"), F.col("r_start_ms").alias("start_ms"), F.col("r_end_ms").alias("end_ms"), F.col("r_bytes").alias("bytes")
    )
    nodes = chunks.select(*keys, "start_ms", "end_ms").join(episodes.select(*EP, "source_video", "duration_ms"), EP)
    sums = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("hi"), F.sum("bytes").alias("_b"))
    head = lambda: rq.escaped_bytes(rq.scan_header(F.col("episode_id"), F.col("source_video"), F.col("start_ms"), F.col("end_ms"), F.col("duration_ms"))) + envelope
    # A closing line break follows the transcript: two more bytes, as after every line.
    silent = head() + rq.escaped_bytes(rq.no_dialogue(F.col("start_ms"), F.col("end_ms"))) + 2
    full = nodes.join(sums, keys, "left")
    whole = full.where(F.col("hi").isNull() | (head() + F.col("_b") <= target))
    fitted = whole.select(
        *keys, "start_ms", "end_ms", F.lit(0).cast("bigint").alias("lo"), F.coalesce("hi", F.lit(0)).cast("bigint").alias("hi"),
        F.when(F.col("hi").isNull(), silent).otherwise(head() + F.col("_b")).alias("size"), F.lit("").alias("path"),
    )
    large = durable(full.where(F.col("hi").isNotNull() & (head() + F.col("_b") > target)).drop("hi", "_b"))
    if not large.isEmpty():
        placed = ranked(met.join(large.select(*keys), keys, "left_semi"), keys, ["start_ms", "end_ms", "ordinal"], "_n")
        pieces = halve_until_fit(large, placed.withColumn("pos", F.col("_n") - 1), keys, target, head)
        fitted = fitted.unionByName(pieces.select(*fitted.columns))
    return fitted.withColumn("capped", F.col("size") > target)


def second_pass_plan(groups: DataFrame, cues: DataFrame, anchors: DataFrame, base: int, target: int = rq.TARGET_BYTES) -> DataFrame:
    """Second-pass requests of gap groups: halved by cues without anchors, then as many anchors as fit.

    groups: episode_id, group_start_ms (key), start_ms, end_ms (clamped to the episode); cues with
    text; anchors: episode_id, group_start_ms, rank (dense from 0), bytes and short_bytes of each
    anchor near the group. Full anchors are tried first, then shortened ones from the front.
    """
    keys = [*EP, "group_start_ms"]
    line = rq.escaped_bytes(F.col("text")) + 20 + 2
    sized = cues.where(F.trim("text") != "").select(*EP, "ordinal", "start_ms", "end_ms", line.alias("bytes"))
    met = overlap_join(groups.select(*keys, "start_ms", "end_ms"), sized, EP, inclusive=True, pad_ms=10_000).select(
        *keys, F.col("r_ordinal").alias("ordinal"), F.col("r_start_ms").alias("start_ms"), F.col("r_end_ms").alias("end_ms"), F.col("r_bytes").alias("bytes")
    )
    placed = ranked(met, keys, ["start_ms", "end_ms", "ordinal"], "_n").withColumn("pos", F.col("_n") - 1)
    pieces = halve_until_fit(groups.select(*keys, "start_ms", "end_ms"), placed, keys, target, lambda: F.lit(base).cast("bigint"))
    upto = running_sum(running_sum(anchors, keys, "rank", F.col("bytes"), "_full"), keys, "rank", F.col("short_bytes"), "_short")
    ends = upto.select(*keys, "rank", (F.col("_full") + F.col("bytes")).alias("full_to"), (F.col("_short") + F.col("short_bytes")).alias("short_to"))
    ends = durable(ends)
    total = ends.groupBy(*keys).agg(F.count("rank").alias("_anchors"), F.max("full_to").alias("_all"))
    # A piece meets the sums that may fit beside it, at most `target` a group, however many anchors the group has.
    room = ends.where(F.col("short_to") <= target).groupBy(*keys, "short_to").agg(F.count("rank").alias("_n"))
    fit = pieces.join(room, keys, "left").groupBy(*keys, "start_ms", "end_ms", "lo", "hi", "size", "path").agg(
        F.coalesce(F.sum(F.when(F.col("size") + F.col("short_to") <= target, F.col("_n"))), F.lit(0)).alias("_short_fit"),
    ).join(total, keys, "left").withColumn("anchors", F.coalesce("_anchors", F.lit(0)))
    whole = F.coalesce(F.col("size") + F.col("_all") <= target, F.lit(True))
    return fit.select(
        *keys, "start_ms", "end_ms", "lo", "hi", "size", "path", F.when(whole, F.col("anchors")).otherwise(F.col("_short_fit")).alias("anchors"),
        (~whole).alias("shortened"), (F.col("size") > target).alias("capped"),
    )


def capped_groups(proposals: DataFrame, keys: Sequence[str], sizes: dict[int, str], full: str, room: int, least: int) -> DataFrame:
    """Groups of proposals: one group if all fit in full, else each takes the first text cap that
    fits alone and groups are packed greedily.

    sizes: text cap to the column of bytes at that cap, largest cap first; `least` is the smallest
    bytes a proposal can have, which bounds the number in a group.
    """
    total = proposals.groupBy(*keys).agg(F.sum(full).alias("_all"))
    levels = F.array(*[F.struct(F.lit(cap).alias("cap"), F.col(column).cast("bigint").alias("bytes")) for cap, column in sizes.items()])
    fitting = F.get(F.filter(levels, lambda v: v["bytes"] <= room), F.lit(0))
    smallest = F.element_at(levels, -1)
    chosen = proposals.withColumn("_c", F.when(F.col(full) <= room, F.struct(F.lit(None).cast("int").alias("cap"), F.col(full).cast("bigint").alias("bytes"))).otherwise(F.coalesce(fitting, smallest)))
    known = chosen.join(total, list(keys))
    one = known.where(F.col("_all") <= room).select(*keys, "pos", F.col(full).cast("bigint").alias("bytes"), F.lit(None).cast("int").alias("text_cap"), F.lit(0).cast("bigint").alias("group_no"))
    many = known.where(F.col("_all") > room).select(*keys, "pos", F.col("_c.bytes").alias("bytes"), F.col("_c.cap").alias("text_cap"))
    return one.unionByName(greedy_groups(many, keys, room, max(1, room // least)).select(*one.columns))


def node_split(members: DataFrame, keys: Sequence[str], cap: int, base: int, max_items: int = 10) -> DataFrame:
    """Halves of candidate groups with more than `max_items` members or too many bytes.

    members: keys, pos, bytes. Survivors of the halves are compared again by the caller's next round.
    """
    timed = members.withColumns({"start_ms": F.lit(0).cast("bigint"), "end_ms": F.lit(0).cast("bigint")})
    nodes = timed.select(*keys, "start_ms", "end_ms").distinct()
    return halve_until_fit(nodes, timed, keys, cap, lambda: F.lit(base).cast("bigint"), max_items).drop("start_ms", "end_ms")


def merge_rounds(items: DataFrame, keys: Sequence[str], room: int, fan_in: int = 4) -> DataFrame:
    """Levels of a hierarchical merge down to one item per key: (keys, level, pos, into).

    Each level packs neighbours greedily by bytes, at most `fan_in`; a key none of whose items can
    share a group is merged in forced pairs. A merged item is as large as its parts together but
    never more than the room, since it must fit alone.
    """
    level, out = 0, None
    current = items.select(*keys, "pos", "bytes")
    while True:
        counts = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        current = durable(current.join(counts.where("_n > 1"), list(keys)))
        if current.isEmpty():
            return out if out is not None else items.limit(0).select(*keys, F.lit(0).alias("level"), "pos", F.col("pos").alias("into"))
        grouped = greedy_groups(current, keys, room, fan_in)
        stuck = grouped.groupBy(*keys).agg((F.max("group_no") + 1 == F.max("_n")).alias("_stuck"))
        step = grouped.join(stuck, list(keys)).select(
            *keys, "pos", "bytes", F.when(F.col("_stuck"), F.floor(F.col("pos") / 2)).otherwise(F.col("group_no")).alias("into")
        )
        step = durable(step)
        shown = step.select(*keys, F.lit(level).alias("level"), "pos", "into")
        out = shown if out is None else out.unionByName(shown)
        current = step.groupBy(*keys, F.col("into").alias("pos")).agg(F.least(F.sum("bytes"), F.lit(room)).alias("bytes"))
        level += 1


def dense(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Adds positions from 0 per key; for keys known to hold few rows."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn(name, number.cast("bigint"))
