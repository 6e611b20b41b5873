"""Merkle manifest of a dataset as a persistent tree: versions share what they do not change.

Rows are leaves of their source's tree, sources are leaves of the root's tree; 16 consecutive nodes have one
parent. A task builds the tree over an aligned block of 256 leaves. A tampered leaf makes a version of it: only
its ancestors are copied, all other nodes are those of the first version. Above the blocks the same is done with
blocks of their tops, level by level as jobs over ever fewer rows; a block then gets the runs of siblings on its
way to the root once, and each of its versions is continued over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import arrow_rows
from cuefold.operators.ranking import ranked
from cuefold.session import durable

ARITY, LEVELS = 16, 2
BLOCK = ARITY**LEVELS


def record_digest(*columns: Column) -> Column:
    """sha256 of a row's values in order, each as byte count, colon, value; a null is `-`."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in columns]).cast("binary"), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


@dataclass(frozen=True, slots=True)
class Node:
    """A node of any version; it never changes, so versions can share it."""

    digest: str
    children: tuple[Node, ...] = ()

    @staticmethod
    def over(children: tuple[Node, ...]) -> Node:
        return Node(digest("".join(c.digest for c in children)), children)


def grown(leaves: list[str], whole: bool) -> tuple[Node, int]:
    """Root and height over the leaves: of `LEVELS` in a tree of more blocks, else until one node remains."""
    level, height = [Node(d) for d in leaves], 0
    while len(level) > 1 or (whole and height < LEVELS):
        level = [Node.over(tuple(level[i : i + ARITY])) for i in range(0, len(level), ARITY)]
        height += 1
    return level[0], height


def version(root: Node, height: int, at: int, leaf: str) -> Node:
    """The root of the version whose leaf `at` is another one: the ancestors are new, all else is shared."""
    if height == 0:
        return Node(leaf)
    i, rest = divmod(at, ARITY ** (height - 1))
    kids = root.children
    return Node.over(kids[:i] + (version(kids[i], height - 1, rest, leaf),) + kids[i + 1 :])


def runs(root: Node, height: int, above: tuple = ()) -> Iterator[tuple[tuple[str, str], ...]]:
    """For every leaf in order the digests left and right of its path, from its own level up."""
    if height == 0:
        yield above
        return
    names = [c.digest for c in root.children]
    for i, child in enumerate(root.children):
        beside = ("".join(names[:i]), "".join(names[i + 1 :]))
        yield from runs(child, height - 1, (beside, *above))


def whole(block: int, size: int) -> bool:
    """Whether the block is surely one of a tree of whole blocks; block 0 with fewer leaves is a tree of its own."""
    return block > 0 or size == BLOCK


RUNS = "array<struct<l: string, r: string>>"
RUNS_TYPE = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def folded(nodes: DataFrame) -> DataFrame:
    """(tree, idx, block, runs, top): nodes in aligned blocks, with the siblings on their way to the block's top."""
    schema = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("block", pa.int64()), ("runs", RUNS_TYPE), ("top", pa.string())])
    grouped = nodes.groupBy("tree", F.expr(f"idx div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("members"))

    def run(rows):
        for tree, block, members in rows:
            root, height = grown([m["digest"] for m in members], whole(block, len(members)))
            for m, beside in zip(members, runs(root, height)):
                yield tree, m["idx"], block, [{"l": l, "r": r} for l, r in beside], root.digest

    return grouped.select("tree", "block", "members").mapInArrow(arrow_rows(run, schema), f"tree string, idx long, block long, runs {RUNS}, top string")


def ways_up(nodes: DataFrame) -> DataFrame:
    """(tree, idx, runs, root) of nodes (tree, idx, digest): the siblings on the way to their tree's root, and the root.

    Each turn has a 256th of the rows of the one before.
    """
    nodes = durable(nodes)
    if nodes.where("idx > 0").isEmpty():
        return nodes.select("tree", "idx", F.expr(f"CAST(array() AS {RUNS})").alias("runs"), F.col("digest").alias("root"))
    members = durable(folded(nodes))
    higher = ways_up(members.where(F.col("idx") % BLOCK == 0).select("tree", F.col("block").alias("idx"), F.col("top").alias("digest")))
    up = higher.select("tree", F.col("idx").alias("block"), F.col("runs").alias("more"), "root")
    return members.join(up, ["tree", "block"]).select("tree", "idx", F.concat("runs", "more").alias("runs"), "root")


def leaf_blocks(leaves: DataFrame) -> DataFrame:
    """(tree, block, members, top): each tree's leaves by ascending doc_id, in aligned blocks of 256."""
    rows = durable(leaves).withColumn("row", F.monotonically_increasing_id())
    placed = ranked(rows, ["tree"], ["doc_id", "leaf", "row"], "rank").withColumn("idx", F.col("rank") - 1)
    grouped = placed.groupBy("tree", F.expr(f"idx div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "doc_id", "leaf", "tampered"))).alias("members"))
    schema = pa.schema([
        ("tree", pa.string()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("leaves", pa.list_(pa.string())),
        ("tampered", pa.list_(pa.string())), ("top", pa.string()),
    ])

    def run(rows):
        for tree, block, members in rows:
            names = [m["leaf"] for m in members]
            yield tree, block, [m["doc_id"] for m in members], names, [m["tampered"] for m in members], grown(names, whole(block, len(names)))[0].digest

    return grouped.select("tree", "block", "members").mapInArrow(
        arrow_rows(run, schema, 20), "tree string, block long, ids array<long>, leaves array<string>, tampered array<string>, top string"
    )


def manifest(leaves: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of leaves (doc_id, source, leaf, tampered).

    `tampered` is the digest of the changed row, null where it is unchanged. A source's leaves ascend by
    doc_id, a null id first, rows of one id by digest, equal rows by place; a null source is a source of its own,
    the first. proof_sha256 digests all siblings up to the root. folded_root is the root of the leaf's own
    version, in which it alone is changed. An empty table gives no rows; other columns are not read.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    blocks = durable(leaf_blocks(leaves.select(F.col("doc_id").cast("long"), tree.alias("tree"), "leaf", "tampered")))
    inside = durable(ways_up(blocks.select("tree", F.col("block").alias("idx"), F.col("top").alias("digest"))))
    subroots = inside.where("idx = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"))
    numbered = durable(ranked(subroots, ["tree"], ["source"], "rank").select("tree", "source", (F.col("rank") - 1).alias("idx"), "digest"))
    outside = ways_up(numbered.drop("source")).join(numbered.select("idx", "source"), "idx")
    paths = inside.select("tree", F.col("idx").alias("block"), "runs", F.col("root").alias("subroot")).join(
        outside.select(F.col("source").alias("tree"), F.col("runs").alias("more"), "root"), "tree"
    )
    whole_paths = paths.select("tree", "block", F.concat("runs", "more").alias("runs"), "subroot", "root")
    schema = pa.schema([("doc_id", pa.int64())] + [(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [("verified", pa.bool_())])

    def run(rows):
        for block, ids, names, tampered, beside, subroot, root in rows:
            above = [(r["l"], r["r"]) for r in beside]
            rest = "".join(l + r for l, r in above)
            top, height = grown(names, whole(block, len(names)))

            def continued(node: Node) -> str:
                name = node.digest
                for l, r in above:
                    name = digest(l + name + r)
                return name

            first = continued(top)
            for at, (doc_id, leaf, changed, path) in enumerate(zip(ids, names, tampered, runs(top, height))):
                proof = digest("".join(l + r for l, r in path) + rest)
                fold = first if changed is None else continued(version(top, height, at, changed))
                yield doc_id, leaf, subroot, root, proof, fold, fold == root

    return blocks.join(whole_paths, ["tree", "block"]).select("block", "ids", "leaves", "tampered", "runs", "subroot", "root").mapInArrow(
        arrow_rows(run, schema), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
