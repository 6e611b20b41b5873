"""Signatures of trees against a plain recursion."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cuefold.operators import signatures

SHAPE = "id string, parent string, at bigint, own string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, fan):
    kids = {}
    for i, parent, at, _ in rows:
        kids.setdefault(parent, []).append((at, i))
    own = {r[0]: r[3] for r in rows}

    def sign(i):
        level = [sign(c) for _, c in sorted(kids.get(i, []))]
        if not level:
            return sha(own[i])
        while True:
            level = [sha("".join(level[k : k + fan])) for k in range(0, len(level), fan)]
            if len(level) == 1:
                return sha(f"{own[i]}|{level[0]}")

    return {r[0]: sign(r[0]) for r in rows}


@pytest.fixture
def tree():
    rng = random.Random(2)
    rows, counts = [("n0", None, 0, "root"), ("alone", None, 0, "alone")], {}
    for k in range(1, 90):
        parent = "n0" if k < 30 else f"n{rng.randrange(k)}"
        rows.append((f"n{k}", parent, counts.get(parent, 0), rng.choice(["a", "b", ""])))
        counts[parent] = counts.get(parent, 0) + 1
    return rows


def test_signatures_follow_the_tree(spark, monkeypatch, tree):
    monkeypatch.setattr(signatures, "FAN", 3)
    got = {r.id: r.signature for r in signatures.node_signatures(spark.createDataFrame(tree, SHAPE).repartition(4)).collect()}
    assert got == plain(tree, 3)


def test_a_change_marks_its_ancestors_and_only_they_are_computed(spark, monkeypatch, tree):
    monkeypatch.setattr(signatures, "FAN", 3)
    parent = {r[0]: r[1] for r in tree}
    changed, want = "n77", set()
    at = changed
    while at:
        want.add(at)
        at = parent[at]
    new = [(*r[:3], "changed") if r[0] == changed else r for r in tree]
    nodes = spark.createDataFrame(new, SHAPE)
    stale = signatures.stale_nodes(nodes, nodes.where(F.col("id") == changed))
    assert {r.id for r in stale.collect()} == want
    before = spark.createDataFrame(list(plain(tree, 3).items()), "id string, signature string")
    held = before.join(stale, "id", "left_anti")
    now = {r.id: r.signature for r in signatures.node_signatures(nodes, held).collect()}
    assert now == plain(new, 3) and {i for i, h in now.items() if h != plain(tree, 3)[i]} == want
    assert signatures.stale_nodes(nodes, nodes.limit(0)).count() == 0
