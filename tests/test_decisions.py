"""Merges of candidates: chains, unions, cycles."""

from cuefold.operators import decisions

CAND = (
    "proposal_id string, title string, thesis string, scope string, confidence double, episodes array<string>, characters array<string>, primary_character string, "
    "supporting_characters array<string>, refs array<string>, facts array<string>, hooks array<string>, ranges array<struct<episode_id: string, start_ms: bigint, end_ms: bigint, ref: string>>"
)
DEC = "candidate_id string, ordinal int, action string, reason_code string, target_id string"
CONS = "proposal_id string, title string, scope string, episodes array<string>, characters array<string>, refs array<string>, ranges array<struct<episode_id: string, start_ms: bigint, end_ms: bigint, ref: string>>"


def candidate(i, lead, start, **more):
    row = dict(proposal_id=i, title=f"T {i}", thesis=f"thesis {i}", scope="SINGLE_EPISODE", confidence=0.9, episodes=["e1"], characters=[f"char {i}"], primary_character=lead,
               supporting_characters=[f"side {i}"], refs=[f"ref {i}"], facts=[f"fact {i}"], hooks=[f"hook {i}"], ranges=[("e1", start, start + 500, f"ref {i}")])
    return tuple({**row, **more}.values())


def test_a_chain_of_merges_ends_in_one_survivor_with_all_of_them(spark):
    """A goes into B and B into C: C gets the ranges, people, facts and hooks of all three."""
    cands = spark.createDataFrame([candidate("A", "Ann", 0), candidate("B", "", 9_000, episodes=["e2"]), candidate("C", "Cy", 90_000), candidate("D", "Di", 5, confidence=0.1), candidate("E", "", 7)], CAND)
    dec = spark.createDataFrame([("A", 0, "MERGE", "", "B"), ("B", 0, "MERGE", "", "C"), ("B", 1, "REJECT", "late", ""), ("C", 0, "KEEP", "", ""), ("E", 0, "MERGE", "", "E")], DEC)
    cons = spark.createDataFrame([("C", "T C", "SINGLE_EPISODE", ["e1"], ["new"], [], [("e1", 91_000, 92_000, ""), ("e9", 0, 1, "made up"), ("e9", 5, 6, "ref A")])], CONS)
    final, kept = decisions.reconcile(cands, dec, cons)
    assert {r.candidate_id: (r.action, r.target_id) for r in final.collect()} == {"A": ("MERGE", "C"), "B": ("MERGE", "C"), "C": ("KEEP", ""), "D": ("REJECT", ""), "E": ("MERGE", "E")}
    rows = {r.proposal_id: r for r in kept.collect()}
    assert set(rows) == {"C"}
    c = rows["C"]
    assert [(r.episode_id, r.start_ms) for r in c.ranges] == [("e1", 0), ("e1", 9_000), ("e1", 90_000), ("e1", 91_000), ("e9", 5)]
    assert c.scope == "CROSS_EPISODE" and c.episodes == ["e1", "e2"] and c.primary_character == "Cy"
    assert c.characters == sorted(["Ann", "Cy", "new", *[f"{k} {i}" for k in ("char", "side") for i in "ABC"]])
    assert c.supporting_characters == [x for x in c.characters if x != "Cy"]
    assert (c.refs, c.facts, c.hooks) == tuple([f"{k} {i}" for i in "ABC"] for k in ("ref", "fact", "hook"))


def test_tables_without_people_or_facts_count_as_empty(spark):
    cands = spark.createDataFrame([candidate("A", "Ann", 0)], CAND).drop("supporting_characters", "facts", "hooks")
    kept = decisions.reconcile(cands, spark.createDataFrame([], DEC), spark.createDataFrame([], CONS))[1].collect()
    assert [(r.proposal_id, r.primary_character, r.facts) for r in kept] == [("A", "Ann", [])]
