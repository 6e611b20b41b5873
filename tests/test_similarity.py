"""Candidate groups against a plain scoring of all pairs."""

import random
import re

import pytest

from cuefold.operators import similarity

SHAPE = (
    "project string, proposal_id string, title string, thesis string, subject string, episodes array<string>, characters array<string>, "
    "primary_character string, tags array<string>, refs array<string>, ranges array<struct<episode_id: string, start_ms: bigint, end_ms: bigint, ref: string>>"
)


def make(n, project, primaries, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the", "of"] * 3
    pick = lambda pool, most: [rng.choice(pool) for _ in range(rng.randint(0, most))]
    return [
        (
            project, f"p{i:03d}", rng.choice(["", "Title"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 14))), "", pick(["e1", "e2", "e3", "e4"], 2), pick(["Ann", "Bob ", "cy", "di"], 2),
            rng.choice(primaries), pick([f"t{k}" for k in range(9)], 4), pick([f"r{k}" for k in range(60)], 1), [("e1", 0, 1, rng.choice(["", f"x{rng.randint(0, 80)}"]))],
        )
        for i in range(n)
    ]


def score(a, b):
    """Restated from the survey."""
    clean = lambda xs: {x.strip().lower() for x in xs} - {""}
    words = lambda c: set(re.findall(r"\w+", " ".join(c[2:5]).lower()))
    refs = lambda c: set(c[9]) | {r[3] for r in c[10] if r[3]}
    j = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    jw, jt, jr, jc = j(words(a), words(b)), j(clean(a[8]), clean(b[8])), j(refs(a), refs(b)), j(clean(a[6]), clean(b[6]))
    same, near = a[7].strip().lower() == b[7].strip().lower() != "", bool(set(a[5]) & set(b[5]))
    lift = 0.70 if same and jw >= 0.35 else 0.55 if same and near and jw >= 0.2 else 0.50 if same and jt >= 0.3 else 0.0
    return min(1.0, max(0.40 * jw + 0.25 * jt + 0.20 * jr + 0.15 * jc, lift, 0.65 if refs(a) & refs(b) else 0.0))


def plain_groups(rows):
    group = {(r[0], r[1]): r[1] for r in rows}
    linked = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0] and score(a, b) >= 0.25 - 1e-12]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            x, y = (a[0], a[1]), (b[0], b[1])
            if group[x] != group[y]:
                group[x] = group[y] = min(group[x], group[y])
                changed = True
    return group


@pytest.mark.parametrize("primaries", [["", "Ann", "bob", "cy", "di"], ["Hero"]])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, primaries):
    """Two projects use the same ids; one primary character leads all; blocks are cut in tiles of a few rows."""
    monkeypatch.setattr(similarity, "TILE", 5)
    rows = make(60, "one", primaries, 3) + make(50, "two", primaries, 4)
    got = similarity.candidate_groups(spark.createDataFrame(rows, SHAPE).repartition(4)).collect()
    assert {(r.project, r.proposal_id): r.group_id for r in got} == plain_groups(rows)
    assert len(got) == len(rows) and len(set(plain_groups(rows).values())) > 1
    links = similarity.similar_links(spark.createDataFrame(rows, SHAPE)).collect()
    by_id = {(r[0], r[1]): r for r in rows}
    assert all(abs(score(by_id[l.project, l.a], by_id[l.project, l.b]) - l.score) < 1e-9 and l.score >= 0.25 for l in links)


def test_candidates_without_a_project_or_rows(spark):
    rows = make(12, "x", ["Ann"], 5)
    df = spark.createDataFrame(rows, SHAPE).drop("project")
    assert {("x", r.proposal_id): r.group_id for r in similarity.candidate_groups(df).collect()} == plain_groups(rows)
    assert similarity.candidate_groups(df.limit(0)).count() == 0


def test_texts_of_one_primary_and_tag_keep_all_their_links(spark):
    """A tag under one primary character is no hub of links: every pair of different texts under it is listed."""
    row = lambda i, tag: ("x", f"p{i}", "", f"w{i}", "", [f"e{i}"], [], "Ann", ["t", tag], [], [])
    rows = [row(1, "a"), row(2, "b"), row(3, "c")]
    links = similarity.similar_links(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted((l.a, l.b) for l in links) == [("p1", "p2"), ("p1", "p3"), ("p2", "p3")]


def test_rows_of_the_largest_group_meet_others_by_all_ways(spark):
    """One group holds most rows; links from it by the thesis, a character, an episode, a tag and tags without words."""
    big = [("x", f"a{i:02d}", "", f"k{i} u v w z", "", ["e1"], ["Cy"], "Bob", [f"m{i}", "n"], ["r"], []) for i in range(9)]
    out = [
        ("x", "b1", "", "k0 u v w", "", [], [], "", [], [], []), ("x", "b2", "", "u v k1 q1 q2", "", [], ["cy"], "", [], [], []),
        ("x", "b3", "", "u v k2 q3 q4 q5", "", ["e1"], [], "bob", [], [], []), ("x", "b4", "", "q6", "", [], ["cy"], "", ["n"], [], []),
        ("x", "b5", "", "", "", [], [], "", [], [], []), ("x", "b6", "", "q7", "", [], [], "bob", ["n"], [], []),
    ]
    rows = big + out
    df = spark.createDataFrame(rows, SHAPE)
    assert {(r.project, r.proposal_id): r.group_id for r in similarity.candidate_groups(df).collect()} == plain_groups(rows)
    links = {(l.a, l.b) for l in similarity.similar_links(df).collect()}
    want = {tuple(sorted((a[1], b[1]))) for a in big for b in out if score(a, b) >= 0.25 - 1e-12}
    assert want and {p for p in links if p[0][0] != p[1][0]} == want
