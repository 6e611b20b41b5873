"""Coverage rules on their literal cases, and gap reconciliation against a loop."""

import random

from cuefold.operators import coverage as cov
from cuefold.operators.gaps import GAP, first_free_matches, reconcile_gaps

CUE = "episode_id string, ordinal bigint, start_ms bigint, end_ms bigint, text string"
EV = "episode_id string, category string, idx bigint, start_ms bigint, end_ms bigint, characters array<string>, summary string"
SPAN = "episode_id string, start_ms bigint, end_ms bigint"
EPISODE = "episode_id string, duration_ms bigint"


def detect(spark, cues, evidence, duration, chunks=None):
    eps = spark.createDataFrame([("e", duration)], EPISODE)
    planned = spark.createDataFrame(chunks, "episode_id string, chunk_index int, start_ms bigint, end_ms bigint") if chunks else None
    out = cov.detect_gaps(spark.createDataFrame(cues, CUE), spark.createDataFrame([], SPAN), spark.createDataFrame(evidence, EV), eps, planned)
    return out.orderBy("ordinal").collect()


def test_silence(spark):
    gaps = detect(spark, [("e", 1, 0, 10_000, "a"), ("e", 2, 50_000, 60_000, "b")], [], 60_000)
    assert [(g.gap_id, g.start_ms, g.end_ms, g.is_actionable, g.status) for g in gaps] == [("gap_silence_01", 10_000, 50_000, False, "RESOLVED")]


def test_dropped_speech(spark):
    gaps = detect(spark, [("e", 1, 10_000, 20_000, "a"), ("e", 2, 20_000, 30_000, "b"), ("e", 3, 30_000, 45_000, "c")], [], 45_000)
    assert [(g.gap_type, g.status) for g in gaps] == [("DROPPED_TRANSCRIPT", "PENDING")]


def test_sparse_chunk(spark):
    cues = [("e", i, i * 3_000, i * 3_000 + 2_990, "words") for i in range(16)]
    gaps = detect(spark, cues, [("e", "major_scenes", 0, 0, 5_000, [], "x")], 60_000, [("e", 0, 0, 60_000)])
    assert [g.gap_type for g in gaps if g.gap_type == "CHUNK_SPARSITY"] == ["CHUNK_SPARSITY"]


def test_character_deficit(spark):
    gaps = detect(spark, [("e", i, i * 1_000, i * 1_000 + 900, "Bob: hello") for i in range(4)], [], 4_000)
    assert [(g.gap_type, g.target_characters) for g in gaps] == [("CHARACTER_DEFICIT", ["Bob"])]


def test_category_deficit(spark):
    cues = [("e", i, i * 12_000, i * 12_000 + 11_990, "words") for i in range(25)]
    gaps = detect(spark, cues, [("e", "major_scenes", 0, 0, 320_000, [], "x")], 320_000)
    assert ["conflicts"] in [g.target_categories for g in gaps if g.gap_type == "CATEGORY_DEFICIT"]
    assert ["major_scenes"] not in [g.target_categories for g in gaps]


def test_status_and_characters(spark):
    cues = spark.createDataFrame([("e", 1, 0, 1_000, "[Ann] hi"), ("e", 2, 2_000, 3_000, "where is ANN?")], CUE)
    evidence = spark.createDataFrame([("e", "failures", 0, 5_000, 6_000, ["Ann", "Jo"], "x")], EV)
    rows = {r.name: r for r in cov.character_coverage(cues, evidence).collect()}
    assert (rows["Ann"].lines, rows["Ann"].items, rows["Ann"].first_ms, rows["Ann"].last_ms, rows["Ann"].has_action) == (1, 1, 0, 6_000, True)
    assert (rows["Jo"].first_ms, rows["Jo"].is_supporting) == (5_000, True)
    eps = spark.createDataFrame([("e", 6_000), ("empty", 5_000)], EPISODE)
    none = spark.createDataFrame([], SPAN)
    timeline = cov.timeline_coverage(cues, none, evidence, eps)
    status = {r.episode_id: r.status for r in cov.episode_status(timeline, spark.createDataFrame([], GAP)).collect()}
    assert status == {"e": "COMPLETE_TRANSCRIPT_ONLY", "empty": "EMPTY_NO_DATA"}


def known_again(a, b):
    """Restated from the survey: by id; else of one type, by targets or by time."""
    shared = {"CATEGORY_DEFICIT": "target_categories", "CHARACTER_DEFICIT": "target_characters"}.get(a["gap_type"])
    over = min(a["end_ms"], b["end_ms"]) - max(a["start_ms"], b["start_ms"])
    apart = max(abs(a["start_ms"] - b["start_ms"]), abs(a["end_ms"] - b["end_ms"]))
    alike = bool(set(a[shared]) & set(b[shared])) if shared else over > 0 or apart <= 10_000
    return a["gap_id"] == b["gap_id"] != "" or a["gap_type"] == b["gap_type"] and alike


def reconcile_loop(found, prior):
    used, out = set(), []
    for gap in found:
        hit = next((i for i, old in enumerate(prior) if i not in used and known_again(gap, old)), None)
        if hit is None:
            out.append((gap["gap_id"], gap["status"], gap["is_actionable"]))
            continue
        used.add(hit)
        old = prior[hit]
        out.append((old["gap_id"], old["status"], old["is_actionable"] if old["status"] != "PENDING" else gap["is_actionable"]))
    return sorted(out + [(g["gap_id"], g["status"], g["is_actionable"]) for i, g in enumerate(prior) if i not in used and g["status"] != "PENDING"])


def test_reconcile_matches_a_loop(spark):
    rng = random.Random(5)
    names = [f.split(" ")[0] for f in GAP.split(", ")]

    def make(ep, n, mark):
        rows = []
        for i in range(n):
            s = rng.randint(0, 200_000)
            rows.append((ep, f"{mark}{rng.randint(0, 9)}_{i}", rng.choice(["DROPPED_TRANSCRIPT", "CATEGORY_DEFICIT", "CHARACTER_DEFICIT"]), i, s, s + rng.randint(0, 40_000),
                         [rng.choice("abc")], [rng.choice("xyz")], rng.random() < 0.5, rng.choice(["PENDING", "RESOLVED", "PERSISTENT_EMPTY"])))
        return rows

    found = [r for e in range(12) for r in make(f"e{e}", rng.randint(0, 30 if e == 3 else 8), "n")]
    prior = [r for e in range(12) for r in make(f"e{e}", rng.randint(0, 30 if e == 3 else 8), "o")]
    # Ids that return, an empty one, and a gap without length.
    found += [("e0", "", "DROPPED_TRANSCRIPT", 50, 9, 9, [], [], True, "PENDING"), ("e1", "same", "OTHER", 51, 0, 1, [], [], True, "PENDING")]
    prior += [("e0", "", "DROPPED_TRANSCRIPT", 50, 9, 9, ["c"], ["z"], False, "RESOLVED"), ("e1", "same", "CATEGORY_DEFICIT", 51, 900_000, 900_001, ["q"], [], False, "RESOLVED")]
    got = {}
    for r in reconcile_gaps(spark.createDataFrame(found, GAP), spark.createDataFrame(prior, GAP)).collect():
        got.setdefault(r.episode_id, []).append((r.gap_id, r.status, r.is_actionable))
    for e in range(12):
        of = lambda rows: [dict(zip(names, r)) for r in rows if r[0] == f"e{e}"]
        assert sorted(got.get(f"e{e}", [])) == reconcile_loop(of(found), of(prior))


def test_one_hot_episode_is_matched_in_order(spark):
    """Every found gap may be any earlier one: the k-th gets the k-th, in rounds that need no task with them all."""
    pairs = spark.range(40).crossJoin(spark.range(30).withColumnRenamed("id", "p")).selectExpr("'e' AS k", "id AS d", "p")
    assert sorted((r.d, r.p) for r in first_free_matches(pairs.where("d < 6 OR p < 6"), ["k"]).collect()) == [(i, i) for i in range(6)]
    assert first_free_matches(pairs.limit(0), ["k"]).count() == 0


def test_episodes_of_two_projects_stay_apart(spark):
    shape = "project string, " + GAP
    row = lambda project, gap_id, status: (project, "E01", gap_id, "DROPPED_TRANSCRIPT", 1, 0, 50_000, ["major_scenes"], [], True, status)
    found = spark.createDataFrame([row("a", "n1", "PENDING"), row("b", "n2", "PENDING")], shape)
    prior = spark.createDataFrame([row("b", "o1", "RESOLVED"), row("c", "o2", "RESOLVED")], shape)
    got = {(r.project, r.gap_id, r.status) for r in reconcile_gaps(found, prior, ["project", "episode_id"]).collect()}
    assert got == {("a", "n1", "PENDING"), ("b", "o1", "RESOLVED"), ("c", "o2", "RESOLVED")}


def test_mentions_against_a_loop(spark, monkeypatch):
    rng = random.Random(7)
    letters = "abAB é"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(0, n)))
    cues = [("hot" if rng.random() < 0.7 else "cold", i, i * 10, i * 10 + rng.randrange(1, 50), rng.choice([None, word(3), word(30)])) for i in range(300)]
    names = list({(e, word(6)) for e in ("hot", "cold", "none") for _ in range(60)})
    want = {}
    for e, name in names:
        met = [(c[2], c[3]) for c in cues if c[0] == e and c[4] and c[4].strip() and name.lower() in c[4].lower()]
        if name.strip() and met:
            want[e, name] = (min(a for a, _ in met), max(z for _, z in met))
    for limits in ((20_000, 200_000), (7, 40)):
        monkeypatch.setattr(cov, "NAMES_A_BLOCK", limits[0])
        monkeypatch.setattr(cov, "CUES_A_BLOCK", limits[1])
        got = cov.mention_spans(spark.createDataFrame(names, "episode_id string, name string"), spark.createDataFrame(cues, CUE)).collect()
        assert {(r.episode_id, r.name): (r.m_first, r.m_last) for r in got} == want and len(got) == len(want)
