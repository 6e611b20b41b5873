"""Interval algebra against plain restatements on random input."""

import random

from pyspark.sql import functions as F

from cuefold.operators.clips import remap_cues
from cuefold.operators.intervals import complement, merge_intervals, running_sum, subtract_intervals
from cuefold.operators.overlap import overlap_join, overlap_semi

SPAN = "episode_id string, ordinal bigint, start_ms bigint, end_ms bigint"


def merged(spans, tolerance=50):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + tolerance:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def subtracted(bases, cuts):
    left = list(bases)
    for cs, ce in merged(cuts):
        nxt = []
        for s, e in left:
            if not max(s, cs) < min(e, ce):
                nxt.append((s, e))
                continue
            if s < cs:
                nxt.append((s, cs))
            if e > ce:
                nxt.append((ce, e))
        left = nxt
    return [x for x in left if x[1] - x[0] > 100]


def random_rows(rng, episodes=40, most=25, horizon=4000, longest=600):
    rows, n = [], 0
    for ep in range(episodes):
        for _ in range(rng.randint(0, most)):
            s = rng.randint(0, horizon)
            rows.append((f"e{ep}", n, s, s + rng.choice([0, rng.randint(0, longest)])))
            n += 1
    return rows


def test_literal_merge_and_subtract(spark):
    rows = [("a", 0, 0, 10_000), ("a", 1, 9_980, 20_000), ("a", 2, 30_000, 40_000), ("a", 3, 40_020, 50_000)]
    got = merge_intervals(spark.createDataFrame(rows, SPAN), ["episode_id"]).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 20_000), (30_000, 50_000)]
    base = spark.createDataFrame([("a", 7, 0, 100_000), ("b", 8, 10_000, 20_000)], SPAN)
    cuts = spark.createDataFrame([("a", 0, 20_000, 40_000), ("a", 1, 60_000, 80_000), ("b", 2, 10_000, 20_000)], SPAN)
    left = subtract_intervals(base, cuts, ["episode_id"], "ordinal").orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in left] == [(0, 20_000), (40_000, 60_000), (80_000, 100_000)]


def test_merge_subtract_and_complement_match_a_loop(spark):
    rng = random.Random(1)
    rows, cuts = random_rows(rng), random_rows(rng)
    for parts in (1, 16):
        df = spark.createDataFrame(rows, SPAN).repartition(parts)
        got = {}
        for r in merge_intervals(df, ["episode_id"], count_as="n").collect():
            got.setdefault(r.episode_id, []).append((r.start_ms, r.end_ms))
        want = {}
        for ep, _, s, e in rows:
            want.setdefault(ep, []).append((s, e))
        assert {k: sorted(v) for k, v in got.items()} == {k: merged(v) for k, v in want.items()}
    by_ep = {}
    for ep, _, s, e in cuts:
        by_ep.setdefault(ep, []).append((s, e))
    left = subtract_intervals(spark.createDataFrame(rows, SPAN), spark.createDataFrame(cuts, SPAN), ["episode_id"], "ordinal", bucket_ms=100)
    got = {}
    for r in left.collect():
        got.setdefault(r.ordinal, []).append((r.start_ms, r.end_ms))
    want = {n: subtracted([(s, e)], by_ep.get(ep, [])) for ep, n, s, e in rows}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    episodes = spark.createDataFrame([(f"e{i}", 3_000) for i in range(41)], "episode_id string, duration_ms bigint")
    islands = merge_intervals(spark.createDataFrame(cuts, SPAN), ["episode_id"])
    got = {}
    for r in complement(islands, episodes, ["episode_id"]).collect():
        got.setdefault(r.episode_id, []).append((r.start_ms, r.end_ms))
    want = {f"e{i}": subtracted([(0, 3_000)], by_ep.get(f"e{i}", [])) for i in range(41)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_overlap_join_emits_each_pair_once_for_short_and_long_spans(spark):
    rng = random.Random(2)
    left, right = random_rows(rng, 6, 30, 9_000, 8_000), random_rows(rng, 6, 30, 9_000, 300)
    for inclusive in (True, False):
        for bounded in (False, True):
            met = overlap_join(
                spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN), ["episode_id"], inclusive=inclusive, bucket_ms=20 if not bounded else 200, bounded=bounded, pad_ms=7
            )
            got = sorted((r.ordinal, r.r_ordinal) for r in met.collect())
            want = []
            for ep, a, s, e in left:
                for ep2, b, x, y in right:
                    lo, hi = max(s - 7, x), min(e + 7, y)
                    if ep == ep2 and (lo <= hi if inclusive else lo < hi):
                        want.append((a, b))
            assert got == sorted(want)
    anti = overlap_semi(spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN), ["episode_id"], ["ordinal"], anti=True, inclusive=False, bucket_ms=50)
    hit = {a for ep, a, s, e in left for ep2, _, x, y in right if ep == ep2 and max(s, x) < min(e, y)}
    assert {r.ordinal for r in anti.collect()} == {r[1] for r in left} - hit


def test_running_sum_over_one_hot_key(spark):
    rows = [("hot", i, i % 7) for i in range(1000)] + [("cold", 0, 5)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint").repartition(8)
    got = {(r.k, r.pos): r.before for r in running_sum(df, ["k"], "pos", F.col("v"), "before", block=64).collect()}
    assert got[("hot", 0)] == 0 and got[("cold", 0)] == 0
    assert all(got[("hot", i)] == sum(j % 7 for j in range(i)) for i in (1, 63, 64, 65, 999))


def test_remap_case(spark):
    cues = spark.createDataFrame(
        [("E01", 1, 2000, 6000, "a"), ("E01", 2, 8000, 12000, "b"), ("E01", 3, 15000, 18000, "c"), ("E02", 4, 1000, 4000, "d")],
        "episode_id string, ordinal bigint, start_ms bigint, end_ms bigint, text string",
    )
    clips = spark.createDataFrame([("o", 0, "E01", 0, 10_000), ("o", 1, "E02", 0, 5_000)], "output_id string, ordinal bigint, episode_id string, start_ms bigint, end_ms bigint")
    got = sorted((r.out_start_ms, r.out_end_ms, r.text) for r in remap_cues(clips, cues, ["output_id"]).collect())
    assert got == [(2000, 6000, "a"), (8000, 10000, "b"), (11000, 14000, "d")]
