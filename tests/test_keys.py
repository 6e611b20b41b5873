"""Names that repeat across keys stay apart."""

from cuefold.operators.intervals import subtract_intervals


def test_a_base_is_cut_by_its_own_keys_only(spark):
    bases = spark.createDataFrame([("a", 7, 0, 100), ("b", 7, 0, 100)], "episode_id string, base long, start_ms long, end_ms long")
    cuts = spark.createDataFrame([("a", 10, 40)], "episode_id string, start_ms long, end_ms long")
    got = sorted(tuple(r) for r in subtract_intervals(bases, cuts, ["episode_id"], "base", drop_ms=0).collect())
    assert got == [("a", 7, 0, 10), ("a", 7, 40, 100), ("b", 7, 0, 100)]
