"""Stream decisions, progress and the arriving-files job."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from cuefold.operators import streams
from cuefold.sources import stores
from cuefold.streaming import arrivals, progress

SIG = (
    "list int, ordinal int, video_codec string, video_profile string, width int, height int, pix_fmt string, fps string, video_time_base string, sar string, "
    "has_audio boolean, audio_codec string, sample_rate int, sample_fmt string, channels int, channel_layout string, audio_time_base string"
)
GOOD = ["h264", "high", 1281, 721, "yuv420p", "24/1", "1/1000", "1:1", True, "aac", 48000, "fltp", 2, "stereo", "1/48000"]


def signed(n, i, **changes):
    names = [f.split(" ")[0] for f in SIG.split(", ")][2:]
    return (n, i, *[changes.get(k, v) for k, v in zip(names, GOOD)])


def test_concat(spark):
    rows = [
        signed(1, 0), signed(1, 1, video_codec="H264"), signed(2, 0), signed(2, 1, fps="25/1", sample_rate=44100), signed(3, 0, channel_layout=""), signed(3, 1),
        signed(4, 0, has_audio=False), signed(4, 1, has_audio=False), signed(5, 0, width=0, height=0), signed(5, 1, has_audio=False),
    ]
    df = spark.createDataFrame(rows, SIG)
    codes = {}
    for r in streams.concat_differences(df, ["list"]).collect():
        codes.setdefault(r.list, set()).add((r.ordinal, r.code))
    assert codes[2] == {(1, "fps_mismatch"), (1, "sample_rate_mismatch")}
    assert codes[3] == {(0, "audio_channel_layout_unknown"), (1, "channel_layout_mismatch")}
    assert codes[5] == {(0, "invalid_dimensions"), (1, "audio_presence_mismatch"), (1, "resolution_mismatch")} and 1 not in codes and 4 not in codes
    ok = {r.list: r.compatible for r in streams.concat_decision(df, ["list"], require_audio=True).collect()}
    assert ok == {1: True, 2: False, 3: False, 4: False, 5: False}
    profile = {r.list: (r.width, r.height) for r in streams.normalisation_profile(df, ["list"]).collect()}
    assert profile[1] == (1280, 720) and profile[5] == (1280, 720)


def test_scanner_progress_never_falls_behind(spark):
    events = spark.createDataFrame(
        [("p", 0, "E1", "chunk", 1, 2), ("p", 1, "E2", "chunk", None, None), ("p", 2, "E1", "coverage_check", None, None), ("p", 3, "E1", "complete", None, None), ("p", 4, "E2", "cached", None, None)],
        "project string, seq bigint, episode_id string, stage string, chunk int, chunks int",
    )
    rows = progress.scanner_progress(events, spark.createDataFrame([("p", 2)], "project string, episodes int")).orderBy("seq").collect()
    assert [r.progress for r in rows] == [20 + int(35 * x) for x in (0.35 / 2, 1.0 / 2, 1.35 / 2, 1.5 / 2, 1.0)]


CUE = lambda a, b: f"1\n00:00:{a:02d},000 --> 00:00:{b:02d},000\nhello\n\n"


def test_arriving_files_replace_only_their_episodes(spark, tmp_path):
    inbox, store, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")

    def land(path, text, at):
        file = inbox / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
        os.utime(file, (at, at))

    def seen(name="coverage"):
        arrivals.follow(spark, str(inbox), store, state).awaitTermination()
        rows = arrivals.current(spark, store, name).collect()
        return {(r.folder, r.episode_id): (r.speech_ms, r.islands, r.cues) for r in rows} if name == "coverage" else rows

    land("E01.srt", CUE(1, 3) + CUE(10, 12), 1000)
    land("first/Show A/E02.srt", CUE(0, 5), 1000)
    land("first/Show B/E02.srt", CUE(0, 7), 1000)
    before = {("", "E01"): (4000, 2, 2), ("Show A", "E02"): (5000, 1, 1), ("Show B", "E02"): (7000, 1, 1)}
    assert seen() == before
    # A later delivery replaces one episode and clears another; an older file that comes late changes nothing.
    land("second/Show A/E02.srt", CUE(0, 2), 2000)
    land("second/Show B/E02.srt", "\n", 2000)
    land("late/Show A/E02.srt", CUE(0, 9), 500)
    assert seen() == {("", "E01"): (4000, 2, 2), ("Show A", "E02"): (2000, 1, 1)}
    assert len(seen("files")) == 3 and len(seen("cues")) == 3


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = str(tmp_path / "store")
    files = lambda *rows: spark.createDataFrame([(f, e, p, datetime.datetime(2024, 1, d), c) for f, e, p, d, c in rows], "folder string, episode_id string, path string, modified timestamp, content string")
    arrivals.store_batch(files(("s", "E1", "a", 1, CUE(0, 5))), 0, store)
    now = lambda: {(r.episode_id, r.speech_ms) for r in arrivals.current(spark, store, "coverage").collect()}
    # What a broken batch leaves, without its list of files, counts for nothing; the batch run again replaces it.
    stores.log_batch(spark.createDataFrame([("s", "E1", "b", 9, 9, 9)], "folder string, episode_id string, path string, speech_ms bigint, islands bigint, cues bigint"), f"{store}/coverage", 1)
    assert now() == {("E1", 5000)}
    for _ in range(2):
        arrivals.store_batch(files(("s", "E1", "b", 2, CUE(0, 8)), ("s", "E2", "c", 2, CUE(0, 1))), 1, store)
    assert now() == {("E1", 8000), ("E2", 1000)}


def test_a_broken_write_leaves_the_snapshot_before_it(spark, tmp_path):
    path = str(tmp_path / "entity")
    assert stores.snapshot(spark, path) is None
    assert stores.publish(spark.range(3), path) == 0
    with pytest.raises(Exception, match="broken"):
        stores.publish(spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).cast("bigint").alias("id")), path)
    assert sorted(r.id for r in stores.snapshot(spark, path).collect()) == [0, 1, 2]
    # A snapshot may be made of the one it replaces; readers of that one are not disturbed.
    reader = stores.snapshot(spark, path)
    assert stores.publish(stores.snapshot(spark, path).select((F.col("id") * 10).alias("id")), path) == 1
    assert sorted(r.id for r in stores.snapshot(spark, path).collect()) == [0, 10, 20] and reader.count() == 3
    assert stores.publish(spark.range(1), path) == 2 and stores.versions(spark, path) == [1, 2]
    assert not [f for f in os.listdir(path) if f.startswith("_writing")]
    assert stores.shape_issues(stores.snapshot(spark, path), {"id": "bigint"}) == []
    assert stores.shape_issues(stores.snapshot(spark, path), {"id": "int", "x": "string"}) == ["id: bigint is not int", "x: missing is not string"]
