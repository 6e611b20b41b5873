"""Text, name, subtitle and answer rules on their literal cases."""

import html
import html.entities
import json
import random

import pytest
from pyspark.sql import functions as F

from cuefold.functions import answers as an
from cuefold.functions import names as nm
from cuefold.functions import text as tx
from cuefold.functions.rational import aspect_ratio, frame_rate, time_base
from cuefold.operators import checks as ck
from cuefold.operators.selection import best_subtitles
from cuefold.sources import catalogue, evidence, subtitles, transport


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first().r


def docs(spark, text):
    return spark.createDataFrame([("d", text)], "path string, content string")


def test_readers(spark):
    srt = docs(spark, "1\r\n00:01:23,456 --> 00:01:25,789\r\n<i>Good morning</i>, world!\r\n\r\n2\n00:00:05,000 --> 00:00:04,000\nback\n\nno times here\n")
    assert [(r.start_ms, r.end_ms, r.text) for r in subtitles.subrip_cues(srt).collect()] == [(83456, 85789, "Good morning, world!")]
    vtt = docs(spark, "WEBVTT\nKind: x\n\n00:01.500 --> 00:03.000 align:start\n<v Roger>Hi &amp; bye</v>\n\nNOTE 00:09.000 --> 00:10.000\nno\n")
    assert [(r.start_ms, r.end_ms, r.text) for r in subtitles.webvtt_cues(vtt).collect()] == [(1500, 3000, "Hi & bye")]
    ass = docs(spark, "[Script Info]\nTitle: t\n[Events]\nFormat: Start, End, Text\nDialogue: 0:01:10.50,0:01:12.80,{\\pos(100,200)}Hello\\NWorld, again\n[Fonts]\nDialogue: 0:00:01.00,0:00:02.00,no\n")
    assert [(r.start_ms, r.end_ms, r.text) for r in subtitles.ass_cues(ass).collect()] == [(70500, 72800, "Hello\nWorld, again")]
    plain = docs(spark, "[Events]\nDialogue: 0,0:01:10.50,0:01:12.80,Default,,0,0,0,,Hi, you\n")
    assert [r.text for r in subtitles.ass_cues(plain).collect()] == ["Hi, you"]
    loose = docs(spark, "1\n00:00:02,500 --> 00:00:01,0\nback <b>is</b>\nkept\n\n2\n0:0:3.25 --> 0:0:4\nx")
    assert [(r.start_ms, r.end_ms, r.text) for r in subtitles.loose_cues(loose).collect()] == [(2500, 1000, "back is kept")]


def test_names(spark):
    pairs = lambda s: sorted(((p.season, p.episode) for p in one(spark, s, nm.episode_numbers)), key=str)
    assert pairs("My.Show.S01E02.mkv") == [(1, 2)] and pairs("Show.2x05.mkv") == [(2, 5)]
    assert pairs("Anime_Ep.03") == [(None, 3)] and pairs("Series - 07") == [(None, 7)] and pairs("[12] x") == [(None, 12)]
    assert one(spark, "/a/My.Show.S01E02.mkv", nm.show_prefix) == "my show"
    order = spark.createDataFrame([("ep10.mkv",), ("ep1.mkv",), ("ep2.mkv",), ("2 start.mkv",)], "p string").orderBy(nm.natural_key(F.col("p"))).collect()
    assert [r.p for r in order] == ["2 start.mkv", "ep1.mkv", "ep2.mkv", "ep10.mkv"]
    assert one(spark, 'A: "b"/c? ', nm.safe_title) == "A - 'b'-c" and one(spark, "con.txt", nm.safe_title) == "con.txt_output" and one(spark, " ._", nm.safe_title) == "output"
    assert len(one(spark, "x" * 300, nm.safe_title)) == 120
    assert [one(spark, v, nm.language_code) for v in ("en_US", "French", "", "klingon")] == ["eng", "fra", "und", "kli"]


def test_sidecars(spark):
    media = spark.createDataFrame([("/d/Show.S01E02.mkv",), ("/d/movie.mkv",)], "video string")
    names = ["Show.S01E02.srt", "Show.S01E02.en.forced.srt", "Show.S01E01.srt", "Show.S02E02.srt", "Other.S01E02.srt", "movie.fr.srt", "movies.srt", "movie.idx"]
    files = spark.createDataFrame([(f"/d/{n}",) for n in names] + [("/e/movie.srt",)], "path string")
    got = {(r.video[3:], r.track_id[8:]): r for r in catalogue.sidecar_tracks(media, files).collect()}
    assert set(got) == {("Show.S01E02.mkv", "Show.S01E02.srt"), ("Show.S01E02.mkv", "Show.S01E02.en.forced.srt"), ("movie.mkv", "movie.fr.srt")}
    assert (got[("movie.mkv", "movie.fr.srt")].language, got[("movie.mkv", "movie.fr.srt")].score) == ("fra", 110.0)
    assert got[("Show.S01E02.mkv", "Show.S01E02.en.forced.srt")].is_forced


def test_track_choice(spark):
    shape = "video string, track_id string, ordinal int, source_type string, language string, is_forced boolean, is_bitmap boolean, score double"
    rows = [
        ("forced", "a", 0, "sidecar", "eng", True, False, 200.0), ("forced", "b", 1, "embedded", "eng", False, False, 100.0), ("only", "c", 0, "sidecar", "eng", True, False, 115.0),
        ("tie", "d", 0, "embedded", "eng", False, False, 110.0), ("tie", "e", 1, "sidecar", "eng", False, False, 110.0), ("bits", "f", 0, "embedded", "eng", False, True, 50.0),
    ]
    got = {r.video: (r.track_id, r.stt_required) for r in best_subtitles(spark.createDataFrame(rows, shape), ["video"]).collect()}
    assert got == {"forced": ("b", False), "only": (None, True), "tie": ("e", False), "bits": ("f", False)}


def test_rationals(spark):
    assert [one(spark, v, frame_rate) for v in ("48000/2002", "23.976", "25", "0/0", "N/A", "30/0")] == ["24000/1001", "2997/125", "25/1", "", "", ""]
    assert [one(spark, v, aspect_ratio) for v in ("8:6", "1.0", "0:1", "4/2", "1.5")] == ["4:3", "1:1", "", "2:1", "3:2"]
    assert [one(spark, v, time_base) for v in ("2/2000", "abc", "0/0", "0/5")] == ["1/1000", "abc", "", ""]


def test_answers(spark):
    wrap = lambda content: '{"choices":[{"message":{"content":' + content + "}}]}"
    bodies = [("", "empty_body"), ('{"choices":[', "outer_json_malformed"), ("[1]", "outer_json_malformed"), ('{"choices":[]}', "choices_missing"), ('{"choices":[{"message":{}}]}', "message_content_missing"),
              (wrap('" "'), "content_empty"), (wrap('"{broken"'), "malformed_model_json"), (wrap('"```json\\n{\\"a\\":1}\\n```"'), None), (wrap('[{"type":"text","text":"{}"}]'), None)]
    for body, want in bodies:
        assert one(spark, body, an.response_defect) == want, body
    assert one(spark, "x", lambda c: an.ocr_issue(c, F.lit(0.9))) is None and one(spark, "-------", lambda c: an.ocr_issue(c, F.lit(0.9))) == "NO_WORDS"


def test_speakers_and_markup(spark):
    assert [one(spark, v, tx.speaker) for v in ("[Alice] hi", "Bob: hi", "Line 3: x", "no tag")] == ["Alice", "Bob", None, None]
    assert one(spark, "{\\an8}<b>a</b>\\N\\N\\N b&nbsp;c \n", tx.strip_formatting) == "a\n\nb c"


def test_final_json_literals(spark):
    clip = '{"episode_id":"E01","source_file":"A.MKV","start_ms":%s,"end_ms":%s}'
    out = '{"outputs":[{"output_id":"o","title":"t","file_name":"t.mp4","output_type":"r","language":"en","segments":[{"segment_id":"s","segment_type":"x","audio_policy":"duck","narration":"n","subtitle_policy":"both","source_clips":[%s]}]}]}'
    plans = spark.createDataFrame(
        [("missing", "{}"), ("empty", '{"outputs":[]}'), ("good", out % (clip % (0, 5))), ("late", out % (clip % (0, 9_999))), ("unknown", out % '{"episode_id":"E9","start":0,"end":1}'), ("untimed", out % '{"episode_id":"E01","source_file":"a.mkv"}')],
        "project string, content string",
    )
    eps = spark.createDataFrame([(p, "E01", 0, "/v/a.mkv", 1_000) for p in ("good", "late", "unknown", "untimed")], "project string, episode_id string, ordinal int, source_video string, duration_ms bigint")
    at = "$.outputs[0].segments[0].source_clips[0]"
    got = sorted((r.project, r.path, r.code) for r in ck.final_json_issues(plans, eps).collect())
    assert got == [("late", at, "TIMESTAMP_OUT_OF_RANGE"), ("missing", "$.outputs", "SCHEMA_ERROR"), ("unknown", at + ".episode_id", "SOURCE_RESOLUTION_ERROR"), ("untimed", at, "TIMESTAMP_ERROR")]


def test_transport_is_lossless(spark):
    long, wide = "a long repeated text", {f"f{i:03d}": i * 1000 for i in range(150)}
    first = {
        "c": [
            {"episode_id": "E1", "start_ms": 1500, "start_sec": 1.5, "summary": long, "detail": long, "n": None, "l": [1, "~x", {"k": "v", "~k": long}]},
            {"summary": long, "note": "~tilde", "other": "^caret", "empty": [], "o": {}}, {"start_sec": 2.0, "start_ms": 1500, "episode_id": "E2"},
            {"t": "~~", "u": "^a"}, {}, None, 3, "~literal", long, [1, [long]], {"start_ms": "1500", "start_sec": 1.5},
        ],
        "e": [], "s": "scalar ~", "m": {"a": ["~q", "^1"]}, "z": None, "": [{'q"uo\\te': 'back\\slash " and\nline: "x":'}],
        "w": [wide, {"f003": 1, "f064": 2, "f149": 3}, {"f000": 1}],
    }
    docs = {("p", "E1"): first, ("q", "E1"): {"c": [{"summary": "another text here", "x": "another text here", "y": long}]}, ("q", "E2"): {}}
    given = spark.createDataFrame([(*k, json.dumps(v)) for k, v in docs.items()], "project string, episode_id string, content string")
    rows, strings, columns = transport.pack(transport.shred(given))
    back = transport.assemble(transport.unpack(rows, strings, columns))
    assert {(r.project, r.episode_id): json.loads(r.content) for r in back.collect()} == docs
    assert sorted((r.project, r.value) for r in strings.collect()) == [("p", f'"{long}"'), ("q", '"another text here"')]
    masks = sorted(int(r["mask"], 16) for r in rows.where("category = 'w'").collect())
    assert masks == [1, (1 << 3) + (1 << 64) + (1 << 149), (1 << 150) - 1]
    dictionary_size = strings.where("project = 'p'").count()
    assert dictionary_size == 1


def test_transport_refuses_what_does_not_fit(spark):
    units = transport.shred(spark.createDataFrame([("p", "E1", '{"c": [{"a": 1, "b": 2}]}')], "project string, episode_id string, content string"))
    rows, strings, columns = transport.pack(units)
    for broken in (rows.withColumn("mask", F.lit("1")), rows.withColumn("values", F.array(F.lit("1"), F.lit('"^7"'))), rows.withColumn("values", F.array(F.lit("1"), F.lit('"~7"'))), rows.withColumn("mask", F.lit("9"))):
        with pytest.raises(Exception):
            transport.unpack(broken, strings, columns).collect()
    with pytest.raises(Exception, match="no JSON object"):
        transport.shred(spark.createDataFrame([("p", "E1", "[1]")], "project string, episode_id string, content string")).collect()


def test_transport_of_nothing(spark):
    rows, strings, columns = transport.pack(transport.shred(spark.createDataFrame([], "project string, episode_id string, content string")))
    assert transport.assemble(transport.unpack(rows, strings, columns)).collect() == []


def test_character_references_are_those_of_python(spark):
    rng = random.Random(5)
    names = sorted(html.entities.html5)
    parts = ["&", ";", "#", "&#", "&#x", " ", "a", "é", "&amp", "&ampx", "&notit;", "&nosuch;", "&#0;", "&#x80;", "&#129;", "&#xD800;", "&#1114112;", "&#99999999999;", "&#0000000065", "&#11;", "&#xfffe;", "&#x1F600;", "&\t", "&&lt;&"]
    texts = ["&" + n for n in names] + ["".join(rng.choice(parts) if rng.random() < 0.7 else "&" + rng.choice(names) for _ in range(rng.randrange(8))) for _ in range(3000)] + [None, "", "&" * 5000, "&" + "x" * 100_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.unescape(F.col("t")).alias("u")).collect()
    wrong = [(texts[r.i], r.u, html.unescape(texts[r.i])) for r in rows if texts[r.i] is not None and r.u != html.unescape(texts[r.i])]
    assert wrong == [] and len(rows) == len(texts)


def test_evidence_items_are_numbered_by_category(spark):
    one = '{"events": [{"category": "Reveals", "summary": "r1"}, {"summary": "m1"}], "weaknesses": [{"z": "w", "a": "1"}], "strengths": [{"summary": "s"}], "reveals": [{"reveal": "r0"}, 7, {"reveal": "r0b"}]}'
    two = '{"reveals": [{"reveal": "r2"}], "strengths_weaknesses": [{"strength": "t"}]}'
    rows = [(p, "E1", n, n * 1000, n * 1000 + 1000, 90_000, c) for p in ("p", "q") for n, c in ((10, two), (2, one))]
    answers = spark.createDataFrame(rows, "project string, episode_id string, chunk_index int, chunk_start_ms bigint, chunk_end_ms bigint, duration_ms bigint, content string")
    told = evidence.with_summary(evidence.answer_evidence(answers)).where("project = 'q'").collect()
    got = {(r.category, r.idx): r.summary for r in told}
    assert got == {
        ("reveals", 0): "Reveal: r0", ("reveals", 1): "Reveal: r0b", ("reveals", 2): "Reveal: r1", ("reveals", 3): "Reveal: r2", ("major_scenes", 0): "m1",
        ("strengths", 0): "s", ("weaknesses", 0): "w; 1", ("strengths_weaknesses", 0): "s", ("strengths_weaknesses", 1): got["strengths_weaknesses", 1], ("strengths_weaknesses", 2): "strength: t",
    }


def test_cues_of_any_shape(spark):
    given = ['{"start_ms": 1500, "end_ms": "2500", "text": "a"}', '{"start_ms": 9, "start_sec": 2.5, "end_sec": 3, "text": 7}', '[1, 2.5, "b", 4]', '[1, 2]', '"x"', "{}", "no json", None, '{"start_sec": "?", "text": null}']
    rows = spark.createDataFrame(list(enumerate(given)), "i int, cue string").select("i", subtitles.cue_fields(F.col("cue")).alias("c")).select("i", "c.*").collect()
    assert {r.i: (r.start_sec, r.end_sec, r.text) for r in rows} == {
        0: (1.5, 2.5, "a"), 1: (2.5, 3.0, "7"), 2: (1.0, 2.5, "b"), 3: (0.0, 0.0, ""), 4: (0.0, 0.0, ""), 5: (0.0, 0.0, ""), 6: (0.0, 0.0, ""), 7: (0.0, 0.0, ""), 8: (None, 0.0, ""),
    }
