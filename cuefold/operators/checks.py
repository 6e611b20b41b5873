"""Validation jobs: rows in, issue rows out. Nothing is clamped, dropped or repaired here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.functions.names import file_name, safe_title, stem, suffix
from cuefold.functions.timecode import srt_ms
from cuefold.session import durable
from cuefold.sources.subtitles import LINE_BREAK

# Audio policies and scopes a plan may name.
POLICIES = ("mute", "duck", "keep", "original_only")
SCOPES = ("SINGLE_SCENE", "SINGLE_EPISODE", "CROSS_EPISODE", "SEASON_ARC")
SLACK_MS = 500
STAMPS = r"(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})"


def _issue(test: Column, path: Column, code: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(path.alias("path"), F.lit(code).alias("code")))


def _spread(rows: DataFrame, keys: Sequence[str], *issues: Column) -> DataFrame:
    found = F.filter(F.array(*issues), lambda i: i.isNotNull())
    return rows.select(*keys, F.explode(found).alias("_i")).select(*keys, "_i.*")


def _duplicates(rows: DataFrame, keys: Sequence[str], value: str, order: str, path: Column, code: str) -> DataFrame:
    """Every holder of a value but the first: found by a map-side combined minimum, not a window."""
    held = rows.where(F.col(value) != "")
    first = held.groupBy(*keys, value).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = held.join(first, [*keys, value]).where(F.col(order) != F.col("_first"))
    return again.select("project", path.alias("path"), F.lit(code).alias("code"))


# What is read of each level, in one cast per object; fields whose kind matters stay variants.
OUTPUT = "output_id string, title string, file_name string, output_type string, language string, segments variant"
SEGMENT = (
    "segment_id string, segment_type string, audio_policy string, subtitle_policy string, narration_text variant, narration variant, "
    "recommended_visual_speed variant, source_clips variant"
)
CLIP = "episode_id string, source_file variant, source_video variant, start_ms variant, end_ms variant, start variant, end variant"


def _fields(item: str, shape: str) -> Column:
    return F.try_variant_get(item, "$", f"struct<{shape}>")


def _plan_rows(plans: DataFrame) -> DataFrame:
    """Final plans as one typed row per clip, keeping empty levels; parsed once, then stored.

    An output's fields repeat on its segments' rows and a segment's on its clips'; the first row of
    each stands for it.
    """
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    tidy = lambda c: F.trim(F.coalesce(c, F.lit("")))
    either = lambda a, b: F.trim(F.coalesce(F.try_variant_get(F.when(F.col(a).isNotNull(), F.col(a)).otherwise(F.col(b)), "$", "string"), F.lit("")))
    # Only an object has fields and only an array members, so one cast tells both the kind and what is in it.
    root = plans.select("project", F.try_parse_json("content").alias("v")).select("project", _fields("v", "outputs variant").alias("f"))
    named = lambda c, what: F.when(F.col(c).isNotNull(), F.lit(what)).otherwise("")
    outs = root.select("project", named("f", "OBJECT").alias("root_kind"), as_list(F.col("f.outputs")).alias("_l")).select(
        "project", "root_kind", named("_l", "ARRAY").alias("outputs_kind"), F.posexplode_outer("_l").alias("oi", "o")
    )
    outs = outs.select("project", "root_kind", "outputs_kind", "oi", _fields("o", OUTPUT).alias("f"))
    outs = outs.withColumn("_l", as_list(F.col("f.segments")))
    # What is told once a level is worked out before its members are spread.
    outs = outs.select(
        "project", "root_kind", "outputs_kind", "oi", F.col("f").isNotNull().alias("out_ok"),
        *[tidy(F.col(f"f.{c}")).alias(c) for c in ("output_id", "title", "file_name", "output_type", "language")],
        F.coalesce(F.size("_l"), F.lit(-1)).alias("n_segments"), "_l",
    )
    own = [*outs.columns[:-1], "si"]
    segs = outs.select(*outs.columns[:-1], F.posexplode_outer("_l").alias("si", "s"))
    segs = segs.select(*own, _fields("s", SEGMENT).alias("f")).withColumn("seg_ok", F.col("f").isNotNull())
    speed = F.col("f.recommended_visual_speed")
    segs = segs.withColumns({"_l": as_list(F.col("f.source_clips")), "speed": F.try_variant_get(speed, "$", "double")})
    segs = segs.select(
        *own, "seg_ok", tidy(F.col("f.segment_id")).alias("segment_id"), F.lower(tidy(F.col("f.segment_type"))).alias("segment_type"),
        F.lower(tidy(F.col("f.audio_policy"))).alias("audio_policy"), F.lower(tidy(F.col("f.subtitle_policy"))).alias("subtitle_policy"),
        either("f.narration_text", "f.narration").alias("narration"), "speed",
        (F.col("speed").isNotNull() | (F.trim(F.coalesce(F.try_variant_get(speed, "$", "string"), F.lit(""))) == "")).alias("speed_ok"),
        F.coalesce(F.size("_l"), F.lit(-1)).alias("n_clips"), "_l",
    )
    own = [*segs.columns[:-1], "ci"]
    clips = segs.select(*segs.columns[:-1], F.posexplode_outer("_l").alias("ci", "c"))
    clips = clips.select(*own, _fields("c", CLIP).alias("f")).withColumn("clip_ok", F.col("f").isNotNull())
    given = lambda a: F.when(F.col(f"f.{a}_ms").isNotNull(), F.try_variant_get(F.col(f"f.{a}_ms"), "$", "bigint")).otherwise(
        F.bround(F.try_variant_get(F.col(f"f.{a}"), "$", "double") * 1000).cast("bigint")
    )
    return durable(clips.select(
        *own, "clip_ok", tidy(F.col("f.episode_id")).alias("episode_id"), either("f.source_file", "f.source_video").alias("source_file"),
        given("start").alias("s"), given("end").alias("e"),
    ))


def final_json_issues(plans: DataFrame, episodes: DataFrame, single: bool = False) -> DataFrame:
    """(project, path, code) of everything wrong in final plans.

    plans: project, content (JSON text); episodes: project, episode_id, ordinal, source_video,
    duration_ms. An empty `outputs` is valid.
    """
    key = ["project"]
    rows = _plan_rows(plans)
    top = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    opath = F.concat(F.lit("$.outputs["), "oi", F.lit("]"))
    spath = F.concat(opath, F.lit(".segments["), "si", F.lit("]"))
    cpath = F.concat(spath, F.lit(".source_clips["), "ci", F.lit("]"))
    under = lambda path, field: F.concat(path, F.lit(f".{field}"))

    roots = rows.where(top("oi") & top("si") & top("ci"))
    at_root = F.when(F.col("root_kind") != "OBJECT", F.lit("$")).when(F.col("outputs_kind") != "ARRAY", F.lit("$.outputs"))
    issues = roots.where(at_root.isNotNull()).select(*key, at_root.alias("path"), F.lit("SCHEMA_ERROR").alias("code"))

    outs = rows.where(F.col("oi").isNotNull() & top("si") & top("ci"))
    ok, name = F.col("out_ok"), F.col("file_name")
    needed = [_issue(ok & (F.col(f) == ""), under(opath, f), "REQUIRED_FIELD") for f in ("output_id", "title", "file_name", "output_type", "language")]
    unsafe = (name != "") & ((file_name(name) != name) | (suffix(name) != ".mp4") | (safe_title(stem(name)) != stem(name)))
    issues = issues.unionByName(_spread(
        outs, key, _issue(~ok, opath, "SCHEMA_ERROR"), *needed, _issue(ok & unsafe, under(opath, "file_name"), "INVALID_FILE_NAME"),
        _issue(ok & (F.col("n_segments") <= 0), under(opath, "segments"), "SCHEMA_ERROR"),
    ))
    good = outs.where(ok).withColumn("folded", F.lower("file_name"))
    issues = issues.unionByName(_duplicates(good, key, "output_id", "oi", under(opath, "output_id"), "DUPLICATE_ID"))
    issues = issues.unionByName(_duplicates(good, key, "folded", "oi", under(opath, "file_name"), "DUPLICATE_FILE_NAME"))

    segs = rows.where(ok & F.col("si").isNotNull() & top("ci"))
    ok = F.col("seg_ok")
    voiced = F.col("audio_policy") != "original_only"
    odd = (F.col("speed") != 0) & (F.abs(F.col("speed") - 1.0) > 0.0001)
    issues = issues.unionByName(_spread(
        segs, key, _issue(~ok, spath, "SCHEMA_ERROR"), _issue(ok & (F.col("segment_id") == ""), under(spath, "segment_id"), "REQUIRED_FIELD"),
        _issue(ok & (F.col("segment_type") == ""), under(spath, "segment_type"), "REQUIRED_FIELD"),
        _issue(ok & ~F.col("audio_policy").isin(*POLICIES), under(spath, "audio_policy"), "UNSUPPORTED_AUDIO_POLICY"),
        _issue(ok & voiced & (F.col("narration") == ""), under(spath, "narration_text"), "REQUIRED_FIELD"),
        _issue(ok & (F.col("n_clips") <= 0), under(spath, "source_clips"), "SCHEMA_ERROR"),
        _issue(ok & ~F.col("speed_ok"), under(spath, "recommended_visual_speed"), "SCHEMA_ERROR"),
        _issue(ok & odd, under(spath, "recommended_visual_speed"), "UNSUPPORTED_VISUAL_SPEED"),
        _issue(ok & (F.col("subtitle_policy") != "both"), under(spath, "subtitle_policy"), "UNSUPPORTED_SUBTITLE_POLICY"),
    ))
    issues = issues.unionByName(_duplicates(segs.where(ok), [*key, "oi"], "segment_id", "si", under(spath, "segment_id"), "DUPLICATE_ID"))

    clips = rows.where(F.col("out_ok") & ok & F.col("ci").isNotNull())
    eps = episodes.select(*key, "episode_id", F.col("ordinal").alias("_at"), "source_video", "duration_ms")
    found = clips.join(eps, [*key, "episode_id"], "left")
    ok, known = F.col("clip_ok"), F.col("clip_ok") & F.col("source_video").isNotNull()
    same = (F.col("source_file") == F.col("source_video")) | (F.lower(file_name(F.col("source_file"))) == F.lower(file_name(F.col("source_video"))))
    untimed = F.col("s").isNull() | F.col("e").isNull()
    backwards = (F.col("s") < 0) | (F.col("e") <= F.col("s"))
    return issues.unionByName(_spread(
        found, key, _issue(~ok, cpath, "SCHEMA_ERROR"), _issue(ok & F.col("source_video").isNull(), under(cpath, "episode_id"), "SOURCE_RESOLUTION_ERROR"),
        _issue(known & (F.col("_at") != 0) & F.lit(single), under(cpath, "episode_id"), "SOURCE_RESOLUTION_ERROR"),
        _issue(known & ~same, under(cpath, "source_file"), "SOURCE_RESOLUTION_ERROR"), _issue(known & (untimed | backwards), cpath, "TIMESTAMP_ERROR"),
        _issue(known & ~untimed & ~backwards & (F.col("duration_ms") > 0) & (F.col("e") > F.col("duration_ms")), cpath, "TIMESTAMP_OUT_OF_RANGE"),
    ))


def manifest_issues(outputs: DataFrame, clips: DataFrame, episodes: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Integrity of a stored plan: unique ids, known episodes and files, 0 <= start < end <= duration + 0.5 s."""
    by = list(keys)
    path = lambda kind_, c: F.concat(F.lit(f"{kind_}:"), F.col(c).cast("string"))
    counted = lambda df, c, what: df.groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & (F.col(c).cast("string") != "")).select(*by, path(what, c).alias("path"), F.lit("DUPLICATE_ID").alias("code"))
    issues = counted(outputs, "output_id", "output").unionByName(counted(episodes, "episode_id", "episode"))
    eps = episodes.dropDuplicates([*by, "episode_id"]).select(*by, "episode_id", F.col("source_video").alias("_v"), "duration_ms", F.lit(True).alias("_k"))
    met = clips.join(eps, [*by, "episode_id"], "left")
    where = F.concat_ws("/", F.col("output_id").cast("string"), F.col("ordinal").cast("string"))
    known = F.col("_k").isNotNull()
    other = (F.col("source_file") != "") & (F.col("_v") != "") & (F.col("source_file") != F.col("_v"))
    return issues.unionByName(_spread(
        met, by, _issue(~known, where, "UNKNOWN_EPISODE"), _issue(known & other, where, "SOURCE_MISMATCH"), _issue(known & (F.col("start_ms") < 0), where, "NEGATIVE_START"),
        _issue(known & (F.col("end_ms") <= F.col("start_ms")), where, "END_BEFORE_START"),
        _issue(known & (F.col("duration_ms") > 0) & (F.col("end_ms") > F.col("duration_ms") + SLACK_MS), where, "PAST_DURATION"),
    ))


def lenient_segments(segments: DataFrame) -> DataFrame:
    """Segments of a forgiving plan reader: ids and policies defaulted, mute made duck, narration checked.

    segments: ordinal, segment_id, audio_policy, narration, narration_text (all but ordinal may be null).
    """
    said = F.trim(F.coalesce(F.nullif("narration", F.lit("")), F.col("narration_text"), F.lit("")))
    policy = F.lower(F.trim(F.coalesce("audio_policy", F.lit("duck"))))
    policy = F.when(policy.isin("keep", "original_only"), policy).otherwise("duck")
    return segments.withColumns({
        "segment_id": F.coalesce("segment_id", F.format_string("seg_%02d", F.col("ordinal") + 1)), "narration": said, "audio_policy": policy,
    }).withColumn("issue", F.when((F.col("audio_policy") != "original_only") & (F.col("narration") == ""), "NARRATION_MISSING")).drop("narration_text")


def lenient_clips(clips: DataFrame, episodes: DataFrame) -> DataFrame:
    """Clips of a forgiving plan reader, checked against their episode with half a second of slack.

    A clip without a file takes its episode's; one without an end lasts five seconds.
    """
    timed = clips.withColumns({"start_ms": F.coalesce("start_ms", F.lit(0)), "end_ms": F.coalesce("end_ms", F.coalesce("start_ms", F.lit(0)) + 5000)})
    met = timed.join(episodes.select("episode_id", F.col("source_video").alias("_v"), "duration_ms"), "episode_id", "left")
    file = F.coalesce(F.nullif(F.trim("source_file"), F.lit("")), F.col("_v"))
    issue = (
        F.when(F.col("duration_ms").isNull(), "UNKNOWN_EPISODE").when((file != F.col("_v")) & (file_name(file) != file_name(F.col("_v"))), "SOURCE_MISMATCH")
        .when(F.col("start_ms") < 0, "NEGATIVE_START").when(F.col("end_ms") <= F.col("start_ms"), "END_BEFORE_START")
        .when((F.col("duration_ms") > 0) & (F.col("end_ms") > F.col("duration_ms") + SLACK_MS), "PAST_DURATION")
    )
    return met.withColumn("source_file", file).withColumn("issue", issue).drop("_v", "duration_ms")


def srt_issues(documents: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Faults of SubRip documents: (carried columns, block, code). documents: content, duration_ms.

    A block needs its time line within the first three lines; blocks of a single line are passed over.
    """
    carried = [c for c in documents.columns if c not in ("content", "duration_ms")]
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    blocks = documents.select(*carried, "duration_ms", F.posexplode(F.split(strip(F.regexp_replace("content", r"\r\n|\r", "\n")), r"\n\s*\n")).alias("block", "_b"))
    lines = F.filter(F.transform(F.split("_b", LINE_BREAK), strip), lambda s: s != "")
    rows = blocks.withColumn("_l", lines)
    line = F.get(F.filter(F.slice("_l", 1, 3), lambda s: s.rlike(STAMPS)), F.lit(0))
    body = rows.where(F.size("_l") >= 2).withColumn("_t", line)
    start, end = srt_ms(F.regexp_extract("_t", STAMPS, 1)), srt_ms(F.regexp_extract("_t", STAMPS, 2))
    code = F.when(F.col("_t").isNull(), "NO_TIME_LINE").when(end < start, "END_BEFORE_START").when(start > F.col("duration_ms") + 1000, "PAST_DURATION")
    faults = body.select(*carried, "block", code.alias("code")).where("code is not null")
    if allow_empty:
        return faults
    counts = rows.groupBy(*carried).agg(F.count_if(F.size("_l") >= 2).alias("_n")).where("_n = 0")
    return faults.unionByName(counts.select(*carried, F.lit(-1).alias("block"), F.lit("EMPTY").alias("code")))


def publication_issues(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Faults of publication folders: missing and extra files, sub-folders, wrong duration.

    files: folder, name, is_dir; expected: folder, title, expected_ms, actual_ms.
    """
    # The endings of the three files of a publication.
    wanted = expected.select("folder", F.explode(F.array(*[F.concat("title", F.lit(e)) for e in (".mp4", ".original.srt", ".narration.srt")])).alias("name"))
    have = files.where(~F.col("is_dir")).select("folder", "name")
    rows = lambda df, code: df.select("folder", "name", F.lit(code).alias("code"))
    scoped = have.join(expected.select("folder"), "folder", "left_semi")
    off = F.abs(F.col("actual_ms") - F.col("expected_ms")) > F.greatest(F.lit(750.0), F.col("expected_ms") * 0.02)
    return (
        rows(wanted.join(have, ["folder", "name"], "left_anti"), "MISSING_FILE")
        .unionByName(rows(scoped.join(wanted, ["folder", "name"], "left_anti"), "EXTRA_FILE"))
        .unionByName(rows(files.where("is_dir").join(expected.select("folder"), "folder", "left_semi"), "SUB_FOLDER"))
        .unionByName(rows(expected.where((F.col("expected_ms") > 0) & off).withColumn("name", F.concat("title", F.lit(".mp4"))), "WRONG_DURATION"))
    )


def media_issues(streams: DataFrame, formats: DataFrame, require_audio: bool = True) -> DataFrame:
    """Technical faults of assembled media. streams: path, kind, ordinal and probe fields;
    formats: path, size, duration_s, start_s, expected_s."""
    counted = F.col("packets").try_cast("bigint")
    framed = F.coalesce(F.col("frames").try_cast("bigint") > 0, F.lit(False))
    told = ~F.coalesce(F.trim("packets"), F.lit("")).isin("", "N/A")
    first = streams.where((F.col("ordinal") == 0) & F.col("kind").isin("video", "audio"))
    joined = first.join(formats.select("path", F.col("duration_s").alias("_d")), "path")
    dead = F.when(told, F.coalesce(counted <= 0, F.lit(False))).otherwise(~framed & (F.greatest("duration_s", "_d") <= 0))
    video, audio = F.col("kind") == "video", F.col("kind") == "audio"
    path = F.col("path")
    layout = F.lower(F.trim("channel_layout"))
    heard = audio & F.lit(require_audio)
    issues = _spread(
        joined, [], _issue(video & ((F.col("width") <= 0) | (F.col("height") <= 0)), path, "BAD_DIMENSIONS"), _issue(video & dead, path, "NO_VIDEO_DATA"),
        _issue(heard & (F.col("channels") <= 0), path, "BAD_CHANNELS"), _issue(heard & layout.isin("", "unknown", "none", "0"), path, "BAD_LAYOUT"),
        _issue(heard & (F.col("sample_rate") <= 0), path, "BAD_SAMPLE_RATE"), _issue(heard & dead, path, "NO_AUDIO_DATA"),
    )
    late = _spread(streams, [], _issue(F.col("start_s") < -0.05, path, "NEGATIVE_START"))
    have = streams.groupBy("path").agg(F.max(video).alias("_v"), F.max(audio).alias("_a"), F.max(F.when(video & (F.col("ordinal") == 0), F.col("duration_s"))).alias("_vd"))
    whole = formats.join(have, "path", "left")
    actual = F.when(F.col("duration_s") > 0, F.col("duration_s")).otherwise(F.coalesce("_vd", F.lit(0.0)))
    tolerance = F.greatest(F.lit(0.75), F.col("expected_s") * 0.02)
    return issues.unionByName(late).unionByName(_spread(
        whole, [], _issue(F.col("size") <= 0, path, "EMPTY_FILE"), _issue(~F.coalesce("_v", F.lit(False)), path, "NO_VIDEO"),
        _issue(F.lit(require_audio) & ~F.coalesce("_a", F.lit(False)), path, "NO_AUDIO"), _issue(F.col("start_s") < -0.05, path, "NEGATIVE_START"),
        _issue(actual <= 0, path, "NO_DURATION"), _issue((F.col("expected_s") > 0) & (actual > 0) & (F.abs(actual - F.col("expected_s")) > tolerance), path, "WRONG_DURATION"),
    ))


def recap_issues(segments: DataFrame) -> DataFrame:
    """Bounds of a single-video plan. segments: keys, start_ms, end_ms, total_ms, audio_policy, narration."""
    issue = (
        F.when(F.col("start_ms") < 0, "NEGATIVE_START").when(F.col("end_ms") <= F.col("start_ms"), "END_BEFORE_START")
        .when((F.col("total_ms") > 0) & (F.col("end_ms") > F.col("total_ms") + 1000), "PAST_DURATION")
        .when((F.col("audio_policy") == "mute") & (F.trim("narration") == ""), "NARRATION_MISSING")
    )
    return segments.withColumn("issue", issue)


def recap_segments(raw: DataFrame) -> DataFrame:
    """Segments of a single-video answer moved into the video, with what is wrong with them.

    raw: keys, ordinal, start_ms, end_ms, total_ms, narration_text, audio_policy, segment_id. The
    first 50 count, as in the reference; they last at least a tenth of a second.
    """
    total = F.col("total_ms")
    s = F.greatest(F.lit(0), F.least(total, F.coalesce("start_ms", F.lit(0))))
    e = F.greatest(s + 100, F.least(total, F.coalesce("end_ms", s + 1000)))
    # s + 100 <= e, so the fallback for an empty span is never taken.
    policy = F.lower(F.trim(F.coalesce("audio_policy", F.lit("mute"))))
    text = F.trim(F.coalesce("narration_text", F.lit("")))
    issue = F.when(text == "", "NARRATION_MISSING").when(~policy.isin("mute", "preserve"), "UNSUPPORTED_AUDIO_POLICY")
    return raw.where(F.col("ordinal") < 50).withColumns({
        "start_ms": s, "end_ms": e, "audio_policy": policy, "narration_text": text, "issue": issue,
        "segment_id": F.coalesce("segment_id", F.format_string("scene_%02d", F.col("ordinal") + 1)),
    })
