"""Subtitle documents, names, tracks, streams and clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuefold.functions import names as nm
from cuefold.functions import text as tx
from cuefold.functions import timecode as tc
from cuefold.functions.rational import aspect_ratio, frame_rate, time_base
from cuefold.operators import clips as cl
from cuefold.operators import loudness, ranking, selection, streams
from cuefold.plans import bindings as b
from cuefold.plans.registry import query
from cuefold.sources import catalogue, probes, subtitles

TALK = b.TALK_SQL
SHELF = b.SHELF_SQL


def _srt_docs(spark, folder):
    return subtitles.srt_text(b.talk(spark, folder), ["episode_id"])


def _stamp_sql(ms: str, mark: str = ",") -> str:
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query(
    "srt_documents",
    f"""{TALK}, n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms) AS i FROM talk)
SELECT episode_id, string_agg(i || chr(10) || {_stamp_sql('start_ms')} || ' --> ' || {_stamp_sql('end_ms')} || chr(10) || trim(text) || chr(10), chr(10) ORDER BY i) AS content
FROM n GROUP BY episode_id""",
)
def srt_documents(spark, folder):
    return _srt_docs(spark, folder)


CUES_BACK = f"{TALK} SELECT episode_id, start_ms, end_ms, text FROM tidy"


@query("subrip_cues", CUES_BACK)
def subrip_cues(spark, folder):
    return subtitles.subrip_cues(_srt_docs(spark, folder)).select("episode_id", "start_ms", "end_ms", "text")


@query("loose_srt_cues", f"{TALK} SELECT episode_id, start_ms, end_ms, replace(text, chr(10), ' ') AS text FROM talk")
def loose_srt_cues(spark, folder):
    return subtitles.loose_cues(_srt_docs(spark, folder)).select("episode_id", "start_ms", "end_ms", "text")


@query("webvtt_cues", CUES_BACK)
def webvtt_cues(spark, folder):
    """Turns written as WebVTT with voice tags, cue settings and a NOTE after each cue, read back."""
    block = F.concat(
        tc.stamp(F.col("start_ms"), "."), F.lit(" --> "), tc.stamp(F.col("end_ms"), "."), F.lit(" align:start\n<v One>"),
        F.col("text"), F.lit("</v>\n\nNOTE 00:00.000 --> 00:01.000\nnot a cue\n"),
    )
    docs = b.talk(spark, folder).withColumn("_b", block).groupBy("episode_id").agg(
        F.concat(F.lit("WEBVTT - talk\nKind: captions\n\n"), F.expr("listagg(_b, '\n') WITHIN GROUP (ORDER BY ordinal)")).alias("content")
    )
    return subtitles.webvtt_cues(docs).select("episode_id", "start_ms", "end_ms", "text")


@query("ass_cues", f"{TALK} SELECT episode_id, start_ms, end_ms // 10 * 10 AS end_ms, text FROM tidy")
def ass_cues(spark, folder):
    """Turns written as ASS dialogue with overrides, read back."""
    centi = lambda c: F.substring(tc.stamp(F.col(c), "."), 2, 10)
    line = F.concat(
        F.lit("Dialogue: 0,"), centi("start_ms"), F.lit(","), centi("end_ms"), F.lit(",Main,,0,0,0,,{\\pos(100,200)}"),
        F.replace("text", F.lit("\n"), F.lit("\\N")),
    )
    head = "[Script Info]\n; a remark\nTitle: talk\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    docs = b.talk(spark, folder).withColumn("_b", line).groupBy("episode_id").agg(
        F.concat(F.lit(head), F.expr("listagg(_b, '\n') WITHIN GROUP (ORDER BY ordinal)"), F.lit("\n[Fonts]\nDialogue: no cue")).alias("content")
    )
    return subtitles.ass_cues(docs).select("episode_id", "start_ms", "end_ms", "text")


@query("companion_cues", f"{TALK} SELECT 'v' || episode_id AS video, episode_id || CASE WHEN CAST(substring(episode_id, 2) AS BIGINT) % 2 = 0 THEN '.vtt' ELSE '_en.srt' END AS path, CAST(count(*) AS BIGINT) AS cues FROM talk GROUP BY ALL")
def companion_cues(spark, folder):
    """Each conversation has a second choice only: even ones a .vtt, odd ones a _en.srt."""
    even = F.substring("episode_id", 2, 20).cast("bigint") % 2 == 0
    docs = _srt_docs(spark, folder).select(F.concat("episode_id", F.when(even, ".vtt").otherwise("_en.srt")).alias("path"), "content")
    videos = b.table(spark, folder, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("stem")).distinct()
    found = subtitles.companion_cues(videos.withColumn("video", F.concat(F.lit("v"), "stem")), docs)
    return found.groupBy("video", "path").agg(F.count(F.lit(1)).alias("cues"))


@query("strip_formatting", f"{TALK} SELECT episode_id, ordinal, text || ' A&B <é> ' || chr(10) || 'end' AS text FROM tidy")
def strip_formatting(spark, folder):
    marked = F.concat(
        F.lit("{\\an8}<font color=\"red\">"), F.regexp_replace("text", "\n", "\\\\N"), F.lit("</font> A&amp;B &lt;&eacute;&#62; \\n\n  <i>end</i>  \n\n"),
    )
    body = b.talk(spark, folder).select("episode_id", "ordinal", tx.strip_formatting(marked).alias("text"))
    return body.withColumn("text", F.regexp_replace("text", "<é>\n\nend$", "<é> \nend"))


@query("normalised_cues", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0.0::DOUBLE WHEN event_id % 4 = 1 THEN CAST(event_id AS DOUBLE) ELSE event_id / 1000.0::DOUBLE END AS start_sec,
 CASE event_id % 4 WHEN 0 THEN (event_id + 500) / 1000.0::DOUBLE WHEN 1 THEN event_id + 2.5::DOUBLE WHEN 2 THEN event_id + 1.0::DOUBLE ELSE 0.0::DOUBLE END AS end_sec,
 CASE WHEN event_id % 4 = 3 THEN '' ELSE props END AS text FROM events""")
def normalised_cues(spark, folder):
    """Cues told in milliseconds, in seconds, as lists, and as something else."""
    e, n = b.table(spark, folder, "events"), F.col("event_id")
    shapes = (
        F.to_json(F.struct(n.alias("start_ms"), (n + 500).alias("end_ms"), F.col("props").alias("text"))), F.to_json(F.struct(n.alias("start_sec"), (n + 2.5).alias("end_sec"), n.alias("start_ms"), F.col("props").alias("text"))),
        F.concat(F.lit("["), n / 1000, F.lit(","), n + 1, F.lit(","), F.to_json(F.col("props").cast("variant")), F.lit("]")), F.to_json(F.col("props").cast("variant")),
    )
    cue = F.when(n % 4 == 0, shapes[0]).when(n % 4 == 1, shapes[1]).when(n % 4 == 2, shapes[2]).otherwise(shapes[3])
    return e.select("event_id", subtitles.cue_fields(cue).alias("_c")).select("event_id", "_c.*")


@query("plain_page_text")
def plain_page_text(spark, folder):
    """Whole pages without tags and entities; Python's entity table has no SQL twin."""
    return b.table(spark, folder, "pages").select("page_id", tx.strip_formatting(F.col("html")).alias("text"))


@query("word_tokens", """SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS INTEGER) AS words,
 CAST(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), lambda x: length(x) > 1)) AS INTEGER) AS long_words FROM documents""")
def word_tokens(spark, folder):
    docs = b.table(spark, folder, "documents")
    return docs.select("doc_id", F.size(tx.tokens(F.col("text"))).alias("words"), F.size(tx.tokens(F.col("text"), 1)).alias("long_words"))


@query("speaker_tags", "SELECT conv_id, turn, CASE WHEN contains(trim(text, E' \\n\\t'), chr(10)) THEN NULL ELSE role END AS speaker FROM conversations")
def speaker_tags(spark, folder):
    turns = b.table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", tx.speaker(F.concat(F.lit("["), "role", F.lit("] "), F.trim("text"))).alias("speaker"))


@query("timestamp_formats", f"{b.TIMELINE_SQL} SELECT event_id, {_stamp_sql('start_ms')} AS srt, {_stamp_sql('start_ms', '.')} AS vtt, start_ms AS srt_ms, start_ms AS vtt_ms, start_ms AS ass_ms, start_ms AS loose_ms FROM spans")
def timestamp_formats(spark, folder):
    spans = b._spans(spark, folder).select("event_id", tc.stamp(F.col("start_ms")).alias("srt"), tc.stamp(F.col("start_ms"), ".").alias("vtt"))
    return spans.select(
        "*", tc.srt_ms(F.col("srt")).alias("srt_ms"), tc.vtt_ms(F.col("vtt")).alias("vtt_ms"),
        tc.ass_ms(F.col("vtt")).alias("ass_ms"), tc.loose_ms(F.col("srt")).alias("loose_ms"),
    )


@query("language_codes", """SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END AS a,
  CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END AS b, substring(source, 1, 3) AS c FROM documents""")
def language_codes(spark, folder):
    docs = b.table(spark, folder, "documents")
    return docs.select(
        "doc_id", nm.language_code(F.col("lang")).alias("a"),
        nm.language_code(F.concat(F.upper("lang"), F.lit("_XX"))).alias("b"), nm.language_code(F.col("source")).alias("c"),
    )


@query("video_files", f"{SHELF} SELECT video AS path FROM shelf")
def video_files(spark, folder):
    s = b.shelf(spark, folder)
    return catalogue.videos(s.select(F.col("video").alias("path")).unionByName(s.select(F.col("sidecar").alias("path"))))


@query("natural_order", f"""{SHELF}, d AS (SELECT p_brand, key, 'ep' || (key * 7919 % 1000) || ' part ' || size || '.mkv' AS name, key * 7919 % 1000 AS x, size FROM shelf)
SELECT p_brand, key, row_number() OVER (PARTITION BY p_brand ORDER BY x, size, key) AS rank FROM d""")
def natural_order(spark, folder):
    s = b.shelf(spark, folder).select("p_brand", "key", F.concat(F.lit("ep"), F.col("key") * 7919 % 1000, F.lit(" part "), "size", F.lit(".mkv")).alias("name"))
    keyed = s.withColumn("k", nm.natural_key(F.col("name")))
    return ranking.ranked(keyed, ["p_brand"], ["k", "key"], "rank").select("p_brand", "key", "rank")


@query("episode_numbering", f"""{SHELF}, d AS (SELECT p_brand AS project, 'Ep ' || (key * 7919 % 1000) || ' v' || key AS title, key * 7919 % 1000 AS x, key FROM shelf),
n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY x, key) AS i FROM d)
SELECT project, title, printf('E%02d', i) AS episode_id FROM n""")
def episode_numbering(spark, folder):
    s = b.shelf(spark, folder)
    files = s.select(F.col("p_brand").alias("project"), F.concat(F.lit("/lib/Ep "), F.col("key") * 7919 % 1000, F.lit(" v"), "key", F.lit(".mkv")).alias("path"))
    return catalogue.number_episodes(files).select("project", "title", "episode_id")


@query("episode_identifiers", f"""{SHELF} SELECT key, CASE WHEN key % 5 = 0 THEN '' ELSE (size % 3 + 1) || ':' || (key % 40 + 1) END AS own,
  CASE WHEN key % 5 = 0 THEN '' ELSE (key % 3 + 1) || ':' || (size % 40 + 1) END AS side,
  CASE WHEN key % 5 = 0 THEN '' ELSE 'show' || key % 7 END AS show FROM shelf""")
def episode_identifiers(spark, folder):
    flat = lambda name: F.array_join(F.transform(nm.episode_numbers(nm.file_name(F.col(name))), lambda e: F.concat(e["season"], F.lit(":"), e["episode"])), ",")
    return b.shelf(spark, folder).select("key", flat("video").alias("own"), flat("sidecar").alias("side"), nm.show_prefix(F.col("video")).alias("show"))


PAIRS = """pairs AS (SELECT DISTINCT v.video, s.sidecar, s.ending, s.size, s.key AS skey, v.key % 5 = 0 AS plain FROM shelf v JOIN shelf s ON v.dir = s.dir AND s.ending NOT IN ('.sub', '.txt')
  AND CASE WHEN s.key % 5 <> 0 THEN v.key % 5 <> 0 AND v.size % 3 = s.key % 3 AND v.key % 40 = s.size % 40 AND v.key % 7 = s.size % 7
           ELSE v.key % 5 = 0 AND v.key % 7 = s.size % 7 END)"""


@query("sidecar_matches", f"{SHELF}, {PAIRS} SELECT DISTINCT video, sidecar FROM pairs")
def sidecar_matches(spark, folder):
    s = b.shelf(spark, folder)
    return catalogue.match_sidecars(s.select("video").distinct(), s.select(F.col("sidecar").alias("path")).distinct())


@query("sidecar_tracks", f"""{SHELF}, {PAIRS}, subs AS (SELECT DISTINCT left(sidecar, length(sidecar) - 4) AS base FROM shelf WHERE ending = '.sub')
SELECT DISTINCT video, 'sidecar:' || split_part(sidecar, '/', 4) AS track_id, CASE ending WHEN '.idx' THEN 'vobsub' ELSE substring(ending, 2) END AS source_format,
  CASE WHEN NOT plain AND size % 5 IN (0) THEN 'sho' WHEN NOT plain THEN 'sho' WHEN size % 5 = 2 THEN 'fra' WHEN size % 5 = 4 THEN 'deu' ELSE 'eng' END AS language,
  size % 5 = 3 AS is_forced, ending = '.idx' AS is_bitmap,
  CAST(CASE WHEN ending = '.idx' THEN 50 ELSE 100 END + CASE WHEN plain AND size % 5 = 0 THEN 15 WHEN plain THEN 10 ELSE 0 END AS DOUBLE) AS score
FROM pairs WHERE ending <> '.idx' OR left(sidecar, length(sidecar) - 4) IN (SELECT base FROM subs)""")
def sidecar_tracks(spark, folder):
    """The first word left of an episode sidecar is its show, so its language reads 'sho'."""
    s = b.shelf(spark, folder)
    return catalogue.sidecar_tracks(s.select("video").distinct(), s.select(F.col("sidecar").alias("path")).distinct()).drop("source_type")


TRACKS = """tracks AS (SELECT key // 4 AS video, 't' || key AS track_id, key % 4 AS ordinal, CASE WHEN size % 2 = 0 THEN 'sidecar' ELSE 'embedded' END AS source_type,
  CASE WHEN size % 3 = 0 THEN 'fra' ELSE 'eng' END AS language, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') AS is_forced, size > 35 AS is_bitmap,
  CASE WHEN size > 35 THEN 50.0 ELSE 100.0 END + size % 4 * 5 AS score FROM shelf)"""


def _tracks(spark, folder):
    size = F.col("size")
    return b.shelf(spark, folder).select(
        F.floor(F.col("key") / 4).alias("video"), F.concat(F.lit("t"), "key").alias("track_id"), (F.col("key") % 4).alias("ordinal"),
        F.when(size % 2 == 0, "sidecar").otherwise("embedded").alias("source_type"), F.when(size % 3 == 0, "fra").otherwise("eng").alias("language"),
        F.col("p_brand").isin(*[f"Brand#{i}" for i in range(1, 6)]).alias("is_forced"), (size > 35).alias("is_bitmap"),
        (F.when(size > 35, 50.0).otherwise(100.0) + size % 4 * 5).alias("score"),
    )


@query("best_subtitles", f"""{SHELF}, {TRACKS}, f AS (SELECT *, NOT is_forced AND language = 'eng' AS f FROM tracks)
SELECT video, arg_max(track_id, {{a: NOT is_bitmap, b: score, c: NOT is_bitmap AND source_type = 'sidecar', d: -ordinal}}) FILTER (f) AS track_id,
  count(*) FILTER (is_forced) AS forced_tracks, NOT bool_or(f) AS stt_required FROM f GROUP BY video""")
def best_subtitles(spark, folder):
    return selection.best_subtitles(_tracks(spark, folder), ["video"])


@query("embedded_tracks", f"""{SHELF} SELECT key AS video, printf('embedded:%d:%s', size, c.f) AS track_id, c.f AS source_format, size > 25 OR p_name LIKE '%forced%' OR key % 11 = 0 AS is_forced,
  c.bm AS is_bitmap, CAST(CASE WHEN c.bm THEN 50 ELSE 100 END + CASE WHEN key % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN c.f = 'ass' THEN 5 ELSE 0 END AS DOUBLE) AS score
FROM shelf JOIN (VALUES (0, 'srt', false), (1, 'ass', false), (2, 'vtt', false), (3, 'pgs', true), (4, 'vobsub', true), (5, 'mov_text', false)) c(k, f, bm) ON key % 6 = c.k""")
def embedded_tracks(spark, folder):
    codecs = F.array(*[F.lit(c) for c in ("SubRip", "ssa", "webvtt", "hdmv_pgs_subtitle", "dvd_subtitle", "mov_text")])
    s = b.shelf(spark, folder).select(
        F.col("key").alias("video"), F.col("size").alias("idx"), F.element_at(codecs, (F.col("key") % 6 + 1).cast("int")).alias("codec"),
        F.lit("en").alias("language"), F.when(F.col("key") % 11 == 0, F.lit("Foreign parts")).otherwise(F.col("p_name")).alias("title"),
        (F.col("key") % 2 == 0).alias("is_default"), (F.col("size") > 25).alias("is_forced"),
    )
    return selection.embedded_tracks(s).select("video", "track_id", "source_format", "is_forced", "is_bitmap", "score")


AUDIO = """audio AS (SELECT key // 4 AS video, CAST(key % 4 AS INTEGER) AS idx, ['eng', 'fra', 'und'][size % 3 + 1] AS language, size % 5 = 0 AS is_default,
  CAST(size % 6 AS INTEGER) AS channels, CAST(key * 31 % 5 AS BIGINT) AS bitrate, size % 4 = 0 AS is_commentary, size % 7 = 0 AS is_descriptive FROM shelf),
tier AS (SELECT *, CASE WHEN is_commentary OR is_descriptive THEN 0 WHEN language = 'eng' THEN 2 ELSE 1 END AS t FROM audio)"""


@query("best_audio", f"""{SHELF}, {AUDIO}, pick AS (SELECT video, arg_max(idx, {{t: t, a: CASE WHEN t > 0 THEN CAST(is_default AS INTEGER) ELSE 0 END, b: CASE WHEN t > 0 THEN channels ELSE 0 END,
  c: CASE WHEN t > 0 THEN bitrate ELSE 0 END, d: -idx}}) AS idx, max(t) AS t FROM tier GROUP BY video)
SELECT video, idx, CASE t WHEN 2 THEN 'english' WHEN 1 THEN 'fallback_non_english' ELSE 'fallback_commentary' END AS reason, t < 2 AS has_warning FROM pick""")
def best_audio(spark, folder):
    size = F.col("size")
    s = b.shelf(spark, folder).select(
        F.floor(F.col("key") / 4).alias("video"), (F.col("key") % 4).cast("int").alias("idx"),
        F.element_at(F.array(F.lit("eng"), F.lit("fra"), F.lit("und")), (size % 3 + 1).cast("int")).alias("language"),
        (size % 5 == 0).alias("is_default"), (size % 6).alias("channels"), (F.col("key") * 31 % 5).alias("bitrate"),
        (size % 4 == 0).alias("is_commentary"), (size % 7 == 0).alias("is_descriptive"),
    )
    return selection.best_audio(s, ["video"])


@query("probe_streams", f"""{SHELF} SELECT video AS path, k.kind, CAST(0 AS INTEGER) AS ordinal, CAST(size * 2 + k.pos AS INTEGER) AS idx, k.codec,
  CASE k.kind WHEN 'audio' THEN CASE WHEN size % 4 = 0 THEN 'Director talk' ELSE p_name END ELSE '' END AS title,
  CASE k.kind WHEN 'audio' THEN 'eng' ELSE 'und' END AS language, k.kind = 'audio' AND size % 4 = 0 AS is_commentary,
  CASE k.kind WHEN 'video' THEN '24000/1001' ELSE '' END AS fps, CASE k.kind WHEN 'video' THEN '1/1000' WHEN 'audio' THEN '1/48000' ELSE '' END AS time_base,
  CASE k.kind WHEN 'video' THEN '4:3' ELSE '' END AS sar, CAST(CASE k.kind WHEN 'video' THEN size * 16 ELSE 0 END AS INTEGER) AS width
FROM (SELECT DISTINCT ON (video) * FROM shelf ORDER BY video, key), (VALUES ('video', 0, 'h264'), ('audio', 1, 'aac'), ('subtitle', 2, 'subrip')) k(kind, pos, codec)""")
def probe_streams(spark, folder):
    """Probe documents composed per video, read back into stream rows."""
    first = b.shelf(spark, folder).groupBy("video").agg(F.min_by(F.struct("size", "p_name"), "key").alias("_r")).select("video", "_r.*")
    index = lambda at: (F.col("size") * 2 + at).alias("index")
    v = F.struct(index(0), F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), (F.col("size") * 16).alias("width"),
                 F.lit("48000/2002").alias("avg_frame_rate"), F.lit("2/2000").alias("time_base"), F.lit("8:6").alias("sample_aspect_ratio"))
    title = F.when(F.col("size") % 4 == 0, "Director talk").otherwise(F.col("p_name"))
    a = F.struct(index(1), F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit("1/48000").alias("time_base"),
                 F.struct(title.alias("title"), F.lit("en").alias("language")).alias("tags"))
    s = F.struct(index(2), F.lit("subtitle").alias("codec_type"), F.lit("subrip").alias("codec_name"))
    content = F.concat(F.lit('{"streams":['), F.concat_ws(",", F.to_json(v), F.to_json(a), F.to_json(s)), F.lit("]}"))
    rows = probes.probe_streams(first.select(F.col("video").alias("path"), content.alias("content")))
    return rows.select("path", "kind", "ordinal", "idx", "codec", "title", "language", "is_commentary", "fps", "time_base", "sar", "width")


@query("rational_rates", """SELECT p_partkey AS key, (p_size // gcd(p_size, 24)) || '/' || (24 // gcd(p_size, 24)) AS rate,
  CASE WHEN p_partkey % 50 = 0 THEN '' ELSE (p_partkey % 50 // gcd(p_partkey % 50, p_size)) || ':' || (p_size // gcd(p_partkey % 50, p_size)) END AS sar,
  CASE WHEN p_size % 2 = 0 THEN (p_size // 2) || '/' || 500 // 1 ELSE p_size || '/1000' END AS base FROM part""".replace("(p_size // 2) || '/' || 500 // 1", "(p_size // gcd(p_size, 1000)) || '/' || (1000 // gcd(p_size, 1000))").replace("p_size || '/1000'", "(p_size // gcd(p_size, 1000)) || '/' || (1000 // gcd(p_size, 1000))"))
def rational_rates(spark, folder):
    p = b.table(spark, folder, "part")
    text = lambda a, mark, z: F.concat(a.cast("string"), F.lit(mark), z.cast("string"))
    return p.select(
        F.col("p_partkey").alias("key"), frame_rate(text(F.col("p_size"), "/", F.lit(24))).alias("rate"),
        aspect_ratio(text(F.col("p_partkey") % 50, ":", F.col("p_size"))).alias("sar"), time_base(text(F.col("p_size"), "/", F.lit(1000))).alias("base"),
    )


SIGNED = """sig AS (SELECT l_orderkey AS list, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS ordinal,
  CASE WHEN l_linestatus = 'O' THEN 'h264' ELSE 'H264' END AS video_codec, CASE WHEN l_suppkey % 9 = 0 THEN 'hevc' ELSE 'high' END AS video_profile,
  CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE 1920 END AS width, '24/1' AS fps, l_returnflag <> 'R' AS has_audio,
  CASE WHEN l_suppkey % 4 = 0 THEN 'unknown' ELSE 'stereo' END AS channel_layout, CASE WHEN l_partkey % 3 = 0 THEN 44100 ELSE 48000 END AS sample_rate FROM lineitem)"""


def _signed(spark, folder):
    order = b.Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
    )
    lit = lambda v, name: F.lit(v).alias(name)
    return b.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("list"), (F.row_number().over(order) - 1).cast("bigint").alias("ordinal"),
        F.when(F.col("l_linestatus") == "O", "h264").otherwise("H264").alias("video_codec"),
        F.when(F.col("l_suppkey") % 9 == 0, "hevc").otherwise("high").alias("video_profile"),
        F.when(F.col("l_partkey") % 13 == 0, 0).otherwise(1920).alias("width"), lit(1081, "height"), lit("yuv420p", "pix_fmt"), lit("24/1", "fps"),
        lit("1/1000", "video_time_base"), lit("1:1", "sar"), (F.col("l_returnflag") != "R").alias("has_audio"), lit("aac", "audio_codec"),
        F.when(F.col("l_partkey") % 3 == 0, 44100).otherwise(48000).alias("sample_rate"), lit("fltp", "sample_fmt"), lit(2, "channels"),
        F.when(F.col("l_suppkey") % 4 == 0, "unknown").otherwise("stereo").alias("channel_layout"), lit("1/48000", "audio_time_base"),
    )


CODES = """b AS (SELECT list, arg_min(video_profile, ordinal) AS bp, arg_min(width, ordinal) AS bw, arg_min(has_audio, ordinal) AS ba, arg_min(channel_layout, ordinal) AS bl, arg_min(sample_rate, ordinal) AS bs FROM sig GROUP BY list),
m AS (SELECT * FROM sig JOIN b USING (list)),
codes AS (SELECT list, ordinal, 'invalid_dimensions' AS code FROM m WHERE width <= 0
 UNION ALL SELECT list, ordinal, 'audio_channel_layout_unknown' FROM m WHERE has_audio AND channel_layout = 'unknown'
 UNION ALL SELECT list, ordinal, 'audio_presence_mismatch' FROM m WHERE ordinal > 0 AND has_audio <> ba
 UNION ALL SELECT list, ordinal, 'video_profile_mismatch' FROM m WHERE ordinal > 0 AND video_profile <> bp
 UNION ALL SELECT list, ordinal, 'resolution_mismatch' FROM m WHERE ordinal > 0 AND width <> bw
 UNION ALL SELECT list, ordinal, 'sample_rate_mismatch' FROM m WHERE ordinal > 0 AND has_audio AND ba AND sample_rate <> bs
 UNION ALL SELECT list, ordinal, 'channel_layout_mismatch' FROM m WHERE ordinal > 0 AND has_audio AND ba AND channel_layout <> bl)"""


@query("concat_differences", f"WITH {SIGNED}, {CODES} SELECT list, ordinal, code FROM codes")
def concat_differences(spark, folder):
    return streams.concat_differences(_signed(spark, folder), ["list"])


@query("concat_decision", f"WITH {SIGNED}, {CODES}, t AS (SELECT s.list, CASE WHEN NOT any_value(a.h) THEN 1 ELSE 0 END + any_value(coalesce(c.n, 0)) AS n FROM sig s JOIN (SELECT list, bool_or(has_audio) AS h FROM sig GROUP BY 1) a USING (list) LEFT JOIN (SELECT list, count(*) AS n FROM codes GROUP BY 1) c USING (list) GROUP BY s.list) SELECT list, n = 0 AS compatible, CAST(n AS BIGINT) AS differences FROM t")
def concat_decision(spark, folder):
    return streams.concat_decision(_signed(spark, folder), ["list"], require_audio=True)


@query("normalisation_profile", f"WITH {SIGNED} SELECT list, coalesce(arg_min(width, ordinal) FILTER (width > 0), 1920) AS width, 1080 AS height, '24/1' AS fps, bool_or(has_audio) AS requires_audio FROM sig GROUP BY list")
def normalisation_profile(spark, folder):
    return streams.normalisation_profile(_signed(spark, folder), ["list"], synthesize_audio=False)


@query("pcm_levels", """WITH s AS (SELECT vec_id, label, unnest(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 32767) AS BIGINT))) AS x FROM embeddings)
SELECT label, count(*) AS samples, CAST(sum(x * x) AS BIGINT) AS sum_squares, max(abs(x)) AS peak, count(*) FILTER (abs(x) >= 32767) AS clipped,
  sqrt(CAST(sum(x * x) AS BIGINT) / count(*)) / 32768 >= 0.001 AS has_sound,
  CASE WHEN max(abs(x)) >= 32767 THEN 'CLIPPING' WHEN 20 * log10(max(abs(x)) / 32768) > -1.35 THEN 'PEAK_OVER_LIMIT' END AS issue FROM s GROUP BY label""")
def pcm_levels(spark, folder):
    samples = F.transform("embedding", lambda x: F.floor(x.cast("double") * 32767))
    blocks = b.table(spark, folder, "embeddings").select("label", samples.alias("samples"))
    return loudness.mix_issue(loudness.block_levels(blocks, ["label"])).drop("rms")


@query("clip_offsets", f"WITH {b.CLIPS_SQL} SELECT output_id, ordinal, CAST(coalesce(sum(CAST(round((end_ms - start_ms) / 1.25) AS BIGINT)) OVER (PARTITION BY output_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM clips WHERE end_ms > start_ms")
def clip_offsets(spark, folder):
    return cl.clip_offsets(b.clips(spark, folder), ["output_id"], 1.25).select("output_id", "ordinal", "offset_ms")


@query("subtitle_remap", f"""{b.TIMELINE_SQL}, {b.CLIPS_SQL}, o AS (SELECT *, coalesce(sum(CAST(round((end_ms - start_ms) / 1.25) AS BIGINT)) OVER (PARTITION BY output_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM clips WHERE end_ms > start_ms)
SELECT o.output_id, o.ordinal AS clip, c.ordinal AS cue, CAST(round_even(o.off + (greatest(c.start_ms, o.start_ms) - o.start_ms) / 1.25, 0) AS BIGINT) AS out_start_ms,
  CAST(round_even(o.off + (least(c.end_ms, o.end_ms) - o.start_ms) / 1.25, 0) AS BIGINT) AS out_end_ms, c.text
FROM o JOIN cues c ON o.episode_id = c.episode_id AND greatest(c.start_ms, o.start_ms) < least(c.end_ms, o.end_ms)""")
def subtitle_remap(spark, folder):
    return cl.remap_cues(b.clips(spark, folder), b.cues(spark, folder), ["output_id"], 1.25).drop("episode_id")


@query("narration_timeline", f"""WITH {b.CLIPS_SQL}, s AS (SELECT output_id, ordinal, end_ms - start_ms AS footage_ms, start_ms % 40000 AS speech_ms, start_ms % 5 = 0 AS orig, start_ms % 11 = 0 AS mute FROM clips),
t AS (SELECT *, CAST(coalesce(sum(footage_ms) OVER (PARTITION BY output_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_start_ms,
  CAST(sum(footage_ms) OVER (PARTITION BY output_id) AS BIGINT) AS total FROM s),
i AS (SELECT *, CASE WHEN NOT orig AND mute THEN 'NARRATION_MISSING' WHEN NOT orig AND speech_ms > footage_ms + 100 THEN 'SPEECH_TOO_LONG' END AS issue FROM t)
SELECT output_id, ordinal, seg_start_ms, CASE WHEN NOT orig AND issue IS NULL THEN least(seg_start_ms + speech_ms, total) END AS cue_end_ms, issue FROM i""")
def narration_timeline(spark, folder):
    start = F.col("start_ms")
    segs = b.clips(spark, folder).select(
        "output_id", "ordinal", (F.col("end_ms") - start).alias("footage_ms"), (start % 40000).alias("speech_ms"),
        F.when(start % 5 == 0, "original_only").otherwise("duck").alias("audio_policy"), F.when(start % 11 == 0, " ").otherwise("words").alias("narration"),
    )
    return cl.narration_timeline(segs, ["output_id"])


@query("safe_titles", r"""WITH t AS (SELECT p_partkey, p_brand || ': ' || p_name || '/"' || p_type || '"?' AS title FROM part)
SELECT p_partkey, regexp_replace(replace(replace(replace(replace(title, ':', ' - '), '/', '-'), '"', ''''), '?', ''), '\s+', ' ', 'g') AS title FROM t""")
def safe_titles(spark, folder):
    title = F.concat("p_brand", F.lit(": "), "p_name", F.lit('/"'), "p_type", F.lit('"?'))
    return b.table(spark, folder, "part").select("p_partkey", nm.safe_title(title).alias("title"))


@query("unique_titles", """WITH t AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS i FROM part)
SELECT p_brand, p_partkey, CASE WHEN i = 1 THEN p_name ELSE p_name || '_' || (i - 1) END AS title FROM t""")
def unique_titles(spark, folder):
    return ranking.unique_names(b.table(spark, folder, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], "p_partkey", "p_name", "title").drop("p_name")


@query("unique_output_ids", """WITH RECURSIVE t AS (SELECT p_partkey // 50 AS project, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'out_' || (p_size % 5) ELSE 'out' END AS output_id FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY p_partkey) AS n FROM t),
walk(project, n, seen, unique_id) AS (SELECT project, n, [output_id], output_id FROM r WHERE n = 1
  UNION ALL SELECT project, n, list_append(seen, id), id FROM (SELECT w.project, r.n, w.seen, CASE WHEN list_contains(w.seen, r.output_id)
      THEN r.output_id || '_' || list_filter(range(1, len(w.seen) + 2), lambda k: NOT list_contains(w.seen, r.output_id || '_' || k))[1] ELSE r.output_id END AS id
    FROM walk w JOIN r ON r.project = w.project AND r.n = w.n + 1))
SELECT project, p_partkey, output_id, unique_id FROM r JOIN walk USING (project, n)""")
def unique_output_ids(spark, folder):
    """Ids of which half are numbered already, so that names collide across bases; ids are never cut."""
    ids = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("out_"), F.col("p_size") % 5)).otherwise(F.lit("out"))
    rows = b.table(spark, folder, "part").select(F.floor(F.col("p_partkey") / 50).alias("project"), "p_partkey", ids.alias("output_id"))
    return ranking.unique_names(rows, ["project"], "p_partkey", "output_id", "unique_id", None)
