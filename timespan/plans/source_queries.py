"""Queries of readers and writers over texts that Spark derives from the tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from timespan import fixtures as fx
from timespan.functions import text as tx
from timespan.operators import intervals as iv
from timespan.operators import transcripts as tr
from timespan.plans.interval_queries import merged
from timespan.plans.transcript_queries import CUT, _cut, _kept
from timespan.registry import ORACLE, query
from timespan.sources import documents as dc
from timespan.sources import logs as lg
from timespan.sources import subtitles as sb


def _lines(spark, d):
    """Subtitle lines: a line per turn, 4 s each."""
    c = fx.table(spark, d, "conversations")
    t = F.col("turn").cast("long")
    return c.select(F.col("conv_id").cast("long").alias("media_id"), t.alias("line_idx"), (t * 5_000_000 + 1_500).alias("start_us"), (t * 5_000_000 + 4_000_500).alias("end_us"), F.regexp_replace(F.btrim("text"), r"\s+", " ").alias("text"), F.concat(F.lit("Speaker "), (t % 3).cast("string")).alias("speaker"))


_SQL_LINES = """lines AS (SELECT conv_id::BIGINT AS media_id, turn::BIGINT AS line_idx, turn::BIGINT * 5000000 + 1500 AS start_us, turn::BIGINT * 5000000 + 4000500 AS end_us, regexp_replace(trim(text), '\\s+', ' ', 'g') AS text, 'Speaker ' || (turn % 3) AS speaker FROM conversations),
ck AS (SELECT *, round_even(start_us / 1000.0, 0)::BIGINT AS a, round_even(end_us / 1000.0, 0)::BIGINT AS b, row_number() OVER (PARTITION BY media_id ORDER BY line_idx) AS n FROM lines)"""


def _clock(c: str, mark: str) -> str:
    return f"printf('%02d:%02d:%02d{mark}%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"


def _body(text: str, numbered: bool, mark: str) -> str:
    n = "n || chr(10) || " if numbered else ""
    return f"regexp_replace(string_agg({n}{_clock('a', mark)} || ' --> ' || {_clock('b', mark)} || chr(10) || {text} || chr(10), chr(10) ORDER BY line_idx), '\\s+$', '') || chr(10)"


@query(f"WITH {_SQL_LINES} SELECT media_id, {_body('text', True, ',')} AS value FROM ck GROUP BY media_id")
def srt_texts(spark, d):
    return sb.to_srt(_lines(spark, d))


@query(f"WITH {_SQL_LINES} SELECT media_id, 'WEBVTT' || chr(10) || chr(10) || {_body('text', False, '.')} AS value FROM ck GROUP BY media_id")
def vtt_texts(spark, d):
    return sb.to_vtt(_lines(spark, d))


_SAID = "speaker || '：' || text"


@query(f"WITH {_SQL_LINES} SELECT media_id, {_body(_SAID, True, ',')} AS value FROM ck GROUP BY media_id")
def speaker_srt_texts(spark, d):
    return sb.to_speaker_srt(_lines(spark, d))


@query(f"WITH {_SQL_LINES} SELECT media_id, string_agg({_SAID}, chr(10) ORDER BY line_idx) AS value FROM lines WHERE trim(text) <> '' GROUP BY media_id")
def plain_texts(spark, d):
    return sb.to_plain(_lines(spark, d))


@query(f"WITH {_SQL_LINES} SELECT media_id, n - 1 AS block, a * 1000 AS start_us, b * 1000 AS end_us, text FROM ck")
def srt_round_trip(spark, d):
    return sb.parse_srt(sb.to_srt(_lines(spark, d)), "media_id")


@query(f"WITH {_SQL_LINES} SELECT media_id, n - 1 AS block, a * 1000 AS start_us, b * 1000 AS end_us, speaker, text FROM ck")
def speaker_srt_round_trip(spark, d):
    return sb.parse_speaker_srt(sb.to_speaker_srt(_lines(spark, d)), "media_id")


@query(f"WITH {_SQL_LINES}, t AS (SELECT media_id, max(end_us) AS total_us FROM lines GROUP BY media_id) SELECT media_id, line_idx, greatest(0, start_us * 16000 // 1000000) AS from_sample, least(total_us * 16000 // 1000000, end_us * 16000 // 1000000) AS to_sample, printf('%08d-%08d.wav', start_us // 1000, end_us // 1000) AS file FROM lines JOIN t USING (media_id) WHERE trim(text) <> ''")
def clip_manifest(spark, d):
    lines = _lines(spark, d)
    return dc.clip_manifest(lines, lines.groupBy("media_id").agg(F.max("end_us").alias("total_us")))


@query(fx.sql("words", "word_totals", query="SELECT media_id, start_us, end_us FROM kept WHERE media_id % 2 = 0 UNION ALL SELECT media_id, start_us, end_us FROM kept WHERE media_id % 2 = 1", more=CUT))
def plan_round_trip(spark, d):
    """Plans written as JSON and read again; every other one without its kept ranges, so that they are derived."""
    totals = fx.word_totals(spark, d)
    plans = dc.plan_json(totals, _cut(spark, d), _kept(spark, d))
    return dc.keep_ranges(plans.withColumn("value", F.when(F.col("media_id") % 2 == 1, F.regexp_replace("value", "keep_ranges", "other")).otherwise(F.col("value"))), totals)


_BY_PREFERENCE = """SELECT media_id, 'keep' AS prefer, start_us, end_us FROM kept WHERE media_id % 4 <> 3 UNION ALL SELECT media_id, 'keep', start_us, end_us FROM cut WHERE media_id % 4 = 3
UNION ALL SELECT media_id, 'delete', start_us, end_us FROM cut WHERE media_id % 4 <> 3 UNION ALL SELECT media_id, 'delete', start_us, end_us FROM kept k WHERE media_id % 4 = 3 AND end_us <= (SELECT max(c.end_us) FROM cut c WHERE c.media_id = k.media_id)"""


@query(fx.sql("words", "word_totals", query=_BY_PREFERENCE, more=CUT))
def range_files(spark, d):
    """Plans with both lists, with one of them, and bare lists of deleted ranges, read as kept and as deleted ranges."""
    plans = dc.plan_json(fx.word_totals(spark, d), _cut(spark, d), _kept(spark, d))
    m = F.col("media_id") % 4
    value = F.when(m == 1, F.replace("value", F.lit("keep_ranges"), F.lit("x"))).when(m == 2, F.replace("value", F.lit("delete_ranges"), F.lit("x")))
    value = value.when(m == 3, F.get_json_object("value", "$.delete_ranges")).otherwise(F.col("value"))
    files = plans.withColumn("value", value)
    both = [dc.range_files(files, p).select("media_id", F.lit(p).alias("prefer"), "start_us", "end_us") for p in ("keep", "delete")]
    return both[0].unionByName(both[1])


@query(ORACLE["silence_candidates"].replace("SELECT q.media_id, q.start_us", "SELECT q.media_id, 1.2::DOUBLE AS min_duration, 'unknown' AS classification, q.start_us"))
def silence_report(spark, d):
    """Reports of silence candidates written and read again."""
    totals = fx.word_totals(spark, d)
    media = totals.select("media_id", F.concat(F.lit("/media/"), F.col("media_id").cast("string"), F.lit(".mp4")).alias("media_path"))
    return dc.read_silence_report(dc.silence_report(media, tr.silences(fx.words(spark, d), totals)))


def _packets(spark, d):
    return fx.ranges(spark, d).select("media_id", F.concat(F.format_string("%.6f", F.col("start_us") / 1e6), F.when(F.col("kind") == "signup", F.lit(",K__")).otherwise(F.lit(",___"))).alias("value"))


@query(fx.sql("ranges", "keyframes", query="SELECT * FROM keyframes"))
def keyframes_from_packets(spark, d):
    return lg.keyframes_from_packets(_packets(spark, d))


@query(fx.sql("ranges", query="SELECT media_id, start_us AS t_us FROM ranges WHERE kind = 'view'"))
def keyframes_from_frames(spark, d):
    f = F.struct((F.col("kind") == "view").cast("int").cast("string").alias("key_frame"), F.when(F.col("start_us") % 2 == 0, F.format_string("%.6f", F.col("start_us") / 1e6)).otherwise("N/A").alias("pkt_pts_time"), F.format_string("%.6f", F.col("start_us") / 1e6).alias("best_effort_timestamp_time"))
    return lg.keyframes_from_frames(fx.ranges(spark, d).groupBy("media_id").agg(F.to_json(F.struct(F.collect_list(f).alias("frames"))).alias("value")))


@query(fx.sql("ranges", "spans", query="SELECT media_id, start_us, end_us FROM merged", more=merged("spans")))
def silences_from_log(spark, d):
    m = iv.merge(fx.spans(spark, d))
    lines = m.select("media_id", F.explode(F.array(F.struct(F.col("start_us").alias("line_no"), F.format_string("[x] silence_start: %.6f", F.col("start_us") / 1e6).alias("value")), F.struct(F.col("end_us").alias("line_no"), F.format_string("[x] silence_end: %.6f | silence_duration: 1", F.col("end_us") / 1e6).alias("value")))).alias("x"))
    return lg.silences_from_log(lines.select("media_id", "x.line_no", "x.value"))


@query(fx.sql("ranges", "totals", query="SELECT media_id, total_us // 10000 * 10000 AS duration_us, media_id % 2 = 0 AS has_video, true AS has_audio FROM totals"))
def probed_media(spark, d):
    cs = F.floor(F.col("total_us") / 10_000)
    dur = F.format_string("  Duration: %d:%02d:%02d.%02d, start: 0", F.floor(cs / 360_000), F.floor(cs / 6_000) % 60, F.floor(cs / 100) % 60, cs % 100)
    kinds = F.when(F.col("media_id") % 2 == 0, F.lit("Stream #0:0: Video: h264")).otherwise(F.lit("Stream #0:0: Data"))
    return lg.probe(fx.totals(spark, d).select("media_id", F.explode(F.array(dur, kinds, F.lit("Stream #0:1(und): Audio: aac"))).alias("value")))


@query(fx.sql("ranges", "totals", query="SELECT media_id, start_us AS line_no, round(least(start_us // 10000 * 10000 / total_us, 1), 9) AS progress FROM ranges JOIN totals USING (media_id)"))
def progress_from_log(spark, d):
    cs = F.floor(F.col("start_us") / 10_000)
    lines = fx.ranges(spark, d).select("media_id", F.col("start_us").alias("line_no"), F.format_string("frame= 1 time=%d:%02d:%02d.%02d bitrate=1", F.floor(cs / 360_000), F.floor(cs / 6_000) % 60, F.floor(cs / 100) % 60, cs % 100).alias("value"))
    return lg.progress(lines, fx.totals(spark, d).withColumnRenamed("total_us", "duration_us")).withColumn("progress", F.round("progress", 9))


@query(r"SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(trim(text), '[\s,，；;、]+')) AS word FROM conversations WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#')) WHERE word <> ''")
def word_list(spark, d):
    return lg.word_list(fx.table(spark, d, "conversations").select(F.col("text").alias("value")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '25/1' END AS rate FROM part")
def media_kinds(spark, d):
    k = F.col("p_partkey") % 4
    path = F.concat(F.lit("/m/"), F.col("p_name"), F.when(k == 0, ".MP4").when(k == 1, ".wav").when(k == 2, ".txt").otherwise(""))
    return fx.table(spark, d, "part").select("p_partkey", tx.suffix_kind(F.regexp_replace(path, " ", "_")).alias("kind"), lg.frame_rate(F.when(F.col("p_partkey") % 3 == 0, F.lit("0/0")).otherwise(F.lit(" 25/1"))).alias("rate"))


@query("SELECT p_name AS name, CASE p_partkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'differs' WHEN 2 THEN 'pointer' ELSE 'ok' END AS status FROM (SELECT c_name AS p_name, c_custkey AS p_partkey FROM customer)")
def checked_artefacts(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 4).alias("k"), F.col("c_address").alias("body") if "c_address" in fx.table(spark, d, "customer").columns else F.col("c_name").alias("body"))
    files = c.filter("k <> 0").select("name", F.when(F.col("k") == 2, F.concat(F.lit("version https://git-lfs.github.com/spec/v1 "), "body")).otherwise(F.col("body")).cast("binary").alias("content"))
    manifest = c.select("name", F.when(F.col("k") == 1, F.lit("0")).otherwise(F.sha2("body", 256)).alias("sha256"))
    return dc.check_artefacts(files, manifest)


_RANKED = "SELECT media_id, dense_rank() OVER (PARTITION BY media_id ORDER BY seg_idx) - 1 AS seg_idx, word_idx, text, start_us, end_us, conf FROM words"


def _languages(spark, d):
    return fx.word_totals(spark, d).select("media_id", F.lit("en").alias("language"))


@query(fx.sql("words", query=_RANKED))
def transcript_round_trip(spark, d):
    """Words written as transcript JSON and read again."""
    texts = dc.transcript_json(fx.words(spark, d), _languages(spark, d)).withColumn("path", F.format_string("%d.json", "media_id"))
    words = dc.transcripts_of(texts).select("path", "seg_idx", F.posexplode("words").alias("word_idx", "w"))
    return words.select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("media_id"), F.col("seg_idx").cast("long"), "word_idx", "w.text", "w.start_us", "w.end_us", "w.conf")


@query(fx.sql("words", query=f"""SELECT media_id || '.json' AS path, seg_idx, min(start_us) AS start_us, max(end_us) AS end_us, string_agg(text, ' ' ORDER BY start_us, end_us, word_idx) AS text, count(*) AS n_words FROM ({_RANKED}) WHERE media_id % 2 = 0 GROUP BY media_id, seg_idx
UNION ALL SELECT media_id || '.srt', n - 1, a * 1000, b * 1000, text, 0 FROM ck WHERE media_id % 2 = 1""", more=_SQL_LINES))
def transcripts_by_suffix(spark, d):
    """JSON transcripts of even media and subtitles of odd ones, read by suffix."""
    json = dc.transcript_json(fx.words(spark, d).filter("media_id % 2 = 0"), _languages(spark, d)).select(F.format_string("%d.json", "media_id").alias("path"), "value")
    srt = sb.to_srt(_lines(spark, d).filter("media_id % 2 = 1")).select(F.format_string("%d.srt", "media_id").alias("path"), "value")
    df = dc.transcripts_of(json.unionByName(srt))
    return df.select("path", F.col("seg_idx").cast("long"), "start_us", "end_us", "text", F.size("words").cast("long").alias("n_words"))


@query(fx.sql("words", query="""SELECT media_id, string_agg(text, ' ' ORDER BY seg_idx) AS text, 'l' || min(seg_idx) AS language, count(*) AS chunks, count(*) AS segments, max(start_us) AS last_us, 'c' || max(seg_idx) || '.json' AS last_file
FROM (SELECT media_id, seg_idx, min(start_us) AS start_us, string_agg(text, ' ' ORDER BY start_us, end_us, word_idx) AS text FROM words GROUP BY media_id, seg_idx) GROUP BY media_id"""))
def merged_transcripts(spark, d):
    """Each turn a chunk: one JSON transcript of a conversation, read again with where its chunks begin."""
    from timespan.operators.transcripts import rebuild_segments

    s = rebuild_segments(fx.words(spark, d)).withColumn("chunk_idx", F.col("seg_idx"))
    c = s.withColumn("file", F.format_string("c%d.json", "chunk_idx")).withColumn("language", F.format_string("l%d", "chunk_idx"))
    about = "STRUCT<num_segments: BIGINT, segment_boundaries: ARRAY<STRUCT<index: BIGINT, start_offset: DOUBLE, transcript_file: STRING>>>"
    read = F.from_json("value", f"text STRING, language STRING, segments ARRAY<STRUCT<start: DOUBLE>>, _metadata {about}")
    df = dc.merged_transcript_json(c, s).select("media_id", read.alias("r"))
    last = F.element_at("r._metadata.segment_boundaries", -1)
    return df.select("media_id", "r.text", "r.language", F.col("r._metadata.num_segments").alias("chunks"), F.size("r.segments").cast("long").alias("segments"), F.rint(last["start_offset"] * 1e6).cast("long").alias("last_us"), last["transcript_file"].alias("last_file"))


@query(fx.sql("ranges", query="""SELECT media_id, CASE WHEN media_id % 5 IN (1, 2) THEN NULL WHEN media_id % 5 = 3 THEN 0 ELSE count(*) END AS chunks,
CASE WHEN media_id % 5 IN (0, 4) THEN min(start_us) END AS first_us, CASE WHEN media_id % 5 IN (0, 4) THEN sum(end_us - start_us)::BIGINT END AS total_us FROM ranges GROUP BY media_id"""))
def chunk_list_round_trip(spark, d):
    """Chunk lists written and read again; some are missing, broken or without chunks."""
    r = fx.ranges(spark, d)
    chunks = r.withColumn("chunk_idx", F.row_number().over(Window.partitionBy("media_id").orderBy("start_us", "end_us")) - 1).withColumn("file", F.format_string("c%d.mp4", "chunk_idx"))
    k = F.col("media_id") % 5
    value = F.when(k == 1, F.lit("{broken")).when(k == 2, F.lit(None)).when(k == 3, F.lit('{"version":"1.0"}')).otherwise(F.col("value"))
    df = dc.chunk_lists(dc.chunk_list_json(chunks).withColumn("value", value))
    us = F.transform("segments", lambda x: F.struct(*(F.rint(x[c] * 1e6).cast("long").alias(c) for c in ("start", "end"))))
    total = F.aggregate(us, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    kept = F.size("segments") > 0
    return df.select("media_id", F.when(F.col("segments").isNotNull(), F.size("segments")).cast("long").alias("chunks"), F.when(kept, us[0]["start"]).alias("first_us"), F.when(kept, total).alias("total_us"))
