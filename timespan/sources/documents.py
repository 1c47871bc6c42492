"""JSON documents (transcripts, range files, chunk lists, plans), samples and artefacts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timespan.functions.clock import motion_class
from timespan.operators import intervals as iv
from timespan.sources import subtitles as sb

WORD = "STRUCT<text: STRING, start: DOUBLE, end: DOUBLE, conf: DOUBLE>"
TRANSCRIPT = f"language STRING, segments ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, words: ARRAY<{WORD}>>>"
_RANGE = "ARRAY<STRUCT<start: DOUBLE, end: DOUBLE>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts against the fixed schema: one that doesn't fit is an error."""
    df = spark.read.schema(TRANSCRIPT).json(path, multiLine=True, mode="FAILFAST")
    return df.select(F.col("_metadata.file_path").alias("path"), "language", "segments")


def transcript_segments(transcripts: DataFrame, key: str = "path") -> DataFrame:
    """Segments with words, in microseconds."""
    s = transcripts.select(key, F.posexplode("segments").alias("seg_idx", "s"))

    def us(c):
        return F.rint(c * 1e6).cast("long")

    words = F.transform(F.coalesce("s.words", F.expr(f"cast(array() AS ARRAY<{WORD}>)")), lambda w: F.struct(w["text"].alias("text"), us(w["start"]).alias("start_us"), us(w["end"]).alias("end_us"), w["conf"].alias("conf")))
    return s.select(key, "seg_idx", us(F.col("s.start")).alias("start_us"), us(F.col("s.end")).alias("end_us"), F.col("s.text").alias("text"), words.alias("words"))


def transcripts_of(texts: DataFrame) -> DataFrame:
    """path, seg_idx, start_us, end_us, text, words of texts (path, value): SRT by the suffix .srt, else transcript JSON.

    JSON that doesn't fit the schema is an error. Subtitles have no words.
    """
    srt = F.endswith(F.lower("path"), F.lit(".srt"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("block")) - 1
    none = F.expr("cast(array() AS ARRAY<STRUCT<text: STRING, start_us: BIGINT, end_us: BIGINT, conf: DOUBLE>>)")
    lines = sb.parse_srt(texts.filter(srt)).select("path", place.alias("seg_idx"), "start_us", "end_us", "text", none.alias("words"))
    parsed = F.from_json("value", TRANSCRIPT, {"mode": "FAILFAST"})
    documents = transcript_segments(texts.filter(~srt).select("path", parsed.alias("d")).select("path", "d.segments"))
    return documents.unionByName(lines)


def load_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The segments of all transcripts and subtitle files under path, by suffix."""
    return transcripts_of(sb.read_texts(spark, path))


def _seconds(item, *more: str):
    times = ((item[c] / 1e6).alias(n) for c, n in (("start_us", "start"), ("end_us", "end")))
    return F.struct(*times, *(item[c].alias(c) for c in more))


def transcript_json(words: DataFrame, languages: DataFrame) -> DataFrame:
    """media_id, value: each medium's transcript as JSON, from timed words and a language (media_id, language)."""
    word = F.struct("start_us", "end_us", "word_idx", "text", "conf")
    held = words.groupBy("media_id", "seg_idx").agg(F.sort_array(F.collect_list(word)).alias("w"))
    segment = F.struct(
        "seg_idx", F.col("w")[0]["start_us"].alias("start_us"), F.array_max("w.end_us").alias("end_us"),
        F.array_join("w.text", " ").alias("text"), F.transform("w", lambda x: _seconds(x, "text", "conf")).alias("words"),
    )
    merged = held.groupBy("media_id").agg(F.sort_array(F.collect_list(segment)).alias("s"))
    segments = F.transform("s", lambda x: _seconds(x, "text", "words")).alias("segments")
    document = F.struct(F.coalesce("language", F.lit("")).alias("language"), segments)
    return merged.join(languages, "media_id", "left").select("media_id", F.to_json(document).alias("value"))


def merged_transcript_json(results: DataFrame, segments: DataFrame) -> DataFrame:
    """media_id, value: one JSON transcript of a medium's chunks, with where they begin under _metadata.

    results: media_id, chunk_idx, start_us, file, text, language. segments: media_id, chunk_idx, seg_idx, start_us,
    end_us, text, on the medium's timeline. Chunks are in the order of chunk_idx; the language is that of the first one.
    """
    chunk = F.struct("chunk_idx", (F.col("start_us") / 1e6).alias("start_offset"), F.col("file").alias("transcript_file"), "text")
    heads = results.groupBy("media_id").agg(F.sort_array(F.collect_list(chunk)).alias("c"), F.min_by("language", "chunk_idx").alias("language"))
    item = F.struct("chunk_idx", "seg_idx", "start_us", "end_us", "text")
    held = segments.groupBy("media_id").agg(F.sort_array(F.collect_list(item)).alias("s"))
    bounds = F.transform("c", lambda x: F.struct(x["chunk_idx"].alias("index"), x["start_offset"], x["transcript_file"]))
    about = F.struct(F.lit(True).alias("is_presplit"), F.size("c").alias("num_segments"), bounds.alias("segment_boundaries"))
    listed = F.transform(F.coalesce("s", F.expr("cast(array() AS ARRAY<STRUCT<chunk_idx: BIGINT, seg_idx: BIGINT, start_us: BIGINT, end_us: BIGINT, text: STRING>>)")), lambda x: _seconds(x, "text"))
    document = F.struct(F.array_join("c.text", " ").alias("text"), listed.alias("segments"), "language", about.alias("_metadata"))
    return heads.join(held, "media_id", "left").select("media_id", F.to_json(document).alias("value"))


_CHUNKS = "ARRAY<STRUCT<index: BIGINT, start: DOUBLE, end: DOUBLE, file: STRING>>"


def chunk_list_json(chunks: DataFrame) -> DataFrame:
    """media_id, value: the chunks (chunk_idx, start_us, end_us, file) of each medium as a chunk list."""
    item = F.struct(F.col("chunk_idx").alias("index"), (F.col("start_us") / 1e6).alias("start"), (F.col("end_us") / 1e6).alias("end"), "file")
    held = chunks.groupBy("media_id").agg(F.sort_array(F.collect_list(item)).alias("segments"))
    return held.select("media_id", F.to_json(F.struct(F.lit("1.0").alias("version"), "segments")).alias("value"))


def chunk_lists(texts: DataFrame) -> DataFrame:
    """media_id, segments of chunk lists: null where the text is missing or isn't a JSON object, empty where it has none."""
    document = F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.try_parse_json("value")).isNotNull()
    found = F.from_json("value", f"segments {_CHUNKS}")["segments"]
    return texts.select("media_id", F.when(document, F.coalesce(found, F.expr(f"cast(array() AS {_CHUNKS})"))).alias("segments"))


def keep_ranges(texts: DataFrame, totals: DataFrame) -> DataFrame:
    """Kept ranges of range files: keep_ranges as they are, else the complement of delete_ranges; a bare list is kept ranges."""
    d = F.from_json("value", f"keep_ranges {_RANGE}, delete_ranges {_RANGE}")
    bare = F.from_json("value", _RANGE)
    df = texts.withColumn("keep", F.coalesce(F.when(F.startswith(F.ltrim("value"), F.lit("[")), bare), d["keep_ranges"])).withColumn("cut", d["delete_ranges"])

    def flat(c: str):
        one = df.select("media_id", F.explode(c).alias("r")) if c == "keep" else df.filter("keep IS NULL AND cut IS NOT NULL").select("media_id", F.explode(c).alias("r"))
        return one.select("media_id", F.rint(F.col("r.start") * 1e6).cast("long").alias("start_us"), F.rint(F.col("r.end") * 1e6).cast("long").alias("end_us"))

    cut_media = df.filter("keep IS NULL AND cut IS NOT NULL").select("media_id")
    return flat("keep").unionByName(iv.complement(flat("cut"), totals.join(cut_media, "media_id", "left_semi")))


def range_files(texts: DataFrame, prefer: str = "keep") -> DataFrame:
    """media_id, start_us, end_us of range files (media_id, value), as kept or as deleted ranges.

    An object gives its preferred list as it is; without it, what its deleted (or else kept) ranges leave of its
    total_duration. A bare list is kept ranges: it is given as it is, or what it leaves up to its largest end. Anything
    else is an error. Ranges that end where they start or earlier are left out.
    """
    if prefer not in ("keep", "delete"):
        raise ValueError("prefer is keep or delete")
    held = F.from_json("value", f"total_duration DOUBLE, keep_ranges {_RANGE}, delete_ranges {_RANGE}")
    listed = F.startswith(F.ltrim("value"), F.lit("["))
    df = texts.select("media_id", F.when(listed, F.from_json("value", _RANGE)).alias("bare"), F.when(~listed, held).alias("d"), "value")
    own, keep, cut = F.col(f"d.{prefer}_ranges"), F.col("d.keep_ranges"), F.col("d.delete_ranges")
    unknown = F.raise_error(F.concat(F.lit("unsupported range file: "), F.col("media_id").cast("string"))).cast(_RANGE)
    df = df.select(
        "media_id", F.coalesce("bare", own, cut, keep, unknown).alias("ranges"), (F.lit(prefer == "delete") & F.col("bare").isNotNull() | F.col("bare").isNull() & own.isNull()).alias("rest"),
        F.coalesce(F.array_max(F.transform("bare", lambda x: x["end"])), F.col("d.total_duration"), F.lit(0.0)).alias("total"),
    )
    each = df.select("media_id", "rest", F.explode("ranges").alias("r"))
    each = each.select("media_id", "rest", *(F.rint(F.col(f"r.{a}") * 1e6).cast("long").alias(f"{a}_us") for a in ("start", "end"))).filter("end_us > start_us")
    totals = df.filter("rest").select("media_id", F.rint(F.col("total") * 1e6).cast("long").alias("total_us"))
    return each.filter("NOT rest").drop("rest").unionByName(iv.complement(each.filter("rest").drop("rest"), totals))


_SILENCE = "ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, duration: DOUBLE, gap_before: DOUBLE, gap_after: DOUBLE, motion_score: DOUBLE, frame_count: BIGINT, classification: STRING>>"


def silence_report(media: DataFrame, candidates: DataFrame, min_duration: float = 1.2, fps: float = 2.0, scale: int = 160) -> DataFrame:
    """media_id, value: a report of the silence candidates of each medium (media_id, media_path) with the parameters they were looked for with.

    motion_score and frames are columns of the candidates where they have been measured.
    """
    seconds = {"start": F.col("start_us"), "end": F.col("end_us"), "duration": F.col("end_us") - F.col("start_us"), "gap_before": F.col("gap_before_us"), "gap_after": F.col("gap_after_us")}
    motion = F.round("motion_score", 4) if "motion_score" in candidates.columns else F.lit(None).cast("double")
    frames = F.col("frames") if "frames" in candidates.columns else F.lit(0)
    more = [motion.alias("motion_score"), frames.cast("long").alias("frame_count"), motion_class(motion).alias("classification")]
    held = candidates.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct(*((c / 1e6).alias(n) for n, c in seconds.items()), *more))).alias("found"))
    df = media.join(held, "media_id", "left")
    listed = F.coalesce("found", F.expr(f"cast(array() AS {_SILENCE})"))
    report = F.struct("media_path", F.lit(min_duration).alias("min_duration"), F.lit(fps).alias("fps"), F.lit(scale).alias("scale"), listed.alias("candidates"))
    return df.select("media_id", F.to_json(report, {"ignoreNullFields": "false"}).alias("value"))


def read_silence_report(texts: DataFrame) -> DataFrame:
    """media_id, min_duration, classification, and start_us, end_us, gap_before_us, gap_after_us of reported candidates."""
    d = F.from_json("value", f"min_duration DOUBLE, candidates {_SILENCE}")
    each = texts.select("media_id", d.alias("d")).select("media_id", "d.min_duration", F.explode("d.candidates").alias("c"))
    return each.select("media_id", "min_duration", "c.classification", *(F.rint(F.col(f"c.{n}") * 1e6).cast("long").alias(f"{n}_us") for n in ("start", "end", "gap_before", "gap_after")))


def plan_json(totals: DataFrame, deletes: DataFrame, keeps: DataFrame) -> DataFrame:
    """media_id, value: a plan of total_duration, delete_ranges and keep_ranges in seconds."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        item = F.struct((F.col("start_us") / 1e6).alias("start"), (F.col("end_us") / 1e6).alias("end"))
        return df.groupBy("media_id").agg(F.sort_array(F.collect_list(item)).alias(name))

    none = F.expr(f"cast(array() AS {_RANGE})")
    df = totals.join(listed(deletes, "d"), "media_id", "left").join(listed(keeps, "k"), "media_id", "left")
    return df.select("media_id", F.to_json(F.struct((F.col("total_us") / 1e6).alias("total_duration"), F.coalesce("d", none).alias("delete_ranges"), F.coalesce("k", none).alias("keep_ranges"))).alias("value"))


def clip_manifest(lines: DataFrame, totals: DataFrame, rate: int = 16_000) -> DataFrame:
    """Sample slices and file names of the lines that have text and a duration."""
    kept = lines.filter((F.btrim("text") != "") & (F.col("end_us") > F.col("start_us"))).join(totals, "media_id")
    a = F.greatest(F.lit(0), F.floor(F.col("start_us") * rate / 1_000_000))
    b = F.least(F.floor(F.col("total_us") * rate / 1_000_000), F.floor(F.col("end_us") * rate / 1_000_000))
    name = F.format_string("%08d-%08d.wav", F.floor(F.col("start_us") / 1000), F.floor(F.col("end_us") / 1000))
    return kept.select("media_id", "line_idx", a.alias("from_sample"), b.alias("to_sample"), name.alias("file")).filter("to_sample > from_sample")


#: Samples that leave a task at once.
SLICE = 100_000


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_idx, v of raw little-endian float32 files; trailing bytes are dropped. Samples leave a task in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples = np.frombuffer(content, "<f4", len(content) // 4)
                for at in range(0, len(samples), SLICE):
                    v = samples[at : at + SLICE].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(np.arange(at, at + len(v))), pa.array(v)], ["path", "sample_idx", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sample_idx long, v double")


def find_media(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, bytes of media files, by suffix; contents aren't read."""
    from timespan.functions.text import suffix_kind

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", suffix_kind(F.col("path")).alias("kind"), F.col("length").alias("bytes")).filter("kind IS NOT NULL")


def check_artefacts(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """status of each expected file: missing, pointer (a placeholder of large-file storage), differs or ok."""
    sha = files.select("name", F.sha2("content", 256).alias("sha"), F.startswith(F.substring(F.col("content").cast("string"), 1, 40), F.lit("version https://git-lfs")).alias("pointer"))
    status = F.when(F.col("sha").isNull(), "missing").when(F.col("pointer"), "pointer").when(F.col("sha") != F.col("sha256"), "differs").otherwise("ok")
    return manifest.join(sha, "name", "left").select("name", status.alias("status"))
