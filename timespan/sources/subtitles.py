"""Subtitle readers and writers: SRT, speaker-prefixed SRT, VTT and plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timespan.functions.clock import clock, parse_clock
from timespan.functions.text import strip

_TIMES = r"^(\d{2}:\d{2}:\d{2},\d{3})\s+-->\s+(\d{2}:\d{2}:\d{2},\d{3})(\s+.*)?$"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, value: a row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def parse_srt(texts: DataFrame, key: str = "path") -> DataFrame:
    """Segments of SRT texts. Blocks without a time line are dropped; a leading number line is skipped."""
    blocks = texts.select(key, F.posexplode(F.split(strip(F.col("value")), r"\r?\n\r?\n")).alias("block", "b"))
    lines = F.filter(F.split("b", r"\r?\n"), lambda x: strip(x) != "")
    df = blocks.withColumn("lines", lines).filter(F.size("lines") > 0)
    skip = F.regexp_like(F.col("lines")[0], F.lit(r"^\d+$")).cast("int")
    df = df.withColumn("times", F.get("lines", skip)).withColumn("rest", F.slice("lines", skip + 2, F.size("lines")))
    df = df.filter(F.regexp_like("times", F.lit(_TIMES)))
    start, end = (parse_clock(F.regexp_extract("times", _TIMES, k)) for k in (1, 2))
    return df.select(key, "block", start.alias("start_us"), end.alias("end_us"), strip(F.array_join("rest", "\n")).alias("text"))


def parse_speaker_srt(texts: DataFrame, key: str = "path") -> DataFrame:
    """Lines with the speaker split off; blocks need a number, a time and a text line, whose lines are joined by spaces."""
    blocks = texts.select(key, F.posexplode(F.split(strip(F.col("value")), r"\n\s*\n")).alias("block", "b")).withColumn("lines", F.split(strip(F.col("b")), "\n")).filter(F.size("lines") >= 3)
    pattern = r"^\s*(\d+:\d+:\d+[,.]\d{3})\s*-->\s*(\d+:\d+:\d+[,.]\d{3})"
    df = blocks.filter(F.regexp_like(F.col("lines")[1], F.lit(pattern))).withColumn("t", strip(F.array_join(F.slice("lines", 3, F.size("lines")), " ")))
    who = F.regexp_extract("t", r"^(說話者\d+|Speaker\s*\d+)：(.+)$", 1)
    return df.select(
        key, "block", parse_clock(F.regexp_extract(F.col("lines")[1], pattern, 1)).alias("start_us"), parse_clock(F.regexp_extract(F.col("lines")[1], pattern, 2)).alias("end_us"),
        F.when(who != "", who).alias("speaker"), F.when(who != "", F.regexp_extract("t", r"^(說話者\d+|Speaker\s*\d+)：(.+)$", 2)).otherwise(F.col("t")).alias("text"),
    )


def _body(lines: DataFrame, text, numbered: bool, mark: str, head: str) -> DataFrame:
    times = F.concat(clock(F.col("start_us"), mark), F.lit(" --> "), clock(F.col("end_us"), mark))
    ordered = F.sort_array(F.collect_list(F.struct("line_idx", times.alias("times"), text.alias("text"))))
    first = (lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"))) if numbered else (lambda x, i: F.lit(""))
    blocks = F.transform(ordered, lambda x, i: F.concat(first(x, i), x["times"], F.lit("\n"), x["text"], F.lit("\n")))
    body = F.regexp_replace(F.concat(F.lit(head), F.array_join(blocks, "\n")), r"\s+$", "")
    return lines.groupBy("media_id").agg(F.concat(body, F.lit("\n")).alias("value"))


def to_srt(lines: DataFrame) -> DataFrame:
    """media_id, value: an SRT text per medium, from lines (line_idx, start_us, end_us, text)."""
    return _body(lines, F.col("text"), True, ",", "")


def to_vtt(lines: DataFrame) -> DataFrame:
    return _body(lines, F.col("text"), False, ".", "WEBVTT\n\n")


def to_speaker_srt(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """SRT with the speakers' names before the texts; a speaker without a name keeps its id."""
    if names is not None:
        lines = lines.join(names.select("media_id", "speaker", "name"), ["media_id", "speaker"], "left").withColumn("speaker", F.coalesce("name", "speaker"))
    return _body(lines, F.when(F.coalesce("speaker", F.lit("")) != "", F.concat_ws("：", "speaker", "text")).otherwise(F.col("text")), True, ",", "")


def to_plain(lines: DataFrame) -> DataFrame:
    text = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat_ws("：", "speaker", "text")).otherwise(F.col("text"))
    kept = lines.filter(strip(F.col("text")) != "")
    ordered = F.sort_array(F.collect_list(F.struct("line_idx", text.alias("t"))))
    return kept.groupBy("media_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("value"))


def write_texts(texts: DataFrame, path: str) -> None:
    """A folder per medium with its text."""
    texts.select("media_id", "value").write.partitionBy("media_id").mode("overwrite").text(path)
