"""Parsers of tool outputs: keyframe probes, silences, probes, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyframes_from_frames(texts: DataFrame) -> DataFrame:
    """t_us of the key frames of a probe's JSON; texts that can't be read give none."""
    frame = "frames ARRAY<STRUCT<key_frame: STRING, pkt_pts_time: STRING, best_effort_timestamp_time: STRING>>"
    f = texts.select("media_id", F.explode(F.from_json("value", frame)["frames"]).alias("f")).filter(F.col("f.key_frame").try_cast("int") == 1)
    t = F.coalesce(F.col("f.pkt_pts_time").try_cast("double"), F.col("f.best_effort_timestamp_time").try_cast("double"))
    return f.select("media_id", F.rint(F.greatest(t, F.lit(0.0)) * 1e6).cast("long").alias("t_us")).filter("t_us IS NOT NULL")


def keyframes_from_packets(lines: DataFrame) -> DataFrame:
    """t_us of packets whose flags have K, from lines 'pts_time,flags'."""
    part = F.split("value", ",")
    return lines.filter(F.contains(part[1], F.lit("K")) & (part[0] != "N/A")).select("media_id", F.rint(part[0].try_cast("double") * 1e6).cast("long").alias("t_us")).filter("t_us IS NOT NULL")


def silences_from_log(lines: DataFrame) -> DataFrame:
    """Each silence_end with the latest silence_start that has no end yet."""
    number = r"([-0-9.eE+]+)"
    start, end = (F.regexp_extract("value", rf"silence_{k}:\s*{number}", 1).try_cast("double") for k in ("start", "end"))
    w = Window.partitionBy("media_id").orderBy("line_no")
    df = lines.withColumn("s", start).withColumn("e", end).filter("s IS NOT NULL OR e IS NOT NULL").withColumn("before", F.lag("s").over(w))
    return df.filter("e IS NOT NULL AND before IS NOT NULL").select("media_id", F.rint(F.col("before") * 1e6).cast("long").alias("start_us"), F.rint(F.col("e") * 1e6).cast("long").alias("end_us"))


def probe(lines: DataFrame) -> DataFrame:
    """duration_us and the kinds of streams of each medium."""
    d = [F.regexp_extract("value", r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", k).try_cast("double") for k in (1, 2, 3)]
    us = F.rint((d[0] * 3600 + d[1] * 60 + d[2]) * 1e6).cast("long")
    kind = F.regexp_extract("value", r"Stream #.*?:\s*(Video|Audio)", 1)
    return lines.groupBy("media_id").agg(F.max(us).alias("duration_us"), F.bool_or(kind == "Video").alias("has_video"), F.bool_or(kind == "Audio").alias("has_audio"))


def progress(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """The share of the duration that each 'time=' line reports, in [0, 1]."""
    t = [F.regexp_extract("value", r"time=(\d+):(\d+):(\d+(?:\.\d+)?)", k).try_cast("double") for k in (1, 2, 3)]
    df = lines.withColumn("us", (t[0] * 3600 + t[1] * 60 + t[2]) * 1e6).filter("us IS NOT NULL").join(durations, "media_id")
    return df.select("media_id", "line_no", F.least(F.greatest(F.col("us") / F.col("duration_us"), F.lit(0.0)), F.lit(1.0)).alias("progress"))


def frame_rate(c):
    return F.when(F.btrim(c).isin("", "0", "0/0"), None).otherwise(F.btrim(c))


def word_list(lines: DataFrame, comments: bool = True) -> DataFrame:
    """Distinct words of a list; lines that start with # are comments if `comments`."""
    t = F.btrim("value")
    kept = lines.filter((t != "") & (~F.startswith(t, F.lit("#")) if comments else F.lit(True)))
    return kept.select(F.explode(F.split(t, r"[\s,，；;、]+")).alias("word")).filter("word <> ''").distinct()
