"""One list of tokens per medium: the words and marks of segment texts, with times, and what pauses become.

Word units of a text take the stamps of the segment's words, other tokens share the time up to the next unit that has
one. That is a fold within a segment. All else are windows: a pause inside a segment lengthens the token before it, is a
mark or a silence by its length; a pause between segments is a mark that belongs to the segment before; a mark that
meets an equal one is joined with it; marks at a segment's head belong to the segment before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timespan.functions import text as tx
from timespan.operators.segmentation import allot_stamps

#: Characters that are marks of a text. Fixed values.
TEXT_MARKS = "，。！？；：,.!?;:、"
COMMA, PERIOD = "，", "。"
SEGMENT = ["media_id", "seg_idx"]
TOKEN = "media_id long, seg_idx long, pos long, kind string, text string, start_us long, end_us long, key string, attached boolean"


def text_tokens(segments: DataFrame) -> DataFrame:
    """media_id, seg_idx, pos, kind (word or punctuation), text of the segments' texts."""
    each = segments.select(*SEGMENT, F.posexplode(tx.tokens(F.col("text"))).alias("pos", "raw"))
    kind = F.when(F.contains(F.lit(TEXT_MARKS), F.col("raw")), "punctuation").otherwise("word")
    return each.select(*SEGMENT, "pos", kind.alias("kind"), tx.wide_punctuation(F.col("raw")).alias("text")).filter("text <> ''")


def filled_stamps(words: DataFrame, least: int = 10_000) -> DataFrame:
    """k, start_us, end_us of each segment's words by time. A missing start is the end before it, a missing end `least` after the start; words before any time are left out."""
    w = Window.partitionBy(*SEGMENT).orderBy("word_idx")
    known = F.coalesce("end_us", F.col("start_us") + least)
    df = words.select(*SEGMENT, "word_idx", "start_us", "end_us", known.alias("known")).withColumn("run", F.count("known").over(w))
    blank = Window.partitionBy(*SEGMENT, "run").orderBy("word_idx")
    df = df.withColumn("to", F.coalesce("known", F.first("known").over(blank) + (F.row_number().over(blank) - 1) * least))
    df = df.withColumn("from", F.coalesce("start_us", F.lag("to").over(w))).filter("`from` IS NOT NULL AND `to` IS NOT NULL")
    k = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("from", "to", "word_idx"))
    return df.select(*SEGMENT, k.alias("k"), F.col("from").alias("start_us"), F.col("to").alias("end_us"))


def _timed(start: int, end: int, given: list[bool], froms: list[int], tos: list[int], weights: list[int], least: int) -> tuple[list[int], list[int], list[int]]:
    """Starts and ends of a segment's tokens, and for tokens with a stamp where the token before them ended."""
    starts, ends, before, at, k = [], [], [], int(start), 0
    while k < len(given):
        if given[k]:
            before.append(at)
            starts.append(max(int(froms[k]), at))
            at = max(int(tos[k]), starts[-1])
            ends.append(at)
            k += 1
            continue
        last = next((j for j in range(k, len(given)) if given[j]), len(given))
        until = max(int(froms[last]), at) if last < len(given) else int(end)
        until = until if until > at else at + (last - k) * least
        share, passed, whole = until - at, 0, sum(weights[k:last])
        for j in range(k, last):
            starts.append(at + share * passed // whole)
            passed += int(weights[j])
            ends.append(at + share * passed // whole)
            before.append(starts[-1])
        at, k = until, last
    return starts, ends, before


def _times(least: int):
    @F.pandas_udf("starts array<long>, ends array<long>, before array<long>")
    def times(start: pd.Series, end: pd.Series, given: pd.Series, froms: pd.Series, tos: pd.Series, weights: pd.Series) -> pd.DataFrame:
        rows = [_timed(*(x.tolist() if hasattr(x, "tolist") else x for x in r), least) for r in zip(start, end, given, froms, tos, weights, strict=True)]
        return pd.DataFrame(rows, columns=["starts", "ends", "before"])

    return times


def _with_times(segments: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """Segments with start_us, end_us, their tokens (null: none), starts, ends and before."""
    tokens = text_tokens(segments)
    stamps = allot_stamps(tokens.filter("kind = 'word'").drop("kind"), filled_stamps(words, least))
    stamped = tokens.join(stamps.select(*SEGMENT, "pos", F.col("start_us").alias("a"), F.col("end_us").alias("b")), [*SEGMENT, "pos"], "left")
    item = F.struct("pos", "kind", "text", F.col("a").isNotNull().alias("given"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    held = stamped.groupBy(*SEGMENT).agg(F.sort_array(F.collect_list(item)).alias("x"))
    df = segments.select(*SEGMENT, "start_us", "end_us").join(held, SEGMENT, "left")
    x = F.coalesce("x", F.expr("cast(array() AS array<struct<pos: int, kind: string, text: string, given: boolean, a: bigint, b: bigint>>)"))
    df = df.withColumn("x", x)
    times = _times(least)("start_us", "end_us", "x.given", "x.a", "x.b", F.transform("x.text", F.length))
    return df.withColumn("t", times).select(*SEGMENT, "start_us", "end_us", "x", "t.*")


def segment_tokens(
    segments: DataFrame, words: DataFrame, near: int = 100, short: int = 600_000, period: int = 1_100_000, silence: int = 1_600_000, least: int = 10_000
) -> DataFrame:
    """TOKEN rows of segments (start_us, end_us, text) and their words: pos is the order within the medium's list.

    kind is word, punctuation or silence. seg_idx is the segment that a token belongs to, which for attached ones is that
    before the one they stand in. Keys are of the times at which a token was made. Tokens without length are left out.
    """
    df = _with_times(segments, words, least)
    order = Window.partitionBy("media_id").orderBy("seg_idx")
    end = F.when(F.size("x") == 0, F.col("end_us")).otherwise(F.greatest(F.element_at("ends", -1), F.when(F.col("end_us") - F.element_at("ends", -1) > near, F.col("end_us"))))
    df = df.withColumn("done", end).withColumn("left_at", F.lag("done").over(order))

    def row(place: Column, kind: Column, text: Column, a: Column, b: Column, made: str) -> Column:
        return F.struct(place.cast("long").alias("place"), kind.alias("kind"), text.alias("text"), a.alias("a"), b.alias("b"), F.lit(made).alias("made"))

    none = F.lit(None).cast("string")
    n = F.size("x")
    own = F.transform(F.sequence(F.lit(0), n - 1), lambda i: row(i * 2 + 2, F.get("x", i)["kind"], F.get("x", i)["text"], F.get("starts", i), F.get("ends", i), "text"))
    gaps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: row(i * 2 + 1, F.lit("gap"), none, F.get("before", i), F.get("starts", i), "inner"))
    first = row(F.lit(0), F.lit("gap"), none, F.col("left_at"), F.col("start_us"), "outer")
    tail = row(n * 2 + 1, F.lit("gap"), none, F.element_at("ends", -1), F.col("end_us"), "inner")
    listed = F.when(n > 0, F.concat(F.array(first), own, gaps, F.array(tail)))
    each = df.select(*SEGMENT, F.explode(listed).alias("r")).select(*SEGMENT, "r.*")
    return _settled(each.filter((F.col("made") == "text") | (F.col("b") - F.col("a") > near)), short, period, silence)


def _settled(rows: DataFrame, short: int, period: int, silence: int) -> DataFrame:
    """Token rows and pauses (kind gap) in order, with pauses made tokens, joined and attached."""
    seg = Window.partitionBy(*SEGMENT)
    w = seg.orderBy("place")
    length, inner = F.col("b") - F.col("a"), F.col("made") == "inner"
    gap = F.when(inner & (length < short), "longer").when(inner & (length >= silence), "silence").otherwise("punctuation")
    df = rows.withColumn("kind", F.when(F.col("kind") == "gap", gap).otherwise(F.col("kind")))
    mark = F.when(length < period, COMMA).otherwise(PERIOD)
    df = df.withColumn("text", F.when((F.col("made") != "text") & (F.col("kind") == "punctuation"), mark).otherwise(F.col("text")))
    serial = F.sum((F.col("kind") == "word").cast("long")).over(w) - 1
    df = df.withColumn("key", F.when(F.col("kind") == "word", F.concat_ws(":", F.col("seg_idx").cast("string"), serial.cast("string"))).otherwise(tx.silence_key("a", "b")))
    follows = F.lead("kind").over(w) == "longer"
    df = df.withColumn("b", F.when(follows, F.greatest("b", F.lead("b").over(w))).otherwise(F.col("b"))).filter("kind <> 'longer'")
    same = (F.col("made") == "inner") & (F.col("kind") == "punctuation") & (F.lag("kind").over(w) == "punctuation") & (F.lag("text").over(w) == F.col("text"))
    meets = same & (F.abs(F.lag("b").over(w) - F.col("a")) < 1000)
    df = df.withColumn("island", F.sum((~F.coalesce(meets, F.lit(False))).cast("int")).over(w))
    df = df.groupBy(*SEGMENT, "island").agg(*(F.min_by(c, "place").alias(c) for c in ("kind", "text", "a", "key", "made")), F.max("b").alias("b"), F.min("place").alias("place"))
    head = F.sum((F.col("kind") != "punctuation").cast("int")).over(w) == 0
    attached = (head & (F.col("seg_idx") > 0)) | (F.col("made") == "outer")
    pos = F.row_number().over(Window.partitionBy("media_id").orderBy("of_seg", "place")) - 1
    df = df.withColumn("attached", attached).withColumnRenamed("seg_idx", "of_seg").filter("b > a")
    return df.select(
        "media_id", F.when(F.col("attached"), F.greatest(F.col("of_seg") - 1, F.lit(0))).otherwise(F.col("of_seg")).alias("seg_idx"), pos.cast("long").alias("pos"),
        "kind", "text", F.col("a").alias("start_us"), F.col("b").alias("end_us"), "key", "attached",
    )
