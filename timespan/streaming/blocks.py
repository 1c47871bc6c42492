"""Blocks of samples in a stream: mixed to one channel, resampled block by block, or without seams."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timespan.streaming.state import IdleProcessor, by_stream

SAMPLE = "stream_id long, sample_idx long, v double"


def mixed(channels: Column) -> Column:
    """The mean of the channels (array<array<double>>) at each sample."""
    n = F.size(channels)
    return F.transform(F.get(channels, F.lit(0)), lambda x, i: F.aggregate(channels, F.lit(0.0), lambda s, c: s + F.get(c, i)) / n)


def resampled_block(samples: Column, src: int, dst: int) -> Column:
    """A block by itself at another rate: n * dst / src places from its first sample to its last, linear between samples."""
    n = F.size(samples)
    m = F.floor(n * dst / src).cast("int")

    def at(k: Column) -> Column:
        pos = F.when(m > 1, k * (n - 1) / (m - 1)).otherwise(F.lit(0.0))
        low = F.floor(pos).cast("int")
        a, b = F.get(samples, low), F.get(samples, F.least(low + 1, n - 1))
        return a + (b - a) * (pos - low)

    return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.expr("cast(array() AS array<double>)"))


def preprocess_stream(blocks: DataFrame, src: int = 16_000, dst: int = 16_000) -> DataFrame:
    """Blocks of channels (block_id, channels) as mono samples of the wanted rate; stateless, so it runs on streams and tables."""
    mono = mixed(F.col("channels"))
    return blocks.select("block_id", (mono if src == dst else resampled_block(mono, src, dst)).alias("mono"))


def _resample(src: int, dst: int):
    """Sample k of the result stands at k * src / dst. The state: samples seen, the last of them, and samples given."""

    def step(key: Any, state: tuple | None, pdf: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame]:
        seen, last, given = state or (0, 0.0, 0)
        at, values = [], []
        for block in pdf["samples"]:
            if not len(block):
                continue
            own = [last, *map(float, block)]  # own[i] is sample seen - 1 + i
            end = seen + len(block)
            while given * src <= (end - 1) * dst:  # at the last sample at most
                low, part = divmod(given * src, dst)
                a = own[low - seen + 1]
                at.append(given)
                values.append(a + (own[low - seen + 2] - a) * (part / dst) if part else a)
                given += 1
            seen, last = end, own[-1]
        return (seen, last, given), pd.DataFrame({"stream_id": [key] * len(at), "sample_idx": at, "v": values}).astype({"stream_id": "int64", "sample_idx": "int64", "v": "float64"})

    return step


def resampled_stream(blocks: DataFrame, src: int, dst: int, delay: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """A stream's blocks (stream_id, block_idx, event_time, samples) as one signal at another rate, wherever its blocks end.

    The last sample and the place between samples are state from block to block; both go when a stream has been idle.
    """
    rows = blocks.select("stream_id", "block_idx", "event_time", "samples")
    return by_stream(rows, IdleProcessor(_resample(src, dst), "seen long, last double, given long", "block_idx", idle_ms), SAMPLE, delay)


def resampled_signal(samples: DataFrame, src: int, dst: int) -> DataFrame:
    """The same of whole signals (stream_id, sample_idx from 0, v), by joins of places with the samples around them."""
    n = samples.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) * dst / src)))
    places = n.select("stream_id", k.alias("k")).withColumn("low", F.floor(F.col("k") * src / dst)).withColumn("part", F.col("k") * src % dst)
    a, b = (samples.select("stream_id", (F.col("sample_idx") - d).alias("low"), F.col("v").alias(c)) for c, d in (("a", 0), ("b", 1)))
    met = places.join(a, ["stream_id", "low"]).join(b, ["stream_id", "low"], "left")
    v = F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("part") / dst))
    return met.select("stream_id", F.col("k").alias("sample_idx"), v.alias("v"))
