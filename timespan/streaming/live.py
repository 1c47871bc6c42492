"""Live speech segmentation as a Structured Streaming job, with its batch twin, and refreshed results.

A chunk with speech is buffered. A silent chunk is buffered too if the buffer holds something; the buffer is flushed
as an utterance after `silence` silent chunks, or when it has `cap` chunks at a silent one. Unbroken speech is never
cut (hard_cap cuts it), and what is buffered at the end stays unflushed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timespan.streaming.state import IdleProcessor, by_stream

CHUNK, RATE = 512, 16_000
UTTERANCE = "stream_id long, first_chunk long, chunks long, seconds long"
STATE = "first long, buffered long, silent long"


def _step(state: tuple[int, int, int], chunk: int, prob: float, silence: int, cap: int, hard_cap: bool) -> tuple[tuple[int, int, int], tuple[int, int] | None]:
    """The state after a chunk, and the (first chunk, chunks) of an utterance that it ends."""
    first, buffered, silent = state
    spoken = prob >= 0.5
    if not spoken and not buffered:
        return state, None
    first, buffered, silent = first if buffered else chunk, buffered + 1, 0 if spoken else silent + 1
    if (not spoken and (silent >= silence or buffered >= cap)) or (hard_cap and buffered >= cap):
        return (0, 0, 0), (first, buffered)
    return (first, buffered, silent), None


def _rows(key: int, found: list[tuple[int, int]]) -> pd.DataFrame:
    seconds = [max(1, n * CHUNK // RATE) for _, n in found]
    return pd.DataFrame({"stream_id": [key] * len(found), "first_chunk": [a for a, _ in found], "chunks": [n for _, n in found], "seconds": seconds}).astype("int64")


def utterances(vad: DataFrame, silence: int = 25, cap: int = 600, hard_cap: bool = False) -> DataFrame:
    """Utterances of whole streams (stream_id, chunk_idx, prob)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, found = (0, 0, 0), []
        for chunk, prob in pdf.sort_values("chunk_idx")[["chunk_idx", "prob"]].itertuples(index=False):
            state, out = _step(state, int(chunk), float(prob), silence, cap, hard_cap)
            found += [out] if out else []
        return _rows(int(pdf["stream_id"].iloc[0]), found)

    return vad.select("stream_id", "chunk_idx", "prob").groupBy("stream_id").applyInPandas(run, UTTERANCE)


def _listen(silence: int, cap: int, hard_cap: bool):
    def step(key: Any, state: tuple | None, pdf: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame]:
        now, found = state or (0, 0, 0), []
        for chunk, prob in pdf[["chunk_idx", "prob"]].itertuples(index=False):
            now, out = _step(now, int(chunk), float(prob), silence, cap, hard_cap)
            found += [out] if out else []
        return now if now[1] else None, _rows(int(key), found)

    return step


def utterance_stream(vad: DataFrame, silence: int = 25, cap: int = 600, hard_cap: bool = False, delay: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Utterances of a stream (stream_id, chunk_idx, event_time, prob) as they end.

    Chunks of a stream come in order from batch to batch; within one they are sorted. A stream has state only while
    something is buffered, and loses it when the watermark is idle_ms beyond its last chunk: its tail is never flushed.
    """
    rows = vad.select("stream_id", "chunk_idx", "event_time", "prob")
    return by_stream(rows, IdleProcessor(_listen(silence, cap, hard_cap), STATE, "chunk_idx", idle_ms), UTTERANCE, delay)


def refreshed(wanted: DataFrame, stored: DataFrame, compute: Callable[[DataFrame], DataFrame], refresh: bool = False) -> DataFrame:
    """Stored results of the wanted projects, and computed ones with the next version where there is none (or for all, with refresh)."""
    top = stored.groupBy("project_id").agg(F.max("version").alias("version"), F.max_by("payload", "version").alias("payload"))
    missing = wanted.select("project_id") if refresh else wanted.select("project_id").join(top, "project_id", "left_anti")
    new = compute(missing).join(top.select("project_id", F.col("version").alias("v")), "project_id", "left")
    new = new.select("project_id", (F.coalesce("v", F.lit(0)) + 1).alias("version"), "payload")
    return new if refresh else new.unionByName(top.join(wanted.select("project_id"), "project_id", "left_semi"))
