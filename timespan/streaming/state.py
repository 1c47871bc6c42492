"""State of streams that ends: state goes when a key has been idle in event time, and queries that run to the end of what there is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class IdleProcessor(StatefulProcessor):
    """Rows of a key in order with one state row, which goes when it is empty or when no event has come for `idle_ms`.

    step(key, state, rows) gives the next state (None: nothing is to be kept) and the rows that come out.
    """

    def __init__(self, step: Callable[[Any, tuple | None, pd.DataFrame], tuple[tuple | None, pd.DataFrame]], schema: str, order: str, idle_ms: int):
        self.step, self.schema, self.order, self.idle_ms = step, schema, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order)
        state, out = self.step(key[0], tuple(self.held.get()) if self.held.exists() else None, pdf)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.held.clear()
        else:
            self.held.update(state)
            last = int(pd.Timestamp(pdf["event_time"].max()).timestamp() * 1000)
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def by_stream(rows: DataFrame, processor: IdleProcessor, schema: str, delay: str) -> DataFrame:
    """The processor over the rows (stream_id, event_time and more) of each stream. Rows later than `delay` are dropped."""
    return rows.withWatermark("event_time", delay).groupBy("stream_id").transformWithStateInPandas(processor, schema, "append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start here keep their state in the store that timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def drain(df: DataFrame, folder: str) -> None:
    """Runs a stream over all that there is now, from where it was; appends its rows to folder/out and keeps its place in folder/state."""
    with keyed_state(df.sparkSession):
        writer = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
