"""Progress of tasks that never goes back: a stream of the largest progress, written so that a batch can come again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a task of a kind shows at progress 0, what it gains up to 1, and what it shows at most. Fixed values.
SCALES = {"transcribe": (0.0, 1.0, 0.95), "cut": (0.1, 0.75, 0.9)}
SHOWN = "task_id long, progress double, status string, seq long"


def shown(kind: Column, progress: Column) -> Column:
    """The progress that a task of a kind shows."""
    inside = F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0))
    out = F.lit(None).cast("double")
    for name, (base, gain, most) in SCALES.items():
        out = F.when(kind == name, F.least(F.lit(most), F.lit(base) + F.lit(gain) * inside)).otherwise(out)
    return out


def progress_stream(events: DataFrame) -> DataFrame:
    """task_id, progress (the largest shown), status and seq (the last ones) of events (task_id, kind, progress, status, seq), for update mode."""
    return events.groupBy("task_id").agg(F.max(shown(F.col("kind"), F.col("progress"))).alias("progress"), F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def upsert(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what a batch changes is its own folder, which the same batch replaces when it comes again."""

    def batch(changed: DataFrame, number: int) -> None:
        changed.select("task_id", "progress", "status", "seq").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return batch


def current(spark: SparkSession, path: str) -> DataFrame:
    """task_id, progress, status, seq as they are now: no batch can lower a progress or bring back an earlier status."""
    rows = spark.read.schema(f"{SHOWN}, batch long").parquet(path)
    return rows.groupBy("task_id").agg(F.max("progress").alias("progress"), F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def compact(spark: SparkSession, path: str, into: str) -> None:
    """The current rows as batch -1 of another folder, from which a stream with a fresh checkpoint goes on."""
    current(spark, path).write.mode("overwrite").parquet(f"{into}/batch=-1")
