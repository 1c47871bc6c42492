"""Ingest of files with a log of each item's status: pending, running, done or failed.

Every batch runs what is new, pending or failed. A stopped item is pending again, with what it was stopped by as its
message. A batch's rows replace those that the same batch has written before, so one that comes again counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timespan.functions.text import INGEST_SUFFIXES, suffix_kind

LOG = "item string, status string, message string, step int, batch long"
PENDING, RUNNING, DONE, FAILED = "pending", "running", "done", "failed"


def media_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """item, kind, bytes, modified of media files as they appear below path. Contents aren't read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    taken = files.filter(suffix.isin(*INGEST_SUFFIXES))
    return taken.select(F.col("path").alias("item"), suffix_kind(F.col("path")).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def statuses(spark: SparkSession, log_path: str, before: int | None = None) -> DataFrame:
    """item, status, message, batch: the last row of each item, of batches below `before` if that is given."""
    try:
        log = spark.read.schema(LOG).parquet(log_path)
    except AnalysisException as e:  # there is none before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log = spark.createDataFrame([], LOG)
    log = log if before is None else log.filter(F.col("batch") < before)
    last = F.struct("batch", "step")
    return log.groupBy("item").agg(F.max_by("status", last).alias("status"), F.max_by("message", last).alias("message"), F.max("batch").alias("batch"))


def _message(error: Exception) -> str:
    return (str(error).strip().splitlines() or [type(error).__name__])[0]


def ingest(work: Callable[[DataFrame], DataFrame], log_path: str, stopped: Callable[[SparkSession], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over items (item): runs work on what is to be done and logs it.

    work gets item and returns item, result and, if it likes, error; it should turn what goes wrong with an item into its
    error. An empty or null result is a failure with a message. If work itself fails, all items of the batch have failed
    with its message and the stream goes on; if the log can't be written, the batch fails and comes again. stopped gives
    the items (item, and reason if it likes) that a user has stopped; they aren't run.
    """

    def batch(items: DataFrame, number: int) -> None:
        spark, target = items.sparkSession, f"{log_path}/batch={number}"
        known = statuses(spark, log_path, number)
        again = known.filter(F.col("status").isin(PENDING, FAILED, RUNNING)).select("item")
        todo = items.select("item").unionByName(again).distinct().join(known.filter(F.col("status") == DONE).select("item"), "item", "left_anti")
        todo = todo.checkpoint(eager=True)  # the log that it comes from is written below
        off = todo.sparkSession.createDataFrame([], "item string, reason string")
        if stopped is not None:
            named = stopped(spark)
            reason = F.col("reason") if "reason" in named.columns else F.lit("stopped")
            off = todo.join(named.select("item", reason.alias("reason")).dropDuplicates(["item"]), "item").checkpoint(eager=True)
        runs = todo.join(off.select("item"), "item", "left_anti")
        none = F.lit(None).cast("string")
        begun = runs.select("item", F.lit(RUNNING).alias("status"), none.alias("message")).unionByName(off.select("item", F.lit(PENDING).alias("status"), F.col("reason").alias("message")))
        begun.withColumn("step", F.lit(0)).write.mode("overwrite").parquet(target)
        try:
            found = work(runs)
            found = found.select("item", "result", (F.col("error") if "error" in found.columns else none).alias("error")).checkpoint(eager=True)
        except Exception as e:  # whatever the caller's work raises
            ended = runs.select("item", F.lit(FAILED).alias("status"), F.lit(_message(e)).alias("message"))
        else:
            ok = F.coalesce(F.length("result"), F.lit(0)) > 0
            ended = runs.join(found, "item", "left")
            ended = ended.select("item", F.when(ok, DONE).otherwise(FAILED).alias("status"), F.when(~ok, F.coalesce("error", F.lit("empty result"))).alias("message"))
        ended.withColumn("step", F.lit(1)).write.mode("append").parquet(target)

    return batch
