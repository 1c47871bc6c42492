"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lower-cases A-Z in UTF-8 bytes; other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Keeps 0-9, a-z and every byte of a non-ASCII character, lower-cases A-Z, and turns the rest to spaces.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only where that is unset, as in tests, one of our own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        named = named or tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, so that lost executors and reuse don't compute it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: str = "text"):
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def signed(n: int) -> int:
    """A 64-bit hash as Spark's long."""
    return n - (1 << 64) if n >> 63 else n


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. To keep those of words seen before is slower than to hash again, and takes memory."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values and their counts."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(first, append=len(values))


def single_thread() -> None:
    """Libraries in a Python worker keep to the one core that Spark gave its task."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def freed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives memory it has no more use for back after each batch: workers outlive tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        for out in task(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
            if trim:
                trim(0)

    return run


#: Bytes of the Arrow batches in which rows go to Python tasks where memory is short.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_BYTES at most (a larger row is one by itself): each is held by the JVM and by the task at the same time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Rows of a few narrow columns (64 bytes at most) up to which a side is broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A stored table with a broadcast hint if it has at most `rows` rows; beyond that it is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, rejected: DataFrame, content) -> DataFrame:
    """docs without the rows whose doc_id and content (a column of docs) are in rejected(doc_id, content). Columns can have any names."""
    gone = small(stored(rejected.distinct().toDF("gone_id", "gone_content")))
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own_id"), content.alias("own_content"))
    return keyed.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_content") == F.col("gone_content")), "left_anti").select("doc.*")


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Stored, narrow rows with `rank`, their place from 0 in their group in the given order (nulls first).

    Rows are dealt by ranges of group and order, so a group with a third of all rows goes to many tasks; equal rows are
    dealt by a hash of their place. Each task numbers its rows, and the counts of tasks before it are added.
    """
    keys = [*by, *order, "tie"]
    dealt = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id())).withColumn("task", F.shiftright("at", 33))
    sizes = dealt.groupBy("task", *by).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # tasks and groups in all
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("task")) - F.col("n")
    shifts = small(stored(sizes.select(F.col("task").alias("its"), *(F.col(c).alias(f"its_{c}") for c in by), (before - F.col("first")).alias("shift"))))
    same: Column = F.col("task") == F.col("its")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"its_{c}"))
    return dealt.join(shifts, same).select(*rows.columns, (F.col("at") + F.col("shift")).alias("rank"))


def crc32_sql(rows: str, value: str, keep: str) -> str:
    """DuckDB expressions crc_entries and crcs: the columns `keep` of rows, and crc, the unsigned crc32 of value in UTF-8."""
    return f"""crc_entries AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
crcs AS (SELECT {keep}, xor(list_reduce(list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295)::BIGINT AS crc
FROM {rows}, crc_entries)"""
