"""Sharding (operator 13): jump consistent hashing (Lamping and Veach, 2014).

A row's shard follows from its key and the number of shards by arithmetic; there is no table of ring positions. The key
seeds a linear congruential generator, whose draws say at which numbers of shards the key jumps into the newest one, so
with one more shard a key either stays or goes into that one, and one key of n + 1 does.

Rows aren't moved to find their shards. Their places within a shard come from ranges of (shard, doc_id), so a shard with
many rows, or a doc_id with a third of all rows, is numbered by many tasks.

Defined results: a null doc_id counts as key 0; a null or empty text has size 1; repeated rows share a shard and have
places of their own; places follow doc_id (null first), check sum and size; an empty table gives none; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timespan.llm.common import crc32_sql, partitions, ranked, stored, table, utf8

SHARDS = 8
#: Multiplier of the generator. Fixed value.
MULTIPLIER = 2_862_933_555_777_941_757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state, at, reached = keys.astype(np.int64).view(np.uint64).copy(), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    while len(going):  # about log(shards) rounds
        at[going] = reached[going]
        state[going] = state[going] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1
        reached[going] = ((at[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        going = going[reached[going] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key (null counts as 0). For keys of other types, pass a 64-bit hash of them."""

    @F.pandas_udf("int")
    def own(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards))

    return own(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def moves(keys: DataFrame, shards: int, grown: int) -> DataFrame:
    """key, from_shard, to_shard of the keys (one column) that another number of shards moves."""
    own = keys.toDF("key").withColumns({"from_shard": shard_of(F.col("key"), shards), "to_shard": shard_of(F.col("key"), grown)})
    return own.filter("from_shard <> to_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """docs with all their columns below path, a folder shard=k each; a shard is written by several tasks."""
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, -(-partitions(docs.sparkSession) // shards))))
    placed = docs.withColumn("shard", shard_of(F.col("doc_id"), shards))
    placed.repartition(partitions(docs.sparkSession), "shard", spread).write.mode("overwrite").partitionBy("shard").parquet(path)


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (with one more), slot: one row per document."""
    text = utf8()
    own = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    own = own.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)})
    return ranked(own, ["shard"], ["doc_id", "text_crc32", "size"]).withColumnRenamed("rank", "slot")


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _jump_sql(shards: int) -> str:
    """The jumps of a key unrolled: each goes at least one shard further, so `shards` of them are enough."""
    return f"""SELECT k, max(b) AS shard FROM (WITH RECURSIVE j AS (SELECT DISTINCT k, k AS s, -1::BIGINT AS b, 0::BIGINT AS nxt FROM keyed
UNION ALL SELECT k, n, nxt, floor((nxt + 1) * (2147483648.0::DOUBLE / ((n // 8589934592) + 1)::DOUBLE))::BIGINT FROM (SELECT k, nxt, (s::UHUGEINT * {MULTIPLIER} + 1) % 18446744073709551616::UHUGEINT AS n FROM j WHERE nxt < {shards})) SELECT * FROM j) GROUP BY k"""


ORACLE_SQL = f"""WITH {crc32_sql("documents", "coalesce(text, '')", "doc_id, strlen(coalesce(text, '')) + 1 AS size")},
keyed AS (SELECT *, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)::UHUGEINT AS k FROM crcs),
small AS ({_jump_sql(SHARDS)}), large AS ({_jump_sql(SHARDS + 1)})
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, small.shard, row_number() OVER (PARTITION BY small.shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot, large.shard AS grown_shard
FROM keyed JOIN small USING (k) JOIN large USING (k)"""
