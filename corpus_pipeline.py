"""A corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the stage before wrote. All but the last
keep the columns of documents. A stage's decisions: documents that the quality rules reject go,
and the others lose the lines above the limits; of documents that are linked by five-word shingles at a similarity of
0.8 or more, that with the smallest doc_id stays; contaminated documents go; secrets are masked in the texts; what is
left is packed into sequences.

Null and empty texts are rejected by the quality rules; repeated rows are one document, of which one row stays; null
doc_ids come last in the choice of which row stays; an empty table gives an empty result; other columns are carried
through all stages but the last, whatever their names.

The stages run one after another in the same executors and Python workers, so rows go to Python in small Arrow batches
(a session setting, which the stages set) and workers give back memory after each batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timespan.llm.common import shared_dir, small_batches, table, utf8, without
from timespan.llm.decontamination import decontaminate
from timespan.llm.ngram_jaccard import one_of_each_group
from timespan.llm.packing import best_fit_packing
from timespan.llm.quality_rules import clean
from timespan.llm.secret_scans import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, judged.filter("contaminated").select("doc_id", F.col("key").alias("content")), F.xxhash64(utf8()))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]

#: Tokenising and the masks of merged spans have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
