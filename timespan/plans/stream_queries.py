"""Queries of the streams: batch twins, and streams run in several steps over slices of the given tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timespan import fixtures as fx
from timespan.registry import query
from timespan.streaming import blocks as bl
from timespan.streaming import ingest as ig
from timespan.streaming import live
from timespan.streaming import progress as pg
from timespan.streaming import state as st

SLICES = 3

_UTTERANCES = """fold AS (SELECT media_id, sample_idx, prob, 0::BIGINT AS first, 0::BIGINT AS buffered, 0::BIGINT AS silent, -1::BIGINT AS i, 0::BIGINT AS out_first, 0::BIGINT AS out_chunks FROM signal WHERE sample_idx = 0 UNION ALL
SELECT media_id, sample_idx, prob, CASE WHEN ends THEN 0 ELSE f END, CASE WHEN ends THEN 0 ELSE n END, CASE WHEN ends THEN 0 ELSE q END, i, f, CASE WHEN ends THEN n ELSE 0 END FROM
(SELECT *, prob < 0.5 AND n > 0 AND (q >= 2 OR n >= 8) AS ends FROM
(SELECT s.media_id, s.sample_idx, s.prob, f.i + 1 AS i, CASE WHEN f.buffered > 0 THEN f.first ELSE s.sample_idx END AS f, CASE WHEN s.prob < 0.5 AND f.buffered = 0 THEN 0 ELSE f.buffered + 1 END AS n, CASE WHEN s.prob >= 0.5 OR f.buffered = 0 THEN 0 ELSE f.silent + 1 END AS q
FROM fold f JOIN signal s ON s.media_id = f.media_id AND s.sample_idx = f.i + 1)))"""
_HEARD = fx.sql("signal", query="SELECT media_id AS stream_id, out_first AS first_chunk, out_chunks AS chunks, greatest(1, out_chunks * 512 // 16000) AS seconds FROM fold WHERE out_chunks > 0", more=_UTTERANCES).replace("WITH ", "WITH RECURSIVE ", 1)


def _vad(df):
    return df.select(F.col("media_id").alias("stream_id"), F.col("sample_idx").alias("chunk_idx"), "prob")


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or tempfile.mkdtemp(prefix="spark-")  # unset only in tests
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/stream-{uuid.uuid4().hex}"


def _signal(spark: SparkSession, d: str) -> DataFrame:
    """The events of a user as chunks a second apart, with the slice that they arrive in."""
    e = fx.ordered_events(spark, d)
    return e.withColumn("event_time", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("sample_idx"))).withColumn("slice", F.floor(F.col("sample_idx") / 25))


def _arriving(rows: DataFrame, folder: str, step) -> None:
    """Writes rows slice by slice (the last one holds the rest), and runs step() on a stream of what is there so far after each."""
    spark = rows.sparkSession
    rows.write.partitionBy("part").parquet(f"{folder}/all")
    schema = rows.drop("part").schema
    for k in range(SLICES):
        spark.read.schema(schema).parquet(f"{folder}/all/part={k}").write.mode("append").parquet(f"{folder}/in")
        step(spark.readStream.schema(schema).parquet(f"{folder}/in"))


def _part(column: str):
    return F.least(F.col(column), F.lit(SLICES - 1)).cast("int").alias("part")


@query(_HEARD)
def live_utterances(spark, d):
    return live.utterances(_vad(fx.ordered_events(spark, d)), silence=2, cap=8)


@query(_HEARD)
def live_utterances_stream(spark, d):
    """The same as a stream that is stopped after each slice and goes on from its state; state ends with the watermark."""
    folder = _folder(spark)
    rows = _signal(spark, d).select(F.col("media_id").alias("stream_id"), F.col("sample_idx").alias("chunk_idx"), "event_time", "prob", _part("slice"))
    _arriving(rows, folder, lambda chunks: st.drain(live.utterance_stream(chunks, silence=2, cap=8, idle_ms=3_600_000, delay="1 hour"), folder))
    return spark.read.schema(live.UTTERANCE).parquet(f"{folder}/out")


@query(fx.sql("tasks", query="SELECT project_id, version, payload FROM (SELECT o_custkey::BIGINT AS project_id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS payload FROM orders GROUP BY o_custkey) UNION ALL SELECT c_custkey::BIGINT, 1, 'new' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"))
def cached_or_computed(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("project_id"), F.col("o_orderkey").cast("long").alias("version"), F.col("o_orderstatus").alias("payload"))
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("project_id"))
    return live.refreshed(c.unionByName(o.select("project_id")).distinct(), o, lambda missing: missing.withColumn("payload", F.lit("new")))


@query("SELECT event_id AS block_id, (value + user_id) / 2 AS mono FROM events")
def mixed_blocks(spark, d):
    e = fx.table(spark, d, "events")
    blocks = e.select(F.col("event_id").alias("block_id"), F.array(F.array(F.col("value").cast("double")), F.array(F.col("user_id").cast("double"))).alias("channels"))
    return bl.preprocess_stream(blocks).select("block_id", F.col("mono")[0].alias("mono"))


def _blocks(spark, d, size):
    """Blocks of `size` samples of each user's signal."""
    s = _signal(spark, d).withColumn("block_idx", F.floor(F.col("sample_idx") / size))
    held = F.sort_array(F.collect_list(F.struct("sample_idx", "v")))["v"].alias("samples")
    return s.groupBy(F.col("media_id").alias("stream_id"), "block_idx").agg(held, F.max("event_time").alias("event_time"), F.min("slice").alias("slice"))


@query(fx.sql("signal", query="""SELECT media_id, b AS block_idx, k::BIGINT AS k, v0 + (v1 - v0) * (pos - floor(pos)) AS v FROM (SELECT p.media_id, p.b, p.k, pos, x.v AS v0, y.v AS v1 FROM
(SELECT media_id, b, n, m, unnest(range(m)) AS k, CASE WHEN m > 1 THEN unnest(range(m)) * (n - 1) / (m - 1)::DOUBLE ELSE 0 END AS pos FROM (SELECT media_id, b, n, n * 3 // 2 AS m FROM (SELECT media_id, sample_idx // 10 AS b, count(*) AS n FROM signal GROUP BY ALL))) p
JOIN signal x ON x.media_id = p.media_id AND x.sample_idx = p.b * 10 + floor(pos)::BIGINT JOIN signal y ON y.media_id = p.media_id AND y.sample_idx = p.b * 10 + least(floor(pos)::BIGINT + 1, p.n - 1))"""))
def resampled_blocks(spark, d):
    """Each block by itself at one and a half times its rate, as a stream of two equal channels."""
    folder = _folder(spark)
    b = _blocks(spark, d, 10).select(F.struct("stream_id", "block_idx").alias("block_id"), F.array("samples", "samples").alias("channels"), _part("slice"))
    _arriving(b, folder, lambda blocks: st.drain(bl.preprocess_stream(blocks, 2, 3), folder))
    out = spark.read.schema("block_id struct<stream_id: long, block_idx: long>, mono array<double>").parquet(f"{folder}/out")
    return out.select(F.col("block_id.stream_id").alias("media_id"), "block_id.block_idx", F.posexplode("mono").alias("k", "v")).withColumn("k", F.col("k").cast("long"))


@query(fx.sql("signal", query="""SELECT p.media_id AS stream_id, k::BIGINT AS sample_idx, CASE WHEN k * 2 % 3 = 0 THEN x.v ELSE x.v + (y.v - x.v) * (k * 2 % 3 / 3.0) END AS v FROM (SELECT media_id, unnest(range((max(sample_idx) * 3) // 2 + 1)) AS k FROM signal GROUP BY media_id) p
JOIN signal x ON x.media_id = p.media_id AND x.sample_idx = k * 2 // 3 LEFT JOIN signal y ON y.media_id = p.media_id AND y.sample_idx = k * 2 // 3 + 1"""))
def resampled_stream(spark, d):
    """One signal at one and a half times its rate from blocks of seven samples that arrive in slices."""
    folder = _folder(spark)
    b = _blocks(spark, d, 7).select("stream_id", "block_idx", "event_time", "samples", _part("slice"))
    _arriving(b, folder, lambda blocks: st.drain(bl.resampled_stream(blocks, 2, 3, delay="1 hour", idle_ms=3_600_000), folder))
    return spark.read.schema(bl.SAMPLE).parquet(f"{folder}/out")


@query(fx.sql("tasks", query="""SELECT task_id, max(CASE WHEN task_id % 2 = 1 THEN least(0.9, 0.1 + 0.75 * progress) ELSE least(0.95, progress) END) AS progress, arg_max(status, seq) AS status, max(seq) AS seq FROM tasks GROUP BY task_id"""))
def monotone_progress(spark, d):
    """Progress events in three slices through an update-mode stream into upserts, of both kinds of tasks."""
    folder = _folder(spark)
    t = fx.tasks(spark, d)
    kind = F.when(F.col("task_id") % 2 == 1, "cut").otherwise("transcribe")

    def step(events: DataFrame) -> None:
        writer = pg.progress_stream(events).writeStream.foreachBatch(pg.upsert(f"{folder}/progress")).option("checkpointLocation", f"{folder}/state")
        writer.outputMode("update").trigger(availableNow=True).start().awaitTermination()

    _arriving(t.select("task_id", kind.alias("kind"), "progress", "status", "seq", (F.col("seq") % SLICES).cast("int").alias("part")), folder, step)
    return pg.current(spark, f"{folder}/progress")


@query("""SELECT 'doc/' || doc_id || '.mp3' AS item, CASE WHEN length(coalesce(text, '')) < 200 THEN 'failed' ELSE 'done' END AS status, CASE WHEN length(coalesce(text, '')) < 100 THEN 'too short' WHEN length(coalesce(text, '')) < 200 THEN 'empty result' END AS message,
CASE WHEN length(coalesce(text, '')) < 200 THEN 2 WHEN doc_id % 7 = 0 AND doc_id % 3 = 0 THEN 1 ELSE doc_id % 3 END::BIGINT AS batch FROM documents""")
def ingest_log(spark, d):
    """Documents that arrive in three batches; a seventh of the first is stopped and runs in the second, failed ones run again in each."""
    folder = _folder(spark)
    docs = fx.table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias("item"), F.length(F.coalesce("text", F.lit(""))).alias("n"), (F.col("doc_id") % SLICES).cast("int").alias("part"), "doc_id")

    def work(items: DataFrame) -> DataFrame:
        found = items.join(docs, "item")
        return found.select("item", F.when(F.col("n") >= 200, F.col("n").cast("string")).alias("result"), F.when(F.col("n") < 100, "too short").alias("error"))

    for_first = docs.filter("doc_id % 7 = 0 AND doc_id % 3 = 0").select("item")
    done: list[int] = []

    def step(items: DataFrame) -> None:
        stopped = (lambda _: for_first) if not done else None
        done.append(1)
        items.writeStream.foreachBatch(ig.ingest(work, f"{folder}/log", stopped)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    _arriving(docs.select("item", "part"), folder, step)
    return ig.statuses(spark, f"{folder}/log")
