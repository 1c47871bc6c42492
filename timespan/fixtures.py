"""Inputs of the operators, derived from the given tables by expressions that Spark and DuckDB share.

Times are microseconds. SQL holds the DuckDB twin of each fixture as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: 2024-01-01 UTC, where the events start.
ORIGIN_US = 1_704_067_200_000_000
STOP_WORDS = ("the", "of", "and")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_us() -> F.Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN_US


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, start_us, end_us, kind: a range per event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("long").alias("media_id"), _event_us().alias("start_us"), (_event_us() + (F.rint(F.col("value") * 100) * 6_000_000).cast("long")).alias("end_us"), F.col("event_type").alias("kind"))


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges(spark, sf_dir).filter("kind = 'error'").drop("kind")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges(spark, sf_dir).filter("kind IN ('click', 'view')").drop("kind")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, total_us: the end of each medium."""
    return ranges(spark, sf_dir).groupBy("media_id").agg(F.max("end_us").alias("total_us"))


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges(spark, sf_dir).filter("kind = 'signup'").select("media_id", F.col("start_us").alias("t_us"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, seg_idx, text of each turn."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("media_id"), F.col("turn").cast("long").alias("seg_idx"), "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words of the conversations."""
    tokens = segments(spark, sf_dir).select("media_id", "seg_idx", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("word_idx", "text"))
    w = Window.partitionBy("media_id").orderBy("seg_idx", "word_idx")
    gap = F.when(F.col("word_idx") == 0, ((F.col("media_id") * 7 + F.col("seg_idx") * 3) % 5) * 400_000).when((F.col("word_idx") * 5 + F.col("seg_idx")) % 17 == 0, 700_000).otherwise(0)
    timed = tokens.withColumn("dur", 100_000 + 30_000 * F.length("text")).withColumn("end_us", F.sum(gap + F.col("dur")).over(w))
    return timed.select("media_id", "seg_idx", "word_idx", "text", (F.col("end_us") - F.col("dur")).cast("long").alias("start_us"), F.col("end_us").cast("long").alias("end_us"), ((F.col("word_idx") % 100) / 100.0).alias("conf"))


def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy("media_id").agg(F.max("end_us").alias("total_us"))


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, sample_idx, v, label, prob: the events of a user as a signal."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    label = F.when(kind == "error", 0).when(kind == "click", 1).when(kind == "view", 2).when(kind == "signup", 3).otherwise(4)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("media_id"), (F.row_number().over(w) - 1).cast("long").alias("sample_idx"), ((F.col("value") - 245) / 245).alias("v"),
        label.alias("label"), F.when(kind.isin("click", "view", "purchase"), 0.9).otherwise(0.1).alias("prob"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, kind, version, payload, created_us of each order."""
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = key.cast("string")
    more = [
        F.when(key % 3 == 0, F.concat(F.lit(',"base":'), (key % 7).cast("string"))).otherwise(""), F.when(key % 5 == 0, F.lit(',"note":"n"')).otherwise(""),
        F.when(key % 4 == 0, F.concat(F.lit(',"deletes":[{"start_us":'), text, F.lit(',"end_us":'), (key + 10).cast("string"), F.lit("}]"))).otherwise(""),
    ]
    payload = F.concat(F.lit('{"key":'), F.col("o_orderkey").cast("string"), F.lit(',"label":" L'), (F.col("o_orderkey") % 5).cast("string"), F.lit(' ","file":"/data/'), F.col("o_custkey").cast("string"), F.lit('/a.wav"'), *more, F.lit("}"))
    return o.select(F.col("o_custkey").cast("long").alias("project_id"), F.col("o_orderstatus").alias("kind"), F.row_number().over(w).alias("version"), payload.alias("payload"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("created"), "o_orderkey")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return o.select(F.col("o_custkey").cast("long").alias("task_id"), status.alias("status"), ((F.col("o_orderkey") % 101) / 100.0).alias("progress"), F.col("o_orderkey").cast("long").alias("seq"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, span_idx, embedding: the vectors of a label, 2,000 at most in a medium."""
    media = F.col("label").cast("long") * 1_000_000 + F.floor(F.col("vec_id") / 2000)
    return table(spark, sf_dir, "embeddings").select(media.cast("long").alias("media_id"), F.col("vec_id").cast("long").alias("span_idx"), F.col("embedding"))


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, span_idx, embedding: all vectors of a label in one medium, however many."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("media_id"), F.col("vec_id").cast("long").alias("span_idx"), F.col("embedding"))


_KIND = "CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
SQL = {
    "ranges": f"ranges AS (SELECT user_id::BIGINT AS media_id, epoch_us(ts) - {ORIGIN_US} AS start_us, epoch_us(ts) - {ORIGIN_US} + (round_even(value * 100, 0) * 6000000)::BIGINT AS end_us, event_type AS kind FROM events)",
    "deletes": "deletes AS (SELECT media_id, start_us, end_us FROM ranges WHERE kind = 'error')",
    "spans": "spans AS (SELECT media_id, start_us, end_us FROM ranges WHERE kind IN ('click', 'view'))",
    "totals": "totals AS (SELECT media_id, max(end_us) AS total_us FROM ranges GROUP BY media_id)",
    "keyframes": "keyframes AS (SELECT media_id, start_us AS t_us FROM ranges WHERE kind = 'signup')",
    "segments": "segments AS (SELECT conv_id::BIGINT AS media_id, turn::BIGINT AS seg_idx, text FROM conversations)",
    "tokens0": r"tokens0 AS (SELECT media_id, seg_idx, (generate_subscripts(w, 1) - 1)::BIGINT AS word_idx, unnest(w) AS text FROM (SELECT media_id, seg_idx, regexp_extract_all(text, '\S+') AS w FROM segments))",
    "words": """words AS (SELECT media_id, seg_idx, word_idx, text, (e - dur)::BIGINT AS start_us, e::BIGINT AS end_us, (word_idx % 100) / 100.0 AS conf FROM (
        SELECT *, sum(CASE WHEN word_idx = 0 THEN ((media_id * 7 + seg_idx * 3) % 5) * 400000 WHEN (word_idx * 5 + seg_idx) % 17 = 0 THEN 700000 ELSE 0 END + dur) OVER (PARTITION BY media_id ORDER BY seg_idx, word_idx) AS e
        FROM (SELECT *, 100000 + 30000 * length(text) AS dur FROM tokens0)))""",
    "word_totals": "word_totals AS (SELECT media_id, max(end_us) AS total_us FROM words GROUP BY media_id)",
    "signal": f"signal AS (SELECT user_id::BIGINT AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, (value - 245) / 245 AS v, {_KIND} AS label, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 0.9 ELSE 0.1 END AS prob FROM events)",
    "snapshots": """snapshots AS (SELECT o_custkey::BIGINT AS project_id, o_orderstatus AS kind, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS version,
        '{"key":' || o_orderkey || ',"label":" L' || (o_orderkey % 5) || ' ","file":"/data/' || o_custkey || '/a.wav"' || CASE WHEN o_orderkey % 3 = 0 THEN ',"base":' || (o_orderkey % 7) ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ',"note":"n"' ELSE '' END
        || CASE WHEN o_orderkey % 4 = 0 THEN ',"deletes":[{"start_us":' || o_orderkey || ',"end_us":' || (o_orderkey + 10) || '}]' ELSE '' END || '}' AS payload, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS created, o_orderkey FROM orders)""",
    "tasks": "tasks AS (SELECT o_custkey::BIGINT AS task_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, (o_orderkey % 101) / 100.0 AS progress, o_orderkey::BIGINT AS seq FROM orders)",
    "vectors": "vectors AS (SELECT (label * 1000000 + vec_id // 2000)::BIGINT AS media_id, vec_id::BIGINT AS span_idx, embedding FROM embeddings)",
    "label_vectors": "vectors AS (SELECT label::BIGINT AS media_id, vec_id::BIGINT AS span_idx, embedding FROM embeddings)",
}
_NEEDS = {"deletes": ["ranges"], "spans": ["ranges"], "totals": ["ranges"], "keyframes": ["ranges"], "tokens0": ["segments"], "words": ["segments", "tokens0"], "word_totals": ["segments", "tokens0", "words"]}


def sql(*names: str, query: str, more: str = "") -> str:
    """A DuckDB query over fixtures. more: further common table expressions."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    ctes = [SQL[n] for n in order] + ([more] if more else [])
    return "WITH " + ",\n".join(ctes) + "\n" + query
