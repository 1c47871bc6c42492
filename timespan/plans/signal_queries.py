"""Queries over signals, frames, labels and vectors."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from timespan import fixtures as fx
from timespan.operators import signal as sg
from timespan.registry import query


@query(fx.sql("signal", query="SELECT s.media_id, sample_idx // w AS place, least(max(abs(v)), 1) AS peak FROM signal s JOIN (SELECT media_id, greatest(ceil(count(*) / 20.0), 1)::BIGINT AS w FROM signal GROUP BY media_id) n ON s.media_id = n.media_id WHERE sample_idx // w < 20 GROUP BY s.media_id, sample_idx // w"))
def peak_envelope(spark, d):
    return sg.peaks(fx.ordered_events(spark, d), 20)


def _frames(spark, d):
    return fx.vectors(spark, d).select("media_id", F.col("span_idx").alias("frame_idx"), F.transform("embedding", lambda x: (F.rint(x.cast("double") * 100) + 128).cast("int")).alias("pixels"))


@query(fx.sql("vectors", query="""SELECT media_id, coalesce(sum(abs(p - q)) / count(q), 0.0) AS score, count(DISTINCT frame_idx) AS frames FROM
(SELECT media_id, frame_idx, p, lag(p) OVER (PARTITION BY media_id, k ORDER BY frame_idx) AS q FROM (SELECT media_id, span_idx AS frame_idx, generate_subscripts(embedding, 1) AS k, (round_even(unnest(embedding)::DOUBLE * 100, 0) + 128)::INT AS p FROM vectors)) GROUP BY media_id"""))
def motion_score(spark, d):
    return sg.motion_score(_frames(spark, d))


@query(fx.sql("signal", query="""SELECT media_id, window_idx, label, round_even(window_idx * 10000000 + (721 + 270 * min(frame_idx)) * 62.5, 0)::BIGINT AS start_us, round_even(window_idx * 10000000 + (721 + 270 * (max(frame_idx) + 1)) * 62.5, 0)::BIGINT AS end_us
FROM (SELECT *, sum(c) OVER (PARTITION BY media_id, window_idx ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT media_id, sample_idx // 20 AS window_idx, sample_idx AS frame_idx, label, CASE WHEN label = lag(label) OVER (PARTITION BY media_id, sample_idx // 20 ORDER BY sample_idx) THEN 0 ELSE 1 END AS c FROM signal))
WHERE label <> 0 GROUP BY media_id, window_idx, run, label"""))
def label_runs(spark, d):
    return sg.label_runs(fx.ordered_events(spark, d).select("media_id", F.floor(F.col("sample_idx") / 20).alias("window_idx"), F.col("sample_idx").alias("frame_idx"), "label"))


_CROSS = "x AS (SELECT media_id, sample_idx + CASE WHEN v = 0 THEN 0.0 ELSE abs(v) / (abs(v) + abs(nx)) END AS pos FROM (SELECT *, lead(v) OVER (PARTITION BY media_id ORDER BY sample_idx) AS nx FROM signal) WHERE v * nx < 0 OR v = 0)"


@query(fx.sql("signal", query="SELECT media_id, round(pos, 9) AS pos FROM x", more=_CROSS))
def zero_crossings(spark, d):
    return sg.zero_crossings(fx.ordered_events(spark, d)).withColumn("pos", F.round("pos", 9))


@query(fx.sql("signal", query="""SELECT t.media_id, t.target, round(coalesce(c.pos, q.sample_idx::DOUBLE, t.target::DOUBLE), 9) AS snapped FROM t LEFT JOIN c USING (media_id, target) LEFT JOIN q USING (media_id, target)""", more=_CROSS + """,
t AS (SELECT DISTINCT media_id, i * 7 AS target FROM signal, range(0, 12) r(i)), c AS (SELECT t.media_id, t.target, arg_min(pos, (abs(pos - target), pos)) AS pos FROM t JOIN x ON t.media_id = x.media_id AND abs(pos - target) <= 1 GROUP BY ALL),
q AS (SELECT t.media_id, t.target, arg_min(sample_idx, (abs(v), sample_idx)) AS sample_idx FROM t JOIN signal s ON t.media_id = s.media_id AND abs(sample_idx - target) <= 1 GROUP BY ALL)"""))
def snapped_to_zero(spark, d):
    s = fx.ordered_events(spark, d)
    targets = s.select("media_id").distinct().select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(77).cast("long"), F.lit(7).cast("long"))).alias("target"))
    return sg.snap_to_zero(targets, s, 1).withColumn("snapped", F.round("snapped", 9))


def _snapped_sql(target: str) -> str:
    """Snapped targets, by comparing each with all samples of its medium."""
    return f"""t AS (SELECT DISTINCT media_id, {target} AS target FROM signal, range(0, 12) r(i)),
c AS (SELECT t.media_id, t.target, arg_min(pos, (abs(pos - target), pos)) AS pos FROM t JOIN x ON t.media_id = x.media_id AND abs(pos - target) <= 2 GROUP BY ALL),
q AS (SELECT t.media_id, t.target, arg_min(sample_idx, (abs(v), sample_idx)) AS sample_idx FROM t JOIN signal s ON t.media_id = s.media_id AND abs(sample_idx - target) <= 2 GROUP BY ALL),
z AS (SELECT t.media_id, t.target, coalesce(c.pos, q.sample_idx::DOUBLE, t.target::DOUBLE) AS snapped FROM t LEFT JOIN c USING (media_id, target) LEFT JOIN q USING (media_id, target))"""


@query(fx.sql("signal", query="""SELECT media_id, first, last, round(CASE WHEN b > a THEN a ELSE first END, 9) AS first_at, round(CASE WHEN b > a THEN b ELSE last END, 9) AS last_at
FROM (SELECT a.media_id, a.target AS first, b.target AS last, a.snapped AS a, b.snapped AS b FROM z a JOIN z b ON a.media_id = b.media_id AND b.target = a.target + 2 WHERE a.target % 7 = 0)""", more=_CROSS + ", " + _snapped_sql("unnest([i * 7, i * 7 + 2])")))
def ranges_snapped_to_zero(spark, d):
    s = fx.ordered_events(spark, d)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(77).cast("long"), F.lit(7).cast("long"))).alias("first")
    ranges = s.select("media_id").distinct().select("media_id", first).withColumn("last", F.col("first") + 2)
    return sg.snap_ranges_to_zero(ranges, s, 2).withColumns({c: F.round(c, 9) for c in ("first_at", "last_at")})


@query(fx.sql("signal", query="SELECT media_id, sample_idx // 2 AS sample_idx, round(avg(v), 9) AS v FROM signal GROUP BY ALL"))
def mono_mix(spark, d):
    return sg.mono(fx.ordered_events(spark, d).withColumn("sample_idx", F.floor(F.col("sample_idx") / 2))).withColumn("v", F.round("v", 9))


@query(fx.sql("signal", query="""SELECT p.media_id, k AS sample_idx, round(a.v + (b.v - a.v) * (pos - lo), 9) AS v FROM (SELECT media_id, n, k, pos, floor(pos)::BIGINT AS lo, least(floor(pos)::BIGINT + 1, n - 1) AS hi FROM
(SELECT media_id, n, m, k, CASE WHEN m > 1 THEN k * (n - 1) / (m - 1)::DOUBLE ELSE 0 END AS pos FROM (SELECT media_id, count(*) AS n, floor(count(*) * 160 / 441.0)::BIGINT AS m FROM signal GROUP BY media_id), range(0, 100000) r(k) WHERE k < m)) p
JOIN signal a ON a.media_id = p.media_id AND a.sample_idx = lo JOIN signal b ON b.media_id = p.media_id AND b.sample_idx = hi"""))
def resampled(spark, d):
    return sg.resample(fx.ordered_events(spark, d), 441, 160).withColumn("v", F.round("v", 9))


@query(fx.sql("label_vectors", query="""SELECT a.media_id, a.span_idx AS a_idx, b.span_idx AS b_idx, round(least(greatest(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 2), 6) AS distance FROM vectors a JOIN vectors b ON a.media_id = b.media_id AND a.span_idx < b.span_idx"""))
def cosine_distances(spark, d):
    # as DuckDB rounds, halves up; F.round goes through the decimal digits of each number, which takes most of the time
    return sg.cosine_distances(fx.label_vectors(spark, d)).withColumn("distance", F.floor(F.col("distance") * 1_000_000 + 0.5) / 1_000_000)


@query(fx.sql("vectors", query="SELECT media_id, span_idx, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM vectors"))
def vector_norms(spark, d):
    return sg.normalise(fx.vectors(spark, d)).select("media_id", "span_idx", F.round("norm", 6).alias("norm"))


@query(fx.sql("label_vectors", query="SELECT media_id, span_idx, dim, round(x - avg(x) OVER (PARTITION BY media_id, dim), 6) AS x FROM (SELECT media_id, span_idx, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM vectors)"))
def mean_centred(spark, d):
    return sg.mean_centred(fx.label_vectors(spark, d).withColumn("embedding", F.col("embedding").cast("array<double>"))).withColumn("x", F.round("x", 6))


@query(fx.sql("signal", query="SELECT media_id, min(peak) AS low, max(peak) AS high FROM (SELECT s.media_id, least(max(abs(v)), 1) AS peak FROM signal s JOIN (SELECT media_id, greatest(ceil(count(*) / 20.0), 1)::BIGINT AS w FROM signal GROUP BY media_id) n ON s.media_id = n.media_id WHERE sample_idx // w < 20 GROUP BY s.media_id, sample_idx // w) GROUP BY media_id"))
def peak_range(spark, d):
    return sg.peak_range(sg.peaks(fx.ordered_events(spark, d), 20))


@query("""WITH s AS (SELECT user_id % 3 AS media_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS i, (value - 245) / 245 AS v FROM events), n AS (SELECT media_id, max(i) + 1 AS n FROM s GROUP BY media_id),
p AS (SELECT *, greatest(1, least(n, greatest(256, least(300, greatest(500, ceil(greatest(n / 16.0, 0.1) * 60))))))::BIGINT AS places FROM n), t AS (SELECT *, greatest(1, n // places) AS stride, greatest(1, greatest(1, n // places) // 2) AS step FROM p)
SELECT media_id::BIGINT AS media_id, place, least(max(abs(v)), 1) AS peak FROM (SELECT s.media_id, i, v, least(i // stride, places - 1) AS place, stride, step FROM s JOIN t USING (media_id)) WHERE (i - place * stride) % step = 0 GROUP BY media_id, place""")
def display_envelope(spark, d):
    """The events of a third of the users as two channels, one half as loud as the other."""
    e = fx.table(spark, d, "events").withColumn("media_id", (F.col("user_id") % 3).cast("long"))
    s = e.select("media_id", (F.row_number().over(Window.partitionBy("media_id").orderBy("event_id")) - 1).cast("long").alias("sample_idx"), ((F.col("value") - 245) / 245).alias("v"))
    both = s.withColumn("channel", F.lit(0)).unionByName(s.withColumns({"channel": F.lit(1), "v": F.col("v") / -2}))
    return sg.display_envelope(both, rate=16, most=300, dense=2)


@query()
def speaker_turns(spark, d):
    """Spans of 0.6 to 2.4 seconds, a tenth of them without a vector."""
    v = fx.vectors(spark, d).withColumn("start_us", F.col("span_idx") * 2_500_000).withColumn("end_us", F.col("start_us") + 600_000 + F.col("span_idx") % 7 * 300_000)
    return sg.speaker_turns(v.withColumn("embedding", F.when(F.col("span_idx") % 10 != 3, F.col("embedding"))), gap=3_000_000)


@query()
def clustered_spans(spark, d):
    return sg.cluster_spans(fx.vectors(spark, d))


def _load():
    return {"scale": 2.0}


def _score(model, pdf):
    return pdf.assign(score=pdf["v"] * model["scale"])[["media_id", "sample_idx", "score"]]


@query(fx.sql("signal", query="SELECT media_id, sample_idx, round(v * 2, 9) AS score FROM signal"))
def scored_chunks(spark, d):
    return sg.score_chunks(fx.ordered_events(spark, d).select("media_id", "sample_idx", "v"), _load, _score, "media_id long, sample_idx long, score double").withColumn("score", F.round("score", 9))
