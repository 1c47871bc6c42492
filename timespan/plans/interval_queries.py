"""Queries of the interval operators."""

from pyspark.sql import functions as F

from timespan import fixtures as fx
from timespan.operators import intervals as iv
from timespan.registry import query


def merged(source: str, tolerance: int = 0, name: str = "merged", order: str = "start_us, end_us") -> str:
    """SQL of a merge: islands of source."""
    return f"""{name}0 AS (SELECT media_id, start_us, end_us, CASE WHEN start_us > max(end_us) OVER (PARTITION BY media_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {tolerance} THEN 1 ELSE 0 END AS brk FROM {source}),
{name}1 AS (SELECT *, sum(brk) OVER (PARTITION BY media_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {name}0),
{name} AS (SELECT media_id, min(start_us) AS start_us, max(end_us) AS end_us FROM {name}1 GROUP BY media_id, island)"""


def complemented(source: str, totals: str, name: str = "kept") -> str:
    """SQL of a complement of source in totals."""
    return f"""{name}0 AS (SELECT media_id, least(greatest(start_us, 0), total_us) AS start_us, least(end_us, total_us) AS end_us FROM {source} JOIN {totals} USING (media_id)
    UNION ALL SELECT media_id, total_us, total_us FROM {totals} WHERE total_us > 0),
{name}1 AS (SELECT * FROM {name}0 JOIN {totals} USING (media_id) WHERE end_us > start_us OR start_us = total_us),
{name}2 AS (SELECT media_id, start_us, coalesce(max(end_us) OVER (PARTITION BY media_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_us FROM {name}1),
{name} AS (SELECT media_id, from_us AS start_us, start_us AS end_us FROM {name}2 WHERE start_us > from_us)"""


FLAT = "SELECT media_id, start_us::BIGINT AS start_us, end_us::BIGINT AS end_us FROM "


@query(fx.sql("ranges", query=FLAT + "merged", more=merged("ranges")))
def merge_touching(spark, d):
    return iv.merge(fx.ranges(spark, d))


@query(fx.sql("ranges", "totals", "spans", query=FLAT + "merged WHERE end_us > start_us", more="c AS (SELECT media_id, greatest(start_us, 0) AS start_us, greatest(least(end_us, total_us), greatest(start_us, 0)) AS end_us FROM (SELECT media_id, start_us - 80000 AS start_us, end_us + 80000 AS end_us FROM spans) JOIN totals USING (media_id)), " + merged("c", 120_000)))
def merge_padded(spark, d):
    padded = fx.spans(spark, d).select("media_id", (F.col("start_us") - 80_000).alias("start_us"), (F.col("end_us") + 80_000).alias("end_us"))
    return iv.merge(iv.clamp(padded, fx.totals(spark, d)), 120_000).filter("end_us > start_us")


@query(fx.sql("ranges", query=FLAT + "merged", more=merged("ranges", 1)))
def merge_within_1us(spark, d):
    return iv.merge(fx.ranges(spark, d), 1)


@query(fx.sql("ranges", "spans", query=FLAT + "merged", more=merged("spans", 500)))
def merge_within_500us(spark, d):
    return iv.merge(fx.spans(spark, d), 500)


@query(fx.sql("ranges", query="SELECT media_id, max(s)::BIGINT AS start_us, max(e)::BIGINT AS end_us FROM f GROUP BY media_id, island", more="""
c AS (SELECT media_id, greatest(start_us, 0) AS s, greatest(end_us, 0) AS e, row_number() OVER (PARTITION BY media_id ORDER BY greatest(start_us, 0), greatest(end_us, 0)) AS k FROM near WHERE end_us > start_us),
f AS (SELECT media_id, k, s, e, 1 AS island FROM c WHERE k = 1 UNION ALL
      SELECT media_id, k, CASE WHEN NOT same AND s2 > e THEN s2 ELSE s END, CASE WHEN same THEN e WHEN s2 > e THEN e2 ELSE greatest(e, e2) END, island + CASE WHEN NOT same AND s2 > e THEN 1 ELSE 0 END
      FROM (SELECT f.media_id, c.k, f.s, f.e, island, c.s AS s2, c.e AS e2, abs(c.s - f.s) < 100 AND abs(c.e - f.e) < 100 AS same FROM f JOIN c ON c.media_id = f.media_id AND c.k = f.k + 1))""".replace("c AS", """
near AS (SELECT media_id, start_us, end_us FROM ranges UNION ALL SELECT media_id, start_us + 60, end_us + 60 FROM ranges UNION ALL SELECT media_id, start_us + 99, end_us + 120 FROM ranges),
c AS""", 1)).replace("WITH ", "WITH RECURSIVE ", 1))
def merge_without_near_duplicates(spark, d):
    r = fx.ranges(spark, d).select("media_id", "start_us", "end_us")
    near = [r.select("media_id", (F.col("start_us") + a).alias("start_us"), (F.col("end_us") + b).alias("end_us")) for a, b in ((60, 60), (99, 120))]
    return iv.merge_near_duplicates(r.unionByName(near[0]).unionByName(near[1]))


@query(fx.sql("ranges", "spans", "deletes", query=FLAT + "g", more="""m AS (SELECT media_id, start_us, end_us, max(end_us) OVER (PARTITION BY media_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_us, row_number() OVER (PARTITION BY media_id ORDER BY start_us, end_us) AS rid FROM spans),
x AS (SELECT DISTINCT m.media_id, m.rid FROM m JOIN deletes d ON m.media_id = d.media_id AND m.start_us > m.last_us AND d.start_us < m.start_us AND d.end_us > m.last_us),
b AS (SELECT m.*, CASE WHEN start_us > last_us + 50000 OR x.rid IS NOT NULL THEN 1 ELSE 0 END AS brk FROM m LEFT JOIN x USING (media_id, rid)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY media_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM b), g AS (SELECT media_id, min(start_us) AS start_us, max(end_us) AS end_us FROM i GROUP BY media_id, island)"""))
def merge_guarded(spark, d):
    return iv.guarded_merge(fx.spans(spark, d), fx.deletes(spark, d))


@query(fx.sql("ranges", query="SELECT media_id, kind, min(start_us)::BIGINT AS start_us, arg_max(end_us, (start_us, end_us))::BIGINT AS end_us FROM i GROUP BY media_id, kind, island", more="""
k AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND start_us - lag(end_us) OVER w < 300000 THEN 0 ELSE 1 END AS brk FROM ranges WHERE end_us - start_us >= 100000 WINDOW w AS (PARTITION BY media_id ORDER BY start_us, end_us)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY media_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM k)"""))
def merge_same_label(spark, d):
    return iv.merge_labelled(fx.ranges(spark, d), label="kind")


@query(fx.sql("ranges", "spans", "totals", query=FLAT + "kept", more=complemented("spans", "totals")))
def complement_of_spans(spark, d):
    return iv.complement(fx.spans(spark, d), fx.totals(spark, d))


@query(fx.sql("ranges", "spans", query="SELECT media_id, start_us, end_us, (coalesce(sum(end_us - start_us) OVER (PARTITION BY media_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - start_us)::BIGINT AS delta_us FROM merged", more=merged("spans")))
def running_offsets(spark, d):
    return iv.with_offsets(iv.merge(fx.spans(spark, d)))


_WITH_ID = "s AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us, end_us) AS id FROM spans)"
_COVER = _WITH_ID + ", v AS (SELECT s.media_id, s.id, sum(least(s.end_us, d.end_us) - greatest(s.start_us, d.start_us)) AS c FROM s JOIN deletes d ON s.media_id = d.media_id AND s.start_us < d.end_us AND s.end_us > d.start_us GROUP BY s.media_id, s.id)"


def _spans_with_id(spark, d):
    from pyspark.sql import Window

    return fx.spans(spark, d).withColumn("id", F.row_number().over(Window.partitionBy("media_id").orderBy("start_us", "end_us")))


@query(fx.sql("ranges", "spans", "deletes", query="SELECT media_id, id, start_us, end_us, coalesce(c, 0)::BIGINT AS covered_us FROM s LEFT JOIN v USING (media_id, id)", more=_COVER))
def coverage_by_deletes(spark, d):
    return iv.coverage(_spans_with_id(spark, d), fx.deletes(spark, d))


@query(fx.sql("ranges", "spans", "deletes", query="SELECT media_id, id, start_us, end_us FROM s LEFT JOIN v USING (media_id, id) WHERE end_us > start_us AND coalesce(c, 0) < end_us - start_us - 1000", more=_COVER))
def surviving_spans(spark, d):
    return iv.surviving(_spans_with_id(spark, d), fx.deletes(spark, d))


@query(fx.sql("ranges", "spans", "deletes", query=FLAT + "spans s WHERE NOT EXISTS (SELECT 1 FROM deletes d WHERE d.media_id = s.media_id AND d.start_us < s.end_us AND d.end_us > s.start_us)"))
def spans_outside_deletes(spark, d):
    return iv.outside(fx.spans(spark, d), fx.deletes(spark, d))


@query(fx.sql("ranges", "spans", "deletes", query=FLAT + "spans s WHERE EXISTS (SELECT 1 FROM deletes d WHERE d.media_id = s.media_id AND d.start_us < s.end_us AND d.end_us > s.start_us)"))
def overlap_violations(spark, d):
    return iv.overlap_violations(fx.spans(spark, d), fx.deletes(spark, d))


_CLIP = "SELECT s.media_id, greatest(s.start_us, d.start_us) AS start_us, least(s.end_us, d.end_us) AS end_us, d.start_us AS r_start_us, d.end_us AS r_end_us FROM spans s JOIN deletes d ON s.media_id = d.media_id AND s.start_us < d.end_us AND s.end_us > d.start_us"


@query(fx.sql("ranges", "spans", "deletes", query=_CLIP))
def clipped_pairs(spark, d):
    return iv.clip(fx.spans(spark, d), fx.deletes(spark, d))


@query(fx.sql("ranges", "spans", "deletes", query=_CLIP))
def clipped_pairs_binned(spark, d):
    return iv.clip(fx.spans(spark, d), fx.deletes(spark, d), bin_us=3_600_000_000)


@query(fx.sql("ranges", query=FLAT + "(SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM ranges) WHERE n = 1 OR end_us - start_us >= 300000000"))
def long_ranges(spark, d):
    return iv.long_enough(fx.ranges(spark, d), 300_000_000).drop("kind")


@query(fx.sql("ranges", query=FLAT + "ranges WHERE end_us > start_us"))
def valid_ranges(spark, d):
    text = fx.ranges(spark, d).select("media_id", F.col("start_us").cast("string").alias("start_us"), F.col("end_us").cast("string").alias("end_us"))
    return iv.valid_ranges(text)


_CHUNKS = "chunks AS (SELECT media_id, i::INT AS chunk_idx, round_even(total_us / n::DOUBLE * i, 0)::BIGINT AS start_us, CASE WHEN i = n - 1 THEN total_us ELSE round_even(total_us / n::DOUBLE * (i + 1), 0)::BIGINT END AS end_us FROM (SELECT *, greatest(2, floor(total_us / 200000000000.0)::BIGINT + 1) AS n FROM totals) t, range(0, 100000) r(i) WHERE i < n)"


@query(fx.sql("ranges", "totals", "spans", query="SELECT media_id, chunk_idx, s AS start_us, e AS end_us FROM (SELECT c.media_id, chunk_idx, greatest(s.start_us, c.start_us) - c.start_us AS s, least(s.end_us, c.end_us) - c.start_us AS e FROM chunks c JOIN spans s ON c.media_id = s.media_id AND s.end_us > c.start_us - 1000 AND s.start_us < c.end_us + 1000) WHERE e - s >= 1000", more=_CHUNKS))
def ranges_in_chunks(spark, d):
    return iv.to_chunks(fx.spans(spark, d), iv.uniform_chunks(fx.totals(spark, d), 200_000_000_000))


_LOCAL = "loc AS (SELECT c.media_id, chunk_idx, greatest(s.start_us, c.start_us) - c.start_us AS s, least(s.end_us, c.end_us) - c.start_us AS e FROM chunks c JOIN spans s ON c.media_id = s.media_id AND s.end_us > c.start_us - 1000 AND s.start_us < c.end_us + 1000)"


@query(fx.sql("ranges", "totals", "spans", query="""SELECT c.media_id, c.chunk_idx, CASE WHEN n IS NULL THEN 'skip' WHEN n = 1 AND s < 1000 AND abs(e - (end_us - start_us)) < 1000 THEN 'copy' ELSE 'cut' END AS plan, coalesce(n, 0) AS ranges
FROM chunks c LEFT JOIN (SELECT media_id, chunk_idx, count(*) AS n, min(s) AS s, max(e) AS e FROM loc WHERE e - s >= 1000 GROUP BY media_id, chunk_idx) l ON l.media_id = c.media_id AND l.chunk_idx = c.chunk_idx""", more=_CHUNKS.replace("200000000000", "20000000000") + ", " + _LOCAL))
def chunk_plans(spark, d):
    chunks = iv.uniform_chunks(fx.totals(spark, d), 20_000_000_000)
    return iv.chunk_plans(chunks, iv.to_chunks(fx.spans(spark, d), chunks), near=1_000)


@query(fx.sql("ranges", "totals", "spans", query="SELECT media_id, chunk_idx, s AS start_us, e AS end_us, (sum(e - s) OVER (PARTITION BY media_id, chunk_idx))::BIGINT AS kept_us FROM (SELECT c.media_id, chunk_idx, greatest(s.start_us, c.start_us) - c.start_us AS s, least(s.end_us, c.end_us) - c.start_us AS e FROM chunks c JOIN spans s ON c.media_id = s.media_id AND s.end_us > c.start_us AND s.start_us < c.end_us)", more="chunks AS (SELECT media_id, i::INT AS chunk_idx, (i * 300000000000)::BIGINT AS start_us, least((i + 1) * 300000000000, total_us)::BIGINT AS end_us FROM totals t, range(0, 100000) r(i) WHERE i * 300000000000 < total_us)"))
def fixed_chunk_clip(spark, d):
    return iv.in_uniform_chunks(fx.spans(spark, d), iv.fixed_chunks(fx.totals(spark, d), 300_000_000_000, 0))


@query(fx.sql("ranges", "totals", "spans", query="SELECT media_id, chunk_idx, s AS start_us, e AS end_us, (sum(e - s) OVER (PARTITION BY media_id, chunk_idx))::BIGINT AS kept_us FROM (SELECT c.media_id, chunk_idx, greatest(s.start_us, c.start_us) - c.start_us AS s, least(s.end_us, c.end_us) - c.start_us AS e FROM chunks c JOIN spans s ON c.media_id = s.media_id AND s.end_us > c.start_us AND s.start_us < c.end_us)", more=_CHUNKS))
def uniform_chunk_clip(spark, d):
    return iv.in_uniform_chunks(fx.spans(spark, d), iv.uniform_chunks(fx.totals(spark, d), 200_000_000_000))


@query(fx.sql("ranges", "spans", "keyframes", query="SELECT media_id, s AS start_us, greatest(e, s) AS end_us FROM b WHERE greatest(e, s) > s", more="""
k AS (SELECT DISTINCT media_id, t_us FROM keyframes), edge AS (SELECT media_id, min(t_us) AS lo, max(t_us) AS hi FROM k GROUP BY media_id),
a AS (SELECT s.media_id, s.start_us, s.end_us, k.t_us AS low FROM spans s ASOF LEFT JOIN k ON s.media_id = k.media_id AND s.start_us >= k.t_us),
b AS (SELECT a.media_id, coalesce(low, lo, a.start_us) AS s, coalesce(k.t_us, hi, a.end_us) AS e FROM a ASOF LEFT JOIN k ON a.media_id = k.media_id AND a.end_us <= k.t_us LEFT JOIN edge ON a.media_id = edge.media_id)"""))
def snapped_to_keyframes(spark, d):
    return iv.snap_to_keyframes(fx.spans(spark, d), fx.keyframes(spark, d))


_TARGETS = "targets AS (SELECT media_id, (i * 100000000000)::BIGINT AS target_us FROM totals, range(1, 100000) r(i) WHERE i <= total_us // 100000000000)"
_SPLIT = """n AS (SELECT t.media_id, target_us, (s.start_us + s.end_us) // 2 AS mid, row_number() OVER (PARTITION BY t.media_id, target_us ORDER BY s.end_us - s.start_us DESC, s.start_us, s.end_us) AS r
FROM targets t JOIN spans s ON t.media_id = s.media_id AND abs((s.start_us + s.end_us) // 2 - target_us) <= 3600000000), best AS (SELECT t.media_id, t.target_us, coalesce(mid, t.target_us) AS split_us FROM targets t LEFT JOIN n ON n.media_id = t.media_id AND n.target_us = t.target_us AND r = 1)"""


@query(fx.sql("ranges", "totals", "spans", query="SELECT * FROM best", more=_TARGETS + ", " + _SPLIT))
def best_silence(spark, d):
    targets = fx.totals(spark, d).select("media_id", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("total_us") / 100_000_000_000))).alias("i")).select("media_id", (F.col("i") * 100_000_000_000).alias("target_us"))
    return iv.best_silence(targets, fx.spans(spark, d), 3_600_000_000)


@query(fx.sql("ranges", "totals", "spans", query="SELECT media_id, split_us AS t_us FROM best UNION ALL SELECT media_id, 0 FROM totals WHERE total_us > 100000000000 UNION ALL SELECT media_id, total_us FROM totals WHERE total_us > 100000000000", more=_TARGETS + ", " + _SPLIT.replace("3600000000", "60000000")))
def silence_split_points(spark, d):
    return iv.split_points(fx.totals(spark, d), fx.spans(spark, d), 100_000_000_000)


@query(fx.sql("ranges", query="SELECT media_id, s AS start_us, greatest(s, end_us - CASE WHEN next IS NULL THEN 0 ELSE least(8000, greatest((next - end_us) // 2, 0), (end_us - s) // 4) END)::BIGINT AS end_us FROM h WHERE end_us > s", more=merged("ranges") + """,
l AS (SELECT *, lag(end_us) OVER w AS prev, lead(start_us) OVER w AS next FROM merged WINDOW w AS (PARTITION BY media_id ORDER BY start_us)),
h AS (SELECT *, least(end_us, start_us + CASE WHEN prev IS NULL THEN 0 ELSE least(8000, greatest((start_us - prev) // 2, 0), (end_us - start_us) // 4) END)::BIGINT AS s FROM l)"""))
def trimmed_margins(spark, d):
    return iv.trim_margins(iv.merge(fx.ranges(spark, d)))


@query(fx.sql("ranges", query="""SELECT media_id, x AS xfade_us, CASE WHEN raw - x * (n - 1) > 0 THEN raw - x * (n - 1) ELSE CASE WHEN raw > 0 THEN raw ELSE 0 END END AS expected_us FROM
(SELECT media_id, sum(len)::BIGINT AS raw, count(*) AS n, greatest(least(40000, coalesce(min(pair) - 1000, 0)), 0)::BIGINT AS x FROM l GROUP BY media_id)""", more=merged("ranges") + ", l AS (SELECT media_id, end_us - start_us AS len, CASE WHEN lag(start_us) OVER w IS NOT NULL THEN least(end_us - start_us, lag(end_us - start_us) OVER w) END AS pair FROM merged WINDOW w AS (PARTITION BY media_id ORDER BY start_us))"))
def crossfade_and_expected_duration(spark, d):
    return iv.expected_duration(iv.merge(fx.ranges(spark, d)), 40_000)


@query(fx.sql("ranges", "spans", query="SELECT media_id, start_us, least(end_us, coalesce(lead(start_us) OVER (PARTITION BY media_id ORDER BY start_us, end_us), end_us)) AS end_us FROM spans"))
def lines_without_overlap(spark, d):
    return iv.without_overlap(fx.spans(spark, d))


@query(fx.sql("ranges", "spans", query="SELECT media_id, batch_idx, count(*) AS n, sum(end_us - start_us)::BIGINT AS kept_us FROM (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY start_us, end_us) - 1) // 7 AS batch_idx FROM spans) GROUP BY ALL HAVING sum(end_us - start_us) > 0"))
def batches_by_count(spark, d):
    return iv.batches(fx.spans(spark, d), 7)


@query(fx.sql("ranges", "spans", query="SELECT media_id, k AS kept_us, CASE WHEN k > 3600000000 THEN least(20, greatest(2, floor(900000000.0 * n / k)::INT)) ELSE 20 END::BIGINT AS batch FROM (SELECT media_id, sum(end_us - start_us)::BIGINT AS k, count(*) AS n FROM spans GROUP BY media_id)"))
def tuned_batch_size(spark, d):
    return iv.batch_size(fx.spans(spark, d), 20)


@query(fx.sql("ranges", "spans", query="SELECT media_id, s AS start_us, least(s + 3000000000, end_us) AS end_us FROM (SELECT *, start_us + i * 3000000000 AS s FROM spans, range(0, 100000) r(i) WHERE i = 0 OR start_us + i * 3000000000 < end_us) WHERE end_us - start_us <= 3000000000 OR end_us - s >= 100000000"))
def spans_in_pieces(spark, d):
    return iv.split_long(fx.spans(spark, d), 3_000_000_000, 100_000_000)


@query(fx.sql("ranges", "totals", query="SELECT media_id, i::INT AS chunk_idx, s AS start_us, least(s + 20000000000, total_us) AS end_us FROM (SELECT *, i * 20000000000 AS s FROM totals, range(0, 1000000) r(i) WHERE i * 20000000000 < total_us) WHERE least(s + 20000000000, total_us) - s >= 500000"))
def fixed_chunks(spark, d):
    return iv.fixed_chunks(fx.totals(spark, d), 20_000_000_000)


@query(fx.sql("ranges", "spans", query="""SELECT media_id, line_idx, CASE WHEN line_idx % 3 = 0 THEN greatest(0, least(start_us + 5000000, end_us - 100000)) ELSE start_us END AS start_us, CASE WHEN line_idx % 3 = 1 THEN greatest(end_us - 5000000, start_us + 100000) ELSE end_us END AS end_us,
greatest(least(start_us, coalesce(lag(start_us) OVER w, start_us)) - 500000, 0) AS view_from_us, greatest(end_us, coalesce(lead(end_us) OVER w, end_us)) + 500000 AS view_to_us FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us, end_us) AS line_idx FROM spans) WINDOW w AS (PARTITION BY media_id ORDER BY line_idx)"""))
def moved_edges(spark, d):
    lines = _spans_with_id(spark, d).withColumnRenamed("id", "line_idx")
    k = F.col("line_idx") % 3
    edits = lines.filter(k < 2).select("media_id", "line_idx", F.when(k == 0, "start").otherwise("end").alias("edge"), F.when(k == 0, F.col("start_us") + 5_000_000).otherwise(F.col("end_us") - 5_000_000).alias("to_us"))
    return iv.move_edges(lines, edits)
