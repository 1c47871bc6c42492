"""Queries over versions, tasks and listings."""

from pyspark.sql import functions as F

from timespan import fixtures as fx
from timespan.operators import history as hs
from timespan.registry import query

LATEST = "top AS (SELECT project_id, kind, max(version) AS version, arg_max(payload, version) AS payload FROM snapshots GROUP BY project_id, kind)"


@query(fx.sql("snapshots", query="SELECT * FROM top", more=LATEST))
def latest_snapshots(spark, d):
    return hs.latest(fx.snapshots(spark, d))


@query(fx.sql("snapshots", query="SELECT project_id, kind, version, payload FROM snapshots WHERE version = 2"))
def snapshot_at_version(spark, d):
    return hs.at_version(fx.snapshots(spark, d), 2)


@query(fx.sql("snapshots", query="SELECT project_id, kind, version, row_number() OVER (PARTITION BY project_id, kind ORDER BY version DESC) AS place, max(version) OVER (PARTITION BY project_id, kind) + 1 AS next_version FROM snapshots"))
def version_history(spark, d):
    return hs.history(fx.snapshots(spark, d))


@query(fx.sql("snapshots", query="SELECT n.project_id, n.kind, (coalesce(top, 0) + row_number() OVER (PARTITION BY n.project_id, n.kind ORDER BY seq))::BIGINT AS version, payload FROM (SELECT o_custkey::BIGINT AS project_id, 'F' AS kind, o_orderkey AS seq, o_orderpriority AS payload FROM orders) n LEFT JOIN (SELECT project_id, kind, max(version) AS top FROM snapshots GROUP BY ALL) t USING (project_id, kind)"))
def appended_versions(spark, d):
    new = fx.table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("project_id"), F.lit("F").alias("kind"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("payload"))
    return hs.append(fx.snapshots(spark, d), new)


@query(fx.sql("snapshots", query="SELECT a.project_id, a.version AS a_version, a.payload AS a_payload, b.version AS b_version, b.payload AS b_payload FROM top a JOIN top b USING (project_id) WHERE a.kind = 'F' AND b.kind = 'O'", more=LATEST))
def latest_pairs(spark, d):
    return hs.latest_pair(fx.snapshots(spark, d), "F", "O")


@query(fx.sql("snapshots", query="SELECT project_id, kind, version FROM snapshots WHERE project_id % 3 <> 0"))
def cascade_delete(spark, d):
    s = fx.snapshots(spark, d)
    return hs.without_projects(s, s.filter("project_id % 3 = 0")).select("project_id", "kind", "version")


@query(fx.sql("snapshots", query="SELECT project_id, kind, version, 'L' || (o_orderkey % 5) AS label, o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS base, CASE WHEN o_orderkey % 5 = 0 THEN 'n' ELSE '' END AS note, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS n_deletes, CASE WHEN o_orderkey % 4 = 0 THEN '[{\"start_us\":' || o_orderkey || ',\"end_us\":' || (o_orderkey + 10) || '}]' ELSE '[]' END AS deletes FROM snapshots"))
def snapshot_fields(spark, d):
    return hs.fields(fx.snapshots(spark, d))


@query(fx.sql("snapshots", query="SELECT DISTINCT project_id, '/data/' || project_id || '/a.wav' AS path FROM snapshots WHERE NOT starts_with('/data/' || project_id, '/data/1')"))
def referenced_files(spark, d):
    return hs.referenced_files(fx.snapshots(spark, d), "/data/1")


@query(fx.sql("tasks", query="SELECT task_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'completed') / count(*) AS done_share FROM tasks GROUP BY task_id"))
def status_rollup(spark, d):
    return hs.status_rollup(fx.tasks(spark, d))


@query(fx.sql("tasks", query="SELECT task_id, round(least(greatest(sum(seq * progress) / sum(seq), 0), 1), 9) AS progress FROM tasks GROUP BY task_id"))
def weighted_progress(spark, d):
    return hs.weighted_progress(fx.tasks(spark, d)).withColumn("progress", F.round("progress", 9))


@query(fx.sql("tasks", query="SELECT task_id, max(least(0.9, 0.1 + 0.75 * progress)) AS progress, arg_max(status, seq) AS status FROM tasks GROUP BY task_id"))
def monotone_progress(spark, d):
    return hs.monotone_progress(fx.tasks(spark, d), 0.75, 0.1, 0.9)


@query(fx.sql("tasks", query="SELECT * FROM (SELECT task_id, arg_max(status, seq) AS status FROM tasks GROUP BY task_id) WHERE status IN ('queued', 'failed')"))
def retryable_tasks(spark, d):
    return hs.retryable(fx.tasks(spark, d))


@query(fx.sql("snapshots", query="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created DESC, version DESC, kind) AS place FROM (SELECT project_id, kind, max(created) AS created, arg_max(version, (created, version)) AS version FROM snapshots GROUP BY project_id, kind)) WHERE place <= 2"))
def recent_entries(spark, d):
    return hs.recent(fx.snapshots(spark, d), 2)


@query(fx.sql("snapshots", query="SELECT project_id, max(created) AS updated, count(*) AS entries FROM snapshots GROUP BY project_id"))
def project_listing(spark, d):
    return hs.listing(fx.snapshots(spark, d))


@query("SELECT media_id, key FROM (SELECT user_id::BIGINT AS media_id, event_type AS key, arg_max(CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END, event_id) AS s FROM events GROUP BY ALL) WHERE s = 'on'")
def toggled_keys(spark, d):
    e = fx.table(spark, d, "events")
    return hs.last_state(e.select(F.col("user_id").cast("long").alias("media_id"), F.col("event_type").alias("key"), F.when(F.col("event_id") % 2 == 0, "on").otherwise("off").alias("state"), F.col("event_id").alias("seq")))


@query(r"""WITH e AS (SELECT c_custkey::BIGINT AS project_id, c_custkey AS seq, trim(regexp_replace(CASE WHEN c_custkey % 50 = 0 THEN ' .' ELSE c_mktsegment || '/a:' || (c_custkey % 7) END, '[\\/:*?"<>|]+', '_', 'g'), ' ._') AS s FROM customer),
f AS (SELECT project_id, seq, CASE WHEN s = '' THEN 'project_' || project_id ELSE s END AS stem FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY project_id, seq) - 1 AS n FROM f)
SELECT project_id, seq, CASE WHEN n = 0 THEN stem ELSE stem || '_' || n END AS export FROM g""")
def export_names(spark, d):
    c = fx.table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 50 == 0, " .").otherwise(F.concat("c_mktsegment", F.lit("/a:"), (F.col("c_custkey") % 7).cast("string")))
    return hs.export_names(c.select(F.col("c_custkey").cast("long").alias("project_id"), F.col("c_custkey").alias("seq"), name.alias("name")))
