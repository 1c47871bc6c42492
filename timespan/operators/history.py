"""Versions, tasks and listings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timespan.functions.text import clean_stem, strip


def latest(snapshots: DataFrame) -> DataFrame:
    """The latest version of each project and kind."""
    return snapshots.groupBy("project_id", "kind").agg(F.max("version").alias("version"), F.max_by("payload", "version").alias("payload"))


def at_version(snapshots: DataFrame, version: int | None) -> DataFrame:
    return latest(snapshots) if version is None else snapshots.filter(F.col("version") == version).select("project_id", "kind", "version", "payload")


def history(snapshots: DataFrame) -> DataFrame:
    """place 1 is the newest version; next_version is what a save would get."""
    w = Window.partitionBy("project_id", "kind")
    return snapshots.select("project_id", "kind", "version", F.row_number().over(w.orderBy(F.desc("version"))).alias("place"), (F.max("version").over(w) + 1).alias("next_version"))


def append(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """new (project_id, kind, seq, payload) with the versions that follow the latest ones."""
    top = snapshots.groupBy("project_id", "kind").agg(F.max("version").alias("top"))
    rank = F.row_number().over(Window.partitionBy("project_id", "kind").orderBy("seq"))
    return new.withColumn("rank", rank).join(top, ["project_id", "kind"], "left").select("project_id", "kind", (F.coalesce("top", F.lit(0)) + F.col("rank")).alias("version"), "payload")


def latest_pair(snapshots: DataFrame, a: str, b: str) -> DataFrame:
    """Projects that have both kinds, with the latest versions of each."""
    top = latest(snapshots)
    one = top.filter(F.col("kind") == a).select("project_id", F.col("version").alias("a_version"), F.col("payload").alias("a_payload"))
    return one.join(top.filter(F.col("kind") == b).select("project_id", F.col("version").alias("b_version"), F.col("payload").alias("b_payload")), "project_id")


def without_projects(snapshots: DataFrame, deleted: DataFrame) -> DataFrame:
    return snapshots.join(deleted.select("project_id").distinct(), "project_id", "left_anti")


def fields(snapshots: DataFrame) -> DataFrame:
    """Version (0 if missing), trimmed label or empty, note or empty, the base version and delete ranges ([] if none, as JSON) of the payload."""
    p = F.from_json("payload", "key BIGINT, label STRING, note STRING, base BIGINT, deletes ARRAY<STRUCT<start_us: BIGINT, end_us: BIGINT>>")
    df, none = snapshots.withColumn("p", p), F.expr("cast(array() AS ARRAY<STRUCT<start_us: BIGINT, end_us: BIGINT>>)")
    return df.select(
        "project_id", "kind", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce(strip(F.col("p.label")), F.lit("")).alias("label"), F.coalesce("p.note", F.lit("")).alias("note"), F.col("p.key").alias("key"),
        F.col("p.base").alias("base"), F.coalesce(F.size("p.deletes"), F.lit(0)).alias("n_deletes"), F.to_json(F.coalesce("p.deletes", none)).alias("deletes"),
    )


def referenced_files(snapshots: DataFrame, keep_root: str) -> DataFrame:
    """Absolute paths anywhere in the payloads, but those under keep_root."""
    found = F.explode(F.regexp_extract_all("payload", F.lit(r'"(/[^"]+)"'), F.lit(1))).alias("path")
    return snapshots.select("project_id", found).filter(~F.startswith("path", F.lit(keep_root))).distinct()


def status_rollup(tasks: DataFrame) -> DataFrame:
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running", "queued")}
    return tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("total"), *n.values()).withColumn("done_share", F.col("completed") / F.col("total"))


def weighted_progress(tasks: DataFrame) -> DataFrame:
    p = F.sum(F.col("seq") * F.col("progress")) / F.sum("seq")
    return tasks.groupBy("task_id").agg(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("progress"))


def monotone_progress(tasks: DataFrame, scale: float = 1.0, base: float = 0.0, cap: float = 0.95) -> DataFrame:
    """The largest capped progress so far, and the status of the last event."""
    now = F.least(F.lit(cap), F.lit(base) + F.lit(scale) * F.least(F.greatest("progress", F.lit(0.0)), F.lit(1.0)))
    return tasks.groupBy("task_id").agg(F.max(now).alias("progress"), F.max_by("status", "seq").alias("status"))


def retryable(tasks: DataFrame) -> DataFrame:
    """Items whose last status lets them run again."""
    return tasks.groupBy("task_id").agg(F.max_by("status", "seq").alias("status")).filter("status IN ('queued', 'failed')")


def recent(rows: DataFrame, most: int = 8) -> DataFrame:
    """Each project's kinds by their newest entry, `most` at most."""
    newest = rows.groupBy("project_id", "kind").agg(F.max("created").alias("created"), F.max_by("version", F.struct("created", "version")).alias("version"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created"), F.desc("version"), "kind"))
    return newest.withColumn("place", place).filter(F.col("place") <= most)


def listing(rows: DataFrame) -> DataFrame:
    """Projects by their newest entry, the newest first."""
    return rows.groupBy("project_id").agg(F.max("created").alias("updated"), F.count(F.lit(1)).alias("entries")).orderBy(F.desc("updated"), "project_id")


def last_state(events: DataFrame) -> DataFrame:
    """Keys whose last toggle is 'on'."""
    return events.groupBy("media_id", "key").agg(F.max_by("state", "seq").alias("state")).filter("state = 'on'").select("media_id", "key")


def export_names(exports: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Clean stems in the order of project and seq; one that is taken gets the first of _1, _2 and so on that is free. existing: export (names that are taken from the start).

    A stem and its numbered forms have a root in common, the stem without its numbers. Roots with one stem and no name
    that exists are numbered by a window; only the others, where a stem can meet another's number, are folded.
    """
    root = F.regexp_replace("stem", r"(_\d+)+$", "")
    named = exports.select("project_id", "seq", clean_stem(F.col("name"), F.col("project_id")).alias("stem")).withColumn("root", root)
    stems = named.select("root", "stem").distinct()
    if existing is not None:
        taken = existing.select(F.col("export").alias("stem")).withColumn("root", root)
        stems = stems.unionByName(taken.select("root", "stem"))
    mixed = stems.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root")
    n = F.row_number().over(Window.partitionBy("stem").orderBy("project_id", "seq")) - 1
    plain = named.join(mixed, "root", "left_anti").withColumn("n", n)
    plain = plain.select("project_id", "seq", F.when(F.col("n") == 0, F.col("stem")).otherwise(F.concat_ws("_", "stem", F.col("n").cast("string"))).alias("export"))
    rows = named.join(mixed, "root", "left_semi").withColumn("taken", F.lit(False))
    if existing is not None:
        held = taken.select(F.lit(None).cast("long").alias("project_id"), F.lit(None).cast("long").alias("seq"), "stem", "root", F.lit(True).alias("taken"))
        rows = rows.unionByName(held.join(mixed, "root", "left_semi"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, last, out = set(pdf.loc[pdf["taken"], "stem"]), {}, []
        for r in pdf[~pdf["taken"]].sort_values(["project_id", "seq"]).itertuples():
            name = r.stem
            while name in used:
                last[r.stem] = last.get(r.stem, 0) + 1
                name = f"{r.stem}_{last[r.stem]}"
            used.add(name)
            out.append((r.project_id, r.seq, name))
        return pd.DataFrame(out, columns=["project_id", "seq", "export"])

    return plain.unionByName(rows.groupBy("root").applyInPandas(fold, "project_id long, seq long, export string"))
