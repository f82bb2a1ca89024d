"""Work queue of a scan and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.changes import classify

KEY = ["scan_id", "path"]


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Queue with ``new(scan_id, path)`` added as not done; known keys stay as they are."""
    fresh = new.select(*KEY).dropDuplicates(KEY).join(queue.select(*KEY), KEY, "left_anti")
    return queue.unionByName(fresh.withColumn("done", F.lit(False)))


def mark_done(queue: DataFrame, finished: DataFrame) -> DataFrame:
    done_now = finished.select(*KEY).dropDuplicates(KEY).withColumn("_done", F.lit(True))
    return (
        queue.join(done_now, KEY, "left")
        .withColumn("done", F.coalesce("_done", "done"))
        .drop("_done")
    )


def pending(queue: DataFrame, scan_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows that are not done; with ``limit`` the first ones by scan and path."""
    rows = queue.where(~F.col("done"))
    if scan_id is not None:
        rows = rows.where(F.col("scan_id") == scan_id)
    return rows.select(*KEY) if limit is None else rows.select(*KEY).orderBy(*KEY).limit(limit)


def without_finished(queue: DataFrame, scan_id: str | None = None) -> DataFrame:
    gone = F.col("done") if scan_id is None else F.col("done") & (F.col("scan_id") == scan_id)
    return queue.where(~gone)


def stale_scan_ids(queue: DataFrame, scans: DataFrame, as_of: Column, max_age_days: int = 7) -> DataFrame:
    """Unfinished scans with queue rows that started ``max_age_days`` calendar days ago or
    earlier. The queue is reduced to its distinct scans before the join."""
    old = scans.where(
        F.col("finished_at").isNull() & (F.to_date("started_at") <= F.date_sub(F.to_date(as_of), max_age_days))
    )
    return queue.select("scan_id").distinct().join(old.select(F.col("id").alias("scan_id")), "scan_id")


def drop_stale(queue: DataFrame, stale: DataFrame) -> DataFrame:
    return queue.join(stale, "scan_id", "left_anti")


def restat(paths: DataFrame, inventory: DataFrame) -> DataFrame:
    """Current mtime and size of queued paths; ``(0, 0)`` when the file is gone."""
    now = inventory.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    return (
        paths.join(now, "path", "left")
        .withColumn("mtime", F.coalesce("_mtime", F.lit(0.0)))
        .withColumn("size", F.coalesce("_size", F.lit(0).cast("long")))
        .drop("_mtime", "_size")
    )


def resume_worklist(
    queue: DataFrame,
    inventory: DataFrame,
    catalog: DataFrame,
    as_of: Column,
    force_recheck_days: int = 0,
    scan_id: str | None = None,
) -> DataFrame:
    return classify(restat(pending(queue, scan_id), inventory), catalog, as_of, force_recheck_days)
