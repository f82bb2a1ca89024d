"""Inventory against catalog: what has to be checked, and what changed meanwhile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.paths import excluded, scan_ext
from assay.functions.text import parse_iso_utc
from assay.operators.history import is_issue


def merge_roots(*inventories: DataFrame) -> DataFrame:
    """Inventories of several roots; a path seen below two roots counts once."""
    out = inventories[0]
    for other in inventories[1:]:
        out = out.unionByName(other)
    return out.dropDuplicates(["path"])


def select_inventory(inventory: DataFrame, extensions: list[str], excludes: list[str]) -> DataFrame:
    """Known extensions that no exclusion glob matches."""
    return inventory.where(scan_ext("path").isin(*extensions) & ~excluded("path", excludes))


def classify(
    inventory: DataFrame, catalog: DataFrame, as_of: Column, force_recheck_days: int = 0
) -> DataFrame:
    """Adds ``reason`` (new, changed, stale, fresh) and ``needs_check``.

    The catalog side carries four narrow columns. A stored ``(0, 0)`` for a file that still
    can not be stat-ed is unchanged, so it is not checked again.
    """
    known = catalog.select(
        "path",
        F.col("mtime").alias("_mtime"),
        F.col("size").alias("_size"),
        F.col("checked_at").alias("_at"),
        F.lit(True).alias("_known"),
    )
    same = F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size"))
    at, unreadable_at = F.col("_at"), F.lit(False)
    if isinstance(catalog.schema["checked_at"].dataType, T.StringType):
        at = parse_iso_utc("_at")
        unreadable_at = at.isNull() & (F.length("_at") > 0)
    overdue = F.lit(False)
    if force_recheck_days > 0:
        days = F.timestamp_diff("DAY", at, as_of)
        overdue = unreadable_at | F.coalesce(days >= force_recheck_days, F.lit(False))
    reason = (
        F.when(F.col("_known").isNull(), "new")
        .when(~same, "changed")
        .when(overdue, "stale")
        .otherwise("fresh")
    )
    return (
        inventory.join(known, "path", "left")
        .withColumn("reason", reason)
        .withColumn("needs_check", F.col("reason") != "fresh")
        .drop("_mtime", "_size", "_at", "_known")
    )


def estimate(classified: DataFrame) -> DataFrame:
    """Files that need a check, per extension."""
    return classified.where("needs_check").groupBy(scan_ext("path").alias("ext")).agg(F.count("*").alias("files"))


def dry_run(inventory: DataFrame) -> DataFrame:
    """Inventory count per extension, and the total in the row with a null extension."""
    per_ext = inventory.groupBy(scan_ext("path").alias("ext")).agg(F.count("*").alias("files"))
    total = per_ext.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"))
    return per_ext.unionByName(total.select(F.lit(None).cast("string").alias("ext"), "files"))


def guard_changes(verdicts: DataFrame, post: DataFrame) -> DataFrame:
    """Adds ``discarded``: the file changed or vanished while it was being checked."""
    after = post.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    same = (F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size"))
    return (
        verdicts.join(after, "path", "left")
        .withColumn("discarded", ~F.coalesce(same, F.lit(False)))
        .drop("_mtime", "_size")
    )


def unnotified(catalog: DataFrame, *statuses: str) -> DataFrame:
    cond = F.col("status").isin(*statuses) if statuses else is_issue()
    return catalog.where(cond & F.col("notified_at").isNull())


def mark_notified(catalog: DataFrame, delivered: DataFrame) -> DataFrame:
    """Sets ``notified_at`` from ``delivered(path, delivered_at)``, keeps it elsewhere."""
    latest_delivery = delivered.groupBy("path").agg(F.max("delivered_at").alias("_delivered"))
    return (
        catalog.join(latest_delivery, "path", "left")
        .withColumn("notified_at", F.coalesce("_delivered", "notified_at"))
        .drop("_delivered")
    )
