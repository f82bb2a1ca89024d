"""Alert digests: counts per scan over all rows, and the first paths of each category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.text import seconds_between
from assay.operators.history import alert_state, alerts_since
from assay.schemas import ISSUE_STATUSES

# Paths listed per category, and the ratio that hints at a mount failure.
LISTED = 50
SYSTEMIC_RATIO = 0.5


def systemic(log: DataFrame, threshold: float = SYSTEMIC_RATIO) -> DataFrame:
    """Per scan: is the share of unreadable files so high that the mount is suspect?"""
    return (
        log.groupBy("scan_id")
        .agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "unreadable").alias("unreadable"))
        .withColumn(
            "suspected",
            (F.col("checked") > 0) & (F.col("unreadable") / F.col("checked") >= F.lit(threshold)),
        )
    )


def alerts_of_scan(log: DataFrame, scan_id: str) -> DataFrame:
    """Alerts a scan raised, given what stood in the log before its first row.

    The log is partitioned by scan, so the first part reads that scan only; of the rest two
    columns per path are kept. What came later is no history of the scan.
    """
    own = log.where(F.col("scan_id") == scan_id)
    begin = own.agg(F.min(F.struct("checked_at", "seq")).alias("begin"))
    before = log.where(F.col("scan_id") != scan_id).join(F.broadcast(begin))  # one row
    before = before.where(F.struct("checked_at", "seq") < F.col("begin"))
    return alerts_since(own, alert_state(before))


def digest(alerts: DataFrame, scans: DataFrame, listed: int = LISTED, log: DataFrame | None = None) -> DataFrame:
    """One row per scan with alerts: counts, the newest ``listed`` files and the remainder.

    With the verdict ``log`` also how many files of the scan were ``checked`` and how many of
    them were ``unreadable_all``, whether they alert or not: what a mount failure shows in.

    The rank limit is applied before the shuffle, so a scan with most of the alerts sends
    ``listed`` rows per task and category, and no list grows with the data. Counts and
    lists each read ``alerts``: pass a stored table, not a plan that is costly to repeat.
    """
    counts = alerts.groupBy("scan_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ISSUE_STATUSES]
    )
    w = Window.partitionBy("scan_id", "status").orderBy(F.desc("checked_at"), "path", F.desc("seq"))
    first = (
        alerts.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= listed)
        .groupBy("scan_id")
        .agg(
            *[
                F.transform(
                    F.array_sort(
                        F.collect_list(F.when(F.col("status") == s, F.struct("_rank", "path", "error")))
                    ),
                    lambda r: F.struct(r["path"].alias("path"), r["error"].alias("error")),
                ).alias(s)
                for s in ISSUE_STATUSES
            ]
        )
    )
    about = scans.select(
        F.col("id").alias("scan_id"),
        "scope",
        F.col("total").alias("total_checked"),
        F.coalesce(
            F.greatest(seconds_between(F.col("started_at"), F.col("finished_at")), F.lit(0.0)), F.lit(0.0)
        ).alias("duration_s"),
    )
    more = [
        F.greatest(F.col(f"{s}_count") - listed, F.lit(0).cast("long")).alias(f"{s}_more") for s in ISSUE_STATUSES
    ]
    out = counts.join(first, "scan_id").join(about, "scan_id", "left").select("*", *more)
    if log is None:
        return out
    seen = systemic(log).select("scan_id", "checked", F.col("unreadable").alias("unreadable_all"))
    return out.join(seen, "scan_id", "left")


def messages(digests: DataFrame, product: str = "Library", threshold: float = SYSTEMIC_RATIO) -> DataFrame:
    """Subject, title, body and payload of each digest that was made with the verdict log."""
    none = F.array().cast("array<string>")
    only = lambda condition, lines: F.when(condition, lines).otherwise(none)
    head = F.array(
        F.format_string(f"{product} check %s of %s", "scan_id", "scope"),
        F.format_string("%d files in %.1f s", "total_checked", F.bround("duration_s", 1)),
    )
    share = F.col("unreadable_all") / F.col("checked")
    mount = F.format_string(
        "Is %s mounted? %d of %d files could not be read.", "scope", "unreadable_all", "checked"
    )

    def section(status: str, name: str) -> Column:
        count, more = F.col(f"{status}_count"), F.col(f"{status}_more")
        line = lambda r: F.concat(
            F.lit("- "), r["path"], F.when(F.length(r["error"]) > 0, F.concat(F.lit(": "), r["error"])).otherwise("")
        )
        lines = F.concat(
            F.array(F.format_string(f"{name}: %d", count)),
            F.transform(status, line),
            only(more > 0, F.array(F.format_string("- %d others", more))),
        )
        return only(count > 0, lines)

    issues = F.col("corrupt_count") + F.col("unreadable_count")
    body = F.concat(
        head,
        only((F.col("checked") > 0) & (share >= F.lit(threshold)), F.array(mount)),
        section("corrupt", "Damaged"),
        section("unreadable", "Unreadable"),
        only(issues == 0, F.array(F.lit("Nothing to report."))),
    )
    out = digests.select(
        "scan_id",
        F.format_string(
            f"{product} check of %s: %d damaged, %d unreadable", "scope", "corrupt_count", "unreadable_count"
        ).alias("subject"),
        F.format_string(f"{product}: %d damaged", "corrupt_count").alias("title"),
        F.array_join(body, "\n").alias("message"),
    )
    return out.withColumn("payload", F.to_json(F.struct("title", "message", "scan_id")))
