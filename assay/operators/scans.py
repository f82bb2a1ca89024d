"""Scan history: counters, close-out, rates, progress and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import percent_1dp, percent_int, seconds_between
from assay.schemas import STATUSES


def fold_events(events: DataFrame) -> DataFrame:
    """One row per scan from append-only start and finish events.

    ``events(id, kind, at, scope, total, corrupt, unreadable, files_per_sec)``.
    """
    started, finished = F.col("kind") == "start", F.col("kind") == "finish"
    last = lambda c: F.max_by(c, F.when(finished, F.col("at"))).alias(c)
    return events.groupBy("id").agg(
        F.min(F.when(started, F.col("at"))).alias("started_at"),
        F.max(F.when(finished, F.col("at"))).alias("finished_at"),
        *[last(c) for c in ("total", "corrupt", "unreadable", "files_per_sec")],
        F.max_by("scope", F.when(started, F.col("at"))).alias("scope"),
    )


def status_counts(log: DataFrame) -> DataFrame:
    """Per scan: total and one column per status; any other status counts as ``error``."""
    known = [s for s in STATUSES if s != "error"]
    return log.groupBy("scan_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in known],
        F.count_if(~F.coalesce(F.col("status").isin(*known), F.lit(False))).alias("error"),
    )


def rate(total: Column, elapsed: Column) -> Column:
    """Files per second; 0 for less than a millisecond."""
    return F.when(elapsed < 0.001, 0.0).otherwise(total / elapsed)


def close_out(checked: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Final scan numbers from verdicts with a ``discarded`` flag.

    Discarded verdicts count as processed but not as examined; skipped files as both.
    """
    kept = ~F.col("discarded")
    out = checked.groupBy("scan_id").agg(
        F.count("*").alias("_checked"),
        F.count_if("discarded").alias("discards"),
        F.count_if(kept & (F.col("status") == "corrupt")).alias("corrupt"),
        F.count_if(kept & (F.col("status") == "unreadable")).alias("unreadable"),
        F.min("checked_at").alias("_from"),
        F.max("checked_at").alias("_to"),
    )
    if skipped is None:
        out = out.withColumn("skipped", F.lit(0).cast("long"))
    else:
        per_scan = skipped.groupBy("scan_id").agg(F.count("*").alias("_skipped"))
        out = out.join(per_scan, "scan_id", "left").withColumn(
            "skipped", F.coalesce("_skipped", F.lit(0).cast("long"))
        )
    processed = F.col("_checked") + F.col("skipped")
    return out.select(
        "scan_id",
        processed.alias("processed"),
        "skipped",
        "discards",
        F.greatest(processed - F.col("discards"), F.lit(0).cast("long")).alias("total"),
        "corrupt",
        "unreadable",
        rate(F.col("_checked") - F.col("discards"), seconds_between(F.col("_from"), F.col("_to"))).alias(
            "files_per_sec"
        ),
    )


def completion(finished_at: Column | str = "finished_at") -> Column:
    c = F.col(finished_at) if isinstance(finished_at, str) else finished_at
    return F.when(c.isNotNull(), "complete").otherwise("incomplete")


def scan_state(issues: Column, finished_at: Column | str = "finished_at") -> Column:
    c = F.col(finished_at) if isinstance(finished_at, str) else finished_at
    return F.when(c.isNull(), "incomplete").when(issues > 0, "completed with issues").otherwise("completed")


def last_rate(scans: DataFrame) -> DataFrame:
    """Rate of the scan that finished last, in one row; null for none or zero."""
    return scans.agg(
        F.nullif(F.max_by("files_per_sec", "finished_at"), F.lit(0.0)).alias("files_per_sec")
    )


def scan_eta(to_check: DataFrame, scans: DataFrame) -> DataFrame:
    """One row: files to check, last rate, and the seconds that takes."""
    none = lambda kind: F.lit(None).cast(kind)
    total = to_check.agg(F.count_if("needs_check").alias("files"), none("double").alias("files_per_sec"))
    speed = last_rate(scans).select(none("long").alias("files"), "files_per_sec")
    return (
        total.unionByName(speed)
        .agg(F.max("files").alias("files"), F.max("files_per_sec").alias("files_per_sec"))
        .withColumn("eta_s", F.col("files") / F.col("files_per_sec"))
    )


def progress(counts: DataFrame) -> DataFrame:
    """Adds remaining, eta and percentages to ``(discovered, processed, files_per_sec)``."""
    remaining = F.greatest(F.col("discovered") - F.col("processed"), F.lit(0).cast("long"))
    return (
        counts.withColumn("remaining", remaining)
        .withColumn(
            "eta_s",
            F.when(
                (F.col("files_per_sec") > 0) & (F.col("remaining") > 0),
                F.col("remaining") / F.col("files_per_sec"),
            ),
        )
        .withColumn("percent", percent_1dp(F.col("processed"), F.col("discovered"), half_even=True))
        .withColumn("percent_int", percent_int(F.col("processed"), F.col("discovered")))
    )


def last_runs(runs: DataFrame) -> DataFrame:
    """Latest run per origin, plus the latest overall in the row with a null origin.

    ``runs(origin, scan_id, state, started_at, finished_at, processed, corrupt, unreadable,
    last_error)``; a run without an end counts by its start.
    """
    body = F.struct(
        "scan_id", "state", "started_at", "finished_at", "processed",
        (F.col("corrupt") + F.col("unreadable")).alias("issues"), "last_error",
    )
    when = F.struct(F.coalesce("finished_at", "started_at"), F.col("scan_id"))
    return (
        runs.select("origin", body.alias("body"), when.alias("at"))
        .rollup("origin")
        .agg(F.max_by("body", "at").alias("body"))
        .select("origin", "body.*")
    )
