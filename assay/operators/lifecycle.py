"""The life of a scan as append-only records, folded to one row per scan.

A scan is queued in parts and begins with a ``start`` record. A part is done when its progress
record is there, which is written after its verdicts. Resuming adds a start record with the
next attempt; a ``finish`` record closes the scan. Records can be written again, by a step that
is repeated after a failure: the fold takes one progress record for each part, and the earliest
start and the latest finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.history import latest
from assay.operators.scans import completion, rate
from assay.schemas import STATUSES

PART = ["scan_id", "part"]
SUMS = ["processed", "skipped", "discards", *STATUSES]


def part_of(path: Column | str, parts: int) -> Column:
    """The part of a scan that a path belongs to, the same in every attempt."""
    return F.pmod(F.xxhash64(path), F.lit(parts)).cast("int")


def committed(progress: DataFrame) -> DataFrame:
    """One record for each part: that of its last attempt, whose verdicts stand in the log."""
    return latest(progress, PART, ["attempt", "at"])


def counts(progress: DataFrame) -> DataFrame:
    """Per scan the sums over its parts that are done, and the rate over the time they took.

    Discarded verdicts count as processed but not as examined, skipped files as both.
    """
    sums = committed(progress).groupBy("scan_id").agg(
        F.count("*").alias("parts_done"),
        *[F.sum(c).alias(c) for c in SUMS],
        F.sum("elapsed_s").alias("elapsed_s"),
    )
    examined = F.col("processed") - F.col("discards")
    return sums.withColumns(
        {
            "total": F.greatest(examined, F.lit(0).cast("long")),
            "files_per_sec": rate(examined - F.col("skipped"), F.col("elapsed_s")),
        }
    )


def fold(events: DataFrame, progress: DataFrame) -> DataFrame:
    """One row per started scan, finished or not: when it ran, in how many attempts, and what it
    has done so far. Counts of a scan without a part that is done are 0."""
    start, finish = F.col("kind") == "start", F.col("kind") == "finish"
    runs = events.groupBy(F.col("id").alias("scan_id")).agg(
        F.min(F.when(start, F.col("at"))).alias("started_at"),
        F.max(F.when(finish, F.col("at"))).alias("finished_at"),
        F.max("attempt").alias("attempts"),
        F.min_by("scope", F.when(start, F.struct("attempt", "at"))).alias("scope"),
    )
    done = counts(progress)
    zero = {c: F.coalesce(c, F.lit(0)) for c in done.columns if c != "scan_id"}
    out = runs.where("started_at IS NOT NULL").join(done, "scan_id", "left").withColumns(zero)
    return out.withColumn("state", completion())


def scan_table(events: DataFrame, progress: DataFrame) -> DataFrame:
    """The scans as reports read them; numbers of a scan that has not finished are null."""
    ended = F.col("finished_at").isNotNull()
    numbers = [F.when(ended, F.col(c)).alias(c) for c in ("total", "corrupt", "unreadable", "files_per_sec")]
    return fold(events, progress).select(F.col("scan_id").alias("id"), "started_at", "finished_at", "scope", *numbers)


def pending(queue: DataFrame, progress: DataFrame) -> DataFrame:
    """Queued paths ``(scan_id, part, path)`` of parts that are not done."""
    return queue.join(progress.select(*PART).distinct(), PART, "left_anti")


def with_done(queue: DataFrame, progress: DataFrame) -> DataFrame:
    """The queue as ``(scan_id, path, done)``."""
    done = progress.select(*PART).distinct().withColumn("_done", F.lit(True))
    return queue.join(done, PART, "left").select("scan_id", "path", F.coalesce("_done", F.lit(False)).alias("done"))
