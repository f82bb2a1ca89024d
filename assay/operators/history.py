"""Operators over the verdict log: latest row, previous verdict, running position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.segmented import prefixes
from assay.operators.skew import join_facts
from assay.schemas import ISSUE_STATUSES
from assay.session import ensure_checkpoint_dir

ORDER = ("checked_at", "seq")
_NULL = "\0"


def is_issue(status: Column | str = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*ISSUE_STATUSES)


def latest(log: DataFrame, keys: Sequence[str] = ("path",), order: Sequence[str] = ORDER) -> DataFrame:
    """Last row per key.

    The rank limit runs before the shuffle too, so each map task sends one row per key
    however long that key's history is, and unused columns are still pruned.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def with_history(log: DataFrame) -> DataFrame:
    """Adds ``prev_status`` and ``had_issue`` (any earlier issue of the path).

    The log is read and shuffled once, and a path that owns a large part of it is spread over
    many tasks. A null status is a status: it is what the next row had before. Select the
    columns that are wanted first; all of them go through the layout.
    """
    # nulls are told from paths without an earlier row
    known = F.coalesce("status", F.lit(_NULL))
    found = prefixes(log, ["path"], ORDER, {"prev_status": known}, {"had_issue": is_issue()})
    return found.withColumn("prev_status", F.nullif("prev_status", F.lit(_NULL)))


def transitions(log: DataFrame, before: str = "ok", after: str = "corrupt") -> DataFrame:
    """Rows where a path went from one status straight to another."""
    return with_history(log).where((F.col("status") == after) & (F.col("prev_status") == before))


def _raises_alert(prev_status: Column, had_issue: Column) -> Column:
    relapse = (F.col("status") == "corrupt") & F.coalesce(prev_status == "ok", F.lit(False))
    return is_issue() & (~had_issue | relapse)


def alerts(log: DataFrame) -> DataFrame:
    """Rows that raise an alert when every alert is delivered.

    A path alerts on its first issue and again only when it is corrupt right after ok.
    """
    return with_history(log).where(_raises_alert(F.col("prev_status"), F.col("had_issue")))


def alert_state(log: DataFrame) -> DataFrame:
    """What the alert rule has to remember of a log: last status and any issue, per path."""
    return log.groupBy("path").agg(
        F.max_by("status", F.struct(*ORDER)).alias("status"), F.max(is_issue()).alias("had_issue")
    )


def advance_state(new: DataFrame, known: DataFrame) -> DataFrame:
    """State of the paths in ``new`` after its rows."""
    before = known.select("path", F.col("had_issue").alias("_had"))
    return (
        alert_state(new)
        .join(before, "path", "left")
        .select("path", "status", (F.col("had_issue") | F.coalesce("_had", F.lit(False))).alias("had_issue"))
    )


def alerts_since(new: DataFrame, known: DataFrame) -> DataFrame:
    """Alerts of later verdicts, given the state of the earlier ones.

    The old log is not read. What is known of a path is joined once to its new rows, and a
    path with very many of them is split.
    """
    before = known.select("path", F.col("status").alias("_was"), F.col("had_issue").alias("_had"))
    counts = new.groupBy("path").agg(F.count("*").alias("n"))
    rows = join_facts(with_history(new), before, "path", counts)
    prev = F.coalesce("prev_status", "_was")
    had = F.col("had_issue") | F.coalesce("_had", F.lit(False))
    return rows.where(_raises_alert(prev, had)).select(*new.columns)


def group_positions(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """1-based position of every row in its group, for groups of any size.

    One range shuffle lays the rows out in order; the position within a range partition is
    shifted by the number of the group's rows in earlier partitions. A group that holds
    most of the table is thereby spread over as many tasks as it fills. The layout is
    checkpointed because a second evaluation could sample other range bounds.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [*groups, *order]
    laid = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_part", F.shiftright("_at", 33))
    )
    starts = laid.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = starts.select(
        *groups,
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    # rows whose group is null are a group too
    shifts = shifts.select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.col("_part").alias("_in"), "_shift")
    same = [laid[g].eqNullSafe(shifts[f"_of_{g}"]) for g in groups]
    together = laid.join(shifts, [laid["_part"] == shifts["_in"], *same])
    return together.select(*[laid[c] for c in df.columns], (F.col("_at") + F.col("_shift")).alias(name))


def running_processed(log: DataFrame) -> DataFrame:
    """Number of files a scan had processed when each verdict was written."""
    return group_positions(log, ["scan_id"], ORDER, "processed")
