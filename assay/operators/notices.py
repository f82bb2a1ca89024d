"""Notification state: when the owner of a path was last told about its trouble.

A verdict or a delivery is a function on the state ``(status, notified_at)`` of a path: a
delivery sets the time, a verdict sets the status, and one that finds a file corrupt right
after ok takes the time away, so that the relapse is reported again. A run of such functions
is again one: it is known by its first verdict, its last verdict, its last relapse and its last
delivery. These are minima and maxima, so the rows of a path are put together before they are
shuffled, whatever their number, and a stored state is one more run in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators.history import ORDER, with_history

STATE = ("path", "status", "checked_at", "seq", "notified_at", "relapsed_at")


def relapses(verdicts: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """``(path, checked_at, seq, relapse)`` of every verdict: was the file ok right before?"""
    rows = verdicts.select("path", "status", *ORDER, F.lit(True).alias("_new"))
    if state is not None:  # what is stored stands before the first new verdict
        rows = rows.unionByName(state.select("path", "status", *ORDER, F.lit(False).alias("_new")))
    relapse = (F.col("status") == "corrupt") & (F.col("prev_status") == "ok")
    return with_history(rows).where("_new").select("path", *ORDER, F.coalesce(relapse, F.lit(False)).alias("relapse"))


def advance(verdicts: DataFrame, deliveries: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """``(path, status, checked_at, seq, notified_at, relapsed_at)`` of every path after all
    verdicts and deliveries, from a stored ``state`` of the same columns on.

    ``deliveries(path, delivered_at)`` of a path count from its first verdict on; one at the
    time of a verdict comes after it. Deliveries can be late or be given again: one before the
    last relapse or before a later delivery changes nothing. New verdicts must be later than
    the stored ones of their path. A path keeps its state if nothing new is known of it; an
    unknown path that only has deliveries gets none.
    """
    last = F.max(F.struct(*ORDER, "status")).alias("last")
    new = verdicts.groupBy("path").agg(last, F.min("checked_at").alias("_begin"))
    broken = relapses(verdicts, state).where("relapse").groupBy("path").agg(F.max("checked_at").alias("_relapse"))
    told = deliveries.groupBy("path").agg(F.max("delivered_at").alias("_told"))
    rows = new.join(broken, "path", "left")
    if state is None:
        kind = lambda c: verdicts.schema["checked_at" if c.endswith("_at") else c].dataType.simpleString()
        stored = ", ".join(f"{c}:{kind(c)}" for c in STATE[1:])
        rows = rows.withColumn("_stored", F.lit(None).cast(f"struct<{stored}>"))
    else:
        rows = rows.join(state.select("path", F.struct(*STATE[1:]).alias("_stored")), "path", "full")
    rows = rows.join(told, "path", "left")
    relapse = F.greatest("_relapse", "_stored.relapsed_at")
    there = F.col("_stored").isNotNull() | (F.col("_told") >= F.col("_begin"))
    latest_told = F.greatest(F.when(there, F.col("_told")), "_stored.notified_at")
    return rows.select(
        "path",
        *[F.coalesce(f"last.{c}", f"_stored.{c}").alias(c) for c in ("status", *ORDER)],
        F.when(relapse.isNull() | (latest_told >= relapse), latest_told).alias("notified_at"),
        relapse.alias("relapsed_at"),
    )
