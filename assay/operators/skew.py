"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key a single task may get; more are split over several tasks.
ROWS_PER_TASK = 1_000_000


def join_facts(
    rows: DataFrame, facts: DataFrame, key: str, counts: DataFrame | None = None, per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Left join of ``rows`` to ``facts``, which has one row per key.

    Keys with more than ``per_task`` rows get several copies of their fact, and their rows
    are dealt out over the copies. ``counts(key, n)`` is the number of rows per key where a
    cheaper way than counting ``rows`` exists. At most rows / per_task keys are above the
    limit, which bounds the broadcast list of them.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    hot = F.broadcast(
        counts.where(F.col(key).isNotNull() & (F.col("n") > per_task)).select(
            key, F.ceil(F.col("n") / per_task).cast("int").alias("_copies")
        )
    )
    dealt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_copies")).cast("int"), F.lit(0))
    salted = rows.join(hot, key, "left").withColumn("_salt", dealt).drop("_copies")
    all_copies = F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))
    copied = facts.join(hot, key, "left").withColumn("_salt", all_copies).drop("_copies")
    return salted.join(copied, [key, "_salt"], "left").drop("_salt")
