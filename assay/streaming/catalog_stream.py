"""Continuous catalog maintenance.

Each batch is folded to one row per path and kept as a delta; readers fold the compacted
buckets and the deltas after them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from assay.operators.catalog import fold
from assay.schemas import VERDICT_LOG
from assay.streaming.sinks import drain
from assay.streaming.state_table import StateTable


def state(spark: SparkSession, folder: str, schema: T.StructType = VERDICT_LOG) -> StateTable:
    return StateTable(spark, folder, ["path"], schema, fold)


def current(spark: SparkSession, folder: str, schema: T.StructType = VERDICT_LOG) -> DataFrame:
    """The catalog as of the last finished batch; empty before the first one. ``schema`` is that of
    the log, or a part of it."""
    return state(spark, folder, schema).current()


def maintain(log: DataFrame, folder: str, checkpoint: str, compact_every: int = 20):
    def fn(batch: DataFrame, batch_id: int) -> None:
        table = state(batch.sparkSession, folder, batch.schema)
        table.add(fold(batch), batch_id)
        if batch_id % compact_every == compact_every - 1:
            table.compact(batch_id)

    return drain(log, fn, checkpoint).start()
