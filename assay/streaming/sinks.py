"""Idempotent micro-batch writes.

A batch that is run again after a failure writes the same folder again, so restarts neither
lose nor repeat rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

BatchFn = Callable[[DataFrame, int], None]


def to_folder(folder: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> BatchFn:
    """Writes each batch to ``folder/batch=<id>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if prepare is None else prepare(batch)
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def drain(stream: DataFrame, fn: BatchFn, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Processes what is there and stops; the next run goes on after it."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(fn)
    )
