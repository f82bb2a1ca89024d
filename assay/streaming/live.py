"""Live counters over the verdict log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from assay.streaming.sinks import drain
from assay.streaming.state_table import StateTable


def counts(log: DataFrame) -> DataFrame:
    """Verdicts per scan and status; partial counts are combined before the shuffle."""
    return log.groupBy("scan_id", "status").agg(F.count("*").alias("cnt"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scan_id", "status").agg(F.sum("cnt").alias("cnt"))


def state(spark: SparkSession, folder: str) -> StateTable:
    schema = T.StructType().add("scan_id", "string").add("status", "string").add("cnt", "long")
    return StateTable(spark, folder, ["scan_id"], schema, _summed)


def publish_counts(log: DataFrame, folder: str, checkpoint: str, compact_every: int = 20):
    """Each batch adds its own counts, in a folder that it rewrites if it is run again; now and
    then they are summed up. A batch neither reads nor writes what earlier ones counted."""

    def fn(batch: DataFrame, batch_id: int) -> None:
        table = state(batch.sparkSession, folder)
        table.add(counts(batch), batch_id)
        if batch_id % compact_every == compact_every - 1:
            table.compact(batch_id)

    return drain(log, fn, checkpoint).start()


def current_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of all batches so far."""
    return state(spark, folder).current()


class ProgressListener(StreamingQueryListener):
    """Hands batch id, rows and rows per second to a callback."""

    def __init__(self, callback):
        self._callback = callback

    def onQueryStarted(self, event):
        self._callback("started", None)

    def onQueryProgress(self, event):
        p = event.progress
        self._callback("running", (p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._callback("failed" if event.exception else "completed", event.exception)
