"""Alert-once state per path, and delivery of digests.

The log has to arrive in time order, as an append-only log does; inside a batch each path's
rows are sorted here. Every alert counts as delivered, as in the batch rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assay.operators.history import advance_state, alerts_since, latest
from assay.schemas import ISSUE_STATUSES
from assay.streaming.sinks import BatchFn, drain
from assay.streaming.state_table import ROWS_PER_BUCKET, StateTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERT_SCHEMA = "seq long, scan_id string, path string, status string, error string, micros long"


#: Groups of paths that share one entry of the state store. Asking the store costs Python a round
#: trip, so it is asked once a group and batch, not once a path. Fixed for the life of a checkpoint.
BUCKETS = 1 << 16


class AlertState(StatefulProcessor):
    """State of a bucket: the last status of each of its paths, and whether it ever had an issue."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("last", "paths array<string>, statuses array<string>, had_issue array<boolean>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._state.get()
        known = {} if state is None else {p: (s, h) for p, s, h in zip(*state)}
        # as in Spark, nulls come first
        for r in sorted(rows, key=lambda r: (r.micros is not None, r.micros, r.seq is not None, r.seq)):
            path, status = r.path, r.status
            last, had_issue = known.get(path, (None, False))
            issue = status in ISSUE_STATUSES
            if issue and (not had_issue or (status == "corrupt" and last == "ok")):
                yield Row(seq=r.seq, scan_id=r.scan_id, path=path, status=status, error=r.error, micros=r.micros)
            known[path] = status, had_issue or issue
        self._state.update(([*known], [s for s, _ in known.values()], [h for _, h in known.values()]))

    def close(self) -> None:
        pass


def alerts(log: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Streaming twin of the batch alert rule. ``checked_at`` must be a timestamp.

    Stateful processors need the RocksDB store, which is set on the session here. A batch reads
    and writes the buckets of its paths, so ``buckets`` should not be far below the number of paths
    divided by some hundred.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = log.select(
        "seq", "scan_id", "path", "status", "error",
        # a whole number is cheaper in Python than a time
        F.unix_micros(F.col("checked_at").cast("timestamp")).alias("micros"),
        F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    found = rows.groupBy("bucket").transformWithState(
        statefulProcessor=AlertState(), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="None"
    )
    return found.withColumn("checked_at", F.timestamp_micros("micros")).drop("micros")


def deliver(
    alert_rows: DataFrame, folder: str, checkpoint: str, send: Callable[[DataFrame, int], None] | None = None
):
    """Writes each batch of alerts, sends it, and records it as delivered when that worked.

    A failed send fails the batch before anything is recorded, so it is sent again.
    """

    def fn(batch: DataFrame, batch_id: int) -> None:
        target = f"{folder}/alerts/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        written = batch.sparkSession.read.parquet(target)
        if send is not None:
            send(written, batch_id)
        delivered = written.select("path", F.col("checked_at").alias("delivered_at"))
        delivered.write.mode("overwrite").parquet(f"{folder}/delivered/batch={batch_id}")

    return drain(alert_rows, fn, checkpoint).start()


STATE = T.StructType().add("path", "string").add("status", "string").add("had_issue", "boolean")


def _newest(rows: DataFrame) -> DataFrame:
    return latest(rows, ["path"], ["batch"])


def state(spark: SparkSession, folder: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> StateTable:
    return StateTable(spark, f"{folder}/state", ["path"], STATE, _newest, rows_per_bucket)


def alert_batch(folder: str, compact_every: int = 20, rows_per_bucket: int = ROWS_PER_BUCKET) -> BatchFn:
    """The alert rule for one batch: writes its alerts and the new state of its paths.

    The state before a batch is the last row per path of earlier batches, read from the buckets
    of the batch's paths only; a batch that is run again gives the same rows.
    """

    def fn(batch: DataFrame, batch_id: int) -> None:
        table = state(batch.sparkSession, folder, rows_per_bucket)
        known = _newest(table.rows(before=batch_id, touched=batch))
        alerts_since(batch, known).write.mode("overwrite").parquet(f"{folder}/alerts/batch={batch_id}")
        table.add(advance_state(batch, known), batch_id)
        if batch_id % compact_every == compact_every - 1:
            table.compact(batch_id)

    return fn


def alert_batches(log: DataFrame, folder: str, checkpoint: str, compact_every: int = 20):
    """The alert rule batch by batch without Python workers, for large batches. A path that owns
    most of a batch is spread over many tasks."""
    return drain(log, alert_batch(folder, compact_every), checkpoint).start()
