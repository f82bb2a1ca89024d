"""Streaming jobs over the events table. Each drains what is there and must agree with the
SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.operators import changes
from assay.session import run_dir
from assay.sources import tables
from assay.streaming import alert_stream as alerting, catalog_stream, live
from assay.streaming.sinks import drain, to_folder
from suite.adapters import catalog, log_from_events, stored_catalog, table, with_views
from suite.history_queries import ALERTS
from suite.registry import query


def _log_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    # A glob, because a stream does not accept the name of a single file.
    return log_from_events(spark.readStream.schema(schema).parquet(f"{sf}/events.{{parquet}}"))


def _folder(spark, name: str) -> str:
    return run_dir(spark, name)


@query(with_views("", "SELECT scan_id, status, count(*) AS cnt FROM verdict_log GROUP BY ALL"))
def live_counts_stream(spark, sf):
    folder = _folder(spark, "live")
    live.publish_counts(_log_stream(spark, sf), f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return live.current_counts(spark, f"{folder}/counts")


@query(with_views("", f", {ALERTS} SELECT seq, scan_id, path, status, error FROM alerts"))
def alert_stream(spark, sf):
    folder = _folder(spark, "alerts")
    rows = alerting.alerts(_log_stream(spark, sf))
    alerting.deliver(rows, folder, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/alerts").drop("batch", "checked_at")


@query(with_views("", f", {ALERTS} SELECT seq, scan_id, path, status, error FROM alerts"))
def alert_batch_stream(spark, sf):
    """The same alerts by windows and a state table instead of a stateful processor."""
    folder = _folder(spark, "alert-batches")
    rows = _log_stream(spark, sf)
    alerting.alert_batches(rows, folder, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/alerts").select("seq", "scan_id", "path", "status", "error")


@query(with_views("catalog", "SELECT path, mtime, size, status, error, scan_id, seq FROM catalog"))
def catalog_stream_fold(spark, sf):
    folder = _folder(spark, "catalog")
    rows = _log_stream(spark, sf)
    catalog_stream.maintain(rows, folder, f"{folder}/checkpoint").awaitTermination()
    return catalog_stream.current(spark, folder, rows.schema).drop("checked_at")


@query(with_views("", "SELECT seq, scan_id, path, status FROM verdict_log"))
def resumable_stream(spark, sf):
    """Two runs with one checkpoint: the second one finds nothing left to do."""
    folder = _folder(spark, "resume")
    rows = _log_stream(spark, sf).select("seq", "scan_id", "path", "status")
    for _ in range(2):
        drain(rows, to_folder(f"{folder}/log"), f"{folder}/checkpoint").start().awaitTermination()
    return spark.read.parquet(f"{folder}/log").drop("batch")


@query(with_views("catalog stored", f""", {ALERTS},
delivered AS (SELECT path, max(checked_at) AS at FROM alerts GROUP BY path)
SELECT s.path, s.status, coalesce(d.at, s.notified_at) AS notified_at
FROM stored s LEFT JOIN delivered d ON s.path = d.path"""))
def delivery_stream(spark, sf):
    """Delivered alerts mark the catalog."""
    folder = _folder(spark, "delivery")
    rows = alerting.alerts(_log_stream(spark, sf))
    alerting.deliver(rows, folder, f"{folder}/checkpoint").awaitTermination()
    delivered = spark.read.parquet(f"{folder}/delivered").withColumn("delivered_at", F.col("delivered_at").cast("timestamp_ntz"))
    return changes.mark_notified(stored_catalog(spark, sf), delivered).select("path", "status", "notified_at")


# --- portable records and report files ------------------------------------------------


@query(with_views("catalog stored", "SELECT * FROM stored"))
def catalog_json_roundtrip(spark, sf):
    """The catalog exported as JSON lines and read back with its fixed schema."""
    folder = _folder(spark, "export")
    tables.export_catalog(stored_catalog(spark, sf), folder)
    back = tables.typed_times(tables.read_portable(spark, folder)).drop("ordinal")
    return back.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("checked_at", "notified_at")})


@query(with_views("catalog stored", "SELECT row_number() OVER (ORDER BY path) - 1 AS ordinal, path, status FROM stored"))
def portable_order(spark, sf):
    """Records keep their order over many files of different sizes and the blocks of each."""
    folder = _folder(spark, "ordered")
    rows = stored_catalog(spark, sf).repartitionByRange(7, "path").sortWithinPartitions("path")
    tables.export_catalog(rows, folder)
    return tables.read_portable(spark, folder).select("ordinal", "path", "status")


@query(with_views("catalog", "SELECT path, status, error FROM catalog WHERE status = 'corrupt'"))
def report_json(spark, sf):
    folder = _folder(spark, "report")
    rows = catalog(spark, sf).where("status = 'corrupt'").select("path", "status", "error")
    tables.write_report(rows, folder, "json")
    return spark.read.schema(rows.schema).json(folder)


@query(with_views("catalog", "SELECT path, status, error FROM catalog WHERE status = 'corrupt'"))
def report_csv(spark, sf):
    folder = _folder(spark, "report")
    rows = catalog(spark, sf).where("status = 'corrupt'").select("path", "status", "error")
    tables.write_report(rows, folder, "csv")
    return spark.read.option("header", True).schema(rows.schema).csv(folder)


@query(with_views("catalog", "SELECT path, seq, status FROM catalog"))
def catalog_snapshot(spark, sf):
    """The fold written as a snapshot version and read back as the latest one."""
    folder = _folder(spark, "snapshot")
    rows = catalog(spark, sf).select("path", "seq", "status", "checked_at")
    tables.write_snapshot(rows, folder, 1)
    return tables.read_snapshot(spark, folder).drop("checked_at")
