"""Table schemas. Every table is read with one of these, never with inference."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed verdict domain.
STATUSES = ("ok", "corrupt", "unsupported", "unreadable", "error")
# Verdicts that need attention.
ISSUE_STATUSES = ("corrupt", "unreadable")

INVENTORY = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("size", T.LongType()),
    ]
)

VERDICT = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("suggested_action", T.StringType()),
    ]
)

# One row per check. Append-only; the catalog is a fold of this table.
VERDICT_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("scan_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("suggested_action", T.StringType()),
        T.StructField("checked_at", T.TimestampType()),
    ]
)

# One row per path: the latest verdict.
CATALOG = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("partial_hash", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("suggested_action", T.StringType()),
        T.StructField("checked_at", T.TimestampType()),
        T.StructField("scan_id", T.StringType()),
        T.StructField("notified_at", T.TimestampType()),
    ]
)

# The portable form keeps timestamps as ISO-8601 text.
PORTABLE_RECORD = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name.endswith("_at") else f.dataType)
        for f in CATALOG
    ]
)

SCANS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("total", T.LongType()),
        T.StructField("corrupt", T.LongType()),
        T.StructField("unreadable", T.LongType()),
        T.StructField("scope", T.StringType()),
        T.StructField("files_per_sec", T.DoubleType()),
    ]
)

SCAN_QUEUE = T.StructType(
    [
        T.StructField("scan_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("done", T.BooleanType()),
    ]
)

# What a scan writes about itself, see operators/lifecycle.py.
SCAN_EVENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("scope", T.StringType()),
    ]
)

PROGRESS = T.StructType(
    [
        T.StructField("scan_id", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("at", T.TimestampType()),
        *[T.StructField(c, T.LongType()) for c in ("processed", "skipped", "discards", *STATUSES)],
        T.StructField("elapsed_s", T.DoubleType()),
    ]
)

QUEUED = T.StructType(
    [
        T.StructField("scan_id", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("path", T.StringType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("value", T.DoubleType()),
    ]
)
