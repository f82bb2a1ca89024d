"""Driver tables as model tables, once for Spark and once as SQL for the oracle.

All timestamps stay ``timestamp_ntz``: filters on them reach the Parquet scan, and no
result depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.history import latest

# Fixed values of the fixture views.
CUT = "2024-01-21 00:00:00"
AS_OF = "2024-01-31 00:00:00"
RECHECK_DAYS = 20


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log_from_events(events: DataFrame) -> DataFrame:
    """Verdict log from an events table, batch or streaming."""
    return (
        events.selectExpr(
            "event_id AS seq", "ts", "user_id", "cast(get_json_object(props, '$.k') AS int) AS k",
            """CASE WHEN event_id % 50 = 0 THEN 'unreadable' WHEN event_type = 'view' THEN 'ok'
                    WHEN event_type = 'error' THEN 'corrupt' WHEN event_type = 'signup' THEN 'unreadable'
                    WHEN event_type = 'purchase' THEN 'unsupported' ELSE 'error' END AS status""",
        )
        .selectExpr(
            "seq",
            "date_format(ts, 'yyyy-MM-dd') AS scan_id",
            """concat('/lib', user_id % 4, '/u', user_id, '/f', k,
                      element_at(array('.jpg', '.NEF', '.pdf', '.mp4', '.docx'), k % 5 + 1)) AS path""",
            """CASE WHEN seq % 50 = 0 THEN 0.0D ELSE cast(1704067200 + user_id * 100 + k
                    + CASE WHEN seq % 3 = 0 THEN 86400 ELSE 0 END AS double) END AS mtime""",
            """CASE WHEN seq % 50 = 0 THEN 0L ELSE cast((k + 1) * 1000
                    + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END AS bigint) END AS size""",
            "status",
            """CASE WHEN seq % 50 = 0 THEN 'Cannot stat file'
                    WHEN status <> 'ok' THEN concat(status, ' code ', k % 7) END AS error""",
            "ts AS checked_at",
        )
    )


def verdict_log(spark: SparkSession, sf: str) -> DataFrame:
    return log_from_events(table(spark, sf, "events"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return latest(verdict_log(spark, sf))


def catalog_before(spark: SparkSession, sf: str) -> DataFrame:
    return latest(verdict_log(spark, sf).where(F.col("checked_at") < ts(CUT)))


def observed(spark: SparkSession, sf: str) -> DataFrame:
    rows = verdict_log(spark, sf).where(F.col("checked_at") >= ts(CUT))
    return latest(rows).select("path", "mtime", "size")


def post_inventory(pre: DataFrame) -> DataFrame:
    return pre.where(F.col("size") % 13 != 0).withColumn(
        "size", F.col("size") + F.when(F.col("size") % 11 == 0, 1).otherwise(0)
    )


def scans(spark: SparkSession, sf: str) -> DataFrame:
    per_scan = verdict_log(spark, sf).groupBy("scan_id").agg(
        F.min("checked_at").alias("started_at"),
        F.max("checked_at").alias("_end"),
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "corrupt").alias("corrupt"),
        F.count_if(F.col("status") == "unreadable").alias("unreadable"),
    )
    day = F.substring("scan_id", 9, 2).cast("int")
    done = day % 6 != 0
    elapsed = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("_end")) / F.lit(1e6)
    return per_scan.select(
        F.col("scan_id").alias("id"),
        "started_at",
        F.when(done, F.col("_end")).alias("finished_at"),
        "total",
        "corrupt",
        "unreadable",
        F.concat(F.lit("/lib"), (day % 4).cast("string")).alias("scope"),
        F.when(done, F.col("total") / elapsed).alias("files_per_sec"),
    )


def scan_queue(spark: SparkSession, sf: str) -> DataFrame:
    return (
        verdict_log(spark, sf)
        .groupBy("scan_id", "path")
        .agg((F.max("seq") % 3 != 0).alias("done"))
    )


def stored_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog with all eleven columns; every seventh record is already notified."""
    return catalog(spark, sf).select(
        "path", "mtime", "size",
        F.lit(None).cast("string").alias("hash"),
        F.lit(None).cast("string").alias("partial_hash"),
        "status", "error",
        F.lit(None).cast("string").alias("suggested_action"),
        "checked_at", "scan_id",
        F.when(F.col("seq") % 7 == 0, F.col("checked_at")).alias("notified_at"),
    )


def import_records(spark: SparkSession, sf: str) -> DataFrame:
    """/lib0 below an old mount, /lib1 with status ok twice, records without a path, and the
    others as they are: every file of the catalog has a record."""
    forms = F.expr(
        """CASE WHEN path LIKE '/lib0/%' THEN array(struct(seq * 4 AS ordinal, concat('/old', path) AS path, status))
                WHEN path LIKE '/lib1/%' THEN array(
                  struct(seq * 4 + 1 AS ordinal, path, 'ok' AS status),
                  struct(seq * 4 + 2 AS ordinal, path, cast(NULL AS string) AS status),
                  struct(seq * 4 + 3 AS ordinal, '' AS path, status))
                ELSE array(struct(seq * 4 AS ordinal, path, status)) END"""
    )
    return (
        catalog(spark, sf)
        .withColumn("form", F.explode(forms))
        .select("form.ordinal", "form.path", "form.status", "mtime", "size", "error", "checked_at", "scan_id")
    )


# --- the same views for the oracle -------------------------------------------------

LOG_SQL = """
verdict_log AS (
  SELECT event_id AS seq, scan_id, path,
         CASE WHEN event_id % 50 = 0 THEN 0.0
              ELSE base_m + CASE WHEN event_id % 3 = 0 THEN 86400 ELSE 0 END END::DOUBLE AS mtime,
         CASE WHEN event_id % 50 = 0 THEN 0
              ELSE (k + 1) * 1000 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END END::BIGINT AS size,
         status,
         CASE WHEN event_id % 50 = 0 THEN 'Cannot stat file'
              WHEN status <> 'ok' THEN status || ' code ' || (k % 7) END AS error,
         ts AS checked_at
  FROM (SELECT event_id, ts, k, strftime(ts, '%Y-%m-%d') AS scan_id,
               '/lib' || (user_id % 4) || '/u' || user_id || '/f' || k
                 || (['.jpg', '.NEF', '.pdf', '.mp4', '.docx'])[k % 5 + 1] AS path,
               1704067200 + user_id * 100 + k AS base_m,
               CASE WHEN event_id % 50 = 0 THEN 'unreadable'
                    ELSE CASE event_type WHEN 'view' THEN 'ok' WHEN 'error' THEN 'corrupt'
                         WHEN 'signup' THEN 'unreadable' WHEN 'purchase' THEN 'unsupported'
                         ELSE 'error' END END AS status
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)))
"""


def _latest_sql(name: str, where: str = "true") -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY checked_at DESC, seq DESC) AS rn
    FROM verdict_log WHERE {where}) WHERE rn = 1)"""


CATALOG_SQL = _latest_sql("catalog")
BEFORE_SQL = _latest_sql("catalog_before", f"checked_at < TIMESTAMP '{CUT}'")
OBSERVED_SQL = (
    _latest_sql("observed_rows", f"checked_at >= TIMESTAMP '{CUT}'")
    + ", observed AS (SELECT path, mtime, size FROM observed_rows)"
)
POST_SQL = """post AS (
  SELECT path, mtime, size + CASE WHEN size % 11 = 0 THEN 1 ELSE 0 END AS size
  FROM observed WHERE size % 13 <> 0)"""
SCANS_SQL = """scans AS (
  SELECT scan_id AS id, started_at, CASE WHEN day % 6 <> 0 THEN ended_at END AS finished_at,
         total, corrupt, unreadable, '/lib' || (day % 4) AS scope,
         CASE WHEN day % 6 <> 0
              THEN total::DOUBLE / (date_diff('microsecond', started_at, ended_at)::DOUBLE / 1e6) END AS files_per_sec
  FROM (SELECT scan_id, CAST(substr(scan_id, 9, 2) AS INT) AS day, min(checked_at) AS started_at,
               max(checked_at) AS ended_at, count(*) AS total,
               count(*) FILTER (status = 'corrupt') AS corrupt,
               count(*) FILTER (status = 'unreadable') AS unreadable
        FROM verdict_log GROUP BY scan_id))"""
QUEUE_SQL = """scan_queue AS (
  SELECT scan_id, path, max(seq) % 3 <> 0 AS done FROM verdict_log GROUP BY scan_id, path)"""
STORED_SQL = """stored AS (
  SELECT path, mtime, size, CAST(NULL AS VARCHAR) AS hash, CAST(NULL AS VARCHAR) AS partial_hash,
         status, error, CAST(NULL AS VARCHAR) AS suggested_action, checked_at, scan_id,
         CASE WHEN seq % 7 = 0 THEN checked_at END AS notified_at FROM catalog)"""
IMPORT_SQL = """import_raw AS (
  SELECT seq * 4 AS ordinal, CASE WHEN path LIKE '/lib0/%' THEN '/old' || path ELSE path END AS path,
         status, mtime, size, error, checked_at, scan_id
  FROM catalog WHERE path NOT LIKE '/lib1/%'
  UNION ALL SELECT seq * 4 + 1, path, 'ok', mtime, size, error, checked_at, scan_id
  FROM catalog WHERE path LIKE '/lib1/%'
  UNION ALL SELECT seq * 4 + 2, path, NULL, mtime, size, error, checked_at, scan_id
  FROM catalog WHERE path LIKE '/lib1/%'
  UNION ALL SELECT seq * 4 + 3, '', status, mtime, size, error, checked_at, scan_id
  FROM catalog WHERE path LIKE '/lib1/%'),
import AS (
  SELECT ordinal, CASE WHEN path LIKE '/old/lib0/%' THEN substr(path, 5) ELSE path END AS path,
         coalesce(status, 'error') AS status, mtime, size, error, checked_at, scan_id FROM import_raw)"""

_VIEWS = {
    "log": LOG_SQL,
    "catalog": CATALOG_SQL,
    "before": BEFORE_SQL,
    "observed": OBSERVED_SQL,
    "post": POST_SQL,
    "scans": SCANS_SQL,
    "queue": QUEUE_SQL,
    "stored": STORED_SQL,
    "import": IMPORT_SQL,
}


def with_views(names: str, select: str) -> str:
    """SQL text with the named views in front; the log always comes first."""
    parts = [_VIEWS["log"]] + [_VIEWS[n] for n in names.split()]
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()
