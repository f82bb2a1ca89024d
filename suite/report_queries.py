"""Catalog reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import text
from assay.plans import paging, reports
from suite.adapters import AS_OF, catalog, scans, ts, with_views
from suite.registry import query

# Report-time extension, as SQL.
EXT = "CASE WHEN contains(path, '.') THEN lower('.' || split_part(path, '.', -1)) ELSE '(no ext)' END"
# Percent to one decimal in integers; halves up, or to the even digit.
PCT_UP = "((1000 * {n}) // {t} + CASE WHEN 2 * ((1000 * {n}) % {t}) >= {t} THEN 1 ELSE 0 END)::DOUBLE / 10.0"
PCT_EVEN = (
    "((1000 * {n}) // {t} + CASE WHEN 2 * ((1000 * {n}) % {t}) > {t} OR (2 * ((1000 * {n}) % {t}) = {t}"
    " AND ((1000 * {n}) // {t}) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 10.0"
)


@query(with_views("catalog", f"""
SELECT {EXT} AS ext, status, count(*) AS cnt, sum(size)::BIGINT AS bytes
FROM catalog GROUP BY ALL"""))
def health_by_format(spark, sf):
    return (
        catalog(spark, sf)
        .groupBy(reports.report_ext("path").alias("ext"), "status")
        .agg(F.count("*").alias("cnt"), F.sum("size").alias("bytes"))
        .orderBy(F.desc("cnt"), "ext", "status")
    )


@query(with_views("catalog", "SELECT status, count(*) AS cnt FROM catalog GROUP BY status"))
def status_totals(spark, sf):
    return reports.status_counts(catalog(spark, sf))


@query(with_views("catalog", "SELECT count(*) AS total, coalesce(sum(size), 0)::BIGINT AS total_size_bytes FROM catalog"))
def total_bytes(spark, sf):
    return reports.totals(catalog(spark, sf))


@query(with_views("catalog", f"SELECT {EXT} AS ext, count(*) AS cnt FROM catalog GROUP BY ALL"))
def format_counts(spark, sf):
    return reports.ordered(reports.format_counts(catalog(spark, sf)), "ext")


@query(with_views("catalog", f"SELECT {EXT} AS ext, status, count(*) AS cnt FROM catalog GROUP BY ALL"))
def format_status_counts(spark, sf):
    return reports.ordered(reports.format_status_counts(catalog(spark, sf)), "ext", "status")


@query(with_views("catalog", f"""
, counts AS (SELECT {EXT} AS ext, count(*) AS cnt FROM catalog GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, ext) AS rk FROM counts),
folded AS (SELECT least(rk, 4) AS rank, CASE WHEN rk > 3 THEN 'other' ELSE ext END AS ext, sum(cnt)::BIGINT AS count
           FROM ranked GROUP BY ALL)
SELECT rank, ext,
       CASE ext WHEN '(no ext)' THEN 'No ext' WHEN 'other' THEN 'Others' ELSE upper(substr(ext, 2)) END AS label,
       count, {PCT_EVEN.format(n='count', t='(sum(count) OVER ())::BIGINT')} AS percent
FROM folded""".lstrip()))
def file_type_breakdown(spark, sf):
    return reports.file_type_breakdown(catalog(spark, sf), limit=3).orderBy("rank")


_OVERVIEW = f"""
, counts AS (SELECT {EXT} AS ext, status, count(*) AS cnt FROM catalog GROUP BY ALL),
ranked AS (SELECT ext, row_number() OVER (ORDER BY sum(cnt) DESC, ext) AS rk FROM counts GROUP BY ext),
folded AS (SELECT CASE WHEN rk > 3 THEN 'other' ELSE ext END AS ext,
                  CASE WHEN rk > 3 THEN 'other' ELSE status END AS status, sum(cnt)::BIGINT AS count
           FROM counts JOIN ranked USING (ext) GROUP BY ALL),
segments AS (
  SELECT ext || ':' || status AS key,
         CASE WHEN ext = 'other' THEN 'Others'
              ELSE CASE status WHEN 'ok' THEN 'Healthy' WHEN 'corrupt' THEN 'Corrupt'
                   WHEN 'unreadable' THEN 'Unreadable' WHEN 'unsupported' THEN 'Unsupported'
                   ELSE 'Error' END || ' ' ||
                   CASE ext WHEN '(no ext)' THEN 'No ext' ELSE upper(substr(ext, 2)) END END AS label,
         ext, status, count,
         CASE status WHEN 'ok' THEN 'healthy' WHEN 'corrupt' THEN 'corrupt'
              WHEN 'unreadable' THEN 'unreadable' ELSE 'other' END AS tone
  FROM folded)
"""


@query(with_views("catalog", _OVERVIEW.lstrip() + "SELECT * FROM segments"))
def overview_breakdown(spark, sf):
    return reports.overview_ordered(reports.overview_breakdown(catalog(spark, sf), limit=3))


@query(with_views("catalog", _OVERVIEW.lstrip() + f"""
SELECT *, {PCT_UP.format(n='count', t='(sum(count) OVER ())::BIGINT')} AS percent FROM segments"""))
def overview_share(spark, sf):
    return reports.with_share(reports.overview_breakdown(catalog(spark, sf), limit=3))


@query(with_views("catalog", """
SELECT error, count(*) AS cnt,
       CASE WHEN length(error) > 14 THEN left(error, 14) || '…' ELSE error END AS shown
FROM catalog WHERE error IS NOT NULL AND error <> ''
GROUP BY error ORDER BY cnt DESC, error LIMIT 5"""))
def top_errors(spark, sf):
    return reports.top_errors(catalog(spark, sf)).withColumn("shown", text.truncated("error", 14))


@query(with_views("catalog", f"""
SELECT count(*) AS stale FROM catalog WHERE checked_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY"""))
def stale_files(spark, sf):
    return reports.stale_count(catalog(spark, sf), ts(AS_OF), 20)


@query(with_views("catalog", """
SELECT path, status, error, checked_at FROM catalog
WHERE status = 'corrupt' ORDER BY checked_at DESC, path LIMIT 1000"""))
def corrupt_latest(spark, sf):
    rows = reports.issue_files(catalog(spark, sf), ["corrupt"])
    return reports.newest_first(rows, 1000).select("path", "status", "error", "checked_at")


@query(with_views("catalog", """
SELECT path, status, error, checked_at FROM catalog
WHERE status = 'corrupt' AND checked_at >= TIMESTAMP '2024-01-10 00:00:00'
  AND path ILIKE '%.nef' AND path ILIKE '/LIB1%' ORDER BY checked_at DESC, path LIMIT 1000"""))
def corrupt_since(spark, sf):
    rows = reports.issue_files(
        catalog(spark, sf), ["corrupt"], ext="..nef", path_prefix="/LIB1", since=ts("2024-01-10 00:00:00")
    )
    return reports.newest_first(rows, 1000).select("path", "status", "error", "checked_at")


@query(with_views("catalog", """
SELECT path, status, error, checked_at FROM catalog
WHERE status IN ('corrupt', 'unreadable') ORDER BY checked_at DESC, path LIMIT 100 OFFSET 40"""))
def issues_page(spark, sf):
    rows = reports.issue_files(catalog(spark, sf))
    return reports.newest_first(rows, 100, offset=40).select("path", "status", "error", "checked_at")


@query(with_views("catalog", """
SELECT path, status, error, checked_at FROM catalog ORDER BY checked_at DESC, path LIMIT 100 OFFSET 300"""))
def deep_page(spark, sf):
    """A page located by counts; the bound is low, so that all steps are taken."""
    return paging.page(catalog(spark, sf), 100, 300, within=20).select("path", "status", "error", "checked_at")


@query(with_views("catalog", """
, days AS (SELECT * REPLACE (date_trunc('month', checked_at) AS checked_at) FROM catalog)
SELECT path, status, checked_at FROM days ORDER BY checked_at DESC, path LIMIT 50 OFFSET 250"""))
def deep_page_of_ties(spark, sf):
    """All files have one time; the page is located by prefixes of their paths."""
    rows = catalog(spark, sf).withColumn("checked_at", F.date_trunc("MONTH", "checked_at").cast("timestamp_ntz"))
    return paging.page(rows, 50, 250, within=20).select("path", "status", "checked_at")


@query(with_views("catalog", """
SELECT path, status FROM catalog WHERE path ILIKE '%.pdf' AND path ILIKE '/lib2/u1%'"""))
def files_any_status(spark, sf):
    """An empty status list selects every status."""
    return reports.issue_files(catalog(spark, sf), [], ext="PDF", path_prefix="/lib2/u1").select("path", "status")


@query(with_views("catalog", """
SELECT path, status FROM catalog
WHERE status IN ('corrupt', 'unreadable') AND contains(lower(path), '/f4')"""))
def issues_search(spark, sf):
    return reports.issue_files(catalog(spark, sf), search="/F4").select("path", "status")


@query(with_views("catalog", """
SELECT count(*) AS total, count(*) FILTER (status = 'corrupt') AS corrupt,
       count(*) FILTER (status = 'unreadable') AS unreadable
FROM catalog WHERE status IN ('corrupt', 'unreadable')"""))
def issue_counts(spark, sf):
    return reports.issue_counts(reports.issue_files(catalog(spark, sf)))


@query(with_views("catalog", """
, c AS (SELECT path, row_number() OVER (ORDER BY checked_at DESC, path) AS rank, count(*) OVER () AS n
        FROM catalog WHERE status = 'corrupt')
SELECT rank, path, greatest(n - 20, 0) AS more FROM c WHERE rank <= 20""".lstrip()))
def report_preview(spark, sf):
    return reports.preview(reports.issue_files(catalog(spark, sf), ["corrupt"]))


@query(with_views("catalog", """
SELECT s.status, count(c.path) AS cnt
FROM (VALUES ('ok'), ('corrupt'), ('unsupported'), ('unreadable'), ('error')) s(status)
LEFT JOIN catalog c ON c.status = s.status GROUP BY s.status"""))
def status_domain(spark, sf):
    return reports.status_domain(catalog(spark, sf))


@query(with_views("catalog", """
SELECT count(*) AS files, count(*) FILTER (status IN ('corrupt', 'unreadable')) AS issues,
       CASE WHEN count(*) FILTER (status IN ('corrupt', 'unreadable')) > 0 THEN 'Issues found'
            WHEN count(*) > 0 THEN 'Healthy' ELSE 'Ready to scan' END AS state
FROM catalog"""))
def health_state(spark, sf):
    return reports.health_state(catalog(spark, sf))


_METRICS = """
, gauges AS (
  SELECT 'files_total{status="' || status || '"} ' || count(*) AS line FROM catalog GROUP BY status
  UNION ALL SELECT 'files_indexed_total ' || count(*) FROM catalog
  UNION ALL SELECT 'scan_rate_files_per_second ' || printf('%.3f', (SELECT files_per_sec FROM scans
      WHERE finished_at IS NOT NULL ORDER BY finished_at DESC LIMIT 1))
  UNION ALL SELECT 'last_scan_timestamp{scan_id="' || id || '"} 1'
      FROM (SELECT * FROM scans ORDER BY started_at DESC, id LIMIT 1) WHERE finished_at IS NOT NULL)
SELECT line FROM gauges"""


@query(with_views("catalog scans", _METRICS.lstrip()))
def metrics_rows(spark, sf):
    return reports.exposition(reports.metrics(catalog(spark, sf), scans(spark, sf)))


@query(with_views("catalog scans", f"""
, latest5 AS (SELECT * FROM scans ORDER BY started_at DESC, id LIMIT 5),
errors AS (SELECT error, count(*) AS cnt FROM catalog WHERE error <> '' GROUP BY error ORDER BY cnt DESC, error LIMIT 5),
report AS (
  SELECT 'status' AS section, status AS key, count(*)::VARCHAR AS value FROM catalog GROUP BY status
  UNION ALL SELECT 'format', {EXT}, count(*)::VARCHAR FROM catalog GROUP BY ALL
  UNION ALL SELECT 'size', 'total size',
      CASE WHEN sum(size) >= 1073741824 THEN printf('%.1f GB', sum(size)::DOUBLE / 1073741824)
           WHEN sum(size) >= 1048576 THEN printf('%.1f MB', sum(size)::DOUBLE / 1048576)
           ELSE printf('%.1f KB', sum(size)::DOUBLE / 1024) END FROM catalog
  UNION ALL SELECT 'stale', '>20 days', count(*)::VARCHAR FROM catalog
      WHERE checked_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY
  UNION ALL SELECT 'trend', id, total || ' total ' || corrupt || ' corrupt ' || unreadable || ' unreadable'
      FROM latest5 WHERE finished_at IS NOT NULL
  UNION ALL SELECT 'error', CASE WHEN length(error) > 60 THEN left(error, 60) || '…' ELSE error END, cnt::VARCHAR
      FROM errors)
SELECT * FROM report""".lstrip()))
def health_report(spark, sf):
    return reports.health_report(catalog(spark, sf), scans(spark, sf), ts(AS_OF), 20)
