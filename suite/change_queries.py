"""Inventory, incremental diff, guards, notification marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.paths import DEFAULT_EXCLUDES, excluded, in_scope, report_ext, scan_ext
from assay.operators import changes, notices, scans as scan_ops
from assay.operators.catalog import reset, reset_count
from assay.operators.history import is_issue
from assay.operators.formats import dispatch
from assay.operators.verdicts import unstatable
from assay.plans import reports
from assay.sources.tables import stage
from suite.adapters import (
    AS_OF, CUT, RECHECK_DAYS, catalog, catalog_before, observed, post_inventory, scans, stored_catalog, ts, verdict_log,
    with_views,
)
from suite.registry import query

SCAN_EXT = r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))"

CLASSIFIED = f"""classified AS (
  SELECT o.path, o.mtime, o.size,
         CASE WHEN c.path IS NULL THEN 'new'
              WHEN c.mtime <> o.mtime OR c.size <> o.size THEN 'changed'
              WHEN date_sub('day', c.checked_at, TIMESTAMP '{AS_OF}') >= {RECHECK_DAYS} THEN 'stale'
              ELSE 'fresh' END AS reason
  FROM observed o LEFT JOIN catalog_before c ON o.path = c.path)"""


def _classified(spark, sf):
    return changes.classify(observed(spark, sf), catalog_before(spark, sf), ts(AS_OF), RECHECK_DAYS)


@query(with_views("before observed", f", {CLASSIFIED} SELECT *, reason <> 'fresh' AS needs_check FROM classified"))
def needs_check_class(spark, sf):
    return _classified(spark, sf)


@query(with_views("before observed", f"""
, {CLASSIFIED} SELECT {SCAN_EXT} AS ext, count(*) AS files FROM classified
WHERE reason <> 'fresh' GROUP BY ALL"""))
def estimate_by_ext(spark, sf):
    return changes.estimate(_classified(spark, sf)).orderBy("ext")


@query(with_views("before observed scans", f"""
, {CLASSIFIED},
rate AS (SELECT files_per_sec FROM scans WHERE finished_at IS NOT NULL ORDER BY finished_at DESC LIMIT 1)
SELECT count(*) FILTER (reason <> 'fresh') AS files, (SELECT files_per_sec FROM rate) AS files_per_sec,
       count(*) FILTER (reason <> 'fresh') / (SELECT files_per_sec FROM rate) AS eta_s
FROM classified"""))
def scan_eta(spark, sf):
    return scan_ops.scan_eta(_classified(spark, sf), scans(spark, sf))


@query(with_views("catalog", f"""
SELECT {SCAN_EXT} AS ext, count(*) AS files
FROM catalog WHERE {SCAN_EXT} IN ('.jpg', '.nef', '.pdf', '.docx')
  AND NOT regexp_matches(path, '/u1[0-9]/f') AND path NOT LIKE '%/f7_.%'
GROUP BY ROLLUP (ext)"""))
def dry_run_by_ext(spark, sf):
    """Defaults plus two more globs, restricted to four registered extensions."""
    kept = changes.select_inventory(
        catalog(spark, sf).select("path", "mtime", "size"),
        [".jpg", ".nef", ".pdf", ".docx"],
        [*DEFAULT_EXCLUDES, "**/u1[0-9]/f*", "**/f7?.*"],
    )
    return changes.dry_run(kept)


@query(with_views("catalog", """
SELECT path, regexp_matches(path, '^/lib[^03].*f1.*$|^.*/u2./.*[.]NEF$|^/lib1/.*[.]pdf$') AS excluded FROM catalog"""))
def glob_exclusion(spark, sf):
    globs = ["/lib[!03]*f1*", "**/u2?/*.NEF", "/lib1/**.pdf"]
    return catalog(spark, sf).select("path", excluded("path", globs).alias("excluded"))


@query(with_views("catalog", f"""
SELECT path, {SCAN_EXT} AS scan_ext,
       CASE WHEN contains(path, '.') THEN lower('.' || split_part(path, '.', -1)) ELSE '(no ext)' END AS report_ext
FROM (SELECT path FROM catalog UNION ALL SELECT replace(path, '.', '/.') FROM catalog
      UNION ALL SELECT replace(replace(path, '.', ''), 'lib', 'l.ib') FROM catalog
      UNION ALL SELECT replace(path, '.', '') FROM catalog)"""))
def path_extensions(spark, sf):
    """Both extension rules on files, dotfiles, dotted folders and names without a dot."""
    paths = catalog(spark, sf).select("path")
    forms = F.array(
        "path",
        F.replace("path", F.lit("."), F.lit("/.")),
        F.replace(F.replace("path", F.lit("."), F.lit("")), F.lit("lib"), F.lit("l.ib")),
        F.replace("path", F.lit("."), F.lit("")),
    )
    return paths.select(F.explode(forms).alias("path")).select(
        "path", scan_ext("path").alias("scan_ext"), report_ext("path").alias("report_ext")
    )


@query(with_views("catalog", "SELECT path, mtime, size FROM catalog"))
def overlapping_roots(spark, sf):
    """The library walked from its top and again from one of its folders."""
    whole = catalog(spark, sf).select("path", "mtime", "size")
    return changes.merge_roots(whole, whole.where(in_scope("path", ["/lib2"])))


@query(with_views("catalog", """
SELECT path, status FROM catalog WHERE path LIKE '/lib1/%' OR path LIKE '/lib2/u6/%' OR path = '/lib0'"""))
def scope_guard(spark, sf):
    """``/lib2/u6`` must not admit ``/lib2/u62``."""
    return catalog(spark, sf).where(in_scope("path", ["/lib1/", "/lib2/u6", "/lib0/u"])).select("path", "status")


@query(with_views("catalog", """
, kinds(ext, kind, cost_class) AS (VALUES ('.jpg', 'jpeg', 'low'), ('.nef', 'raw', 'high'), ('.pdf', 'pdf', 'low'),
   ('.mp4', 'video', 'low'), ('.docx', 'ooxml', 'low')),
exts AS (SELECT lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext, size FROM
   (SELECT path, size FROM catalog UNION ALL SELECT path || '.bin', size FROM catalog))
SELECT ext, kind, coalesce(cost_class, 'low') AS cost_class, count(*) AS files, sum(size)::BIGINT AS bytes,
       kind IS NULL AS unsupported
FROM exts LEFT JOIN kinds USING (ext) GROUP BY ALL"""))
def dispatch_classes(spark, sf):
    """Routing by extension; the copies with an unknown suffix have no validator."""
    files = catalog(spark, sf).select(
        F.explode(F.array("path", F.concat("path", F.lit(".bin")))).alias("path"), "size"
    )
    return (
        dispatch(files)
        .groupBy("ext", "kind", "cost_class", F.col("kind").isNull().alias("unsupported"))
        .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    )


@query(with_views("catalog", """
SELECT path, CASE WHEN mtime = 0 AND size = 0 THEN 'unreadable' END AS status,
       CASE WHEN mtime = 0 AND size = 0 THEN 'Cannot stat file' END AS error FROM catalog"""))
def unstatable_files(spark, sf):
    v = unstatable()
    return catalog(spark, sf).select("path", v["status"].alias("status"), v["error"].alias("error"))


_GUARD = """
, post_all AS (SELECT path, mtime, size + CASE WHEN size % 11 = 0 THEN 1 ELSE 0 END AS size FROM catalog WHERE size % 13 <> 0),
guarded AS (
  SELECT v.seq, v.path, v.status, v.scan_id, v.checked_at,
         NOT coalesce(v.mtime = p.mtime AND v.size = p.size, false) AS discarded
  FROM verdict_log v LEFT JOIN post_all p ON v.path = p.path)"""


def _guarded(spark, sf):
    """All verdicts against the files as they are now."""
    return changes.guard_changes(verdict_log(spark, sf), post_inventory(catalog(spark, sf).select("path", "mtime", "size")))


@query(with_views("catalog", _GUARD + " SELECT seq, path, status FROM guarded WHERE NOT discarded"))
def toctou_guard(spark, sf):
    return _guarded(spark, sf).where(~F.col("discarded")).select("seq", "path", "status")


@query(with_views("catalog", _GUARD + """
SELECT scan_id, count(*) AS processed, 0 AS skipped, count(*) FILTER (discarded) AS discards,
       greatest(count(*) - count(*) FILTER (discarded), 0) AS total,
       count(*) FILTER (NOT discarded AND status = 'corrupt') AS corrupt,
       count(*) FILTER (NOT discarded AND status = 'unreadable') AS unreadable,
       CASE WHEN date_diff('microsecond', min(checked_at), max(checked_at)) < 1000 THEN 0.0
            ELSE count(*) FILTER (NOT discarded)::DOUBLE
                 / (date_diff('microsecond', min(checked_at), max(checked_at))::DOUBLE / 1e6) END AS files_per_sec
FROM guarded GROUP BY scan_id"""))
def scan_closeout(spark, sf):
    """All scans of the log."""
    return scan_ops.close_out(_guarded(spark, sf))


@query(with_views("catalog stored", """
, delivered AS (SELECT path, max(checked_at) AS at FROM verdict_log WHERE status = 'corrupt' GROUP BY path)
SELECT s.path, s.status, coalesce(d.at, s.notified_at) AS notified_at
FROM stored s LEFT JOIN delivered d ON s.path = d.path"""))
def mark_notified(spark, sf):
    delivered = verdict_log(spark, sf).where("status = 'corrupt'").select(
        "path", F.col("checked_at").alias("delivered_at")
    )
    return changes.mark_notified(stored_catalog(spark, sf), delivered).select("path", "status", "notified_at")


_NOTICES = f"""
, deliveries AS (SELECT path, checked_at + INTERVAL 2 HOUR AS moment FROM verdict_log
                 WHERE status IN ('corrupt', 'unreadable') AND seq % 3 = 0),
steps AS (SELECT *, lag(status) OVER (PARTITION BY path ORDER BY checked_at, seq) AS prev FROM verdict_log),
events AS (
  SELECT path, checked_at AS moment, 0 AS kind, seq, status = 'corrupt' AND coalesce(prev = 'ok', false) AS relapse FROM steps
  UNION ALL SELECT path, moment, 1, 0, false FROM deliveries),
told AS (
  SELECT *, max(CASE WHEN relapse THEN nth END) OVER (PARTITION BY path) AS relapsed
  FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY moment, kind, seq) AS nth FROM events)),
noted AS (
  SELECT c.path, c.status, c.checked_at,
         (SELECT max(moment) FROM told t WHERE t.path = c.path AND kind = 1 AND nth > coalesce(relapsed, 1)) AS notified_at
  FROM catalog c)"""


def _deliveries(log):
    """Every third issue is delivered two hours later."""
    some = log.where(is_issue() & (F.col("seq") % 3 == 0))
    return some.select("path", (F.col("checked_at") + F.expr("INTERVAL 2 HOURS")).alias("delivered_at"))


@query(with_views("catalog", _NOTICES + " SELECT path, status, checked_at, notified_at FROM noted"))
def notification_state(spark, sf):
    """Verdicts and deliveries as one composed state; relapses take the time away."""
    log = verdict_log(spark, sf)
    return notices.advance(log, _deliveries(log)).drop("seq", "relapsed_at")


@query(with_views("catalog", _NOTICES + " SELECT path, status, checked_at, notified_at FROM noted"))
def notification_state_continued(spark, sf):
    """The same from a stored state at the cut and what came later."""
    log = verdict_log(spark, sf)
    told = _deliveries(log)
    early, late = F.col("checked_at") < ts(CUT), F.col("delivered_at") < ts(CUT)
    known = stage(notices.advance(log.where(early), told.where(late)), "notices")
    return notices.advance(log.where(~early), told.where(~late), known).drop("seq", "relapsed_at")


@query(with_views("catalog", _NOTICES + """
SELECT path, status FROM noted WHERE status IN ('corrupt', 'unreadable') AND notified_at IS NULL"""))
def notification_due(spark, sf):
    """Files in trouble that nobody was told about since they broke."""
    log = verdict_log(spark, sf)
    return changes.unnotified(notices.advance(log, _deliveries(log))).select("path", "status")


_NEW = """SELECT path, status, checked_at FROM stored
WHERE status {cond} AND notified_at IS NULL {more} ORDER BY checked_at DESC, path LIMIT 1000"""


@query(with_views("catalog stored", _NEW.format(cond="= 'corrupt'", more="")))
def new_corrupt(spark, sf):
    rows = changes.unnotified(stored_catalog(spark, sf), "corrupt")
    return reports.newest_first(rows, 1000).select("path", "status", "checked_at")


@query(with_views("catalog stored", _NEW.format(cond="= 'unreadable'", more="")))
def new_unreadable(spark, sf):
    rows = changes.unnotified(stored_catalog(spark, sf), "unreadable")
    return reports.newest_first(rows, 1000).select("path", "status", "checked_at")


@query(with_views("catalog stored", """
SELECT path, status FROM stored WHERE status IN ('corrupt', 'unreadable') AND notified_at IS NULL
  AND scan_id = '2024-01-17'"""))
def new_issues_of_scan(spark, sf):
    """Corrupt and unreadable files of one scan that still have to be reported."""
    rows = stored_catalog(spark, sf).where("scan_id = '2024-01-17'")
    corrupt, unreadable = changes.unnotified(rows, "corrupt"), changes.unnotified(rows, "unreadable")
    return corrupt.unionByName(unreadable).select("path", "status")


@query(with_views("catalog", "SELECT path, status FROM catalog WHERE NOT path ILIKE '/LIB1/u1%'"))
def reset_prefix(spark, sf):
    return reset(catalog(spark, sf), "/LIB1/u1").select("path", "status")


@query(with_views("catalog", "SELECT count(*) AS deleted FROM catalog WHERE path ILIKE '/LIB1/u1%'"))
def reset_prefix_count(spark, sf):
    return reset_count(catalog(spark, sf), "/LIB1/u1")
