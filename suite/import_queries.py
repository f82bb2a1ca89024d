"""Import, remapping and the work queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import importing, queue as queue_ops
from suite.adapters import (
    AS_OF, RECHECK_DAYS, catalog, catalog_before, import_records, observed, scan_queue, scans, ts, verdict_log,
    with_views,
)
from suite.registry import query

MAP = {"/old/": "/", "/lib": "/never"}
COLS = ["path", "mtime", "size", "status", "error", "checked_at", "scan_id"]


def _import(spark, sf):
    records = importing.prepare(import_records(spark, sf), MAP)
    return records, catalog_before(spark, sf).select(*COLS), catalog(spark, sf).where(F.col("size") % 5 != 0)


# The target holds what was known before the cut; files that exist are those of another size.
_IMPORT_VIEWS = "catalog before import"
_EXISTS = "existing AS (SELECT path FROM catalog WHERE size % 5 <> 0)"


def _actions_sql(force: bool) -> str:
    taken = "" if force else (
        "WHEN EXISTS (SELECT 1 FROM catalog_before c WHERE c.path = i.path)"
        " OR ordinal > min(ordinal) OVER (PARTITION BY path) THEN 'skipped_existing'"
    )
    return f"""acted AS (SELECT i.*, CASE WHEN path = '' THEN 'skipped_empty'
     WHEN NOT EXISTS (SELECT 1 FROM existing e WHERE e.path = i.path) THEN 'skipped_missing'
     {taken} ELSE 'inserted' END AS action FROM import i)"""


@query(with_views(_IMPORT_VIEWS, f", {_EXISTS}, {_actions_sql(False)} SELECT ordinal, path, action FROM acted"))
def import_actions(spark, sf):
    records, target, existing = _import(spark, sf)
    return importing.actions(records, target, existing).select("ordinal", "path", "action")


@query(with_views(_IMPORT_VIEWS, f""", {_EXISTS}, {_actions_sql(False)}
SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action <> 'inserted') AS skipped FROM acted"""))
def import_counts(spark, sf):
    records, target, existing = _import(spark, sf)
    return importing.import_counts(records, target, existing)


@query(with_views(_IMPORT_VIEWS, f""", {_EXISTS}, {_actions_sql(True)}
SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action <> 'inserted') AS skipped FROM acted"""))
def import_force_counts(spark, sf):
    records, target, existing = _import(spark, sf)
    return importing.import_counts(records, target, existing, force=True)


_ALL = ", ".join(COLS)


@query(with_views(_IMPORT_VIEWS, f""", {_EXISTS}, {_actions_sql(False)}
SELECT {_ALL} FROM catalog_before UNION ALL SELECT {_ALL} FROM acted WHERE action = 'inserted'"""))
def import_ignore(spark, sf):
    records, target, existing = _import(spark, sf)
    return importing.apply_import(target, records, existing)


@query(with_views(_IMPORT_VIEWS, f""", {_EXISTS}, {_actions_sql(True)},
last AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ordinal DESC) AS rn FROM acted WHERE action = 'inserted')
SELECT {_ALL} FROM last WHERE rn = 1
UNION ALL SELECT {_ALL} FROM catalog_before c WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.path = c.path)"""))
def import_force(spark, sf):
    records, target, existing = _import(spark, sf)
    return importing.apply_import(target, records, existing, force=True)


@query(with_views("catalog import", "SELECT ordinal, path FROM import"))
def path_remap(spark, sf):
    return importing.prepare(import_records(spark, sf), MAP).select("ordinal", "path")


@query(with_views("catalog", """
SELECT path AS old_path, CASE
   WHEN user_part IN ('u1', 'u12') AND lib = 'lib0' THEN '/archive/' || user_part || tail
   WHEN lib = 'lib1' THEN '/m1/' || user_part || tail
   WHEN lib = 'lib3' THEN '/lib3/' || user_part || tail
   ELSE path END AS path
FROM (SELECT path, split_part(path, '/', 2) AS lib, split_part(path, '/', 3) AS user_part,
             '/' || split_part(path, '/', 4) AS tail FROM catalog)"""))
def path_remap_table(spark, sf):
    """Many mappings as a table; the first one in order wins, ``/lib0/u1`` is not ``/lib0/u12``."""
    mapping = spark.sql(
        "SELECT * FROM VALUES (1, '/lib0/u1/', '/archive/u1'), (2, '/lib0/u12', '/archive/u12'), "
        "(3, '/lib1', '/m1/'), (4, '/lib1/u1', '/never'), (5, '/lib3/', '/lib3'), (6, '/li', '/never') "
        "AS m(ordinal, old, new)"
    )
    files = catalog(spark, sf).select("path", F.col("path").alias("old_path"))
    return importing.remap_by_table(files, mapping)


@query(with_views("catalog before", """
SELECT path, status FROM catalog_before WHERE path IN (SELECT path FROM catalog WHERE size % 5 <> 0)"""))
def import_known_paths(spark, sf):
    existing = catalog(spark, sf).where(F.col("size") % 5 != 0).select("path")
    return catalog_before(spark, sf).join(existing, "path", "left_semi").select("path", "status")


@query(with_views("queue", "SELECT scan_id, path FROM scan_queue WHERE NOT done"))
def queue_pending(spark, sf):
    return queue_ops.pending(scan_queue(spark, sf))


@query(with_views("queue", "SELECT path, scan_id FROM scan_queue WHERE NOT done AND scan_id = '2024-01-18'"))
def queue_pending_of_scan(spark, sf):
    return queue_ops.pending(scan_queue(spark, sf), "2024-01-18")


@query(with_views("queue", """
SELECT scan_id, path, done FROM scan_queue
UNION ALL SELECT DISTINCT scan_id, path, false FROM
  (SELECT scan_id, path FROM verdict_log UNION ALL SELECT '2024-02-01', path FROM verdict_log) n
WHERE NOT EXISTS (SELECT 1 FROM scan_queue q WHERE q.scan_id = n.scan_id AND q.path = n.path)"""))
def queue_dedup(spark, sf):
    """Every logged path queued again for its own scan and once for a new one."""
    log = verdict_log(spark, sf)
    new = log.select("scan_id", "path").unionByName(log.select(F.lit("2024-02-01").alias("scan_id"), "path"))
    return queue_ops.enqueue(scan_queue(spark, sf), new)


@query(with_views("queue", """
SELECT q.scan_id, q.path, coalesce(f.hit, q.done) AS done FROM scan_queue q
LEFT JOIN (SELECT DISTINCT scan_id, path, true AS hit FROM verdict_log WHERE status = 'ok') f
  ON q.scan_id = f.scan_id AND q.path = f.path"""))
def queue_mark_done(spark, sf):
    return queue_ops.mark_done(scan_queue(spark, sf), verdict_log(spark, sf).where("status = 'ok'"))


@query(with_views("queue", "SELECT * FROM scan_queue WHERE NOT (done AND scan_id = '2024-01-12')"))
def queue_cleanup(spark, sf):
    return queue_ops.without_finished(scan_queue(spark, sf), "2024-01-12")


_STALE = f""", stale AS (
  SELECT DISTINCT q.scan_id FROM scan_queue q JOIN scans s ON q.scan_id = s.id
  WHERE s.finished_at IS NULL AND s.started_at::DATE <= DATE '{AS_OF[:10]}' - 7)"""


@query(with_views("queue scans", _STALE + " SELECT scan_id FROM stale"))
def stale_queues(spark, sf):
    return queue_ops.stale_scan_ids(scan_queue(spark, sf), scans(spark, sf), ts(AS_OF))


@query(with_views("queue scans", _STALE + """
SELECT * FROM scan_queue WHERE scan_id NOT IN (SELECT scan_id FROM stale)"""))
def queue_without_stale(spark, sf):
    queue = scan_queue(spark, sf)
    return queue_ops.drop_stale(queue, queue_ops.stale_scan_ids(queue, scans(spark, sf), ts(AS_OF)))


@query(with_views("queue before observed", f"""
, work AS (SELECT q.scan_id, q.path, coalesce(o.mtime, 0.0) AS mtime, coalesce(o.size, 0) AS size
           FROM scan_queue q LEFT JOIN observed o ON q.path = o.path WHERE NOT q.done)
SELECT w.*, CASE WHEN c.path IS NULL THEN 'new' WHEN c.mtime <> w.mtime OR c.size <> w.size THEN 'changed'
        WHEN date_sub('day', c.checked_at, TIMESTAMP '{AS_OF}') >= {RECHECK_DAYS} THEN 'stale' ELSE 'fresh' END AS reason,
       (c.path IS NULL OR c.mtime <> w.mtime OR c.size <> w.size
        OR date_sub('day', c.checked_at, TIMESTAMP '{AS_OF}') >= {RECHECK_DAYS}) AS needs_check
FROM work w LEFT JOIN catalog_before c ON w.path = c.path"""))
def resume_worklist(spark, sf):
    return queue_ops.resume_worklist(
        scan_queue(spark, sf), observed(spark, sf), catalog_before(spark, sf), ts(AS_OF), RECHECK_DAYS
    )
