"""Scan history, transitions, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import text
from assay.operators import history, lifecycle, scans as scan_ops
from assay.plans import alerting, reports
from assay.schemas import STATUSES
from assay.sources.tables import stage
from suite.adapters import AS_OF, CUT, catalog, scans, ts, verdict_log, with_views
from suite.registry import query

_COUNTS = """SELECT scan_id, count(*) AS total, count(*) FILTER (status = 'ok') AS ok,
  count(*) FILTER (status = 'corrupt') AS corrupt, count(*) FILTER (status = 'unsupported') AS unsupported,
  count(*) FILTER (status = 'unreadable') AS unreadable,
  count(*) FILTER (status NOT IN ('ok', 'corrupt', 'unsupported', 'unreadable')) AS error
FROM {src} GROUP BY scan_id"""


@query(with_views("catalog", _COUNTS.format(src="catalog")))
def scan_status_pivot(spark, sf):
    """Counts restored on resume: the catalog's rows per scan."""
    return scan_ops.status_counts(catalog(spark, sf))


@query(with_views("", _COUNTS.format(src="verdict_log")))
def scan_counters(spark, sf):
    return scan_ops.status_counts(verdict_log(spark, sf))


_AGE = """CASE WHEN {s} < 5 THEN 'just now' WHEN {s} < 60 THEN {s} || 's ago'
  WHEN {s} < 3600 THEN ({s} // 60) || 'm ago' WHEN {s} < 86400 THEN ({s} // 3600) || 'h ago'
  ELSE ({s} // 86400) || 'd ago' END"""
_DURATION = """CASE WHEN {s} < 60 THEN {s} || 's'
  WHEN {s} < 3600 THEN ({s} // 60) || 'm' || CASE WHEN {s} % 60 > 0 THEN ' ' || ({s} % 60) || 's' ELSE '' END
  ELSE ({s} // 3600) || 'h' || CASE WHEN ({s} // 60) % 60 > 0 THEN ' ' || (({s} // 60) % 60) || 'm' ELSE '' END END"""


@query(with_views("scans", f"""
, timed AS (SELECT *, date_diff('microsecond', started_at, finished_at) AS us,
                   date_diff('microsecond', started_at, finished_at) // 1000000 AS s,
                   date_diff('microsecond', started_at, TIMESTAMP '{AS_OF}') // 1000000 AS old FROM scans)
SELECT id, scope, total, corrupt, unreadable,
       CASE WHEN finished_at IS NOT NULL THEN 'complete' ELSE 'incomplete' END AS completion,
       CASE WHEN finished_at IS NULL THEN 'incomplete' WHEN corrupt + unreadable > 0 THEN 'completed with issues'
            ELSE 'completed' END AS state,
       CASE WHEN finished_at IS NOT NULL THEN us::DOUBLE / 1e6 ELSE 0.0 END AS duration_s,
       CASE WHEN finished_at IS NOT NULL THEN {_DURATION.format(s='s')} END AS duration,
       {_AGE.format(s='old')} AS age
FROM timed ORDER BY started_at DESC, id LIMIT 20""".strip()))
def scan_list(spark, sf):
    return reports.scan_list(scans(spark, sf), ts(AS_OF))


@query(with_views("scans", "SELECT * FROM scans WHERE id = '2024-01-17'"))
def scan_lookup(spark, sf):
    return scans(spark, sf).where("id = '2024-01-17'")


@query(with_views("scans", """
, latest AS (SELECT * FROM scans ORDER BY started_at DESC, id LIMIT 5)
SELECT id, finished_at::DATE::VARCHAR AS day, total, corrupt, unreadable,
       (SELECT count(*) FROM latest WHERE finished_at IS NULL) AS incomplete
FROM latest WHERE finished_at IS NOT NULL"""))
def scan_trend(spark, sf):
    return reports.health_trend(scans(spark, sf))


@query(with_views("scans", "SELECT * FROM scans ORDER BY started_at DESC, id LIMIT 1"))
def last_scan(spark, sf):
    return reports.recent_scans(scans(spark, sf), 1)


@query(with_views("scans", """
SELECT files_per_sec FROM scans WHERE finished_at IS NOT NULL ORDER BY finished_at DESC LIMIT 1"""))
def last_rate(spark, sf):
    return scan_ops.last_rate(scans(spark, sf))


@query(with_views("catalog scans", """
, last AS (SELECT * FROM scans ORDER BY started_at DESC, id DESC LIMIT 1),
open_issues AS (SELECT count(*) AS issues FROM catalog WHERE status IN ('corrupt', 'unreadable'))
SELECT id AS scan_id, issues, CASE WHEN finished_at IS NULL THEN 'incomplete'
       WHEN issues > 0 THEN 'completed with issues' ELSE 'completed' END AS state
FROM last, open_issues"""))
def last_scan_state(spark, sf):
    return reports.last_scan_state(catalog(spark, sf), scans(spark, sf))


def _runs(spark, sf):
    """Scans as runs: even days scheduled, odd days manual; every fifth day failed."""
    day = F.substring("id", 9, 2).cast("int")
    return scans(spark, sf).select(
        F.when(day % 2 == 0, "scheduled").otherwise("manual").alias("origin"),
        F.col("id").alias("scan_id"),
        F.when(day % 5 == 0, "failed")
        .when(F.col("finished_at").isNull(), "interrupted")
        .otherwise("completed")
        .alias("state"),
        "started_at",
        "finished_at",
        F.col("total").alias("processed"),
        "corrupt",
        "unreadable",
        F.when(day % 10 == 5, F.concat(F.lit("disk "), day.cast("string"))).alias("last_error"),
    )


_RUNS = """runs AS (
  SELECT CASE WHEN day % 2 = 0 THEN 'scheduled' ELSE 'manual' END AS origin, id AS scan_id,
         CASE WHEN day % 5 = 0 THEN 'failed' WHEN finished_at IS NULL THEN 'interrupted' ELSE 'completed' END AS state,
         started_at, finished_at, total AS processed, corrupt + unreadable AS issues,
         CASE WHEN day % 10 = 5 THEN 'disk ' || day END AS last_error
  FROM (SELECT *, CAST(substr(id, 9, 2) AS INT) AS day FROM scans))"""


@query(with_views("scans", f"""
, {_RUNS}, both_levels AS (SELECT *, origin AS grp FROM runs UNION ALL SELECT *, NULL FROM runs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY coalesce(finished_at, started_at) DESC, scan_id DESC) AS rn
           FROM both_levels)
SELECT grp AS origin, scan_id, state, started_at, finished_at, processed, issues, last_error FROM ranked WHERE rn = 1"""))
def last_run_by_origin(spark, sf):
    return scan_ops.last_runs(_runs(spark, sf))


@query(with_views("scans", f"""
, {_RUNS}
SELECT scan_id, CASE WHEN state = 'completed' AND issues = 0 THEN 'completed'
       WHEN state = 'completed' THEN 'completed with ' || issues || ' issue' || CASE WHEN issues = 1 THEN '' ELSE 's' END
       WHEN state = 'failed' AND last_error <> '' THEN last_error ELSE state END AS outcome
FROM runs"""))
def scan_outcomes(spark, sf):
    return _runs(spark, sf).select(
        "scan_id",
        text.run_outcome("state", F.col("corrupt") + F.col("unreadable"), F.col("last_error")).alias("outcome"),
    )


@query(with_views("scans", f"""
, timed AS (SELECT id, floor(date_diff('microsecond', TIMESTAMP '2024-01-15 12:00:00', started_at)::DOUBLE / 1e6 + 0.5)::BIGINT AS d
            FROM scans),
spans AS (SELECT *, abs(d) AS a FROM timed)
SELECT id, CASE WHEN a < 5 AND d >= 0 THEN 'in a moment' WHEN a < 5 THEN 'just now'
   ELSE CASE WHEN d >= 0 THEN 'in ' ELSE '' END ||
        CASE WHEN a < 60 THEN a || 's' WHEN a < 3600 THEN (a // 60) || 'm'
             WHEN a < 86400 THEN (a // 3600) || 'h' ELSE (a // 86400) || 'd' END ||
        CASE WHEN d >= 0 THEN '' ELSE ' ago' END END AS relative FROM spans"""))
def relative_times(spark, sf):
    at = ts("2024-01-15 12:00:00")
    return scans(spark, sf).select("id", text.relative_time("started_at", at).alias("relative"))


@query(with_views("", """
SELECT scan_id, path, checked_at, prev_status, status FROM (
  SELECT *, lag(status) OVER (PARTITION BY path ORDER BY checked_at, seq) AS prev_status FROM verdict_log)
WHERE status = 'corrupt' AND prev_status = 'ok'"""))
def transitions(spark, sf):
    return history.transitions(verdict_log(spark, sf)).select(
        "scan_id", "path", "checked_at", "prev_status", "status"
    )


ALERTS = """alerts AS (
  SELECT * FROM (
    SELECT *, lag(status) OVER (PARTITION BY path ORDER BY checked_at, seq) AS prev_status,
           coalesce(count(*) FILTER (status IN ('corrupt', 'unreadable')) OVER (
             PARTITION BY path ORDER BY checked_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM verdict_log)
  WHERE status IN ('corrupt', 'unreadable')
    AND (earlier = 0 OR (status = 'corrupt' AND prev_status = 'ok')))"""


@query(with_views("", f", {ALERTS} SELECT seq, scan_id, path, status, error FROM alerts"))
def alert_once(spark, sf):
    return history.alerts(verdict_log(spark, sf)).select("seq", "scan_id", "path", "status", "error")


@query(with_views("", f", {ALERTS} SELECT seq, path, status FROM alerts WHERE checked_at >= TIMESTAMP '{CUT}'"))
def alerts_since_cut(spark, sf):
    """Alerts after the cut from the later verdicts and the state at the cut."""
    log = verdict_log(spark, sf)
    known = history.alert_state(log.where(F.col("checked_at") < ts(CUT)))
    return history.alerts_since(log.where(F.col("checked_at") >= ts(CUT)), known).select("seq", "path", "status")


@query(with_views("", f", {ALERTS} SELECT seq, path, status FROM alerts WHERE scan_id = '2024-01-30'"))
def alerts_of_last_scan(spark, sf):
    rows = alerting.alerts_of_scan(verdict_log(spark, sf), "2024-01-30")
    return rows.select("seq", "path", "status")


@query(with_views("", f", {ALERTS} SELECT seq, path, status FROM alerts WHERE scan_id = '2024-01-17'"))
def alerts_of_middle_scan(spark, sf):
    """Later scans are no history of an earlier one."""
    rows = alerting.alerts_of_scan(verdict_log(spark, sf), "2024-01-17")
    return rows.select("seq", "path", "status")


DIGEST = f""", {ALERTS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY scan_id, status ORDER BY checked_at DESC, path, seq DESC) AS rk
           FROM alerts),
digest AS (
  SELECT scan_id, count(*) FILTER (status = 'corrupt') AS corrupt_count,
         count(*) FILTER (status = 'unreadable') AS unreadable_count,
         coalesce(string_agg(path || '=' || error, '|' ORDER BY rk) FILTER (status = 'corrupt' AND rk <= {{cap}}), '') AS corrupt,
         coalesce(string_agg(path || '=' || error, '|' ORDER BY rk) FILTER (status = 'unreadable' AND rk <= {{cap}}), '') AS unreadable
  FROM ranked GROUP BY scan_id)"""


def _stored_alerts(spark, sf):
    """Alerts as a job stores them before it reports; counts and lists both read them."""
    rows = history.alerts(verdict_log(spark, sf))
    return stage(rows.select("seq", "scan_id", "path", "status", "error", "checked_at"), "alerts")


@query(with_views("scans", DIGEST.format(cap=50) + """
SELECT d.*, s.scope, s.total AS total_checked,
       CASE WHEN s.finished_at IS NULL THEN 0.0
            ELSE date_diff('microsecond', s.started_at, s.finished_at)::DOUBLE / 1e6 END AS duration_s,
       greatest(corrupt_count - 50, 0) AS corrupt_more, greatest(unreadable_count - 50, 0) AS unreadable_more
FROM digest d LEFT JOIN scans s ON d.scan_id = s.id"""))
def alert_digest(spark, sf):
    out = alerting.digest(_stored_alerts(spark, sf), scans(spark, sf))
    listing = lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["path"], F.lit("="), r["error"])), "|")
    return out.withColumn("corrupt", listing("corrupt")).withColumn("unreadable", listing("unreadable"))


@query(with_views("scans", DIGEST.format(cap=3) + """
, joined AS (SELECT d.*, s.scope, s.total, u.checked, u.unreadable_all, CASE WHEN s.finished_at IS NULL THEN 0.0
                ELSE date_diff('microsecond', s.started_at, s.finished_at)::DOUBLE / 1e6 END AS dur
             FROM digest d JOIN scans s ON d.scan_id = s.id
             JOIN (SELECT scan_id, count(*) AS checked, count(*) FILTER (status = 'unreadable') AS unreadable_all
                   FROM verdict_log GROUP BY scan_id) u ON u.scan_id = d.scan_id),
body AS (SELECT scan_id,
  'Library check of ' || scope || ': ' || corrupt_count || ' damaged, ' || unreadable_count || ' unreadable' AS subject,
  'Library: ' || corrupt_count || ' damaged' AS title,
  'Library check ' || scan_id || ' of ' || scope || chr(10) || total || ' files in ' || printf('%.1f', dur) || ' s'
  || CASE WHEN unreadable_all::DOUBLE / checked >= 0.2 THEN chr(10) || 'Is ' || scope || ' mounted? ' || unreadable_all
       || ' of ' || checked || ' files could not be read.' ELSE '' END
  || CASE WHEN corrupt_count > 0 THEN chr(10) || 'Damaged: ' || corrupt_count
       || list_aggregate(list_transform(string_split(corrupt, '|'),
            lambda r: chr(10) || '- ' || replace(r, '=', ': ')), 'string_agg', '')
       || CASE WHEN corrupt_count > 3 THEN chr(10) || '- ' || (corrupt_count - 3) || ' others' ELSE '' END ELSE '' END
  || CASE WHEN unreadable_count > 0 THEN chr(10) || 'Unreadable: ' || unreadable_count
       || list_aggregate(list_transform(string_split(unreadable, '|'),
            lambda r: chr(10) || '- ' || replace(r, '=', ': ')), 'string_agg', '')
       || CASE WHEN unreadable_count > 3 THEN chr(10) || '- ' || (unreadable_count - 3) || ' others' ELSE '' END
     ELSE '' END AS message FROM joined)
SELECT scan_id, subject, title, message, title AS payload_title, message AS payload_message, scan_id AS payload_scan
FROM body"""))
def alert_messages(spark, sf):
    log = verdict_log(spark, sf)
    digests = alerting.digest(_stored_alerts(spark, sf), scans(spark, sf), listed=3, log=log)
    out = alerting.messages(digests, threshold=0.2)
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return out.select(
        "scan_id", "subject", "title", "message",
        field("title").alias("payload_title"), field("message").alias("payload_message"), field("scan_id").alias("payload_scan"),
    )


def _systemic_sql(threshold: float) -> str:
    return with_views("", f"""
SELECT scan_id, count(*) AS checked, count(*) FILTER (status = 'unreadable') AS unreadable,
       count(*) FILTER (status = 'unreadable')::DOUBLE / count(*) >= {threshold} AS suspected
FROM verdict_log GROUP BY scan_id""")


@query(_systemic_sql(0.5))
def systemic_flag(spark, sf):
    return alerting.systemic(verdict_log(spark, sf))


@query(_systemic_sql(0.22))
def systemic_flag_low(spark, sf):
    return alerting.systemic(verdict_log(spark, sf), 0.22)


@query(with_views("", """
SELECT seq, scan_id, count(*) OVER (PARTITION BY scan_id ORDER BY checked_at, seq) AS processed FROM verdict_log"""))
def running_progress(spark, sf):
    rows = verdict_log(spark, sf).select("seq", "scan_id", "checked_at")
    return history.running_processed(rows).drop("checked_at")


@query(with_views("queue", """
, done AS (SELECT scan_id, count(*) AS discovered, count(*) FILTER (done) AS processed FROM scan_queue GROUP BY scan_id),
timed AS (SELECT scan_id, date_diff('microsecond', min(checked_at), max(checked_at))::DOUBLE / 1e6 AS elapsed
          FROM verdict_log GROUP BY scan_id),
rated AS (SELECT scan_id, discovered, processed,
                 CASE WHEN elapsed < 0.001 THEN 0.0 ELSE processed::DOUBLE / elapsed END AS files_per_sec
          FROM done JOIN timed USING (scan_id)),
eta AS (SELECT *, discovered - processed AS remaining,
               CASE WHEN files_per_sec > 0 AND discovered > processed
                    THEN (discovered - processed) / files_per_sec END AS eta_s FROM rated)
SELECT *, ((1000 * processed) // discovered + CASE WHEN 2 * ((1000 * processed) % discovered) > discovered
             OR (2 * ((1000 * processed) % discovered) = discovered AND ((1000 * processed) // discovered) % 2 = 1)
             THEN 1 ELSE 0 END)::DOUBLE / 10.0 AS percent,
       least(100, floor(processed::DOUBLE / discovered * 100))::BIGINT AS percent_int,
       CASE WHEN eta_s IS NULL OR eta_s < 1 THEN '' WHEN ceil(eta_s) < 60 THEN ceil(eta_s)::BIGINT || 's remaining'
            ELSE '~' || ceil(ceil(eta_s) / 60)::BIGINT || 'm remaining' END AS eta
FROM eta"""))
def progress_rows(spark, sf):
    from suite.adapters import scan_queue

    done = scan_queue(spark, sf).groupBy("scan_id").agg(
        F.count("*").alias("discovered"), F.count_if("done").alias("processed")
    )
    timed = verdict_log(spark, sf).groupBy("scan_id").agg(
        text.seconds_between(F.min("checked_at"), F.max("checked_at")).alias("elapsed")
    )
    rated = done.join(timed, "scan_id").select(
        "scan_id", "discovered", "processed", scan_ops.rate(F.col("processed"), F.col("elapsed")).alias("files_per_sec")
    )
    return scan_ops.progress(rated).withColumn("eta", text.eta_text("eta_s"))


@query(with_views("scans", """
SELECT id, started_at, finished_at, scope, CASE WHEN finished_at IS NOT NULL THEN total END AS total,
       CASE WHEN finished_at IS NOT NULL THEN corrupt END AS corrupt,
       CASE WHEN finished_at IS NOT NULL THEN unreadable END AS unreadable, files_per_sec FROM scans"""))
def scan_history_fold(spark, sf):
    """Start and finish events written by scans, folded back to one row per scan."""
    base = scans(spark, sf)
    null = lambda t: F.lit(None).cast(t)
    start = base.select(
        "id", F.lit("start").alias("kind"), F.col("started_at").alias("at"), "scope",
        *[null("long").alias(c) for c in ("total", "corrupt", "unreadable")], null("double").alias("files_per_sec"),
    )
    finish = base.where("finished_at IS NOT NULL").select(
        "id", F.lit("finish").alias("kind"), F.col("finished_at").alias("at"), null("string").alias("scope"),
        "total", "corrupt", "unreadable", "files_per_sec",
    )
    return scan_ops.fold_events(start.unionByName(finish))


# --- the life of scans ----------------------------------------------------------------

# Fixture: the paths of a day's scan are queued in five parts. Scans of days 1, 5, 9, ... broke
# off behind part 2 and were resumed an hour later, which did part 2 again; every sixth day's
# scan broke off and was left. Records of parts and ends are written twice.
PARTS_SQL = """parts AS (
  SELECT scan_id, CAST(substr(scan_id, 9, 2) AS INT) AS day, CAST(seq % 5 AS INT) AS part, path, status, checked_at
  FROM verdict_log),
spans AS (SELECT scan_id, day, min(checked_at) AS started_at, max(checked_at) AS ended_at FROM parts GROUP BY scan_id, day),
done AS (SELECT * FROM parts WHERE day % 6 <> 0 OR part <= 2)"""


def _parts(spark, sf):
    return verdict_log(spark, sf).select(
        "scan_id",
        F.substring("scan_id", 9, 2).cast("int").alias("day"),
        (F.col("seq") % 5).cast("int").alias("part"),
        "path",
        "status",
        "checked_at",
    )


def _records(spark, sf):
    """Events and progress of all scans, and the queues of those that have not finished."""
    parts = _parts(spark, sf)
    spans = parts.groupBy("scan_id", "day").agg(F.min("checked_at").alias("began"), F.max("checked_at").alias("ended"))
    resumed, left = F.col("day") % 4 == 1, F.col("day") % 6 == 0
    scope = F.concat(F.lit("/lib"), F.col("day") % 4)
    record = lambda kind, attempt, at: F.struct(F.lit(kind).alias("kind"), F.lit(attempt).alias("attempt"), at.alias("at"))
    later = F.col("began") + F.expr("INTERVAL 1 HOUR")
    every = F.array(
        record("start", 1, F.col("began")),
        F.when(resumed, record("start", 2, later)),
        *[F.when(~left, record("finish", 1, F.col("ended")))] * 2,
    )
    events = spans.select(F.col("scan_id").alias("id"), scope.alias("scope"), F.explode(every).alias("r")).where("r IS NOT NULL")
    counts = parts.groupBy("scan_id", "day", "part").agg(
        F.max("checked_at").alias("at"),
        F.count("*").alias("processed"),
        F.lit(0).cast("long").alias("skipped"),
        F.lit(0).cast("long").alias("discards"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.lit(0.5).alias("elapsed_s"),
    )
    attempts = F.when(resumed & (F.col("part") == 2), F.array(F.lit(1), F.lit(1), F.lit(2)))
    attempts = attempts.when(resumed & (F.col("part") > 2), F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(1)))
    progress = counts.where(~left | (F.col("part") <= 2)).withColumn("attempt", F.explode(attempts)).drop("day")
    return events.select("id", "scope", "r.*"), progress, parts.where(left).select("scan_id", "part", "path")


@query(with_views("", f"""
, {PARTS_SQL}
SELECT scan_id, started_at, CASE WHEN day % 6 <> 0 THEN ended_at END AS finished_at, CASE WHEN day % 4 = 1 THEN 2 ELSE 1 END AS attempts,
       '/lib' || (day % 4) AS scope, count(DISTINCT part) AS parts_done, count(part) AS total,
       count(*) FILTER (status = 'corrupt') AS corrupt, count(*) FILTER (status = 'unreadable') AS unreadable,
       count(part) / (count(DISTINCT part) * 0.5::DOUBLE) AS files_per_sec,
       CASE WHEN day % 6 <> 0 THEN 'complete' ELSE 'incomplete' END AS state
FROM spans JOIN done USING (scan_id, day) GROUP BY ALL"""))
def scan_lifecycle(spark, sf):
    """Scans from their records, some of them resumed, repeated or broken off."""
    events, progress, _ = _records(spark, sf)
    return lifecycle.fold(events, progress).select(
        "scan_id", "started_at", "finished_at", "attempts", "scope", "parts_done", "total", "corrupt", "unreadable", "files_per_sec", "state"
    )


@query(with_views("", f"""
, {PARTS_SQL}
SELECT DISTINCT scan_id, part, path, (SELECT count(*) FROM done d WHERE d.scan_id = p.scan_id) AS done_before
FROM parts p WHERE day % 6 = 0 AND part > 2"""))
def scan_resume_plan(spark, sf):
    """What is left of the scans that broke off, and how much they had done."""
    events, progress, queue = _records(spark, sf)
    open_scans = lifecycle.fold(events, progress).where("state = 'incomplete'").select("scan_id", F.col("processed").alias("done_before"))
    return lifecycle.pending(queue.distinct(), progress).join(open_scans, "scan_id")
