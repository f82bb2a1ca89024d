"""Behaviour of single operators on hand-made rows."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import paths, text
from assay.operators import changes, fingerprints, history, importing, notices, queue, scans, segmented, skew, table_checks, verdicts
from assay.operators.catalog import fold, merge, reset
from assay.operators.segmented import prefixes
from assay.plans import alerting, paging, reports
from assay.schemas import ISSUE_STATUSES, STATUSES

T0 = datetime(2024, 1, 1)
LOG = "seq long, scan_id string, path string, mtime double, size long, status string, error string, checked_at timestamp"


def log(spark, rows):
    """rows: (path, status[, scan_id]) in time order."""
    full = [
        (i, (r[2] if len(r) > 2 else "s"), r[0], 1.0, 10, r[1], None if r[1] == "ok" else f"e {r[1]}", T0 + timedelta(hours=i))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, LOG)


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


# --- paths ---------------------------------------------------------------------------


def test_extension_rules(spark):
    names = ["/a/b.JPG", "/a/.bashrc", "/a.b/f", "/a/f", "x.tar.gz", "/a/f."]
    assert column(spark, names, paths.scan_ext) == [".jpg", "", "", "", ".gz", ""]
    assert column(spark, names, paths.report_ext) == [".jpg", ".bashrc", ".b/f", "(no ext)", ".gz", "."]


@pytest.mark.parametrize(
    "path, globs, want",
    [
        ("/m/roll7/scan.tif", [], False),
        ("/m/roll7/Thumbs.db", ["**/Thumbs.db"], True),
        ("/m/.trash/old/scan.tif", ["**/.trash/**"], True),
        ("/m/roll7/scan.tif", ["**/.trash/**"], False),
        ("/m/roll7/scan.xmp", ["**/Thumbs.db", "**/*.xmp"], True),
        ("/a/b1.jpg", ["/a/b[0-3].jpg"], True),
        ("/a/b1.jpg", ["/a/b[!0-3].jpg"], False),
        ("/a/b+.jpg", ["/a/b?.jpg"], True),
        ("/a/x(1).jpg", ["*x(1).jpg"], True),
        (".hidden", ["*"], False),
    ],
)
def test_globs(spark, path, globs, want):
    assert column(spark, [path], lambda c: paths.excluded(c, globs)) == [want]


def test_prefix_and_scope(spark):
    names = ["/lib", "/lib/a", "/library/a", "/LIB/b", "/x%/a"]
    assert column(spark, names, lambda c: paths.in_scope(c, ["/lib/"])) == [True, True, False, False, False]
    assert column(spark, names, lambda c: paths.has_prefix(c, "/lib")) == [True, True, True, True, False]
    assert column(spark, names, lambda c: paths.has_prefix(c, "/%")) == [False] * 5
    assert column(spark, names, lambda c: paths.in_scope(c, ["/"])) == [True] * 5
    assert column(spark, ["/a.JPG", "/ajpg"], lambda c: paths.has_ext(c, "..jpg")) == [True, False]


REMAPS = [("/old", "/new"), ("/old/x/", "/never"), ("/data", "/mnt/"), ("/", "/root")]


def test_remap_first_boundary_match_wins(spark):
    names = ["/old/a", "/old", "/older/a", "/old/x/y", "/data/q", "rel/a"]
    want = ["/new/a", "/new", "/root/older/a", "/new/x/y", "/mnt/q", "rel/a"]
    assert column(spark, names, lambda c: paths.remap_prefix(c, dict(REMAPS))) == want
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, path string")
    table = spark.createDataFrame([(i, o, n) for i, (o, n) in enumerate(REMAPS)], "ordinal int, old string, new string")
    assert [r.path for r in importing.remap_by_table(df, table).orderBy("i").collect()] == want


# --- text ----------------------------------------------------------------------------


def test_text_forms(spark):
    assert column(spark, [-1, 0, 59, 60, 61, 3600, 3660, 7325], text.duration, "long") == [
        None, "0s", "59s", "1m", "1m 1s", "1h", "1h 1m", "2h 2m",
    ]
    assert column(spark, [None, 0.5, 1.0, 59.2, 59.9, 61.0], text.eta_text, "double") == [
        "", "", "1s remaining", "~1m remaining", "~1m remaining", "~2m remaining",
    ]
    assert column(spark, [0, 256, 1536, 1 << 20, 3 << 30], text.byte_size, "long") == [
        "0.0 KB", "0.2 KB", "1.5 KB", "1.0 MB", "3.0 GB",
    ]
    assert column(spark, ["x" * 60, "x" * 61], text.truncated) == ["x" * 60, "x" * 60 + "…"]
    assert column(spark, [".jpg", "(no ext)", "other"], text.ext_label) == ["JPG", "No ext", "Others"]


def test_percent_rounding(spark):
    df = spark.createDataFrame([(1, 3), (1, 16), (3, 16), (0, 0), (7, 7)], "n long, t long")
    up = [r[0] for r in df.select(text.percent_1dp(F.col("n"), F.col("t"))).collect()]
    even = [r[0] for r in df.select(text.percent_1dp(F.col("n"), F.col("t"), half_even=True)).collect()]
    assert up == [33.3, 6.3, 18.8, 0.0, 100.0]
    assert even == [33.3, 6.2, 18.8, 0.0, 100.0]


def test_relative_times(spark):
    base = datetime(2024, 1, 10)
    at = F.lit(base)
    stamps = [base - timedelta(seconds=s) for s in (2, 30, 90, 7200, 200000)]
    assert column(spark, stamps, lambda c: text.age(c, at), "timestamp") == [
        "just now", "30s ago", "1m ago", "2h ago", "2d ago",
    ]
    stamps = [base + timedelta(seconds=s) for s in (2, 30, -90, 7200)]
    assert column(spark, stamps, lambda c: text.relative_time(c, at), "timestamp") == [
        "in a moment", "in 30s", "1m ago", "in 2h",
    ]


def test_iso_parsing(spark):
    got = column(
        spark,
        ["2024-01-01T00:00:00+00:00", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00", "2024-01-01", "nonsense", ""],
        lambda c: F.date_format(text.parse_iso_utc(c), "yyyy-MM-dd HH:mm"),
    )
    assert got == ["2024-01-01 00:00"] * 4 + [None, None]


def test_run_outcomes(spark):
    rows = [("completed", 0, None), ("completed", 1, None), ("completed", 4, None), ("failed", 0, "disk"), ("failed", 0, None), ("interrupted", 0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, n long, e string")
    out = df.orderBy("i").select(text.run_outcome("s", F.col("n"), F.col("e")).alias("o")).collect()
    assert [r.o for r in out] == ["completed", "completed with 1 issue", "completed with 4 issues", "disk", "failed", "interrupted"]


# --- catalog and history ---------------------------------------------------------------


def test_fold_is_order_independent_and_incremental(spark):
    rows = [(f"/p{i % 7}", random.Random(i).choice(STATUSES)) for i in range(60)]
    whole = log(spark, rows)
    want = sorted(fold(whole).collect())
    assert sorted(fold(whole.orderBy(F.rand(3))).collect()) == want
    early, late = whole.where("seq < 25"), whole.where("seq >= 25")
    assert sorted(merge(fold(early), late).collect()) == want
    assert sorted(merge(fold(late), early).collect()) == want  # late arrival


def test_reset(spark):
    df = fold(log(spark, [("/a/x", "ok"), ("/ab", "ok"), ("/b", "ok")]))
    assert [r.path for r in reset(df, "/A").collect()] == ["/b"]
    assert reset(df).count() == 0


def simulate_alerts(rows):
    """Row by row: notified is carried, and reset only when a path goes from ok to corrupt."""
    state, out = {}, []
    for i, (path, status) in enumerate(rows):
        last, notified = state.get(path, (None, False))
        if status == "corrupt" and last == "ok":
            notified = False
        if status in ISSUE_STATUSES and not notified:
            out.append(i)
            notified = True
        state[path] = (status, notified)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_alert_rule_equals_row_by_row_state(spark, seed):
    rng = random.Random(seed)
    rows = [(f"/p{rng.randrange(12)}", rng.choice(STATUSES)) for _ in range(400)]
    got = sorted(r.seq for r in history.alerts(log(spark, rows)).select("seq").collect())
    assert got == simulate_alerts(rows)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_history_does_not_depend_on_the_layout(spark, partitions):
    """A hot path, null statuses and a null path, in layouts of few and of many partitions."""
    rng = random.Random(5)
    rows = [(rng.choice(["/hot"] * 8 + ["/a", "/b", None]), rng.choice([*STATUSES, None])) for _ in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.seq: (r.prev_status, r.had_issue) for r in history.with_history(log(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    last, want = {}, {}
    for i, (path, status) in enumerate(rows):
        want[i] = last.get(path, (None, False))
        last[path] = (status, want[i][1] or status in ISSUE_STATUSES)
    assert got == want


def test_alerts_over_a_null_status(spark):
    rows = [("/p", "corrupt"), ("/p", None), ("/p", "ok"), ("/p", None), ("/p", "corrupt"), ("/p", "ok"), ("/p", "corrupt")]
    assert sorted(r.seq for r in history.alerts(log(spark, rows)).collect()) == [0, 6]


def simulate_notices(events):
    """Event by event, as a table with one row per path would be updated."""
    state = {}
    for i, (path, what) in enumerate(events):
        status, told = state.get(path, (None, None))
        if what == "told":
            if path in state:
                state[path] = (status, i)
        else:
            state[path] = (what, None if (what, status) == ("corrupt", "ok") else told)
    return state


@pytest.mark.parametrize("seed", [3, 4])
def test_notices_equal_row_by_row_updates(spark, seed):
    rng = random.Random(seed)
    paths = ["/hot"] * 6 + [f"/p{i}" for i in range(12)]
    events = [(rng.choice(paths), rng.choice(["ok", "corrupt", "ok", "corrupt", "unreadable", "told"])) for _ in range(400)]
    at = lambda i: datetime(2024, 1, 1) + timedelta(minutes=i)
    verdict_rows = spark.createDataFrame(
        [(p, w, at(i), i) for i, (p, w) in enumerate(events) if w != "told"], "path string, status string, checked_at timestamp, seq long"
    )
    told_rows = spark.createDataFrame([(p, at(i)) for i, (p, w) in enumerate(events) if w == "told"], "path string, delivered_at timestamp")
    want = {p: (s, None if i is None else at(i)) for p, (s, i) in simulate_notices(events).items()}
    got = lambda df: {r.path: (r.status, r.notified_at) for r in df.collect()}
    assert got(notices.advance(verdict_rows, told_rows)) == want
    # in three steps, every step with all deliveries up to its end once more
    state = None
    for a, b in ((0, 100), (100, 250), (250, 400)):
        some = verdict_rows.where((F.col("seq") >= a) & (F.col("seq") < b))
        state = notices.advance(some, told_rows.where(F.col("delivered_at") < F.lit(at(b))), state)
        state = spark.createDataFrame(state.collect(), state.schema)
    assert got(state) == want


def test_prefixes_of_numbers_and_counts(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), i, rng.choice([None, 1.5, 2.5])) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int, v double")
    out = prefixes(df, ["g"], ["i"], {"before": F.col("v")}, {"high": F.col("v") > 2}, "n").collect()
    for r in out:
        earlier = [v for g, i, v in rows if g == r.g and i < r.i]
        known = [v for v in earlier if v is not None]
        assert (r.n, r.before, r.high) == (len(earlier), known[-1] if known else None, 2.5 in known)
    assert prefixes(df.limit(0), ["g"], ["i"], count="n").count() == 0


def test_history_reads_and_shuffles_the_log_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    log(spark, [("/p", "ok"), ("/q", "corrupt")]).write.parquet(folder)
    seen = []
    stage = segmented.stage
    segmented.stage = lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, name)
    try:
        history.with_history(spark.read.parquet(folder)).collect()
    finally:
        segmented.stage = stage
    plan = seen[0].split("Initial Plan")[-1]
    assert (plan.count("Exchange"), plan.count("FileScan")) == (1, 1)


def test_positions_of_one_huge_group(spark):
    """Nine of ten rows are one group; it is spread over partitions and still numbered right."""
    rng = random.Random(9)
    rows = [("big" if i % 10 else f"g{i}", rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t double, i long")
    got = {r.i: r.position for r in history.group_positions(df, ["g"], ["t", "i"]).collect()}
    want, n = {}, {}
    for g, t, i in sorted(rows):
        n[g] = n.get(g, 0) + 1
        want[i] = n[g]
    assert got == want


def test_join_facts_splits_hot_keys(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i long")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    more = spark.createDataFrame([("lonely", 999), (None, 998)], "k string, i long")
    got = skew.join_facts(rows.unionByName(more), facts, "k", per_task=20)
    out = {r.i: r.top for r in got.collect()}
    assert got.count() == len(out) == 302 and out[999] is out[998] is None and out[1] == 299 and out[3] == 3


# --- changes ---------------------------------------------------------------------------


def _catalog(spark, rows, kind="timestamp"):
    return spark.createDataFrame(rows, f"path string, mtime double, size long, checked_at {kind}")


def test_needs_check_classes(spark):
    now = datetime(2024, 2, 1)
    inv = spark.createDataFrame(
        [("/new", 1.0, 1), ("/same", 1.0, 1), ("/touched", 2.0, 1), ("/grown", 1.0, 2), ("/old", 1.0, 1), ("/gone", 0.0, 0)],
        "path string, mtime double, size long",
    )
    cat = _catalog(spark, [
        ("/same", 1.0, 1, now - timedelta(days=9, hours=23)), ("/touched", 1.0, 1, now), ("/grown", 1.0, 1, now),
        ("/old", 1.0, 1, now - timedelta(days=10)), ("/gone", 0.0, 0, now),
    ])
    got = {r.path: r.reason for r in changes.classify(inv, cat, F.lit(now), 10).collect()}
    assert got == {"/new": "new", "/same": "fresh", "/touched": "changed", "/grown": "changed", "/old": "stale", "/gone": "fresh"}
    off = {r.path: r.reason for r in changes.classify(inv, cat, F.lit(now), 0).collect()}
    assert off["/old"] == "fresh"


def test_unparseable_check_time_forces_a_check(spark):
    inv = spark.createDataFrame([(p, 1.0, 1) for p in ("/bad", "/empty", "/naive")], "path string, mtime double, size long")
    cat = _catalog(spark, [("/bad", 1.0, 1, "soon"), ("/empty", 1.0, 1, ""), ("/naive", 1.0, 1, "2024-01-01T00:00:00")], "string")
    got = {r.path: r.reason for r in changes.classify(inv, cat, F.lit(datetime(2024, 1, 5)), 5).collect()}
    assert got == {"/bad": "stale", "/empty": "fresh", "/naive": "fresh"}


def test_guard(spark):
    pre = spark.createDataFrame([("/a", 1.0, 1), ("/b", 1.0, 1), ("/c", 1.0, 1)], "path string, mtime double, size long")
    post = spark.createDataFrame([("/a", 1.0, 1), ("/b", 1.0, 2)], "path string, mtime double, size long")
    assert {r.path: r.discarded for r in changes.guard_changes(pre, post).collect()} == {"/a": False, "/b": True, "/c": True}


# --- import and queue --------------------------------------------------------------------

REC = "ordinal long, path string, status string, mtime double, size long"


def test_import_rules(spark):
    recs = spark.createDataFrame(
        [(1, "/a", "ok", 1.0, 1), (2, "/a", "corrupt", 1.0, 1), (3, "", "ok", 1.0, 1), (4, None, "ok", 1.0, 1),
         (5, "/missing", "ok", 1.0, 1), (6, "/have", "corrupt", 2.0, 2), (7, "/new", None, None, None)],
        REC,
    )
    cat = spark.createDataFrame([("/have", "ok", 1.0, 1)], "path string, status string, mtime double, size long")
    exist = spark.createDataFrame([(p,) for p in ("/a", "/have", "/new")], "path string")
    recs = importing.prepare(recs)
    got = {r.ordinal: r.action for r in importing.actions(recs, cat, exist).collect()}
    assert got == {1: "inserted", 2: "skipped_existing", 3: "skipped_empty", 4: "skipped_empty", 5: "skipped_missing",
                   6: "skipped_existing", 7: "inserted"}
    after = {r.path: (r.status, r.mtime) for r in importing.apply_import(cat, recs, exist).collect()}
    assert after == {"/a": ("ok", 1.0), "/have": ("ok", 1.0), "/new": ("error", 0.0)}
    forced = {r.path: r.status for r in importing.apply_import(cat, recs, exist, force=True).collect()}
    assert forced == {"/a": "corrupt", "/have": "corrupt", "/new": "error"}
    counts = importing.result_counts(importing.actions(recs, cat, exist, force=True)).collect()[0]
    assert (counts.inserted, counts.skipped) == (4, 3)


def test_queue_lifecycle(spark):
    q = spark.createDataFrame([("s", "/a", True), ("s", "/b", False)], "scan_id string, path string, done boolean")
    new = spark.createDataFrame([("s", "/a"), ("s", "/c"), ("s", "/c"), ("t", "/a")], "scan_id string, path string")
    q2 = queue.enqueue(q, new)
    assert sorted(map(tuple, q2.collect())) == [("s", "/a", True), ("s", "/b", False), ("s", "/c", False), ("t", "/a", False)]
    q3 = queue.mark_done(q2, spark.createDataFrame([("s", "/b")], "scan_id string, path string"))
    assert sorted(r.path for r in queue.pending(q3, "s").collect()) == ["/c"]
    assert queue.pending(q3, limit=1).count() == 1
    assert sorted(map(tuple, queue.without_finished(q3, "s").select("scan_id", "path").collect())) == [("s", "/c"), ("t", "/a")]


def test_stale_queues_compare_calendar_days(spark):
    q = spark.createDataFrame([("old", "/a", False), ("edge", "/a", False), ("young", "/a", False), ("done", "/a", False)],
                              "scan_id string, path string, done boolean")
    s = spark.createDataFrame(
        [("old", datetime(2024, 1, 1), None), ("edge", datetime(2024, 1, 3, 23, 59), None),
         ("young", datetime(2024, 1, 4), None), ("done", datetime(2024, 1, 1), datetime(2024, 1, 2))],
        "id string, started_at timestamp, finished_at timestamp",
    )
    stale = queue.stale_scan_ids(q, s, F.lit(datetime(2024, 1, 10, 1)), 7)
    assert sorted(r.scan_id for r in stale.collect()) == ["edge", "old"]
    assert sorted(r.scan_id for r in queue.drop_stale(q, stale).collect()) == ["done", "young"]


# --- scans and reports -----------------------------------------------------------------


def test_unknown_status_counts_as_error(spark):
    row = scans.status_counts(log(spark, [("/a", "ok"), ("/b", "odd"), ("/c", "error"), ("/d", None)])).collect()[0]
    assert (row.total, row.ok, row.error) == (4, 1, 3)


def test_last_rate_ignores_open_scans_and_zero(spark):
    schema = "finished_at timestamp, files_per_sec double"
    df = spark.createDataFrame([(datetime(2024, 1, 1), 5.0), (datetime(2024, 1, 2), 7.0), (None, 9.0)], schema)
    assert scans.last_rate(df).collect()[0][0] == 7.0
    assert scans.last_rate(spark.createDataFrame([(datetime(2024, 1, 1), 0.0)], schema)).collect()[0][0] is None
    assert scans.last_rate(spark.createDataFrame([], schema)).collect()[0][0] is None


def test_overview_golden(spark):
    rows = [(f"/r/{i}.cr2", "ok") for i in range(4)] + [(f"/r/{i}.pdf", "corrupt") for i in range(3)]
    rows += [("/r/9.cr2", "error"), ("/r/9.pdf", "unsupported"), ("/r/x.doc", "ok")]
    df = log(spark, rows)
    got = [(r.ext, r.status, r["count"]) for r in reports.overview_ordered(reports.overview_breakdown(df)).collect()]
    assert sorted(got) == [
        (".cr2", "error", 1), (".cr2", "ok", 4), (".doc", "ok", 1), (".pdf", "corrupt", 3), (".pdf", "unsupported", 1),
    ]
    types = reports.file_type_breakdown(df, 2).orderBy("rank").collect()
    assert [(r.label, r.percent) for r in types] == [("CR2", 50.0), ("PDF", 40.0), ("Others", 10.0)]


def test_empty_library(spark):
    df = log(spark, []).withColumn("notified_at", F.lit(None).cast("timestamp"))
    sc = spark.createDataFrame([], "id string, started_at timestamp, finished_at timestamp, total long, corrupt long, unreadable long, scope string, files_per_sec double")
    assert reports.health_state(df).collect()[0].state == "Ready to scan"
    assert reports.file_type_breakdown(df).count() == 0
    assert reports.last_scan_state(df, sc).collect()[0].state == "none"
    assert reports.totals(df).collect()[0].total_size_bytes == 0
    assert reports.health_report(df, sc, F.lit(T0), 5).where("section = 'stale'").collect()[0].value == "0"
    assert [r.line for r in reports.exposition(reports.metrics(df, sc)).collect()] == ["files_indexed_total 0"]


@pytest.mark.parametrize(
    "flags, want",
    [({}, "Issues found"), ({"scanning": True}, "Scan running"), ({"scanning": True, "access_problem": True}, "Access problem suspected"),
     ({"config_error": True, "access_problem": True}, "Configuration needed")],
)
def test_health_precedence(spark, flags, want):
    assert reports.health_state(log(spark, [("/a", "corrupt"), ("/b", "ok")]), **flags).collect()[0].state == want


def test_digest_caps_lists_but_not_counts(spark):
    rows = [(f"/c{i:03d}", "corrupt") for i in range(60)] + [(f"/u{i:03d}", "unreadable") for i in range(5)]
    df = log(spark, rows)
    sc = spark.createDataFrame([("s", T0, T0 + timedelta(seconds=90), 100, "/lib")],
                               "id string, started_at timestamp, finished_at timestamp, total long, scope string")
    d = alerting.digest(df, sc, log=df)
    row = d.collect()[0]
    assert (row.corrupt_count, len(row.corrupt), row.corrupt_more) == (60, 50, 10)
    assert row.corrupt[0].path == "/c059" and len(row.unreadable) == 5
    m = alerting.messages(d).collect()[0]
    assert m.subject == "Library check of /lib: 60 damaged, 5 unreadable"
    sent = json.loads(m.payload)
    assert sent == {"title": "Library: 60 damaged", "message": m.message, "scan_id": "s"}
    assert "- 10 others" in m.message and "mounted" not in m.message and "in 90.0 s" in m.message
    assert "Is /lib mounted? 5 of 65 files" in alerting.messages(d, threshold=0.05).collect()[0].message


def test_files_that_alerted_before_count_as_unreadable(spark):
    """A second outage raises no new alerts, but the mount is as suspect as before."""
    df = log(spark, [("/a", "corrupt")] + [(f"/u{i}", "unreadable") for i in range(9)])
    sc = spark.createDataFrame([("s", T0, T0, 10, "/lib")], "id string, started_at timestamp, finished_at timestamp, total long, scope string")
    m = alerting.messages(alerting.digest(df.where("path = '/a'"), sc, log=df)).collect()[0]
    assert "9 of 10 files" in m.message


def test_rows_without_a_group_keep_their_positions(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, t int")
    got = sorted((r.g or "", r.t, r.position) for r in history.group_positions(df, ["g"], ["t"]).collect())
    assert got == [("", 2, 1), ("", 3, 2), ("a", 1, 1)]


def test_systemic_threshold_is_inclusive(spark):
    df = log(spark, [("/a", "unreadable"), ("/b", "ok")])
    assert alerting.systemic(df).collect()[0].suspected is True
    assert alerting.systemic(df, 0.51).collect()[0].suspected is False


# --- verdicts --------------------------------------------------------------------------


def test_status_domain_is_closed(spark):
    with pytest.raises(ValueError):
        verdicts.verdict("fine")
    df = spark.createDataFrame([("fine",)], "status string").select(
        verdicts.checked(F.struct("status", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("suggested_action"))).alias("v")
    )
    with pytest.raises(Exception, match="Invalid status: fine"):
        df.collect()


def test_rules_are_tried_in_order(spark):
    v = verdicts.first_failing(
        verdicts.rule(F.col("v") > 10, "truncated", "first"), verdicts.rule(F.col("v") > 5, "unknown_audio", "second")
    )
    got = column(spark, [1, 7, 20], lambda _: F.concat_ws(":", v["status"], v["error"]), "int")
    assert got == ["ok", "unsupported:second", "corrupt:first"]
    retry = verdicts.or_else(v, "unsupported", verdicts.ok())
    assert column(spark, [7, 20], lambda _: retry["status"], "int") == ["ok", "corrupt"]


def test_vector_and_page_verdicts(spark):
    vectors = [None, [1.0, 2.0], [1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    got = column(spark, vectors, lambda c: table_checks.vector_verdict(c, 2)["status"], "array<double>")
    assert got == ["unreadable", "ok", "corrupt", "corrupt", "corrupt", "corrupt"]
    pages = [None, " ", "<!DOCTYPE html><p></html >", "<p></html>", "<!doctype html><p>"]
    assert column(spark, pages, lambda c: table_checks.page_verdict(c)["error"]) == [
        "empty page", "empty page", None, "doctype missing", "closing html tag missing",
    ]


def test_moves_never_pair_up_groups(spark):
    df = lambda rows: spark.createDataFrame(rows, "path string, hash string, partial_hash string")
    before = df([("/a", "1", None), ("/b", "2", None), ("/c", "3", None), ("/d", "3", None), ("/e", "4", None)])
    after = df([("/a", "1", None), ("/x", "2", None), ("/y", "3", None), ("/z", "3", None), ("/n", "5", None)])
    got = {r.fingerprint: (r.state, r.vanished, r.appeared, r.from_path, r.to_path) for r in fingerprints.moves(before, after).collect()}
    assert got == {"2": ("moved", 1, 1, "/b", "/x"), "3": ("ambiguous", 2, 2, None, None), "4": ("vanished", 1, 0, None, None),
                   "5": ("appeared", 0, 1, None, None)}


@pytest.mark.parametrize("offset", [0, 7, 120, 333, 599, 640])
def test_pages_at_any_depth(spark, offset):
    """Times that many files share, a missing time, repeated paths, and pages over the edges."""
    rng = random.Random(3)
    at = lambda: rng.choice([None, datetime(2024, 1, 1), datetime(2024, 1, 1), datetime(2024, 3, 1), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(10**6))])
    rows = [(f"/lib/{rng.choice('aé中')}/{rng.randrange(99)}.jpg", at()) for _ in range(600)]
    df = spark.createDataFrame(rows, "path string, checked_at timestamp")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or datetime(2024, 1, 1)).timestamp(), r[0].encode()))
    got = [(r.path, r.checked_at) for r in paging.page(df, 20, offset, within=15).collect()]
    assert got == want[offset : offset + 20]


def test_dashboard_of_an_empty_catalog_and_of_null_statuses(spark):
    rows = log(spark, [("/a.jpg", "ok"), ("/b.jpg", None), ("/c", "corrupt")])
    scans = spark.createDataFrame([], "id string, started_at timestamp, finished_at timestamp, total long, corrupt long, unreadable long, scope string, files_per_sec double")
    report = lambda df: sorted(map(str, (tuple(r) for r in reports.health_report(df, scans, F.lit(T0 + timedelta(days=9)), 2).collect() if r.section != "error")))
    sums = [("size", "total size", "0.0 KB"), ("stale", ">2 days", "3")]
    want = [("status", "ok", "1"), ("status", None, "1"), ("status", "corrupt", "1"), ("format", ".jpg", "2"), ("format", "(no ext)", "1")]
    assert report(rows) == sorted(map(str, want + sums))
    assert report(rows.where("false")) == sorted(map(str, [("size", "total size", "0.0 KB"), ("stale", ">2 days", "0")]))


def test_import_counts_need_no_join(spark):
    schema = "ordinal long, path string, status string, mtime double, size long"
    rows = [(0, "/new", "ok", 1.0, 1), (1, "/new", "ok", 1.0, 1), (2, "/old", "ok", 1.0, 1), (3, "/gone", "ok", 1.0, 1), (4, "", "ok", 1.0, 1), (5, None, "ok", 1.0, 1)]
    records = importing.prepare(spark.createDataFrame(rows, schema))
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    known, existing = paths("/old"), paths("/new", "/old")
    for force, want in ((False, (1, 5)), (True, (3, 3))):
        assert tuple(importing.import_counts(records, known, existing, force).first()) == want
        assert tuple(importing.result_counts(importing.actions(records, known, existing, force)).first()) == want
    empty = records.where("false")
    assert tuple(importing.import_counts(empty, known, existing).first()) == (0, 0)
