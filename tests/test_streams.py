"""Streams agree with their batch twins, also over several batches and restarts."""

from __future__ import annotations

import os
import random
import time

from pyspark.sql import Row, functions as F

import files
from assay.operators.catalog import fold
from assay.operators.history import alerts as batch_alerts
from assay.schemas import STATUSES
from assay.sources.inventory import read_inventory
from assay.streaming import alert_stream, catalog_stream, live
from assay.streaming.scan_stream import check_stream, work_stream
from test_operators import LOG, log


def _parts(spark, folder, n=3):
    """A log in several files, oldest first."""
    rng = random.Random(4)
    df = log(spark, [(f"/p{rng.randrange(8)}", rng.choice(STATUSES)) for _ in range(90)])
    for i in range(n):
        df.where(f"seq % 90 >= {30 * i} AND seq % 90 < {30 * i + 30}").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return df


def _stream(spark, folder):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streams_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "log")
    whole = _parts(spark, folder)
    out = str(tmp_path / "alerts")
    sent = []
    q = alert_stream.deliver(
        alert_stream.alerts(_stream(spark, folder)), out, out + "/cp", send=lambda df, i: sent.append(df.count())
    )
    q.awaitTermination()
    got = sorted(r.seq for r in spark.read.parquet(out + "/alerts").collect())
    assert got == sorted(r.seq for r in batch_alerts(whole).collect())
    assert sum(sent) == len(got) and len(sent) == 3

    again = str(tmp_path / "again")
    alert_stream.alert_batches(_stream(spark, folder), again, again + "/cp", compact_every=2).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(again + "/alerts").collect()) == got

    cat = str(tmp_path / "catalog")
    catalog_stream.maintain(_stream(spark, folder), cat, cat + "/cp", compact_every=2).awaitTermination()
    cols = ["path", "seq", "status"]
    want = sorted(fold(whole).select(*cols).collect())
    assert sorted(catalog_stream.current(spark, cat).select(*cols).collect()) == want
    assert os.path.isdir(cat + "/snapshots/v=1")

    seen = []
    listener = live.ProgressListener(lambda state, detail: seen.append(state))
    spark.streams.addListener(listener)
    counts = str(tmp_path / "counts")
    live.publish_counts(_stream(spark, folder), counts, counts + "/cp", compact_every=2).awaitTermination()
    total = sorted(map(tuple, live.counts(whole).collect()))
    assert sorted(map(tuple, live.current_counts(spark, counts).collect())) == total
    assert os.path.isdir(counts + "/snapshots/v=1")
    # a batch that is run again changes nothing, whether it has been summed up or not
    for batch_id in (0, 2):
        rows = spark.read.parquet(f"{counts}/deltas/batch={batch_id}").collect()
        live.state(spark, counts).add(spark.createDataFrame(rows, "scan_id string, status string, cnt long, bucket int"), batch_id)
    assert sorted(map(tuple, live.current_counts(spark, counts).collect())) == total
    for _ in range(50):
        if seen[-1:] == ["completed"]:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert seen[0] == "started" and seen[-1] == "completed" and seen.count("running") >= 3


def test_checking_resumes_and_does_nothing_twice(spark, tmp_path):
    lib, work, out = tmp_path / "lib", str(tmp_path / "work"), str(tmp_path / "out")
    lib.mkdir()
    (lib / "a.png").write_bytes(files.png())
    (lib / "b.png").write_bytes(files.png()[:20])
    read_inventory(spark, [str(lib)], tasks=1).coalesce(1).write.parquet(work)
    run = lambda: check_stream(work_stream(spark, work), out, str(tmp_path / "cp"), "s1").awaitTermination()
    run()
    first = sorted((r.path, r.status) for r in spark.read.parquet(out).collect())
    assert [s for _, s in first] == ["ok", "corrupt"]
    run()
    assert spark.read.parquet(out).count() == 2
    (lib / "c.png").write_bytes(files.png())
    read_inventory(spark, [str(lib)], tasks=1).where(f"path like '%c.png'").coalesce(1).write.mode("append").parquet(work)
    run()
    assert spark.read.parquet(out).count() == 3


def test_a_batch_reads_the_buckets_of_its_paths(spark, tmp_path):
    out = str(tmp_path / "out")
    fn = alert_stream.alert_batch(out, compact_every=1, rows_per_bucket=20)
    table = alert_stream.state(spark, out, 20)
    first = log(spark, [(f"/p{i}", "ok") for i in range(1000)])
    fn(first, 0)
    fn(log(spark, [("/p1", "corrupt")]).withColumn("seq", F.col("seq") + 1000), 1)
    index = table._index(None)
    assert index.buckets == 64 and sum(index.held.values()) == 1000
    one = log(spark, [("/p7", "corrupt"), ("/new", "corrupt")]).withColumn("seq", F.col("seq") + 2000)
    touched = table.rows(before=2, touched=one)
    assert len(touched.inputFiles()) <= 2 < len(table.rows(before=2).inputFiles())
    assert touched.where("path = '/p7'").count() == 1 and touched.count() < 100
    # a batch compacts the buckets it changed only; run again, also after that, it gives the same rows
    for _ in range(2):
        fn(one, 2)
        got = sorted((r.path, r.status) for r in spark.read.parquet(f"{out}/alerts/batch=2").collect())
        assert got == [("/new", "corrupt"), ("/p7", "corrupt")]
        index = table._index(None)
        assert index.version == 2 and sorted(index.written.values())[-3:] == [1, 2, 2]
    assert table.current().count() == 1001
    fn(one.withColumn("seq", F.col("seq") + 10), 3)
    assert spark.read.parquet(f"{out}/alerts/batch=3").count() == 0


def test_states_without_rows(spark, tmp_path):
    table = alert_stream.state(spark, str(tmp_path / "none"))
    assert table.current().count() == 0
    fn = alert_stream.alert_batch(str(tmp_path / "none"), compact_every=1)
    empty = log(spark, [("/a", "ok")]).where("false")
    fn(empty, 0)
    fn(log(spark, [("/a", "corrupt")]), 1)
    fn(empty, 2)
    assert [tuple(r) for r in table.current().collect()] == [("/a", "corrupt", True)]


class _Store:
    """A state store that counts how often it is asked."""

    def __init__(self):
        self.value, self.asked = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value


def test_alert_state_is_asked_once_a_bucket(spark, tmp_path):
    store, processor = _Store(), alert_stream.AlertState()
    processor.init(store)
    row = lambda seq, path, status, micros: Row(
        bucket=0, seq=seq, scan_id="s", path=path, status=status, error=None, micros=micros
    )
    first = [row(i, f"/p{i}" if i else None, "ok", i) for i in range(100)]
    assert list(processor.handleInputRows((0,), iter(first), None)) == []
    again = [row(300, "/p1", "corrupt", 9), row(100, "/p1", "unreadable", None), row(200, None, "corrupt", 9), row(201, None, "corrupt", 9)]
    assert [r.seq for r in processor.handleInputRows((0,), iter(again), None)] == [100, 200]
    assert store.asked == 4 and len(store.value[0]) == 100

    folder, out = str(tmp_path / "log"), str(tmp_path / "alerts")
    whole = _parts(spark, folder, 2)
    alert_stream.deliver(alert_stream.alerts(_stream(spark, folder), buckets=2), out, out + "/cp").awaitTermination()
    want = [r for r in batch_alerts(whole.where("seq % 90 < 60")).select("seq", "path", "checked_at").collect()]
    assert sorted(spark.read.parquet(out + "/alerts").select("seq", "path", "checked_at").collect()) == sorted(want)
