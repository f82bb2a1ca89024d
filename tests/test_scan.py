"""File inventory, validation and the scan job on real files."""

from __future__ import annotations

import io
import json
import os
import struct
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import files
from assay.operators import formats, lifecycle
from assay.operators.catalog import complete
from assay.operators.compound import Broken, listed
from assay.operators.deep_checks import deep_check, registered
from assay.operators.fingerprints import verify_hashes, with_fingerprints
from assay.operators.importing import apply_import, prepare
from assay.operators.payload_checks import check_content
from assay.operators.scans import last_rate
from assay.operators.validation import validate_content, validate_files
from assay.plans import alerting
from assay.plans.scan_job import ScanError, ScanOptions, known_catalog, resume_scan, run_scan, take_snapshot
from assay.sources.inventory import read_inventory, restat
from assay.sources.scan_state import ScanState
from assay.sources.tables import export_catalog, read_log, read_payloads, read_portable, typed_times

CASES = {
    "ok.jpg": (files.jpeg(), "ok"),
    "cut.jpg": (files.jpeg()[:60], "corrupt"),
    "text.jpeg": (b"this is not an image", "corrupt"),
    "noframe.jpg": (files.jpeg().replace(b"\xff\xc0", b"\xff\x00"), "corrupt"),
    "ok.png": (files.png(), "ok"),
    "cut.png": (files.png()[:30], "corrupt"),
    "crc.png": (files.png().replace(b"IDAT", b"IDAU"), "corrupt"),
    "ok.TIF": (files.tiff(), "ok"),
    "big.tiff": (files.tiff(b"MM\0*"), "ok"),
    "cut.tif": (files.tiff()[:20], "corrupt"),
    "ok.webp": (files.webp(), "ok"),
    "cut.webp": (files.webp()[:16], "corrupt"),
    "ok.pdf": (files.pdf(), "ok"),
    "cut.pdf": (files.pdf()[:40], "corrupt"),
    "ok.docx": (files.docx(), "ok"),
    "badxml.docx": (files.docx({"[Content_Types].xml": "<Types", "_rels/.rels": "<R/>"}), "corrupt"),
    "nopart.xlsx": (files.docx({"[Content_Types].xml": "<Types/>"}), "corrupt"),
    "cut.docx": (files.docx()[:100], "corrupt"),
    "zip.doc": (files.docx(), "corrupt"),
    "ok.doc": (files.ole(), "ok"),
    "wrong.xls": (files.ole(), "corrupt"),
    "named.doc": (files.ole("Notes", text="WordDocument"), "corrupt"),
    "inside.doc": (files.ole(inside="ObjectPool"), "corrupt"),
    "cut.doc": (files.ole()[:1100].ljust(1536, b"\0"), "corrupt"),
    "ok.mp4": (files.mp4(), "ok"),
    "nomoov.mp4": (files.mp4().replace(b"moov", b"free"), "corrupt"),
    "ok.wav": (files.wav(), "ok"),
    "cut.wav": (files.wav(5000), "corrupt"),
    "text.mp3": (b"just some text", "unsupported"),
    "empty.mp3": (b"", "unsupported"),
    "empty.png": (b"", "corrupt"),
    "_DSC0001.NEF": (files.tiff(), "ok"),
    "odd.cr2": (b"no camera wrote this text here", "unsupported"),
    "cut.nef": (b"II*\0\xff\xff\0\0" + bytes(16), "corrupt"),
    "variant.dng": (b"II+\0\x08\0\0\0" + bytes(16), "ok"),
    "odd.dng": (b"neither raw nor tiff in here", "unsupported"),
    "odd.heic": (b"\0\0\0\x18ftypzzzz" + bytes(16), "unsupported"),
    "ok.heic": (b"\0\0\0\x18ftypheic" + bytes(16), "ok"),
}


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib"
    (root / "a" / "deep").mkdir(parents=True)
    (root / "b").mkdir()
    (root / "@eaDir").mkdir()
    for i, (name, (content, _)) in enumerate(CASES.items()):
        (root / ["", "a", "a/deep", "b"][i % 4] / name).write_bytes(content)
    (root / "@eaDir" / "thumb.jpg").write_bytes(files.jpeg())
    (root / "notes.txt").write_text("no registered extension")
    (root / ".hidden.jpg").write_bytes(files.jpeg())
    os.symlink(root / "gone.jpg", root / "broken.jpg")
    return root


def _verdicts(df):
    return {os.path.basename(r.path): r.verdict for r in df.collect()}


def test_inventory_lists_what_a_scan_must_judge(spark, library):
    rows = read_inventory(spark, [str(library)], exclude=["**/@eaDir/**"]).collect()
    names = {os.path.basename(r.path): r for r in rows}
    assert set(names) == set(CASES) | {".hidden.jpg", "broken.jpg"}
    assert (names["broken.jpg"].mtime, names["broken.jpg"].size) == (0.0, 0)
    assert names["ok.png"].size == len(files.png())
    assert names["ok.png"].mtime == os.stat(names["ok.png"].path).st_mtime


def test_inventory_partitions_and_overlaps_do_not_change_the_rows(spark, library):
    one = read_inventory(spark, [str(library)], tasks=1)
    many = read_inventory(spark, [str(library), str(library / "a")], tasks=100)
    assert sorted(one.collect()) == sorted(many.collect())
    assert read_inventory(spark, [str(library / "missing")]).count() == 0


def test_symlinked_folders_only_when_asked(spark, library, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "x.jpg").write_bytes(files.jpeg())
    os.symlink(other, library / "link")
    os.symlink(library, library / "loop")
    found = lambda follow: {
        r.path for r in read_inventory(spark, [str(library)], follow_symlinks=follow, tasks=100).collect()
    }
    assert not any("/link/" in p for p in found(False))
    assert str(library / "link" / "x.jpg") in found(True)


def test_files_get_the_expected_verdict(spark, library):
    out = validate_files(read_inventory(spark, [str(library)], exclude=["**/@eaDir/**"]))
    got = _verdicts(out)
    wrong = {n: got[n] for n, (_, want) in CASES.items() if got[n].status != want}
    assert not wrong
    assert got["broken.jpg"].status == "unreadable" and got["broken.jpg"].error == "Cannot stat file"
    assert got["cut.tif"].suggested_action == "Restore from backup; TIFF IFD chain may be damaged"


def test_contents_get_the_same_verdict_as_files(spark):
    rows = [(f"/x/{n}", bytearray(c)) for n, (c, _) in CASES.items()]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = _verdicts(validate_content(df))
    assert {n: v.status for n, v in got.items()} == {n: want for n, (_, want) in CASES.items()}
    rules_only = _verdicts(check_content(df))
    assert rules_only["crc.png"].status == "ok" and rules_only["cut.png"].status == "corrupt"


def test_missing_and_unknown_files(spark, tmp_path):
    rows = [(str(tmp_path / "gone.jpg"), 1.0, 5), (str(tmp_path / "x.xyz"), 1.0, 5)]
    got = _verdicts(validate_files(spark.createDataFrame(rows, "path string, mtime double, size long")))
    assert got["gone.jpg"].status == "unreadable"
    assert (got["x.xyz"].status, got["x.xyz"].error) == ("unsupported", "No validator for '.xyz'")


def test_what_follows_the_end_does_no_harm(spark, tmp_path):
    """Trailing bytes after sound payloads, as content and as files."""
    sound = {"a.jpg": files.jpeg() + b"\n" * 100_000, "b.png": files.png() + b"x", "c.pdf": files.pdf() + b"\n" * 100_000}
    for name, content in sound.items():
        (tmp_path / name).write_bytes(content)
    stat = lambda n: os.stat(tmp_path / n)
    rows = [(str(tmp_path / n), stat(n).st_mtime, stat(n).st_size) for n in sound]
    got = _verdicts(validate_files(spark.createDataFrame(rows, "path string, mtime double, size long")))
    assert {v.status for v in got.values()} == {"ok"}
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in sound.items()], "path string, content binary")
    assert {v.status for v in _verdicts(validate_content(df)).values()} == {"ok"}
    assert {v.status for v in _verdicts(check_content(df)).values()} == {"ok"}


def test_damage_in_the_middle_of_large_content_is_seen(spark):
    sound = bytes(11 << 20)
    damaged = sound[: 5 << 20] + b"!" + sound[(5 << 20) + 1 :]
    df = lambda content: with_fingerprints(spark.createDataFrame([("/a", bytearray(content))], "path string, content binary"))
    assert verify_hashes(df(sound), df(damaged)).collect()[0].verdict.status == "corrupt"
    assert verify_hashes(df(sound), df(sound)).collect()[0].verdict.status == "ok"


def test_a_check_that_raises_is_an_error_of_its_row(spark):
    before = registered()["webp"] if "webp" in registered() else None

    @deep_check("webp")
    def broken(f, ext):
        raise RuntimeError("boom")

    try:
        df = spark.createDataFrame([("/x/a.webp", bytearray(files.webp()))], "path string, content binary")
        v = _verdicts(validate_content(df))["a.webp"]
        assert (v.status, v.error) == ("error", "boom")
    finally:
        deep_check("webp")(before or (lambda f, ext: None))


def test_registration_moves_an_extension(spark):
    saved = dict(formats._registry)
    try:
        formats.register("pdf", [".JPG"])
        df = spark.createDataFrame([("/x/a.jpg", bytearray(files.pdf()))], "path string, content binary")
        assert _verdicts(check_content(df))["a.jpg"].status == "ok"
    finally:
        formats._registry.clear()
        formats._registry.update(saved)


def test_second_scan_skips_and_changes_are_found(spark, library, tmp_path):
    log = str(tmp_path / "log")
    first = run_scan(spark, [str(library)], log, options=ScanOptions(tasks=2)).collect()[0]
    assert first.total == len(CASES) + 2 and first.skipped == 0
    again = run_scan(spark, [str(library)], log, options=ScanOptions(tasks=2)).collect()[0]
    assert (again.processed, again.skipped, again.total, again.files_per_sec) == (first.total, first.total, first.total, 0.0)
    target = library / "ok.jpg"
    target.write_bytes(b"now it is broken")
    third = run_scan(spark, [str(library)], log, options=ScanOptions(tasks=2)).collect()[0]
    assert (third.processed - third.skipped, third.corrupt) == (1, 1)
    rows = {r.path: r for r in known_catalog(spark, log).collect()}
    assert rows[str(target)].status == "corrupt" and len(rows) == len(CASES) + 2
    raised = alerting.alerts_of_scan(read_log(spark, log), rows[str(target)].scan_id).collect()
    assert [(r.path, r.status) for r in raised] == [(str(target), "corrupt")]


def test_export_and_import_into_an_empty_catalog(spark, library, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "export")
    run_scan(spark, [str(library)], log, options=ScanOptions(tasks=2)).collect()
    catalog = complete(known_catalog(spark, log))
    export_catalog(catalog, out)
    records = prepare(read_portable(spark, out))
    inserted = apply_import(records.drop("ordinal").limit(0), records, read_inventory(spark, [str(library)]))
    want = sorted((r.path, r.status, r.size) for r in catalog.collect() if not r.path.endswith("broken.jpg"))
    got = sorted((r.path, r.status, r.size) for r in inserted.collect() if not r.path.endswith("broken.jpg"))
    assert got == want
    assert typed_times(inserted).where("checked_at IS NULL").count() == 0


def test_forced_recheck(spark, library, tmp_path):
    log = str(tmp_path / "log")
    run_scan(spark, [str(library)], log, options=ScanOptions(tasks=2)).collect()
    same_day = run_scan(spark, [str(library)], log, options=ScanOptions(force_recheck_days=1, tasks=2)).collect()[0]
    assert same_day.processed == same_day.skipped > 0


def test_changed_while_checked_is_discarded(spark, library):
    rows = read_inventory(spark, [str(library)]).withColumn("size", F.col("size") + 1)
    out = validate_files(rows)
    flags = {os.path.basename(r.path): r.discarded for r in out.collect()}
    assert flags["ok.png"] is True and all(flags.values())  # every recorded size is wrong


def test_scan_leaves_its_row_and_no_queue(spark, library, tmp_path):
    log = str(tmp_path / "log")
    out = run_scan(spark, [str(library)], log, options=ScanOptions(tasks=2, part_rows=10)).collect()[0]
    assert out.files_per_sec > 0
    state = ScanState(spark, log)
    row = state.scans().collect()[0]
    assert (row.id, row.total, row.corrupt, row.scope) == (out.scan_id, len(CASES) + 2, out.corrupt, str(library))
    assert row.finished_at >= row.started_at and row.files_per_sec == out.files_per_sec
    assert state.queue().count() == 0 and state.progress().count() == 4
    assert last_rate(state.scans()).collect()[0].files_per_sec == out.files_per_sec
    assert known_catalog(spark, log).count() == len(CASES) + 2


def broken_off(spark, library, log, monkeypatch, after):
    """A scan whose ``after``-th part is written but never marked as done."""
    commits = []
    commit = ScanState.commit

    def failing(self, **row):
        commits.append(row["part"])
        if len(commits) > after:
            raise KeyboardInterrupt
        commit(self, **row)

    monkeypatch.setattr(ScanState, "commit", failing)
    with pytest.raises(KeyboardInterrupt):
        run_scan(spark, [str(library)], log, options=ScanOptions(tasks=2, part_rows=10), scan_id="a b/1")
    monkeypatch.undo()
    return commits


def test_resume_goes_on_with_what_was_done(spark, library, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    parts = broken_off(spark, library, log, monkeypatch, after=2)
    state = ScanState(spark, log)
    before = state.scan("a b/1")
    assert (before.state, before.parts_done, before.attempts) == ("incomplete", 2, 1)
    todo = {r.path for r in lifecycle.pending(state.queue(), state.progress()).collect()}
    assert 0 < len(todo) == len(CASES) + 2 - before.processed
    assert state.scans().collect()[0].total is None
    # a file of the part that broke off is mended before the scan goes on
    changed = next(p for p in todo if os.path.basename(p) in CASES and CASES[os.path.basename(p)][1] == "corrupt")
    os.remove(changed)
    out = resume_scan(spark, "a b/1", log, options=ScanOptions(tasks=2)).collect()[0]
    assert (out.processed, out.total, out.skipped) == (len(CASES) + 2, len(CASES) + 2, 0)
    after = state.scan("a b/1")
    assert (after.state, after.attempts, after.parts_done) == ("complete", 2, 4) and after.started_at == before.started_at
    rows = read_log(spark, log).collect()
    assert len(rows) == len({r.path for r in rows}) == len(CASES) + 2 and {r.scan_id for r in rows} == {"a b/1"}
    assert next(r.status for r in rows if r.path == changed) == "unreadable"
    assert state.queue().count() == 0 and len(parts) == 3


def test_resume_skips_what_another_scan_has_checked(spark, library, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    broken_off(spark, library, log, monkeypatch, after=1)
    run_scan(spark, [str(library)], log, options=ScanOptions(tasks=2), scan_id="other").collect()
    # what a part wrote that was never done does not count for the other scan
    done = ScanState(spark, log).scan("a b/1").processed
    others = read_log(spark, log).where("scan_id = 'other'").count()
    out = resume_scan(spark, "a b/1", log, options=ScanOptions(tasks=2)).collect()[0]
    assert (out.processed, out.skipped) == (len(CASES) + 2, others) and others == len(CASES) + 2 - done
    assert len({r.path for r in read_log(spark, log).collect()}) == len(CASES) + 2
    assert ScanState(spark, log).queue().count() == 0


def test_unknown_finished_and_repeated_scans_are_refused(spark, library, tmp_path):
    log = str(tmp_path / "log")
    with pytest.raises(ScanError, match="not known"):
        resume_scan(spark, "nobody", log)
    run_scan(spark, [str(library / "b")], log, options=ScanOptions(tasks=1), scan_id="one").collect()
    with pytest.raises(ScanError, match="finished"):
        resume_scan(spark, "one", log)
    with pytest.raises(ScanError, match="started already"):
        run_scan(spark, [str(library / "b")], log, scan_id="one")


def test_stale_queues_go(spark, tmp_path):
    state = ScanState(spark, str(tmp_path / "log"))
    now = datetime.now(timezone.utc)
    for name, days in (("old", 8), ("new", 2)):
        state.enqueue(name, spark.createDataFrame([("/a", 0)], "path string, part int"))
        state.event(id=name, kind="start", attempt=1, at=now - timedelta(days=days), scope="/")
    assert state.drop_stale(F.current_timestamp()) == ["old"]
    assert [r.scan_id for r in state.queue().collect()] == ["new"]


def test_snapshot_and_later_log(spark, library, tmp_path, monkeypatch):
    log, snapshots = str(tmp_path / "log"), str(tmp_path / "snapshots")
    assert known_catalog(spark, log, snapshots) is None
    broken_off(spark, library, log, monkeypatch, after=2)
    run_scan(spark, [str(library / "b")], log, options=ScanOptions(tasks=1), scan_id="whole").collect()
    want = lambda: sorted((r.path, r.status, r.scan_id) for r in known_catalog(spark, log).collect())
    assert sorted((r.path, r.status, r.scan_id) for r in known_catalog(spark, log, snapshots).collect()) == want()
    assert take_snapshot(spark, log, snapshots) == 1
    resume_scan(spark, "a b/1", log, snapshots, options=ScanOptions(tasks=2)).collect()
    (library / "ok.png").write_bytes(b"broken")
    run_scan(spark, [str(library)], log, snapshots, options=ScanOptions(tasks=2), scan_id="later").collect()
    got = lambda: sorted((r.path, r.status, r.scan_id) for r in known_catalog(spark, log, snapshots).collect())
    assert got() == want() and (str(library / "ok.png"), "corrupt", "later") in got()
    assert take_snapshot(spark, log, snapshots) == 2
    assert got() == want()


def test_restat(spark, library):
    df = spark.createDataFrame([(str(library / "ok.jpg"),), ("/nowhere/x.jpg",)], "path string")
    got = {os.path.basename(r.path): (r.mtime, r.size) for r in restat(df).collect()}
    assert got["x.jpg"] == (0.0, 0) and got["ok.jpg"][1] == len(files.jpeg())


def test_payload_reader(spark, library):
    df = read_payloads(spark, str(library))
    rows = {os.path.basename(r.path): r for r in df.where("path not like '%.txt'").collect()}
    assert rows["ok.png"].content == files.png() and rows["ok.png"].size == len(files.png())
    assert "empty.png" not in rows and "_DSC0001.NEF" not in rows  # what the inventory source is for
    got = _verdicts(validate_content(df))
    assert got["ok.pdf"].status == "ok" and got["cut.png"].status == "corrupt"
    inventory = read_inventory(spark, [str(library)], [], False)
    every = {os.path.basename(r.path): r for r in read_payloads(spark, str(library), inventory).collect()}
    assert len(every) == inventory.count() and bytes(every["empty.png"].content) == b""


@pytest.mark.parametrize("tasks", [1, 2, 3, 100])
def test_links_are_walked_whatever_the_number_of_tasks(spark, tmp_path, tasks):
    """A link above its target, two links to one folder, and links that lead upwards."""
    root = tmp_path / "lib"
    (root / "z" / "deep" / "deeper").mkdir(parents=True)
    (root / "z" / "deep" / "deeper" / "x.jpg").write_bytes(files.jpeg())
    os.symlink(root / "z" / "deep", root / "a")
    os.symlink(root / "z" / "deep", root / "b")
    os.symlink(root, root / "z" / "up")
    os.symlink(root / "z", root / "z" / "deep" / "back")
    found = read_inventory(spark, [str(root)], follow_symlinks=True, tasks=tasks).collect()
    got = sorted(os.path.relpath(r.path, root) for r in found)
    # by every way that does not enter a folder it is already in
    assert got == sorted(
        ["z/deep/deeper/x.jpg", "a/deeper/x.jpg", "b/deeper/x.jpg"]
    )
    plain = read_inventory(spark, [str(root)], tasks=tasks).collect()
    assert [os.path.relpath(r.path, root) for r in plain] == ["z/deep/deeper/x.jpg"]


@pytest.mark.parametrize("array", [False, True])
def test_records_keep_their_order_over_many_files(spark, tmp_path, array):
    """Small and large files; the smallest comes first, and lines are read in many blocks."""
    n = 0
    for name, size in (("part-0", 3), ("part-1", 4000), ("part-2", 1), ("part-3", 900)):
        records = [{"path": f"/p{n + i}", "status": "ok"} for i in range(size)]
        text = json.dumps(records) if array else "\n".join(map(json.dumps, records))
        (tmp_path / f"{name}.json").write_text(text)
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        rows = read_portable(spark, str(tmp_path), array).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.ordinal, r.path) for r in rows) == [(i, f"/p{i}") for i in range(n)]


def test_first_and_last_record_of_many_files_win(spark, tmp_path):
    for name, status in (("part-0", "ok"), ("part-1", "corrupt"), ("part-2", "unreadable")):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps({"path": "/a", "status": status}) for _ in range(5)))
    records = read_portable(spark, str(tmp_path))
    files_there = spark.createDataFrame([("/a",)], "path string")
    win = lambda force: apply_import(records.drop("ordinal").limit(0), records, files_there, force=force).collect()[0].status
    assert (win(False), win(True)) == ("ok", "unreadable")


def camera_jpeg(restarts=b"") -> bytes:
    """With a thumbnail in front, as cameras write them."""
    plain = files.jpeg()
    thumb = b"Exif\0\0" + plain
    return plain[:2] + b"\xff\xe1" + (len(thumb) + 2).to_bytes(2, "big") + thumb + plain[2:-5] + b"\x01" * 500 + restarts + b"\xff\xd9"


def two_revisions() -> bytes:
    first = files.pdf()
    update = b"2 0 obj<</Length 3>>endobj\n"
    at = len(first) + len(update)
    return first + update + b"xref\n0 1\ntrailer<</Prev 40>>\nstartxref\n%d\n%%%%EOF\n" % at


def big_tiff(strip: int = 3) -> bytes:
    entry = lambda tag, n, v: struct.pack("<HHQQ", tag, 16, n, v)
    entries = entry(256, 1, 1) + entry(273, 1, 90) + entry(279, 1, strip)
    return b"II+\0\x08\0\0\0" + struct.pack("<QQ", 16, 3) + entries + bytes(8) + bytes(20)


STRUCTURED = {
    "sound.jpg": (camera_jpeg(), "ok"),
    "behind.jpg": (camera_jpeg() + b"\n" * 70_000, "ok"),
    "cut.jpg": (camera_jpeg()[:-100], "corrupt"),
    "front.jpg": (camera_jpeg()[:120], "corrupt"),
    "turns.jpg": (camera_jpeg(b"\xff\xd0ab\xff\xd1cd"), "ok"),
    "sound.pdf": (two_revisions(), "ok"),
    "behind.pdf": (two_revisions() + b"\n" * 70_000, "ok"),
    "cut.pdf": (two_revisions()[:-60], "corrupt"),
    "nowhere.pdf": (two_revisions().replace(b"startxref\n40", b"startxref\n4").replace(b"%d" % (len(files.pdf()) + 27), b"99999"), "corrupt"),
    "big.tif": (big_tiff(), "ok"),
    "bigcut.tif": (big_tiff(3000), "corrupt"),
}


def test_damage_behind_a_part_that_is_whole(spark, tmp_path):
    """An end mark of a thumbnail or of an earlier revision does not stand for the whole."""
    rows = []
    for name, (content, _) in STRUCTURED.items():
        (tmp_path / name).write_bytes(content)
        st = os.stat(tmp_path / name)
        rows.append((str(tmp_path / name), st.st_mtime, st.st_size))
    want = {n: w for n, (_, w) in STRUCTURED.items()}
    status = lambda df: {n: v.status for n, v in _verdicts(df).items()}
    assert status(validate_files(spark.createDataFrame(rows, "path string, mtime double, size long"))) == want
    df = spark.createDataFrame([(n, bytearray(c)) for n, (c, _) in STRUCTURED.items()], "path string, content binary")
    assert status(validate_content(df)) == want
    assert status(check_content(df.where("path NOT LIKE '%.tif'"))) == {n: w for n, w in want.items() if not n.endswith(".tif")}
    # what only a walk through the data sees
    df = spark.createDataFrame([("/x.jpg", bytearray(camera_jpeg(b"\xff\xd0ab\xff\xd3cd")))], "path string, content binary")
    assert _verdicts(validate_content(df))["x.jpg"].error == "restart markers out of turn"
    movie = files.mp4() + b"\0\0\1\0mdat" + b"x" * 20
    df = spark.createDataFrame([("/x.mp4", bytearray(movie))], "path string, content binary")
    assert _verdicts(validate_content(df))["x.mp4"].error == "declared length exceeds the file"


def test_a_check_that_takes_too_long_is_ended(spark):
    before = registered()["webp"] if "webp" in registered() else None

    @deep_check("webp")
    def slow(f, ext):
        import time

        if b"slow" in f.read():
            time.sleep(60)

    try:
        rows = [("/x/a.webp", bytearray(files.webp() + b"slow")), ("/x/b.webp", bytearray(files.webp()))]
        began = time.monotonic()
        got = _verdicts(validate_content(spark.createDataFrame(rows, "path string, content binary").coalesce(1), timeout_s=0.5))
        assert time.monotonic() - began < 30
        assert (got["a.webp"].status, got["a.webp"].error) == ("error", "validation timed out after 0.5s")
        assert got["b.webp"].status == "ok"
    finally:
        deep_check("webp")(before or (lambda f, ext: None))


def test_a_directory_far_behind_is_found_by_the_further_list():
    """The header lists 109 sectors of the table; a list of its own names the ones after them."""
    at = 110 * 128 + 5  # the directory's sector, in the 111th sector of the table
    one = bytearray(files.ole())
    table, listing = at + 1, at + 2
    raw = bytearray(one[:512]) + bytes((listing + 1) * 512)
    place = lambda sector: (sector + 1) * 512
    struct.pack_into("<i", raw, 48, at)
    struct.pack_into("<2i", raw, 68, listing, 1)
    raw[place(at) : place(at) + 512] = one[1024:1536]
    raw[place(table) : place(table) + 512] = struct.pack("<i", -1) * 5 + struct.pack("<i", -2) + struct.pack("<i", -1) * 122
    raw[place(listing) : place(listing) + 512] = struct.pack("<2i", 0, table) + struct.pack("<i", -1) * 125 + struct.pack("<i", -2)
    assert listed(io.BytesIO(bytes(raw))) == [("WordDocument", 0)]
    with pytest.raises(Broken, match="outside"):
        listed(io.BytesIO(bytes(raw[:-512])))
    with pytest.raises(Broken, match="cut off"):
        listed(io.BytesIO(b""))
