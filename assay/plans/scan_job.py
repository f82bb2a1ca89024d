"""A scan from roots to the verdict log, and its resumption."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.paths import DEFAULT_EXCLUDES
from assay.operators import lifecycle
from assay.operators.catalog import fold, merge
from assay.operators.changes import classify
from assay.operators.formats import spread
from assay.operators.validation import TIMEOUT_S, validate_files
from assay.schemas import STATUSES, VERDICT_LOG
from assay.sources.inventory import read_inventory, restat
from assay.sources.scan_state import ScanState
from assay.sources.tables import latest_version, read_log, read_snapshot, stage, write_snapshot


@dataclass
class ScanOptions:
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDES))
    follow_symlinks: bool = False
    # Fixed value: default recheck horizon in days.
    force_recheck_days: int = 90
    depth: str = "structure"
    timeout_s: float = TIMEOUT_S
    # Tasks for light files; heavy ones get twice as many.
    tasks: int | None = None
    # Files of a part: what a scan that breaks off has to do again at most.
    part_rows: int = 1_000_000


class ScanError(RuntimeError):
    """A scan that can not be started or resumed."""


def known_catalog(spark: SparkSession, log_dir: str, snapshot_dir: str | None = None) -> DataFrame | None:
    """The last snapshot and what the log has beyond it, or a fold of the log if there is no
    snapshot yet; None before the first scan. Verdicts of parts that are not done do not count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log_dir)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    log = ScanState(spark, log_dir).visible(read_log(spark, log_dir, with_part=True)) if exists else None
    snapshot = None if snapshot_dir is None else read_snapshot(spark, snapshot_dir)
    if snapshot is None:
        return None if log is None else fold(log.drop("part"))
    if log is None:
        return snapshot
    version = latest_version(spark, snapshot_dir)
    covered = [r.id for r in spark.read.schema("id string").parquet(f"{snapshot_dir}/scans/v={version}").collect()]
    return merge(snapshot, log.where(~F.col("scan_id").isin(covered)).drop("part"))


def take_snapshot(spark: SparkSession, log_dir: str, snapshot_dir: str) -> int:
    """Writes the catalog as the next snapshot version, and which scans are whole in it: those
    that have finished. Of other scans the log is read again beside the snapshot."""
    finished = ScanState(spark, log_dir).events().where("kind = 'finish'").select("id").distinct()
    covered = stage(finished, "finished")  # before the log is read: what ends meanwhile is not covered
    version = (latest_version(spark, snapshot_dir) or 0) + 1
    covered.write.mode("overwrite").parquet(f"{snapshot_dir}/scans/v={version}")
    catalog = known_catalog(spark, log_dir, snapshot_dir)
    write_snapshot(catalog, snapshot_dir, version)
    return version


def worklist(inventory: DataFrame, catalog: DataFrame | None, options: ScanOptions) -> DataFrame:
    """Inventory rows that need a check. Payloads are opened only after this."""
    if catalog is None:
        return inventory.withColumn("reason", F.lit("new")).withColumn("needs_check", F.lit(True))
    return classify(inventory, catalog, F.current_timestamp(), options.force_recheck_days)


def check(spark: SparkSession, todo: DataFrame, scan_id: str, options: ScanOptions) -> DataFrame:
    """Validates a worklist once, and returns the stored verdicts with ``discarded``.

    The result is written before it is used, because both the log and the close-out read
    it and a file must not be checked twice.
    """
    tasks = options.tasks or 4 * spark.sparkContext.defaultParallelism
    checked = validate_files(
        spread(todo.select("path", "mtime", "size"), tasks, 2 * tasks), options.depth, options.timeout_s
    )
    rows = checked.select(
        F.monotonically_increasing_id().alias("seq"),
        F.lit(scan_id).alias("scan_id"),
        "path",
        "mtime",
        "size",
        "verdict.status",
        "verdict.error",
        "verdict.suggested_action",
        F.current_timestamp().alias("checked_at"),
        "discarded",
    )
    return stage(rows, "checked")


def run_scan(
    spark: SparkSession,
    roots: list[str],
    log_dir: str,
    snapshot_dir: str | None = None,
    options: ScanOptions | None = None,
    scan_id: str | None = None,
) -> DataFrame:
    """Checks what is new, changed or overdue below the roots; returns the close-out row.

    Verdicts of files that changed while they were checked stay out of the log, so the
    next scan checks those files again. Vanished files keep their last verdict. The paths are
    queued before the scan starts and are worked off in parts, each done as a whole; a scan
    that breaks off can be resumed by its id.
    """
    options = options or ScanOptions()
    scan_id = scan_id or str(uuid.uuid4())
    state, began = ScanState(spark, log_dir), datetime.now(timezone.utc)
    if state.scan(scan_id) is not None:
        raise ScanError(f"scan {scan_id} has been started already")
    found = stage(read_inventory(spark, roots, options.exclude, options.follow_symlinks), "inventory")
    parts = max(1, -(-found.count() // options.part_rows))
    files = found.withColumn("part", lifecycle.part_of("path", parts))
    state.enqueue(scan_id, files)
    state.event(id=scan_id, kind="start", attempt=1, at=began, scope=",".join(roots))
    state.drop_stale(F.current_timestamp())
    return _work(spark, state, scan_id, 1, files, range(parts), known_catalog(spark, log_dir, snapshot_dir), options)


def resume_scan(
    spark: SparkSession,
    scan_id: str,
    log_dir: str,
    snapshot_dir: str | None = None,
    options: ScanOptions | None = None,
) -> DataFrame:
    """Goes on with the parts of a scan that are not done, as the files are now; returns the
    close-out row of the whole scan, earlier attempts included.

    Files that were checked by another scan meanwhile are skipped. What an attempt wrote of a
    part that it did not finish is replaced.
    """
    options = options or ScanOptions()
    state, now = ScanState(spark, log_dir), datetime.now(timezone.utc)
    known = state.scan(scan_id)
    if known is None:
        raise ScanError(f"scan {scan_id} is not known")
    if known.finished_at is not None:
        raise ScanError(f"scan {scan_id} has finished and can not be resumed")
    attempt = known.attempts + 1
    state.event(id=scan_id, kind="start", attempt=attempt, at=now, scope=known.scope)
    mine = F.col("scan_id") == scan_id
    left = lifecycle.pending(state.queue().where(mine), state.progress().where(mine)).select("path", "part")
    parts = sorted(r.part for r in left.select("part").distinct().collect())
    return _work(spark, state, scan_id, attempt, restat(left), parts, known_catalog(spark, log_dir, snapshot_dir), options)


def _work(
    spark: SparkSession,
    state: ScanState,
    scan_id: str,
    attempt: int,
    files: DataFrame,
    parts: Iterable[int],
    catalog: DataFrame | None,
    options: ScanOptions,
) -> DataFrame:
    work = stage(worklist(files, catalog, options), "work")
    for part in parts:
        began = time.monotonic()
        mine = work.where(F.col("part") == part)
        checked = check(spark, mine.where("needs_check"), scan_id, options)
        state.write_verdicts(scan_id, part, checked.where("NOT discarded").select(*VERDICT_LOG.fieldNames()))
        skipped = mine.where("NOT needs_check").count()
        kept = ~F.col("discarded")
        sums = checked.agg(
            F.count("*").alias("checked"),
            F.count_if("discarded").alias("discards"),
            *[F.count_if(kept & (F.col("status") == s)).alias(s) for s in STATUSES],
        ).first()
        state.commit(
            scan_id=scan_id,
            part=part,
            attempt=attempt,
            at=datetime.now(timezone.utc),
            processed=sums.checked + skipped,
            skipped=skipped,
            elapsed_s=time.monotonic() - began,
            **{c: sums[c] for c in ("discards", *STATUSES)},
        )
    state.event(id=scan_id, kind="finish", attempt=attempt, at=datetime.now(timezone.utc), scope=None)
    state.drop_queue(scan_id)
    done = lifecycle.fold(state.events().where(F.col("id") == scan_id), state.progress().where(F.col("scan_id") == scan_id))
    return done.select("scan_id", "processed", "skipped", "discards", "total", "corrupt", "unreadable", "files_per_sec")
