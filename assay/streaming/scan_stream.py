"""Resumable checking of a growing work list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.payload_checks import check_content
from assay.operators.validation import TIMEOUT_S, validate_files
from assay.schemas import INVENTORY
from assay.streaming.sinks import drain, to_folder


def work_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Inventory files as they are added to a folder; the trigger size bounds work in flight."""
    return (
        spark.readStream.schema(INVENTORY)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def check_stream(
    work: DataFrame, log_folder: str, checkpoint: str, scan_id: str, depth: str = "structure", timeout_s: float = TIMEOUT_S
):
    """Checks new work and appends verdicts; a second run with the same checkpoint adds
    nothing, and a run after an interruption does only what was not finished."""

    def check(batch: DataFrame) -> DataFrame:
        # The work list lists paths of one folder after another; deal them out evenly.
        spread = batch.dropDuplicates(["path"])
        return validate_files(spread, depth, timeout_s).where(~F.col("discarded")).drop("discarded", "reason")

    return _verdicts(work, check, log_folder, checkpoint, scan_id)


def check_payload_stream(
    payloads: DataFrame, log_folder: str, checkpoint: str, scan_id: str, check: Callable[[DataFrame], DataFrame] = check_content
):
    """The same for a stream of ``(path, content, ...)`` rows; ``check`` puts a ``verdict`` in place of
    the content."""
    return _verdicts(payloads, check, log_folder, checkpoint, scan_id)


def _verdicts(work: DataFrame, check: Callable[[DataFrame], DataFrame], log_folder: str, checkpoint: str, scan_id: str):
    def prepare(batch: DataFrame) -> DataFrame:
        checked = check(batch)
        kept = [c for c in ("path", "mtime", "size") if c in checked.columns]
        return checked.select(
            F.lit(scan_id).alias("scan_id"), *kept, "verdict.*",
            F.current_timestamp().alias("checked_at"), F.monotonically_increasing_id().alias("seq"),
        )

    return drain(work, to_folder(log_folder, prepare), checkpoint).start()
