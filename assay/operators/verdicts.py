"""Verdict structs: closed status domain, ordered rules, reason table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.schemas import STATUSES, VERDICT

# Advice given with a verdict.
RESTORE = "Restore from backup or re-download"
RESTORE_TIFF = "Restore from backup; TIFF IFD chain may be damaged"
UPDATE_RAW = "Update rawpy/LibRaw for this camera model"
UPDATE_DNG = "Update rawpy or check DNG variant"
UPDATE_HEIF = "Update pillow-heif / libheif"
SLOW_FILE = "File may be severely corrupt"

# Reason → (status, advice).
REASONS = {
    "cannot_stat": ("unreadable", None),
    "missing": ("unreadable", None),
    "empty": ("corrupt", RESTORE),
    "bad_signature": ("corrupt", RESTORE),
    "truncated": ("corrupt", RESTORE),
    "bad_structure": ("corrupt", RESTORE),
    "bad_tiff": ("corrupt", RESTORE_TIFF),
    "bad_raw": ("corrupt", None),
    "missing_part": ("corrupt", RESTORE),
    "bad_container": ("corrupt", RESTORE),
    "no_validator": ("unsupported", None),
    "unknown_audio": ("unsupported", None),
    "unknown_camera": ("unsupported", UPDATE_RAW),
    "unknown_dng": ("unsupported", UPDATE_DNG),
    "unknown_codec": ("unsupported", UPDATE_HEIF),
    "timed_out": ("error", SLOW_FILE),
    "failed": ("error", None),
}


def verdict(status: str, error: Column | str | None = None, action: str | None = None) -> Column:
    """A verdict with a fixed status; a status outside the domain fails when the plan is built."""
    if status not in STATUSES:
        raise ValueError(f"Invalid status: {status!r}")
    text = F.lit(error) if error is None or isinstance(error, str) else error
    return F.struct(
        F.lit(status).alias("status"),
        text.cast("string").alias("error"),
        F.lit(action).cast("string").alias("suggested_action"),
    )


OK_STATUS = "ok"


def ok() -> Column:
    return verdict(OK_STATUS)


def because(reason: str, error: Column | str) -> Column:
    status, action = REASONS[reason]
    return verdict(status, error, action)


def rule(condition: Column, reason: str, error: Column | str) -> Column:
    """Null when the condition does not hold, so rules can be tried in order."""
    return F.when(condition, because(reason, error))


def first_failing(*rules: Column) -> Column:
    return F.coalesce(*rules, ok())


def or_else(primary: Column, retry_on: str, fallback: Column) -> Column:
    """The primary verdict, except that ``retry_on`` is decided by the fallback."""
    return F.when(primary["status"] == retry_on, fallback).otherwise(primary)


def checked(v: Column) -> Column:
    """Fails the query on a status outside the domain; for verdicts read from outside."""
    bad = F.concat(F.lit("Invalid status: "), F.coalesce(v["status"], F.lit("null")))
    return F.when(v["status"].isin(*STATUSES), v).otherwise(F.raise_error(bad).cast(VERDICT))


def unstatable() -> Column:
    """Verdict for an inventory row that could not be stat-ed; such a file is never opened."""
    return rule((F.col("mtime") == 0) & (F.col("size") == 0), "cannot_stat", "Cannot stat file")


def flat(df: DataFrame, column: str = "verdict") -> DataFrame:
    """Replaces the verdict struct by its three fields."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")
