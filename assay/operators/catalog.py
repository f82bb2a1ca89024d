"""Catalog snapshots: fold, incremental merge and reset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.paths import has_prefix
from assay.operators.history import ORDER, latest
from assay.schemas import CATALOG


def fold(log: DataFrame) -> DataFrame:
    """Latest verdict per path. Late rows are safe: order is ``(checked_at, seq)``."""
    return latest(log, ["path"], ORDER)


def merge(snapshot: DataFrame, delta: DataFrame) -> DataFrame:
    """Snapshot after more verdicts; the same as folding the whole log."""
    return latest(snapshot.unionByName(delta), ["path"], ORDER)


def complete(catalog: DataFrame) -> DataFrame:
    """Catalog rows with all eleven columns; what the log does not hold is null."""
    return catalog.select(
        *[
            f.name if f.name in catalog.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in CATALOG
        ]
    )


def reset(catalog: DataFrame, path_prefix: str | None = None) -> DataFrame:
    """Catalog without the rows below a prefix, or without any rows."""
    return catalog.where(~has_prefix("path", path_prefix) if path_prefix else F.lit(False))


def reset_count(catalog: DataFrame, path_prefix: str | None = None) -> DataFrame:
    gone = catalog.where(has_prefix("path", path_prefix)) if path_prefix else catalog
    return gone.agg(F.count("*").alias("deleted"))
