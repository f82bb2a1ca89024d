"""Pages of a long list at any depth.

Sorting up to a page far down would gather all rows above it. Instead the page is located by
counting: rows per time range, newest first, then inside the range that holds the page's first
row, until few rows are left. Where more rows share one time, as after a large batch, paths are
narrowed by their prefixes the same way. Only what begins there is sorted.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.sources.tables import stage

#: Ranges that a count is cut into.
RANGES = 4096
_LOWEST = -(1 << 62)


def _holding(counts: list[tuple], before: int, offset: int):
    """The entry of ordered ``(key, rows)`` that holds a position, and the rows before it."""
    for key, rows in counts:
        if before + rows > offset:
            return key, rows, before
        before += rows
    return None


def page(files: DataFrame, limit: int, offset: int, within: int = 100_000) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of files by time, newest first, and path.

    A page among the first ``within`` rows is sorted at once. For others no task holds more
    than ``within + limit`` rows. Files without a time come last. A page behind the end is empty.
    """
    if offset + limit <= within:
        return files.orderBy(F.desc("checked_at"), "path").offset(offset).limit(limit)
    rows = stage(files, "paged")
    at = F.coalesce(F.unix_micros(F.col("checked_at").cast("timestamp")), F.lit(_LOWEST))
    low, high, n = rows.agg(F.min(at), F.max(at), F.count("*")).first()
    if offset >= n:
        return rows.limit(0)
    before, some = 0, rows
    while n > within and low < high:
        width = -(-(high - low + 1) // RANGES)
        nth = F.expr(f"({high}L - _at) div {width}L")
        counts = some.select(at.alias("_at")).groupBy(nth.alias("k")).count().collect()
        k, n, before = _holding(sorted((r.k, r["count"]) for r in counts), before, offset)
        low, high = max(low, high - (k + 1) * width + 1), high - k * width
        some = rows.where(at.between(low, high))
    prefix = ""
    while n > within:  # all of one time
        tied = some.where(F.col("path") >= prefix) if prefix else some
        tied = tied.where(F.startswith("path", F.lit(prefix)))
        first, last = tied.agg(F.min("path"), F.max("path")).first()
        if first == last:
            break
        length = len(os.path.commonprefix([first, last])) + 1
        counts = tied.groupBy(F.substring("path", 1, length).alias("k")).count().collect()
        ordered = sorted(((r.k, r["count"]) for r in counts), key=lambda c: c[0].encode())
        prefix, n, before = _holding(ordered, before, offset)
    begin = (at < high) | ((at == high) & (F.col("path") >= prefix)) if prefix else at <= high
    return rows.where(begin).orderBy(F.desc("checked_at"), "path").offset(offset - before).limit(limit)
