"""Small helpers of the operators: per-worker caches, sizes of joined texts, class ids."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a Python worker; functions travel by value, so their
    module's globals would be new in every task."""
    store = sys.modules.setdefault("_assay_worker", types.ModuleType("_assay_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def release() -> None:
    """Drops what ``once`` made in this Python worker. Workers are used again, so an operator with
    tables of its own would hold them beside those of the operator before it."""
    vars(sys.modules.get("_assay_worker", types.ModuleType("_assay_worker"))).clear()


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece stay near a size; a longer text is a piece
    of its own. Every row is in exactly one piece."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            n = n or 0
            if i > start and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key in turn, from batches sorted by whole-number keys without nulls.
    A group is held in memory: keys must name blocks of bounded size."""
    kept: list[pa.RecordBatch] = []
    last: tuple | None = None

    def whole() -> pa.RecordBatch:
        return kept[0] if len(kept) == 1 else pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(at[a])
            if kept and key != last:
                yield whole()
                kept = []
            kept.append(batch.slice(a, b - a))
            last = key
    if kept:
        yield whole()


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the groups of each ``a`` and ``b`` were joined; a label is its group's
    smallest member."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(labels, high, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]
