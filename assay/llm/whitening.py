"""Embedding whitening: distributed covariance, eigenvectors in single precision, refined.

Entries become whole numbers. The fit list holds every different vector once. Tasks sum it,
then sum products of what is left after taking off the whole number next to the mean; such
sums are exact as long as they stay below 2**53, and the fraction that is left of the mean is
taken off in whole numbers, so the covariance does not depend on how rows were dealt out. Only
matrices of the vectors' length reach the driver.

``refined`` starts from single precision eigenvectors and corrects them by the iteration of
Ogita and Aishima, matrix products only, in double and at last in extended precision (double
where numpy has no wider type). Eigenvalues too close for it are handled as clusters: the
matrix, moved to the cluster's centre, is solved again inside the cluster's subspace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.sources.tables import stage

#: Whole numbers for an entry of one.
SCALE = 256
#: Products of whole numbers of this size do not overflow when they are summed.
SAFE = 1 << 62


@dataclass
class Model:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: list[int]  # sums of what is left after taking off the centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    def projected(self, x: np.ndarray, most: int) -> np.ndarray:
        """Whitened components of whole-number rows; without spread a component is NaN."""
        mean = np.array([r / self.n for r in self.rest])
        y = (x - self.centre).astype(np.float64) - mean
        values = self.values[:most]
        floor = len(self.centre) * np.finfo(float).eps * max(self.trace, 0.0)
        size = np.where(values > floor, np.sqrt(np.maximum(values, 0)), np.nan)
        return (y @ self.vectors[:, :most]) / size


def whole(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, x)`` of the vectors that count, as whole numbers."""
    v = F.col(vector)
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(1 << 63) / SCALE)
    good = vectors.where(v.isNotNull() & F.coalesce(F.forall(v, fits), F.lit(False)))
    return good.select(F.col(key).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of a batch's vectors of one length, and the vectors as rows of a matrix."""
    column = batch.column("x")
    lengths = pa.compute.list_value_length(column).to_numpy()
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        yield at, column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), int(dims))


def gathered(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For every length of vector the sum over the fit list of the matrices that ``part`` makes
    of some rows. A task sends one matrix; its rows are added up by as many tasks as there are."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch):
                dims = x.shape[1]
                sums[dims] = sums.get(dims, 0) + part(x)
        yield from rows(sums)

    def rows(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for dims, m in sums.items():
            kept = [np.full(len(m), dims, np.int32), np.arange(len(m), dtype=np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, kept), pa.array(list(m), pa.list_(pa.float64()))], ["dims", "i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys = zip(batch.column("dims").to_pylist(), batch.column("i").to_pylist())
            for at, row in zip(keys, batch.column("row")):
                sums[at] = sums.get(at, 0) + row.values.to_numpy()
        for (dims, i), row in sums.items():
            kept = [pa.array([dims], pa.int32()), pa.array([i], pa.int32()), pa.array([row], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(kept, ["dims", "i", "row"])

    kind = "dims int, i int, row array<double>"
    found = fit.mapInArrow(partial, kind).repartition("dims", "i").mapInArrow(added, kind).collect()
    out: dict[int, dict[int, list[float]]] = {}
    for r in found:
        out.setdefault(r.dims, {})[r.i] = r.row
    return {dims: np.array([some[i] for i in sorted(some)]) for dims, some in out.items()}


def limbs(x: np.ndarray) -> np.ndarray:
    """The number of rows, and sums of their entries' four 16-bit limbs, exact as doubles."""
    parts = [(x >> s) & 0xFFFF if s < 48 else x >> s for s in (0, 16, 32, 48)]
    return np.array([np.full(x.shape[1], len(x)), *[p.sum(axis=0) for p in parts]], np.float64)


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One step of the iteration in the precision of ``a``, with sub-solves for clusters; also
    how large the correction was."""
    x = x.astype(a.dtype)
    eye = np.eye(len(a), dtype=a.dtype)
    r = eye - x.T @ x
    s = x.T @ a @ x
    s = (s + s.T) / 2  # what rounding leaves on one side would spoil the angles
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: float(np.sqrt((m * m).sum()))
    delta = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > delta
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
    x = x + x @ e
    order = np.argsort(values, kind="stable")
    ends = np.flatnonzero(np.diff(values[order]) > delta) + 1
    size = float(np.abs(e).max(initial=0))
    for some in np.split(order, ends):
        if len(some) > 1:
            basis = x[:, some]
            moved = a - eye * values[some].mean()
            inner = basis.T @ moved @ basis
            inner = ((inner + inner.T) / 2).astype(np.float64)
            x[:, some] = basis @ np.linalg.eigh(inner)[1]
    return x, size


def refined(v: np.ndarray, most: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, to double
    precision. Of equal eigenvalues any basis of their space is given."""
    scale = float(np.abs(v).max(initial=0))
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    a = v / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    for kind in (np.float64, np.longdouble):
        wide = a.astype(kind)
        for _ in range(most):
            x, size = corrected(wide, x)
            if size <= 4 * np.finfo(np.float64).eps:
                break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = ((wide @ x) * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> dict[int, Model]:
    """A model for each length of vector; none if no vector counts."""
    different = stage(whole(vectors, key, vector).select("x").distinct(), "whitening")
    models = {}
    for dims, m in gathered(different, limbs).items():
        if not dims:
            continue
        n = int(m[0, 0])
        sums = [sum(int(m[1 + k, i]) << 16 * k for k in range(4)) for i in range(dims)]
        centre = [(2 * s + n) // (2 * n) for s in sums]
        rest = [s - n * c for s, c in zip(sums, centre)]
        models[dims] = Model(n, sums, np.array(centre, np.int64), rest, None, None, 0.0)
    centres = {dims: m.centre for dims, m in models.items()}

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - centres[x.shape[1]]).astype(np.float64) if x.shape[1] else np.zeros(x.shape)
        return y.T @ y

    for dims, m in (gathered(different, products) if models else {}).items():
        if dims not in models:
            continue
        model = models[dims]
        square = model.n * model.n
        outer = lambda i, j: (model.n * int(m[i, j]) - model.rest[i] * model.rest[j]) / square
        cov = np.array([[outer(i, j) for j in range(dims)] for i in range(dims)])
        values, axes = refined((cov + cov.T) / 2)
        models[dims] = replace(model, values=values, vectors=axes, trace=float(np.trace(cov)))
    known = dict(models)

    def spread(x: np.ndarray) -> np.ndarray:
        """Moments of the whitened rows: products beside sums."""
        if x.shape[1] not in known:
            return np.zeros((0, 0))
        w = np.nan_to_num(known[x.shape[1]].projected(x, components))
        return np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])

    for dims, m in (gathered(different, spread) if models else {}).items():
        if dims not in models:
            continue
        model = models[dims]
        mean = m[-1] / model.n  # nothing but rounding, the mean was taken off before multiplying
        found = m[:-1] / model.n - np.outer(mean, mean)
        there = np.flatnonzero(np.isfinite(model.projected(model.centre[None, :], components)[0]))
        apart = np.abs(found[np.ix_(there, there)] - np.eye(len(there)))
        models[dims] = replace(model, error=float(apart.max(initial=0)))
    return models


def deviations(x: np.ndarray, model: Model) -> list[str]:
    """Sums of squares of ``n * x - sums``, exact, as text."""
    y = x - model.centre
    rest = np.array(model.rest, object)
    top = int(np.abs(y).max(initial=0))
    if top * max(top, max(map(abs, model.rest), default=0)) * y.shape[1] < SAFE:
        rest = rest.astype(np.int64)
    else:
        y = y.astype(object)
    squares, mixed = (y * y).sum(axis=1).tolist(), (y @ rest).tolist()
    own = sum(r * r for r in model.rest)
    return [str(model.n * (model.n * s - 2 * m) + own) for s, m in zip(squares, mixed)]


def whitened(vectors: DataFrame, models: dict[int, Model], key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` of every row and
    component up to ``components``.

    Rows whose vector is null or holds a null, a non-finite entry or one beyond whole numbers of
    64 bits have no result; neither have empty vectors, which have no component. Zero vectors
    count like others. Vectors of each length have a model of their own; ``identity_error`` is
    the largest over all. Repeated rows, ids and null ids are kept as they are, and count once
    in the fit. A component without any spread has a null ``whitened``, and ``explained`` is null
    where nothing has spread. ``deviation`` is a decimal, null beyond 38 digits. An empty table
    gives an empty table.
    """
    error = max((m.error for m in models.values()), default=0.0)
    rows = whole(vectors, key, vector)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for at, x in by_length(batch):
                model = models.get(x.shape[1])
                if model is None:
                    continue
                w = model.projected(x, components)
                k = w.shape[1]
                share = model.values[:k] / model.trace if model.trace > 0 else np.full(k, np.nan)
                rows = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at[rows])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(rows), model.n, np.int64)),
                        pa.array(deviations(x, model)).take(pa.array(rows)),
                        pa.array(w.ravel(), from_pandas=True),
                        pa.array(np.tile(share, len(at)), from_pandas=True),
                        pa.array(np.full(len(rows), error)),
                    ],
                    names,
                )

    schema = f"id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    found = rows.mapInArrow(project, schema)
    return found.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))
