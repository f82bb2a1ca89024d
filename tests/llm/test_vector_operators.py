from __future__ import annotations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import near_vectors, neighbours
from assay.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, id long, vector string, list int, sound boolean"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", 3, None) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, a chain, other lengths and vectors that do not count."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24))
    x[50:120] = x[50] + 0.02 * rng.normal(size=(70, 24))  # a crowd of near copies
    x[130:140] = x[130]  # exact copies
    for i in range(141, 150):  # neighbours link, ends do not
        x[i] = x[i - 1] / np.linalg.norm(x[i - 1]) + 0.25 * np.eye(24)[i - 141]
    x[150] = 7 * x[151]
    x = x.astype(np.float32)
    out = [(i + 1, v.tolist()) for i, v in enumerate(x)]
    odd = [(1001, None), (1002, []), (1003, [0.0] * 24), (1004, [float("nan")] + [1.0] * 23), (1005, [float("inf")] * 24)]
    odd += [(1006, [None] + [1.0] * 23), (1007, [1.0, 2.0, 3.0]), (1008, [1.0, 2.0, 3.0]), (1009, [1e38] * 24), (None, [1.0] * 24)]
    odd += [(1010, [-0.0] * 23 + [1.0]), (1011, [0.0] * 23 + [1.0])]
    return out + odd


def sound(rows, n=24):
    return [(i, v) for i, v in rows if i is not None and v and len(v) == n and all(c is not None for c in v) and np.isfinite(v).all() and any(v)]


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors(spark, rows, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)  # small blocks: the crowd is dealt out
    found = {r.id: r for r in near_vectors.near_duplicates(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    good = sorted(sound(rows))
    x = np.array([v for _, v in good], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    links = brute.vector_links(x, 0.95)
    n = np.bincount(np.array(links).ravel(), minlength=len(good))
    group = brute.groups(len(good), links)
    for k, (i, _) in enumerate(good):
        r = found[i]
        assert (r.n_links, r.component, r.kept) == (n[k], good[group[k]][0], group[k] == k), i
    for i in (1001, 1002, 1003, 1004, 1005, 1006, None):
        assert (found[i].n_links, found[i].component, found[i].kept) == (0, i, True)
    assert (found[1008].n_links, found[1008].component) == (1, 1007)
    assert found[1011].component == 1010


def test_near_vectors_repeated_rows_and_empty(spark, rows):
    some = frame(spark, rows[:5] + rows[:2])
    assert sorted((r.id, r.n_links) for r in near_vectors.near_duplicates(some).collect()) == [
        (1, 1), (1, 1), (2, 1), (2, 1), (3, 0), (4, 0), (5, 0),
    ]
    assert near_vectors.near_duplicates(some.limit(0)).count() == 0


def test_hash_recall_at_the_threshold():
    """Pairs at the smallest cosine that counts."""
    rng = np.random.default_rng(4)
    length = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a, z = length(rng.normal(size=(2000, 64))), rng.normal(size=(2000, 64))
    z = length(z - (z * a).sum(axis=1, keepdims=True) * a)
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * z
    x, y = near_vectors.buckets(a), near_vectors.buckets(b)
    met = (x == y[:, :, :1]).any(axis=(1, 2)) | (y == x[:, :, :1]).any(axis=(1, 2))
    assert met.mean() > 0.99


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(near_vectors.hadamard(near_vectors.hadamard(x)), x)


def best(rows, queries, k):
    good = sorted(sound(rows))
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float64)
    out = {}
    for i, v in good:
        if i in queries:
            score = (x * np.array(v)).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), score[j]) for j in order]
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_neighbours(spark, rows, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows = [r for r in rows if r[0] != 1009]
    found = neighbours.nearest(frame(spark, rows + rows[:3]), F.col("vec_id") % 20 == 0, k=10).collect()
    want = best(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 10)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert set(got) == set(want)
    vectors = dict(rows)
    hits = 0
    for q, some in got.items():
        assert len(some) == 10 and some == sorted(some, key=lambda s: (-s[1], s[0]))
        for i, score in some:
            assert score == pytest.approx(float(np.dot(np.array(vectors[q]), np.array(vectors[i]))), rel=1e-12)
        hits += len({i for i, _ in some} & {i for i, _ in want[q]})
    assert hits >= 0.95 * 10 * len(want)


def test_neighbours_of_few_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in range(20, 25)] + [(40, [5.0, 5.0])]
    found = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted((r.query_id, r.rank, r.id) for r in found) == sorted(
        (q, n + 1, i) for q, some in best_small(rows).items() for n, i in enumerate(some)
    )
    assert neighbours.nearest(frame(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def best_small(rows):
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    return {q: [i for i, w in sorted(rows, key=lambda r: (-score(v, r[1]), r[0])) if i != q] for q, v in rows if q % 20 == 0}


def test_equal_vectors_tie_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1, 90)] + [(200 + i, [0.5, 0.0, 0.0, float(i)]) for i in range(3)]
    found = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect()
    for q in (20, 40, 60, 80):
        assert [r.id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == [i for i in range(1, 22) if i != q][:20]


def test_repeated_rows_of_equal_vectors_take_no_places(spark):
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1, 60)]
    rows = same * 2 + same[:1] * 30 + [(200 + i, [0.5, 0.0, 0.0, float(i)]) for i in range(3)]
    found = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect()
    for q in (20, 40):
        assert [r.id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == [i for i in range(1, 22) if i != q][:20]


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(500)] + [(7, 7), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    names = sorted({n for link in links for n in link})
    at = {n: i for i, n in enumerate(names)}
    want = brute.groups(len(names), [(at[a], at[b]) for a, b in links])
    assert found == {n: names[want[at[n]]] for n in names if any(n in l and l[0] != l[1] for l in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
