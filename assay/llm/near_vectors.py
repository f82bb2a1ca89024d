"""Embedding near-duplicates: cross-polytope hashing with fast rotations and multiprobe buckets.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is
the axis it comes closest to, with sign. ``HASHES`` of them name a bucket. Every vector stands
in one bucket of each table and looks into a few more, the ones it missed by least.

Candidates are compared inside buckets by matrix products in double precision. A large bucket
is cut into blocks on both sides. A pair may meet in several buckets; it counts in the first of
them only, which each block works out from the two vectors alone. Blocks report numbers of
links and chains that join what is linked, never pairs, so a group of copies costs one row for
each vector and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import groups, merged
from assay.llm.components import components
from assay.llm.vectors import matrix, rows_of, unit
from assay.sources.tables import stage

TABLES = 6
HASHES = 2
#: Further buckets a vector looks into, in every table.
PROBES = 2
#: Vectors of a block on either side.
BLOCK = 2048
#: Hot buckets up to this many are broadcast.
BROADCAST_ROWS = 100_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; lengths are powers of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def axes(x: np.ndarray, table: int, nth: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The closest signed axes of the rotated rows, best first, and how far each falls short."""
    n, dims = x.shape
    width = max(2, 1 << (dims - 1).bit_length())
    y = np.zeros((n, width))
    y[:, :dims] = x
    signs = np.random.default_rng((table, nth, width)).choice([-1.0, 1.0], (3, width))
    for s in signs:
        y = hadamard(y * s)
    size = np.abs(y)
    most = min(most, width)
    top = np.argsort(-size, axis=1, kind="stable")[:, :most]
    value = np.take_along_axis(y, top, axis=1)
    loss = np.abs(value[:, :1]) - np.abs(value)
    return top * 2 + (value < 0), loss * loss


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """``[row, table, 1 + probes]``: the bucket of every row, then those it nearly fell into.

    The further buckets change the choice of one hash at a time.
    """
    n, dims = x.shape
    base = 2 * max(2, 1 << (dims - 1).bit_length())
    if dims * base**hashes >= 1 << 63:
        raise ValueError("too many hashes for vectors of this length")
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        found = [axes(x, t, h, 1 + probes) for h in range(hashes)]
        home = np.full(n, dims, np.int64)  # only vectors of one length share a bucket
        for axis, _ in found:
            home = home * base + axis[:, 0]
        out[:, t, 0] = home
        options, losses = [], []
        for h, (axis, loss) in enumerate(found):
            weight = base ** (hashes - 1 - h)
            options.append(home[:, None] + (axis[:, 1:] - axis[:, :1]) * weight)
            losses.append(loss[:, 1:])
        options, losses = np.concatenate(options, axis=1), np.concatenate(losses, axis=1)
        best = np.argsort(losses, axis=1, kind="stable")[:, :probes]
        some = np.take_along_axis(options, best, axis=1)
        out[:, t, 1 : 1 + some.shape[1]] = some
        out[:, t, 1 + some.shape[1] :] = -1  # short vectors have fewer axes
    return out


def first_meeting(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """When pairs meet first, from their buckets: ``2 t`` where in table ``t`` the pair's low
    member looks into the bucket of the high one, ``2 t + 1`` for the other way round."""
    looks = (low == high[:, :, :1]).any(axis=2)
    back = (high == low[:, :, :1]).any(axis=2)
    both = np.stack([looks, back], axis=2).reshape(len(low), -1)
    return both.argmax(axis=1)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """``(id, n_links, component, kept)`` of every row.

    ``n_links`` counts the other rows with a cosine of at least ``least`` that were found,
    ``component`` is the smallest id reachable, ``kept`` says whether that is the row's own.
    Rows whose vector is null, empty, zero or holds a null or non-finite component, and rows
    without id, link with nothing. Vectors of different lengths never link. Rows with equal
    vectors link with each other. Repeated ids are rows like others. An empty table gives an
    empty table.
    """
    rows = rows_of(vectors, key, vector)
    classes = (
        rows.where("sound")
        .groupBy("one", "two")
        .agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column("vector")).to_numpy()
            for dims in np.unique(lengths):
                some = batch.take(pa.array(np.flatnonzero(lengths == dims)))
                places = buckets(unit(matrix(some.column("vector"))))
                columns = [some.column(c) for c in ("one", "two", "id", "n", "vector")]
                looks = pa.array([p.ravel() for p in places], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, looks], ["one", "two", "id", "n", "vector", "looks"])

    kind = classes.schema["vector"].dataType.simpleString()
    known = stage(
        classes.mapInArrow(hashed, f"one long, two long, id long, n long, vector {kind}, looks array<long>"),
        "hashed-vectors",
    )
    wide = 1 + PROBES
    table, home = F.floor(F.col("at") / wide).cast("int"), (F.col("at") % wide) == 0
    spread = known.select("id", "n", "vector", F.posexplode("looks").alias("at", "bucket")).where("bucket >= 0")
    spread = spread.select("id", "n", "vector", table.alias("table"), "bucket", home.alias("home"))
    place = ["table", "bucket"]
    sizes = spread.groupBy(*place).agg(F.count("*").alias("there")).where(F.col("there") > BLOCK)
    crowd = stage(sizes.select(*place, F.ceil(F.col("there") / BLOCK).cast("long").alias("blocks")), "hot-buckets")
    crowd = F.broadcast(crowd) if crowd.count() <= BROADCAST_ROWS else crowd

    # a vector at home in a bucket is compared with all that look into it, and looks itself;
    # in a hot bucket the two sides are dealt out apart: to one block of its own side and all
    # of the other's
    one = F.lit(1).cast("long")
    dealt = spread.join(crowd, place, "left").withColumn("blocks", F.coalesce("blocks", one))
    sides = F.when(~F.col("home"), F.array(F.lit(2))).otherwise(
        F.when(F.col("blocks") == 1, F.array(F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))
    )
    dealt = dealt.withColumn("side", F.explode(sides)).withColumn(
        "nth", F.explode(F.sequence(one - 1, F.col("blocks") - 1))
    )
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    block = F.when(F.col("side") == 2, F.col("nth") * F.col("blocks") + own).otherwise(
        own * F.col("blocks") + F.col("nth")
    )
    dealt = dealt.select(*place, block.alias("block"), "side", "id", "n", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["table", "bucket", "block"]):
            side = rows.column("side").to_numpy()
            a, b = np.flatnonzero(side & 2), np.flatnonzero(side & 1)
            if not len(a) or not len(b) or len(side) < 2:
                continue
            ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
            table = rows.column("table")[0].as_py()
            x = unit(matrix(rows.column("vector")))
            total, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
            places, placed = np.zeros((len(ids), TABLES, wide), np.int64), np.zeros(len(ids), bool)
            for i in range(0, len(a), 256):
                r, c = np.nonzero(x[a[i : i + 256]] @ x[b].T >= least)
                r, c = a[i : i + 256][r], b[c]
                other = ids[r] != ids[c]
                r, c = r[other], c[other]
                fresh = np.unique(np.concatenate([r, c]))
                fresh = fresh[~placed[fresh]]
                if len(fresh):
                    places[fresh], placed[fresh] = buckets(x[fresh]), True
                for k in range(0, len(r), 65536):
                    p, q = r[k : k + 65536], c[k : k + 65536]
                    low, high = np.where(ids[p] < ids[q], p, q), np.where(ids[p] < ids[q], q, p)
                    first = first_meeting(places[low], places[high]) == 2 * table + (low != p)
                    p, q = p[first], q[first]
                    total += np.bincount(p, n[q], len(ids)).astype(np.int64)
                    total += np.bincount(q, n[p], len(ids)).astype(np.int64)
                    labels = merged(labels, p, q)
            there = np.flatnonzero(total)
            if len(there):
                # a vector may stand on both sides of a block; ids keep the two apart
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[there]), pa.array(total[there]), pa.array(ids[labels[there]])], ["a", "links", "b"]
                )

    keys = [*place, "block"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    found = stage(dealt.mapInArrow(compare, "a long, links long, b long"), "vector-links")
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b")).withColumnRenamed("node", "id")
    known = (
        known.select("one", "two", "id", "n")
        .join(links, "id", "left")
        .join(joined, "id", "left")
        .select(
            "one",
            "two",
            F.lit(True).alias("sound"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    out = rows.select("id", "one", "two", "sound").join(known, ["one", "two", "sound"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        "id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
