"""Nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample and balanced: a centroid that gathers too much is made
less attractive round by round. Every vector is indexed in the list of its closest centroid and,
near a boundary, in those of further ones that are hardly farther. A query searches the
centroids through a graph of their neighbours, held in memory, and reads the lists whose
centroids are within a ratio of the closest distance. The ratio is chosen on the sample so that
the lists hold ``AIM`` of the true neighbours there.

For the inner product, vectors are lifted to one length by a further component, so that the
largest product is the smallest distance. Long lists are cut into blocks of bounded size, and
so are the queries of a list. Of equal vectors each list needs as many as a query may return.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import groups
from assay.llm.vectors import matrix, rows_of
from assay.sources.tables import stage

#: Vectors that centroids and ratio are fitted on, and the centroids fitted on them.
SAMPLE, LISTS = 8192, 96
#: Distance ratio up to which a vector stands in further lists, and in how many at most.
BOUNDARY, REPLICAS = 1.03, 3
AIM = 0.98
#: Neighbours of a centroid in the graph.
DEGREE = 12
#: Centroids out of reach that a search visits in a row before it ends.
PATIENCE = 12
BLOCK = 4096
BROADCAST_ROWS = 100_000


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.maximum(out, 0.0)


@dataclass
class Index:
    """Centroids, the graph between them and how lists are chosen. ``reach`` is the largest
    length of an indexed vector."""

    centroids: np.ndarray
    graph: list[list[int]]
    reach: float
    ratio: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.reach**2 - (x * x).sum(axis=1), 0.0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    @staticmethod
    def asked(q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that hold each lifted vector: the closest and near boundaries some more."""
        d = np.sqrt(squared(x, self.centroids))
        order = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
        near = np.take_along_axis(d, order, axis=1)
        return [o[n <= max(n[0] * BOUNDARY, 0.0)] for o, n in zip(order, near)]

    def search(self, q: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
        """Lists for one query, closest first: the graph is walked from the closest known
        centroid on, as long as what comes next can be within the ratio. The lists hold at
        least ``least`` of ``counts`` vectors, if there are so many."""
        dist: dict[int, float] = {}

        def see(nodes) -> None:
            fresh = [int(n) for n in nodes if int(n) not in dist]
            if fresh:
                found = np.sqrt(((self.centroids[fresh] - q) ** 2).sum(axis=1))
                dist.update(zip(fresh, found.tolist()))

        see(range(0, len(self.centroids), max(1, len(self.centroids) // 8)))
        done: set[int] = set()
        beyond = 0  # nodes in a row that were out of reach
        while beyond < PATIENCE and len(done) < len(dist):
            node = min((n for n in dist if n not in done), key=lambda n: (dist[n], n))
            done.add(node)
            beyond = beyond + 1 if dist[node] > min(dist.values()) * self.ratio else 0
            see(self.graph[node])
        limit = min(dist.values()) * self.ratio
        found = np.array(sorted((n for n in dist if dist[n] <= limit), key=lambda n: (dist[n], n)))
        if counts[found].sum() < least:  # short lists: all centroids in order, until there is enough
            order = np.argsort(((self.centroids - q) ** 2).sum(axis=1), kind="stable")
            found = order[: int(np.searchsorted(np.cumsum(counts[order]), least)) + 1]
        return found

    @staticmethod
    def linked(centroids: np.ndarray) -> list[list[int]]:
        """Each centroid's closest ones, but none that a closer neighbour already leads to:
        so links also leave a crowd of centroids. Links go both ways."""
        between = squared(centroids, centroids)
        out: list[set[int]] = [set() for _ in centroids]
        for i, row in enumerate(np.argsort(between, axis=1, kind="stable").tolist()):
            kept: list[int] = []
            for j in row:
                if j != i and len(kept) < DEGREE and all(between[i, j] < between[j, n] for n in kept):
                    kept.append(j)
            for j in kept:
                out[i].add(j)
                out[j].add(i)
        return [sorted(n) for n in out]

    @classmethod
    def fit(cls, sample: np.ndarray, reach: float, k: int) -> Index:
        index = cls(np.zeros((0, 0)), [], reach, 1.0)
        x = index.lifted(sample)
        lists = max(1, min(LISTS, len(x) // 8))
        rng = np.random.default_rng(7)
        centre = x[rng.choice(len(x), lists, replace=False)]
        price = np.zeros(lists)
        for _ in range(25):
            d = squared(x, centre)
            mine = (d + price * d.mean()).argmin(axis=1)
            count = np.bincount(mine, minlength=lists)
            price = np.clip(price + 0.05 * (count * lists / len(x) - 1), -0.5, 0.5)
            total = np.zeros_like(centre)
            np.add.at(total, mine, x)
            full = count > 0
            centre[full] = total[full] / count[full, None]
            centre[~full] = x[rng.choice(len(x), int((~full).sum()))]
        index.centroids, index.graph = centre, cls.linked(centre)
        index.ratio = index._ratio(sample, k)
        return index

    def _ratio(self, sample: np.ndarray, k: int) -> float:
        """The smallest ratio at which the sample's own neighbours are found well enough."""
        x = self.lifted(sample)
        member = np.zeros((len(x), len(self.centroids)), bool)
        for i, some in enumerate(self.lists_of(x)):
            member[i, some] = True
        asked = sample[:: max(1, len(sample) // 256)]
        distance = np.sqrt(squared(self.asked(asked), self.centroids))
        best = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
        need = []  # the ratio at which each neighbour comes into reach
        for row, found in zip(distance, best):
            lists = np.where(member[found], row[None, :], np.inf).min(axis=1)
            need.append(lists / max(row.min(), 1e-12))
        # where most of the sample lies on centroids the quantile is zero: the closest list counts
        return max(1.0, float(np.quantile(np.concatenate(need), AIM)) * 1.0001) if need else 1.0


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` rows found with the largest inner product for
    every row that ``is_query`` holds for, without itself. Ties go to the smaller id.

    Rows whose vector is null, empty, zero or holds a null or non-finite component, and rows
    without id, take no part. Vectors of another length than most are no candidates of each
    other. Rows that repeat an id with the same vector are one row. An empty table gives an
    empty table.
    """
    spark = vectors.sparkSession
    rows = rows_of(vectors.withColumn("_asks", is_query), key, vector).where("sound")
    asks = vectors.where(is_query).select(F.col(key).cast("long").alias("id")).distinct()
    # equal vectors: as many of the smallest ids as a query can return, and its own; repeated
    # rows are made one first, or they would take the places of other ids
    first = F.row_number().over(Window.partitionBy("one", "two").orderBy("id"))
    sample_of = lambda some: some.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    lengths = rows.groupBy(F.size("vector").alias("dims")).agg(F.max(size).alias("reach"), F.count("*").alias("n"))
    out = None
    for row in sorted(lengths.collect(), key=lambda r: (-r["n"], r["dims"])):  # one for each vector length
        some = rows.where(F.size("vector") == row["dims"])
        sample = matrix(sample_of(some.select("id", "vector")).toArrow().column("vector").combine_chunks())
        index = Index.fit(sample, row["reach"], k)
        single = some.dropDuplicates(["id", "one", "two"])
        kept = single.withColumn("nth", first).where(F.col("nth") <= k + 1).select("id", "vector")
        found = _search(kept, some.join(asks, "id", "left_semi").select("id", "vector").dropDuplicates(), index, k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, id long, score double")


def _search(kept: DataFrame, asking: DataFrame, index: Index, k: int) -> DataFrame:
    kind = kept.schema["vector"].dataType.simpleString()

    # a vector stands in REPLICAS lists at most, so these hold more than k different ones
    least = REPLICAS * (k + 1)

    def listed(counts: np.ndarray | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    some = batch.slice(i, 1024)
                    x = matrix(some.column("vector"))
                    if counts is None:
                        lists = index.lists_of(index.lifted(x))
                    else:
                        lists = [index.search(q, counts, least) for q in index.asked(x)]
                    at = pa.array(np.repeat(np.arange(len(lists)), [len(n) for n in lists]))
                    flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(flat), some.column("id").take(at), some.column("vector").take(at)], ["list", "id", "vector"]
                    )

        return run

    schema = f"list int, id long, vector {kind}"
    posts = stage(kept.mapInArrow(listed(), schema), "posting-lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for row in posts.groupBy("list").count().collect():  # as many numbers as lists
        sizes[row["list"]] = row["count"]
    asked = stage(asking.mapInArrow(listed(sizes), schema), "list-queries")
    # blocks on both sides: there are as many counts as lists
    blocks = lambda some, to: some.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias(to))
    counts = F.broadcast(blocks(posts, "rows").join(blocks(asked, "queries"), "list"))
    own = lambda to: F.pmod(F.xxhash64("id"), F.col(to))
    nth = lambda to: F.explode(F.sequence(F.lit(0).cast("long"), F.col(to) - 1))
    left = posts.join(counts, "list").select("list", own("rows").alias("a"), nth("queries").alias("b"), F.lit(False).alias("asks"), "id", "vector")
    right = asked.join(counts, "list").select("list", nth("rows").alias("a"), own("queries").alias("b"), F.lit(True).alias("asks"), "id", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["list", "a", "b"]):
            asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            if asks.all() or not asks.any():
                continue
            ids, x = rows.column("id").to_numpy(), matrix(rows.column("vector"))
            here = np.flatnonzero(~asks)
            here = here[np.argsort(ids[here], kind="stable")]
            queries = np.flatnonzero(asks)
            for i in range(0, len(queries), 256):
                some = queries[i : i + 256]
                product = x[some] @ x[here].T
                product[ids[some][:, None] == ids[here][None, :]] = -np.inf
                n = min(k, len(here))
                last = np.partition(product, len(here) - n, axis=1)[:, len(here) - n]
                # the block's order of sums may differ: take all that could tie, sum them alike
                slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(last), last, 0.0)))
                r, c = np.nonzero((product >= (last - slack)[:, None]) & np.isfinite(product))
                score = np.einsum("ij,ij->i", x[some[r]], x[here[c]])
                order = np.lexsort((ids[here[c]], -score, r))
                r, c, score = r[order], c[order], score[order]
                begin = np.searchsorted(r, np.arange(len(some)))
                top = np.arange(len(r)) - begin[r] < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some[r[top]]]), pa.array(ids[here[c[top]]]), pa.array(score[top])], ["query_id", "id", "score"]
                )

    keys = ["list", "a", "b"]
    both = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys)
    found = both.mapInArrow(compare, "query_id long, id long, score double")
    # a vector may stand in several lists
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.select("query_id", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)
