"""State of a stream in buckets by key: a delta per batch, and bases compacted bucket by bucket.

    deltas/batch=<id>/bucket=<b>      what a batch adds; run again, it rewrites its own
    snapshots/v=<id>/bucket=<b>       the buckets a compaction wrote
    index/v=<id>                      for every bucket, the compaction that wrote it last

A batch reads the buckets of its own keys only. A compaction rewrites the buckets that changed,
and all of them when their number doubles, which it does as the state grows: what a key costs
does not depend on the size of the state. Folders are never overwritten by other content, and an
index counts once it is complete. The index is a row per bucket, and the driver holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.sources.tables import latest_version, names_in

Fold = Callable[[DataFrame], DataFrame]

#: Rows a bucket holds on average before the number of buckets doubles, and that number at first.
ROWS_PER_BUCKET, FIRST_BUCKETS = 500_000, 16
INDEX = "bucket int, written long, held long, buckets int"


class _Index(NamedTuple):
    version: int
    buckets: int
    written: dict[int, int]
    held: dict[int, int]


class StateTable:
    """Rows of ``schema`` that ``fold`` reduces to those that count. ``fold`` sees them with their
    ``batch``; rows with equal ``key`` stay together. An empty folder is an empty table."""

    def __init__(
        self, spark: SparkSession, folder: str, key: Sequence[str], schema: T.StructType, fold: Fold,
        rows_per_bucket: int = ROWS_PER_BUCKET,
    ):
        self._spark, self._folder, self._key, self._fold = spark, folder, list(key), fold
        self._schema, self._per_bucket = schema, rows_per_bucket

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self._key), F.lit(buckets)).cast("int")

    def _index(self, before: int | None) -> _Index:
        version = latest_version(self._spark, f"{self._folder}/index", before)
        if version is None:
            return _Index(-1, FIRST_BUCKETS, {}, {})
        rows = self._spark.read.schema(INDEX).parquet(f"{self._folder}/index/v={version}").collect()
        some = [r for r in rows if r["bucket"] is not None]
        return _Index(
            version, rows[0]["buckets"], {r["bucket"]: r["written"] for r in some}, {r["bucket"]: r["held"] for r in some}
        )

    def _write(self, rows: DataFrame, buckets: int, folder: str) -> None:
        order = [c for c in ("status", "checked_at") if c in rows.columns]
        dealt = rows.select(*self._schema.fieldNames()).withColumn("bucket", self._bucket(buckets)).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(folder)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Keeps what a batch adds; ``rows`` has few of each key."""
        self._write(rows, self._index(batch_id).buckets, f"{self._folder}/deltas/batch={batch_id}")

    def _deltas(self, index: _Index, before: int | None) -> DataFrame | None:
        """The deltas after an index; their buckets are counted as its own."""
        ids = [int(n[6:]) for n in names_in(self._spark, f"{self._folder}/deltas") if n.startswith("batch=")]
        ids = [i for i in sorted(ids) if i > index.version and (before is None or i < before)]
        if not ids:
            return None
        schema = T.StructType([*self._schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        read = self._spark.read.schema(schema).option("basePath", f"{self._folder}/deltas")
        return read.parquet(*[f"{self._folder}/deltas/batch={i}" for i in ids])

    def _read(self, index: _Index, before: int | None, some: set[int] | None) -> DataFrame:
        names = [*self._schema.fieldNames(), "batch"]
        parts = []
        paths = [
            f"{self._folder}/snapshots/v={v}/bucket={b}" for b, v in sorted(index.written.items()) if some is None or b in some
        ]
        if paths:
            base = self._spark.read.schema(self._schema).parquet(*paths)
            parts.append(base.withColumn("batch", F.lit(index.version).cast("long")).select(*names))
        deltas = self._deltas(index, before)
        if deltas is not None:
            parts.append((deltas if some is None else deltas.where(F.col("bucket").isin(*some))).select(*names))
        if not parts:
            none = T.StructType([*self._schema.fields, T.StructField("batch", T.LongType())])
            return self._spark.createDataFrame([], none)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def rows(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """Rows with the ``batch`` they belong to, not folded.

        ``before`` leaves out that batch and later ones, also what they have compacted, so a
        batch that is run again sees what it saw. Of ``touched`` the keys count: only their
        buckets are read.
        """
        index = self._index(before)
        some = None
        if touched is not None:  # at most as many numbers as buckets
            some = {r[0] for r in touched.select(self._bucket(index.buckets)).distinct().collect()}
        return self._read(index, before, some)

    def current(self) -> DataFrame:
        """The folded rows of all batches so far."""
        return self._fold(self.rows()).select(*self._schema.fieldNames())

    def compact(self, upto: int) -> None:
        """Folds all batches up to this one into the buckets they changed."""
        if latest_version(self._spark, f"{self._folder}/index", upto + 1) == upto:
            return  # the batch is run again
        index = self._index(upto)
        deltas = self._deltas(index, upto + 1)
        changed = set() if deltas is None else {r[0] for r in deltas.select("bucket").distinct().collect()}
        buckets = index.buckets
        while sum(index.held.values()) > buckets * self._per_bucket:
            buckets *= 2
        same = buckets == index.buckets
        target = f"{self._folder}/snapshots/v={upto}"
        self._write(self._fold(self._read(index, upto + 1, changed if same else None)), buckets, target)
        bucketed = T.StructType([*self._schema.fields, T.StructField("bucket", T.IntegerType())])
        found = self._spark.read.schema(bucketed).parquet(target).groupBy("bucket").count().collect()
        rows = [(r["bucket"], upto, r["count"], buckets) for r in found]
        if same:
            rows += [(b, v, index.held[b], buckets) for b, v in index.written.items() if b not in changed]
        # a row without bucket stands for a table that is empty
        done = self._spark.createDataFrame(rows or [(None, upto, 0, buckets)], INDEX)
        done.coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/index/v={upto}")
