"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a hash of their text, a hash of their key and a number, so equal texts lie
side by side. The splitters between shards are found by counting: a round counts the exact
bytes and rows below evenly spaced probes inside every open interval, and the interval that
holds a splitter's target becomes the next one, 4096 times narrower. Rounds read the staged
order columns only, and from the second on only rows of open intervals. A splitter is settled
at the edge nearest its target of a group of equal texts, if the group is within the tolerance,
otherwise of a single row: groups stay together unless a shard's size forbids it, and a group
of any size can be cut.

Shards larger than ``part_bytes`` get splitters inside as well, which need not be exact, so no
task has to hold a shard. All rows are then exchanged once, by range; the rows below every
splitter are known from the counts, so the place of a row in its shard needs no second pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.sources.tables import stage

#: Bits of an order column, and bits by which a round narrows an interval.
BITS, STEP = 60, 12
ORDER = ("a", "b", "c")
#: An inner splitter may miss its target by this part of a range.
INNER = 0.25


@dataclass
class Splitter:
    """The interval that holds the target of splitter ``nth``, and what lies below it."""

    nth: int
    target: int
    fixed: tuple[int, ...] = ()
    prefix: int = 0
    shift: int = BITS
    bytes: int = 0
    rows: int = 0
    key: tuple[int, ...] | None = field(default=None)

    def settle(self, value: int) -> None:
        """Rows from ``value`` of the open column on are above."""
        self.key = (*self.fixed, value, 0, 0)[: len(ORDER)]


def digits(column: Column) -> Column:
    """The first 60 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(column.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def values(spark: SparkSession, names: list[str], rows: list[tuple[int, ...]]) -> DataFrame:
    """A small table of longs, known to the planner."""
    text = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names)})")


def counted(rows: DataFrame, splitters: list[Splitter], depth: int, shift: int) -> list:
    """For each splitter the probe interval that holds its target: ``nth, bin``, bytes and rows
    below it and in it, and the least and largest value in it."""
    spark, column = rows.sparkSession, ORDER[depth]
    intervals = sorted({(*s.fixed, s.prefix) for s in splitters})
    number = {at: i for i, at in enumerate(intervals)}
    some = rows.select(*ORDER[: depth + 1], "size")
    if depth or shift < BITS:
        names = [f"at_{c}" for c in ORDER[: depth + 1]]
        where = values(spark, ["at", *names], [(i, *at) for at, i in number.items()])
        same = [F.col(c) == F.col(f"at_{c}") for c in ORDER[:depth]]
        same.append(F.shiftright(column, shift) == F.col(f"at_{column}"))
        some = some.join(where, same)
    else:
        some = some.withColumn("at", F.lit(0).cast("long"))
    bins = some.groupBy("at", F.shiftright(column, shift - STEP).alias("bin")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(column).alias("low"), F.max(column).alias("high")
    )
    below = Window.partitionBy("at").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns({f"{c}_below": F.coalesce(F.sum(c).over(below), F.lit(0)) for c in ("bytes", "rows")})
    here = F.struct("bin", "bytes", "rows", "low", "high", "bytes_below", "rows_below")
    edges = bins.select("at", F.col("bytes_below").alias("place"), F.lit(None).cast("long").alias("nth"), here.alias("here"))
    sought = values(spark, ["at", "place", "nth"], [(number[*s.fixed, s.prefix], s.target - s.bytes, s.nth) for s in splitters])
    both = edges.unionByName(sought.withColumn("here", F.lit(None).cast(edges.schema["here"].dataType)))
    # the last bin that begins at a target or before holds it
    upto = Window.partitionBy("at").orderBy("place", F.asc_nulls_first("nth")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("here", F.last("here", ignorenulls=True).over(upto))
    return both.where("nth IS NOT NULL").select("nth", "here.*").collect()


def splitters(rows: DataFrame, shards: int, parts: int, tolerance: float, total: int) -> list[Splitter]:
    """The settled splitters between ``shards * parts`` ranges of staged ``rows(a, b, c, size)``."""
    many = shards * parts
    every = [Splitter(j, total * j // many) for j in range(1, many)]
    while open_ones := [s for s in every if s.key is None]:
        by_width: dict[tuple[int, int], list[Splitter]] = {}
        for s in open_ones:
            by_width.setdefault((len(s.fixed), s.shift), []).append(s)
        for (depth, shift), some in by_width.items():
            found = {r.nth: r for r in counted(rows, some, depth, shift)}
            for s in some:
                r = found[s.nth]
                s.prefix, s.shift = r.bin, shift - STEP
                s.bytes, s.rows = s.bytes + r.bytes_below, s.rows + r.rows_below
                if s.nth % parts and r.bytes * many <= INNER * total:
                    s.settle(r.bin << s.shift)
                elif r.low < r.high:
                    continue
                elif r.rows == 1 or depth == 2 or (depth == 0 and r.bytes * shards <= tolerance * total):
                    # whatever has its middle below the target is below the splitter
                    if (2 * s.bytes + r.bytes) * many < 2 * total * s.nth:
                        s.bytes, s.rows = s.bytes + r.bytes, s.rows + r.rows
                        s.settle(r.low + 1)
                    else:
                        s.settle(r.low)
                else:
                    s.fixed, s.prefix, s.shift = (*s.fixed, r.low), 0, BITS
    for last, s in zip(every, every[1:]):
        if s.key < last.key:  # a coarse inner splitter behind an exact one
            s.key, s.bytes, s.rows = last.key, last.bytes, last.rows
    return every


def longs(numbers: list[int]) -> Column:
    """An array of longs that is folded into one constant."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def position(every: list[Splitter]) -> Column:
    """How many splitters a row is not below, by binary search."""
    n = len(every)
    if not n:
        return F.lit(0)
    tables = [longs([s.key[i] for s in every]) for i in range(len(ORDER))]

    def reached(i: Column) -> Column:
        out = F.lit(True)
        for table, column in reversed(list(zip(tables, ORDER))):
            split = F.element_at(table, i)
            out = (split < F.col(column)) | ((split == F.col(column)) & out)
        return out

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & reached(F.least(at + step, F.lit(n))), at + step).otherwise(at),
    )


def sharded(
    docs: DataFrame,
    shards: int = 40,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str | Column] | None = None,
    tolerance: float = 0.01,
    part_bytes: int = 256 << 20,
) -> DataFrame:
    """``(row, size, shard, slot)`` of every row: its columns, or those in ``keep``, as a struct,
    its bytes, its shard from 0 and its place there from 0, without gaps.

    A row's size is the UTF-8 bytes of its text, none for null, plus 16. Shards have nearly equal
    bytes: each ends at the edge nearest its due size, of a group of equal texts of at most
    ``tolerance`` of a shard, or of one row. Null and empty texts are one group. Null keys count
    as empty ones; repeated rows are rows of their own, in any order among themselves. A text
    longer than a shard fills one or leaves its neighbours empty. An empty table gives an empty
    table. Other columns travel in ``row`` and can have any names.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    found = docs.select(
        F.struct(*(docs.columns if keep is None else keep)).alias("row"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        digits(body).alias("a"),
        digits(name).alias("b"),
    )
    # the number is written down, so that it stays the same when tasks run again
    rows = stage(found.withColumn("c", F.monotonically_increasing_id()), "sharding")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (shards * part_bytes)))
    every = splitters(rows, shards, parts, tolerance, total) if total else []
    starts = [0, *[s.rows for s in every]] if total else [0]
    at = F.col("range")
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*ORDER)) - 1
    before = longs([n - starts[i - i % parts] for i, n in enumerate(starts)])
    return rows.withColumn("range", position(every)).select(
        "row",
        "size",
        F.floor(at / F.lit(parts)).cast("int").alias("shard"),
        (F.element_at(before, at + 1) + nth).cast("long").alias("slot"),
    )
