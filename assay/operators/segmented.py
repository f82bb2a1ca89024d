"""Prefix scans over groups of any size, with one range shuffle.

Rows are laid out by group and order; the layout is written down once. Inside a range
partition what precedes a row in its group is worked out batch by batch. Of each partition one
further row is written, the state its last group ends with. States are summed up along a
group's partitions, of which there are few, and the sums are handed only to the rows of the
group that a partition begins with. A group that holds most of the table is thereby spread over
as many tasks as it fills, and the result does not depend on where the partitions are cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.sources.tables import stage


class _State:
    """What the rows of the current group leave behind."""

    def __init__(self, kinds: list[pa.DataType], flags: int):
        self.last = [pa.scalar(None, k) for k in kinds]
        self.any = [False] * flags
        self.count = 0
        self.key: list | None = None
        self.first_group = True


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first is another one than the value before; nulls are equal."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False)


def _advance(batch: pa.RecordBatch, groups: list[str], last: list[str], flags: list[str], state: _State) -> dict[str, pa.Array]:
    """The prefix columns of a batch; moves the state behind it."""
    n = batch.num_rows
    keys = [batch.column(g) for g in groups]
    first = [k[0] for k in keys]
    starts = np.zeros(n, bool)
    starts[0] = state.key is not None and any(not a.equals(b) for a, b in zip(first, state.key))
    for k in keys:
        starts[1:] |= _differs(k)
    places = np.arange(n)
    begin = np.maximum.accumulate(np.where(starts, places, -1))
    carried, floor = begin < 0, np.maximum(begin, 0)
    ends = int(floor[-1])
    out = {"_open": pa.array(carried & state.first_group)}
    for i, name in enumerate(last):
        column = batch.column(name)
        there = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), places, -1))
        before = np.append(-1, there[:-1])
        found = column.take(pa.array(before, mask=before < floor))
        out[name] = pc.if_else(pa.array(carried & (before < 0)), state.last[i], found)
        if there[-1] >= ends:
            state.last[i] = column[int(there[-1])]
        elif not carried[-1]:
            state.last[i] = pa.scalar(None, column.type)
    for i, name in enumerate(flags):
        sums = np.append(0, np.cumsum(batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)))
        out[name] = pa.array((sums[:-1] > sums[floor]) | (carried & state.any[i]))
        state.any[i] = bool(sums[-1] > sums[ends]) or bool(carried[-1] and state.any[i])
    out["_count"] = pa.array(places - floor + np.where(carried, state.count, 0))
    state.count = n - ends + (state.count if carried[-1] else 0)
    state.first_group &= bool(carried[-1])
    state.key = [k[n - 1] for k in keys]
    return out


def prefixes(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    last: dict[str, Column] | None = None,
    any_before: dict[str, Column] | None = None,
    count: str | None = None,
) -> DataFrame:
    """``df`` with what precedes every row in its group.

    ``last`` names columns with the last value before the row that is not null, ``any_before``
    columns that tell whether a condition held before, and ``count`` the number of rows before.
    A null group is a group. Rows that are equal in ``order`` come in any order among
    themselves. An empty table gives an empty table.
    """
    last, any_before = last or {}, any_before or {}
    values, flags = [f"_last{i}" for i in range(len(last))], [f"_any{i}" for i in range(len(any_before))]
    prepared = df.select(
        "*",
        *[c.alias(v) for c, v in zip(last.values(), values)],
        *[F.coalesce(c, F.lit(False)).alias(f) for c, f in zip(any_before.values(), flags)],
    )
    kinds = [prepared.schema[v].dataType for v in values]
    extra = [T.StructField("_count", T.LongType()), T.StructField("_part", T.LongType())]
    extra += [T.StructField("_open", T.BooleanType()), T.StructField("_tail", T.BooleanType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in prepared.schema] + extra)
    names, keys = schema.fieldNames(), list(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, kept = TaskContext.get().partitionId(), None, None

        def row(batch: pa.RecordBatch, new: dict[str, pa.Array], tail: bool) -> pa.RecordBatch:
            n = batch.num_rows
            new = {**new, "_part": pa.array(np.full(n, part, np.int64)), "_tail": pa.array(np.full(n, tail))}
            return pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

        for batch in batches:
            if batch.num_rows:
                if state is None:
                    state = _State([batch.schema.field(v).type for v in values], len(flags))
                yield row(batch, _advance(batch, keys, values, flags, state), False)
                kept = batch.slice(batch.num_rows - 1)
        if kept is not None:
            new = {v: pa.array([s.as_py()], s.type) for v, s in zip(values, state.last)}
            new |= {f: pa.array([s]) for f, s in zip(flags, state.any)}
            yield row(kept, {**new, "_count": pa.array([state.count]), "_open": pa.array([state.first_group])}, True)

    by = [*groups, *order]
    laid = stage(prepared.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), "prefixes")
    ordered = Window.partitionBy(*groups).orderBy("_part")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = laid.where("_tail")
    # what a partition leaves behind is for the next one; there is a row for each partition
    carry = tails.select(
        *[F.col(g).alias(f"_of_{g}") for g in groups],
        F.lead("_part").over(Window.orderBy("_part")).alias("_into"),
        *[F.last(v, ignorenulls=True).over(upto).alias(f"{v}_in") for v in values],
        *[F.max(f).over(upto).alias(f"{f}_in") for f in flags],
        F.sum("_count").over(upto).alias("_count_in"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups]
    rows = laid.where("NOT _tail").join(F.broadcast(carry), [F.col("_part") == F.col("_into"), F.col("_open"), *same], "left")
    counted = [] if count is None else [(F.col("_count") + F.coalesce("_count_in", F.lit(0))).alias(count)]
    return rows.select(
        *df.columns,
        *[F.coalesce(v, f"{v}_in").alias(n) for v, n in zip(values, last)],
        *[(F.col(f) | F.coalesce(f"{f}_in", F.lit(False))).alias(n) for f, n in zip(flags, any_before)],
        *counted,
    )
