"""Packing of token ids into sequences of fixed size, with a bounded number of open windows.

Every partition packs its documents as they come. Stretches that fill a window are a sequence
at once. What is left of a document goes to the open window in which it fits best. When it fits
in none and no more may be opened, the fullest window takes as much as it has room for and is
emitted. At the end of a partition its open windows are poured together, so that one is left at
most; those of all partitions are merged the same way, some hundred at a time.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import slices, texts
from assay.llm.tokens import library
from assay.sources.tables import stage

SIZE = 2048
OPEN_WINDOWS = 64
#: Unfinished windows that one task merges.
FAN_IN = 512
ID = 4

PIECE = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Window:
    """Pieces ``(key, start, ids, document's ids)`` that stand one after the other."""

    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.used = 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.used += len(piece[2]) // ID


def cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
    key, start, ids, total = piece
    return (key, start, ids[: at * ID], total), (key, start + at, ids[at * ID :], total)


class Packer:
    """Best fit among a fixed number of open windows; ``done`` takes what is emitted."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[tuple[int, int, Window]] = []  # by room, then age
        self.age = 0
        self.done: list[Window] = []

    def _file(self, window: Window) -> None:
        if window.used == self.size:
            self.done.append(window)
            return
        self.age += 1
        insort(self.open, (self.size - window.used, self.age, window))

    def place(self, piece: tuple) -> None:
        while len(piece[2]) // ID >= self.size:
            full, window = None, Window()
            full, piece = cut(piece, self.size)
            window.add(full)
            self.done.append(window)
        n = len(piece[2]) // ID
        while n:
            at = bisect_left(self.open, (n,))
            if at < len(self.open):  # fits best here
                window = self.open.pop(at)[2]
            elif len(self.open) < self.most:
                window = Window()
            else:  # fits nowhere: fill the fullest and emit it
                room, _, window = self.open.pop(0)
                head, piece = cut(piece, room)
                window.add(head)
                self._file(window)
                n = len(piece[2]) // ID
                continue
            window.add(piece)
            self._file(window)
            return

    def pour(self) -> None:
        """Fills the fullest windows with the pieces of the emptiest; one stays open at most."""
        while len(self.open) > 1:
            source = self.open.pop()[2]
            for piece in source.pieces:
                while len(piece[2]):
                    if not self.open:
                        self._file(Window())
                    room, _, window = self.open.pop(0)
                    head, piece = cut(piece, min(room, len(piece[2]) // ID))
                    window.add(head)
                    self._file(window)


def _rows(windows: list[Window], ids_of: Iterator[int], with_ids: bool, open_: bool) -> list[tuple]:
    out = []
    for window in windows:
        at, sequence = 0, next(ids_of)
        for key, start, ids, total in window.pieces:
            n = len(ids) // ID
            kept = bytes(ids) if with_ids or open_ else None
            out.append((key, start, n, zlib.crc32(ids), total, sequence, at, open_, kept))
            at += n
    return out


_NAMES = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open", "ids"]
_TYPES = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _counter(first: int) -> Iterator[int]:
    while True:
        yield first
        first += 1


def packed(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    end: int = 1,
    size: int = SIZE,
    most: int = OPEN_WINDOWS,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece of a document: ``key``, ``start`` in the document, ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, and ``ids`` as
    little-endian unsigned 32-bit integers (only ``with_ids``).

    Ids come from the byte-level vocabulary file ``path`` through the tokenizers library; every
    document ends with ``end``. Null and empty texts are that id alone. Repeated rows are packed
    like any other; an empty table gives no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = library(path, spaced=True)
        last = np.array([end], "<u4").tobytes()
        ids_of = _counter(TaskContext.get().partitionId() << 32)
        packer = Packer(size, most)
        for batch in slices(batches, "text", 1_000_000):
            for k, raw in zip(batch.column("key").to_pylist(), chunks.encode(texts(batch))):
                raw = memoryview(raw + last)
                packer.place((k, 0, raw, len(raw) // ID))
            yield _batch(_rows(packer.done, ids_of, with_ids, False))
            packer.done = []
        packer.pour()
        yield _batch(_rows(packer.done, ids_of, with_ids, False))
        yield _batch(_rows([w for *_, w in packer.open], ids_of, with_ids, True))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(size, len(rows) + 1)
        numbers = sorted(rows["sequence_id"].unique())
        for _, some in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            window = Window()
            for r in some.itertuples():
                k = None if pd.isna(r.key) else int(r.key)
                window.add((k, int(r.start), r.ids, int(r.doc_tokens)))
            packer._file(window)
        packer.pour()
        ids_of = iter(numbers)  # never more windows than before
        done = _rows(packer.done, ids_of, True, False)
        return pd.DataFrame(done + _rows([w for *_, w in packer.open], ids_of, True, True), columns=_NAMES).astype(
            {"key": "Int64"}
        )

    schema = f"{PIECE}, open boolean, ids binary"
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    first = stage(rows.mapInArrow(run, schema), "packed")
    out, left = first.where("NOT open"), first.where("open")
    partition = F.shiftright("sequence_id", 32)
    for group in (F.floor(partition / FAN_IN), F.floor(partition / FAN_IN**2), F.lit(0)):
        # at most one open window for each group is left, the first of the sequence ids names it
        left = stage(left.groupBy(group.alias("g")).applyInPandas(merge, schema), "packed")
        out, left = out.unionByName(left.where("NOT open")), left.where("open")
    out = out.unionByName(left)
    return out.drop("open") if with_ids else out.drop("open", "ids")
