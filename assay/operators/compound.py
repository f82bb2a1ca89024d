"""Streams of compound office files, listed from their directory.

A compound file is a chain of sectors per stream, kept in an allocation table whose own sectors
a list in the header names. A walk reads the directory's sectors and the table entries on
its way, whatever the size of the file. What it finds are rows; joins decide what is missing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the public format: sector numbers from here on are marks, entries of a
# directory have a fixed size, the header lists the first sectors of the table.
LAST_SECTOR = 0xFFFFFFFA
ENTRY_BYTES = 128
HEADER_LIST, HEADER_LISTED = 76, 109
STORAGE, STREAM, ROOT = 1, 2, 5
#: Payloads whose streams are held at a time.
SOME = 256
_FOUND = pa.schema([("path", pa.string()), ("stream", pa.string()), ("size", pa.int64()), ("error", pa.string())])


class Broken(ValueError):
    """The structure of a compound file can not be followed."""


class _Sectors:
    """Sectors of a file and what follows each, read one at a time."""

    def __init__(self, f: BinaryIO):
        self._f = f
        self._size = f.seek(0, 2)
        f.seek(0)
        self.head = f.read(512)
        if len(self.head) < 512:
            raise Broken("OLE header is cut off")
        shift = struct.unpack_from("<H", self.head, 30)[0]
        if shift not in (9, 12):
            raise Broken("OLE sector size is unknown")
        self.bytes = 1 << shift
        self.count = max(0, -(-self._size // self.bytes) - 1)
        self._more: list[int] = []  # sectors that go on with the list of the header
        self._table: tuple[int, bytes] = (-1, b"")

    def read(self, number: int) -> bytes:
        if number >= min(self.count, LAST_SECTOR):
            raise Broken("an OLE sector lies outside the file")
        self._f.seek((number + 1) * self.bytes)
        found = self._f.read(self.bytes)
        if len(found) < self.bytes:
            raise Broken("an OLE sector is cut off")
        return found

    def _table_sector(self, nth: int) -> int:
        if nth < HEADER_LISTED:
            return struct.unpack_from("<I", self.head, HEADER_LIST + 4 * nth)[0]
        each = self.bytes // 4 - 1
        part, at = divmod(nth - HEADER_LISTED, each)
        while len(self._more) <= part:
            last = self._more[-1] if self._more else None
            follows = struct.unpack_from("<I", self.head, 68) if last is None else struct.unpack("<I", self.read(last)[-4:])
            self._more.append(follows[0])
        return struct.unpack_from("<I", self.read(self._more[part]), 4 * at)[0]

    def after(self, number: int) -> int:
        nth, at = divmod(number, self.bytes // 4)
        if self._table[0] != nth:
            self._table = nth, self.read(self._table_sector(nth))
        return struct.unpack_from("<I", self._table[1], 4 * at)[0]

    def chain(self, first: int) -> Iterator[bytes]:
        """The sectors from one on, each once."""
        number, seen = first, set()
        while number < LAST_SECTOR:
            if number in seen:
                raise Broken("an OLE chain goes in circles")
            seen.add(number)
            yield self.read(number)
            number = self.after(number)


def listed(f: BinaryIO) -> list[tuple[str, int]]:
    """``(name, size)`` of all streams, names with those of the storages they lie in."""
    sectors = _Sectors(f)
    entries = []
    for sector in sectors.chain(struct.unpack_from("<I", sectors.head, 48)[0]):
        entries += [sector[i : i + ENTRY_BYTES] for i in range(0, sectors.bytes, ENTRY_BYTES)]
    if not entries or entries[0][66] != ROOT:
        raise Broken("OLE directory has no root")
    # sizes are of 64 bits in files with large sectors only
    size_of = "<Q" if sectors.bytes > 512 else "<I"
    out, seen = [], {0}
    todo = [("", struct.unpack_from("<I", entries[0], 76)[0])]
    while todo:
        parent, at = todo.pop()
        if at >= LAST_SECTOR:
            continue
        if at >= len(entries) or at in seen:
            raise Broken("OLE directory entries do not form a tree")
        seen.add(at)
        entry = entries[at]
        length, kind = struct.unpack_from("<HB", entry, 64)
        left, right, child = struct.unpack_from("<III", entry, 68)
        name = parent + entry[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
        todo += [(parent, left), (parent, right)]
        if kind == STREAM:
            out.append((name, struct.unpack_from(size_of, entry, 120)[0]))
        elif kind == STORAGE:
            todo.append((name + "/", child))
        else:
            raise Broken("OLE directory entries do not form a tree")
    return out


def streams(payloads: DataFrame) -> DataFrame:
    """``(path, stream, size, error)`` from ``(path, content)``: a row per stream, and one with an
    error alone where the structure is broken. Null content gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # contents are read where they lie; a few at a time, so that what is found stays small
            for start in range(0, batch.num_rows, SOME):
                rows = []
                for path, content in zip(*batch.slice(start, SOME).columns):
                    path = path.as_py()
                    try:
                        rows += [(path, name, size, None) for name, size in listed(pa.BufferReader(content.as_buffer()))]
                    except Broken as e:
                        rows.append((path, None, None, str(e)))
                columns = zip(_FOUND, zip(*rows)) if rows else ((f, []) for f in _FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in columns], schema=_FOUND)

    return payloads.where(F.col("content").isNotNull()).select("path", "content").mapInArrow(
        run, "path string, stream string, size long, error string"
    )


def lacking(payloads: DataFrame, found: DataFrame, required: DataFrame) -> DataFrame:
    """``(path, stream)`` that ``required(ext, stream)`` demands of ``payloads(path, ext)`` and that
    ``found(path, stream)`` does not have. The table of what is required has a row per format."""
    due = payloads.select("path", "ext").join(required, "ext").select("path", "stream")
    return due.join(found.where(F.col("stream").isNotNull()), ["path", "stream"], "left_anti")
