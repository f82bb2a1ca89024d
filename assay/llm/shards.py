"""Binary shards of token ids with keyed access.

A shard holds the ids of documents in ascending order of their keys, as raw little-endian
integers of two or four bytes. Its index is a minimal perfect hash: keys that are alone at
their bit of a level are placed there, the others go on to the next level, and the number of
bits set before a key's bit is its slot. A slot holds a fingerprint of the key and its first
row, so a key that is not in the shard is noticed without the keys being stored in the index.

Layout: ``HEADER``, level sizes, level bits, rank of every block of bits, slots, keys and null
flags of the rows, token offsets of the rows, ids.

Shards get a name of their own in every attempt of a task and count only if the manifest, which
Spark commits, lists them. What failed or speculative attempts wrote is never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import slices, texts
from assay.llm.tokens import library
from assay.sources.tables import stage

MAGIC = b"ASSAYID1"
#: magic, bytes of an id, rows, tokens, keys, levels.
HEADER = "<8sIQQQI"
#: Bits of a level for each key that reaches it.
ROOM = 2.0
RANK_BITS = 512
#: Bytes of ids after which a shard is closed.
SHARD_BYTES = 32 << 20


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well mixed 64-bit hash of whole numbers."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """Levels of bits, one after the other, with the number of ones before each block."""

    sizes: np.ndarray
    bits: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct keys."""
        sizes, levels = [], []
        left = keys
        while len(left):
            size = -(-int(len(left) * ROOM + 1) // 64) * 64
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        flat = np.concatenate([flat, np.zeros(-len(flat) % RANK_BITS, bool)])
        ones = flat.reshape(-1, RANK_BITS).sum(axis=1)
        return cls(np.array(sizes, np.uint64), np.packbits(flat, bitorder="little"), np.cumsum(ones) - ones)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 for a key that no level holds."""
        out = np.full(len(keys), -1, np.int64)
        live, begin = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = (mix(keys[live], level) % np.uint64(size)).astype(np.int64) + begin
            here = (self.bits[at >> 3] >> (at & 7)) & 1 == 1
            found = at[here]
            block = found // RANK_BITS
            words = self.bits.reshape(-1, RANK_BITS // 8)[block]
            inside = np.unpackbits(words, axis=1, bitorder="little")
            before = (inside * (np.arange(RANK_BITS) < (found % RANK_BITS)[:, None])).sum(axis=1)
            out[live[here]] = self.ranks[block].astype(np.int64) + before
            live = live[~here]
            begin += size
        return out


def write_shard(stream, keys: list[int | None], ids: list[np.ndarray], width: int) -> None:
    """Rows must come in ascending order of their keys; those with a null key are not indexed."""
    null = np.array([k is None for k in keys], np.uint8)
    plain = np.array([k or 0 for k in keys], np.int64)
    there = np.flatnonzero(null == 0)
    distinct, first = np.unique(plain[there], return_index=True)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    prints, rows = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slots], rows[slots] = fingerprints(distinct), there[first]
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype("<u8")
    head = struct.pack(HEADER, MAGIC, width, len(keys), int(offsets[-1]), len(distinct), len(index.sizes))
    for part in (head, index.sizes.astype("<u8"), index.bits, index.ranks.astype("<u8"), prints, rows, plain.astype("<i8"), null, offsets):
        stream.write(part if isinstance(part, bytes) else part.tobytes())
    for i in ids:
        stream.write(i.astype(f"<u{width}").tobytes())


class Shard:
    """A shard opened for reading: its index is loaded, ids are read where they are wanted."""

    def __init__(self, path: str):
        system, name = arrow_fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        magic, self.width, self.n, self.tokens, n_keys, levels = struct.unpack(HEADER, self.file.read(struct.calcsize(HEADER)))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard of ids")
        read = lambda kind, n: np.frombuffer(self.file.read(np.dtype(kind).itemsize * n), kind)
        sizes = read("<u8", levels)
        total = -(-int(sizes.sum()) // RANK_BITS) * RANK_BITS
        self.index = PerfectHash(sizes, read("u1", total // 8), read("<u8", total // RANK_BITS))
        self.prints, self.rows = read("<u4", n_keys), read("<u4", n_keys)
        self.keys, self.null = read("<i8", self.n), read("u1", self.n).astype(bool)
        self.offsets = read("<u8", self.n + 1).astype(np.int64)
        self.payload = self.file.tell()

    def first_rows(self, keys: np.ndarray) -> np.ndarray:
        """The first row of every key, -1 where the shard has no such key."""
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64)
        slots = self.index.slots(keys)
        right = (slots >= 0) & (self.prints[slots] == fingerprints(keys))
        return np.where(right, self.rows[slots].astype(np.int64), -1)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids of the shard from one position to another."""
        self.file.seek(self.payload + begin * self.width)
        return np.frombuffer(self.file.read((end - begin) * self.width), f"<u{self.width}")

    def of(self, key: int) -> list[np.ndarray]:
        """The ids of every row with a key."""
        row = int(self.first_rows(np.array([key], np.int64))[0])
        out = []
        while 0 <= row < self.n and self.keys[row] == key and not self.null[row]:
            out.append(self.ids(*self.offsets[row : row + 2].tolist()))
            row += 1
        return out


MANIFEST = "task long, nth long, path string, n_docs long, n_tokens long, least long, greatest long"


def write_shards(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end: int = 1) -> DataFrame:
    """Writes all rows as shards below ``folder`` and gives the manifest, one row for a shard:
    task and number give the order of the shards, ``start`` the ids in all shards before.

    Ids come from the vocabulary file ``path`` through the tokenizers library; every row ends
    with ``end``. Null and empty texts are that id alone. Null keys come first and have no
    entry in an index. Repeated keys stand side by side. Rows of one key may be split over
    tasks. An empty table gives an empty manifest.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    greatest = max([end, *file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])])
    width = 2 if greatest < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunks = TaskContext.get().partitionId(), library(path, spaced=False)
        last = np.array([end], "<u4").tobytes()
        system, root = arrow_fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        keys: list = []
        ids: list = []
        listed: list[tuple] = []

        def close() -> None:
            name = f"{task:06d}-{len(listed):04d}-{uuid.uuid4().hex}.ids"
            with system.open_output_stream(f"{root}/{name}") as stream:
                write_shard(stream, keys, ids, width)
            real = [k for k in keys if k is not None]
            listed.append(
                (task, len(listed), f"{folder}/{name}", len(keys), sum(map(len, ids)), min(real, default=None), max(real, default=None))
            )
            keys.clear()
            ids.clear()

        size = 0
        for batch in slices(batches, "text", 1_000_000):
            for k, raw in zip(batch.column("key").to_pylist(), chunks.encode(texts(batch))):
                if size >= SHARD_BYTES:
                    close()
                    size = 0
                keys.append(k)
                ids.append(np.frombuffer(raw + last, "<u4").astype(f"<u{width}"))
                size += len(ids[-1]) * width
        if keys:
            close()
        columns = list(zip(*listed)) if listed else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * 4
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the last column deals out rows that repeat a key
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("nth")
    )
    ordered = rows.repartitionByRange(parts, "key", "nth").sortWithinPartitions("key", "nth").select("key", "text")
    manifest = stage(ordered.mapInArrow(run, MANIFEST), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("task", "nth").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every row in the shards, found through the index
    of its shard where it has a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(path)
                there = np.flatnonzero(~shard.null)
                rows = np.arange(shard.n)
                # an indexed row is its key's first row plus its place among the key's rows
                first = shard.first_rows(shard.keys[there])
                if (first < 0).any():
                    raise ValueError(f"{path}: a key is not in the index")
                new = np.ones(len(there), bool)
                new[1:] = shard.keys[there][1:] != shard.keys[there][:-1]
                begin = np.flatnonzero(new)
                rows[there] = first + np.arange(len(there)) - np.repeat(begin, np.diff(np.append(begin, len(there))))
                # documents in the order of the file, some at a time, so that reads are large
                for i in range(0, shard.n, 1024):
                    some = rows[i : i + 1024]
                    low, high = int(shard.offsets[some.min()]), int(shard.offsets[some.max() + 1])
                    ids = shard.ids(low, high).astype("<u4")
                    begins, ends = shard.offsets[some], shard.offsets[some + 1]
                    sums = [zlib.crc32(ids[a - low : b - low].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.keys[i : i + 1024], mask=shard.null[i : i + 1024]),
                            pa.array(begins + start),
                            pa.array(ends - begins),
                            pa.array(sums, pa.int64()),
                        ],
                        ["key", "start", "n_tokens", "ids_crc32"],
                    )

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = manifest.select("path", "start").repartition(parts, "path")
    return rows.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")
