"""Encoding and decoding of whole texts with the tokenization automaton of ``bpe``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import slices, texts
from assay.llm.tokens import automaton


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` of every row: the ids of its text. Null and empty texts have none.

    Special strings of the vocabulary in a text become their ids. Repeated rows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, _ = automaton(path)
        for batch in slices(batches, "text", 1_000_000):
            raw = chunks.encode(texts(batch))
            ends = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
            ids = np.frombuffer(b"".join(raw), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], ["key", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, ids array<int>")


def decoded(rows: DataFrame, path: str, key: str = "key", ids: str = "ids") -> DataFrame:
    """``(key, text)`` of every row of ids; bytes that are no UTF-8 become replacement
    characters. Null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = automaton(path)[1].automaton
        for batch in batches:
            out = [
                table.decode(np.array(i or [], np.int64))[0].decode("utf-8", "replace")
                for i in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string())], ["key", "text"])

    rows = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` of every row: its text encoded and what
    the ids decode to, without ids or texts leaving the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, encoder = automaton(path)
        for batch in slices(batches, "text", 1_000_000):
            raw = chunks.encode(texts(batch))
            n = np.array([len(r) // 4 for r in raw], np.int64)
            joined, ends = encoder.automaton.decode(np.frombuffer(b"".join(raw), "<u4").astype(np.int64))
            ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])].tolist()
            back = (joined[a:b].decode("utf-8", "replace").encode("utf-8") for a, b in zip(ends, ends[1:]))
            digest = lambda some: pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n), digest(raw), digest(back)],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string")
