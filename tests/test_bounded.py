"""What a worker holds beside a batch does not grow with the batch."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from assay.operators import compound
from suite.compound_files import front
from suite.content_queries import write_library


class _Given:
    """Takes the place of a table: keeps the function that is mapped over its batches."""

    def where(self, *_):
        return self

    select = repartition = where
    sparkSession = property(lambda self: self)
    sparkContext = property(lambda self: self)
    defaultParallelism = 1

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def _held(run, batch: pa.RecordBatch) -> tuple[list[pa.RecordBatch], int]:
    """What a function gives for a batch, and the most Python bytes it held meanwhile."""
    tracemalloc.start()
    try:
        return list(run(iter([batch]))), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_streams_are_listed_where_the_payloads_lie(spark):
    payload = front() + bytes(100_000)
    contents = [payload, b"", payload[:512], *[payload] * 397]
    batch = pa.record_batch({"path": [None, *map(str, range(1, 400))], "content": contents})
    out, held = _held(compound.streams(_Given()).run, batch)
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows[:4] == [
        (None, "WordDocument", 0, None), (None, "ObjectPool/Contents", 7, None),
        ("1", None, None, "OLE header is cut off"), ("2", None, None, "an OLE sector lies outside the file"),
    ]
    assert len(rows) == 2 * 398 + 2 and len(out) == 2
    assert held < 2_000_000 < batch.nbytes / 10


def test_a_library_is_written_some_texts_at_a_time(tmp_path):
    texts = [chr(97 + i % 26) * 50_000 for i in range(1000)]
    batch = pa.record_batch({"doc_id": list(range(1000)), "source": ["a", "b"] * 500, "text": texts})
    del texts
    out, held = _held(write_library(_Given(), str(tmp_path)).run, batch)
    assert [b.to_pydict() for b in out] == [{"files": [1000]}]
    assert len(list(tmp_path.glob("*/*"))) == 1000
    assert (tmp_path / "b" / "d9.txt").read_bytes() == b"j" * 50_000 + bytes(64)
    assert held < batch.nbytes / 5
