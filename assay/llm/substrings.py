"""Passages that repeat across documents, by relative Lempel-Ziv parsing.

Every document is factored against the documents with a smaller key. The reference blocks are
segments: runs of windows of ``WINDOW`` words that have the same anchor, which is the smallest
hash of a window's ``GRAM``-word sequences. Equal windows have equal anchors wherever they
stand, so a window can only be found in segments of its own anchor.

A document's text is taken segment by segment. A segment that stands as a whole in a smaller
document is a factor at once. The others hold the boundaries of factors: their windows are
looked up one by one in the index of all segments with the same anchor, so that a window that
begins in one factor and ends in the next is found like any other. Factors of at least one
window are duplicate spans; adjoining ones run together.

Segments and windows are keyed by two 64-bit hashes each, the anchor and their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import release, slices, texts
from assay.sources.tables import stage

WINDOW = 50
#: Words of the sequences anchors are taken from.
GRAM = 10
#: Odd multipliers of the window and sequence hashes: fixed values.
WINDOW_BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM_BASE = np.uint64(0xC2B2AE3D27D4EB4F)

WORD = re.compile("[^\x20\x09-\x0d]+")


class Words:
    """Hashes of words, kept while there is room."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > self.most:
            known.clear()
        return out


def _powers(hashes: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of every ``n`` consecutive words, mixed so that all bits count."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out *= base
            out += hashes[k : k + size]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every ``n`` consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


class Parsed:
    """The documents of a batch as one sequence of words."""

    def __init__(self, docs: list[str], words: Words):
        # surrogates can not occur in a table's strings
        split = [d.encode("utf-8").split() for d in docs]
        self.words = split
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.starts = np.cumsum(self.sizes) - self.sizes
        parts = [words.of(s) for s in split]
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and document of every window that lies in one document."""
        n = np.maximum(self.sizes - WINDOW + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        return self.starts[doc] + at, doc

    def anchors(self, first: np.ndarray) -> np.ndarray:
        grams = _powers(self.hashes, GRAM, GRAM_BASE)
        return _least(grams, WINDOW - GRAM + 1)[first]

    def segments(self) -> tuple[np.ndarray, ...]:
        """Anchor, hash, document, first window and number of windows of every segment."""
        first, doc = self.windows()
        if not len(first):
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
        anchor = self.anchors(first)
        own = _powers(self.hashes, WINDOW, WINDOW_BASE)[first]
        new = np.ones(len(first), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(first)))
        nth = np.arange(len(first)) - np.repeat(at, size)
        with np.errstate(over="ignore"):
            turned = own * (np.uint64(2) * nth.astype(np.uint64) + np.uint64(1))
            turned ^= turned >> np.uint64(29)
            turned *= np.uint64(0xBF58476D1CE4E5B9)
            total = np.add.reduceat(turned, at) + size.astype(np.uint64)
        return anchor[at], total, doc[at], first[at] - self.starts[doc[at]], size


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    words = Words()
    for batch in slices(batches, "text"):
        anchor, own, doc, at, size = Parsed(texts(batch), words).segments()
        who = pa.array(doc)
        columns = [_long(anchor), _long(own), batch.column("key").take(who), batch.column("class").take(who)]
        yield pa.RecordBatch.from_arrays(
            [*columns, _long(at), _long(size)], ["anchor", "segment", "key", "class", "at", "size"]
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the segments that are asked for: ``asked`` lists (anchor, segment, at, size)."""
    release()
    words = Words()
    for batch in slices(batches, "text"):
        parsed = Parsed(texts(batch), words)
        own = _powers(parsed.hashes, WINDOW, WINDOW_BASE)
        asked = batch.column("asked")
        flat = asked.flatten()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
        field = lambda name: flat.field(name).to_numpy()
        size = field("size")
        each = np.repeat(np.arange(len(size)), size)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
        window = own[(parsed.starts[doc] + field("at"))[each] + nth]
        yield pa.RecordBatch.from_arrays(
            [
                _long(field("anchor")[each]),
                _long(field("segment")[each]),
                _long(window),
                _long(nth),
                batch.column("key").take(pa.array(doc[each])),
            ],
            ["anchor", "segment", "window", "nth", "key"],
        )


def found_factors(docs: DataFrame) -> DataFrame:
    """``(key, class, factors)`` of the documents ``(key, class, text)`` that have any; factors
    are ``(at, size)``: first window and number of windows."""
    known = docs.where("key IS NOT NULL")
    segments = stage(
        known.mapInArrow(
            _segments, "anchor long, segment long, key long, class long, at long, size long"
        ),
        "segments",
    )
    # the smallest place of every segment
    least = segments.groupBy("anchor", "segment").agg(F.min(F.struct("key", "class", "at", "size")).alias("least"))
    least = stage(least.select("anchor", "segment", "least.*"), "least")
    # anchors with more than one segment: only there can single windows be shared
    several = least.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    asked = least.join(several, "anchor").groupBy("key", "class").agg(
        F.collect_list(F.struct("anchor", "segment", "at", "size")).alias("asked")
    )
    # a repeated row gives its windows again, which changes neither minima nor spans
    windows = stage(
        known.join(asked, ["key", "class"])
        .select("key", "text", "asked")
        .mapInArrow(_windows, "anchor long, segment long, window long, nth long, key long"),
        "windows",
    )
    # windows of one document only are settled here; the table of the others is stored, so that
    # a passage with very many surroundings, one key of the join, can be split
    index = windows.groupBy("anchor", "window").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"))
    index = stage(index.where("smallest < largest").drop("largest"), "shared-windows")
    shared = (
        windows.join(index, ["anchor", "window"])
        .where("smallest < key")
        .groupBy("anchor", "segment")
        .agg(F.collect_list("nth").alias("shared"))
    )
    # a segment that a smaller document has goes as a whole, of the others what is shared
    origin = least.select("anchor", "segment", F.col("key").alias("least")).join(shared, ["anchor", "segment"], "left")
    one = F.lit(1).cast("long")
    single = F.transform("shared", lambda n: F.struct((F.col("at") + n).alias("at"), one.alias("size")))
    some = F.when(F.col("key") > F.col("least"), F.array(F.struct("at", "size"))).otherwise(single)
    return (
        segments.join(origin, ["anchor", "segment"])
        .where("key > least OR shared IS NOT NULL")
        .select("key", "class", some.alias("some"))
        .groupBy("key", "class")
        .agg(F.flatten(F.collect_list("some")).alias("factors"))
    )


def _kept(text: str, gone: np.ndarray) -> str:
    """The text without the words that are marked; what stands between kept words stays."""
    out, last = [], 0
    ends = [(m.start(), m.end()) for m in WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(text[last : ends[a][0]])
        last = ends[b][0] if b < len(ends) else len(text)
    out.append(text[last:])
    return "".join(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        counts, removed, sums, kept = [], [], [], []
        for text, factors in zip(batch.column("text").to_pylist(), batch.column("factors").to_pylist()):
            words = (text or "").encode("utf-8").split()
            n = 0
            if factors:
                steps = np.zeros(len(words) + 1, np.int64)
                for f in factors:
                    steps[f["at"]] += 1
                    steps[f["at"] + f["size"] + WINDOW - 1] -= 1
                gone = np.cumsum(steps)[:-1] > 0
                n = int(gone.sum())
                text = _kept(text, gone)
                words = text.encode("utf-8").split()
            counts.append(len(words) + n)
            removed.append(n)
            sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                pa.array(kept, pa.string()),
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(sums, pa.string()),
                batch.column("rest"),
            ],
            ["key", "text", "n_words", "n_removed", "kept_sha256", "rest"],
        )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, n_words, n_removed, kept_sha256, rest)`` of every row: ``text`` without the
    words of passages that begin in a document with a smaller key, and ``rest``, a struct of the
    row's other columns.

    ``kept_sha256`` is over the kept words joined by one space. Windows are judged on the input.
    Null texts stay null and have no words. Rows with a null key are no reference and keep all
    words. Rows that repeat a key are one document: they do not remove each other's words.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (key, text)] or [F.lit(None).alias("none")]
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(text)).alias("class"),
        F.struct(*others).alias("rest"),
    )
    found = found_factors(rows.select("key", "class", "text"))
    joined = rows.join(found, ["key", "class"], "left").select("key", "text", "factors", "rest")
    rest = joined.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(
        _cut,
        f"key long, text string, n_words long, n_removed long, kept_sha256 string, rest {rest}",
    )
