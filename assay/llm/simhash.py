"""SimHash near-duplicates: fingerprints that differ in few bits, found part by part.

Fingerprints are made from word shingles. Equal fingerprints are one class from the start. The
search for links follows the generalised pigeonhole principle: the 64 bits are grouped into
parts of 16, correlated bits together, and every fingerprint gets a threshold ``t`` for each
part so that the sum of ``t + 1`` over the parts is the largest distance plus one. Whoever
links with it differs by at most ``t`` bits in at least one part (-1: the part is not used).
Thresholds come from dynamic programming over the estimated number of candidates, which is
known from a count of every part's values: 4 x 65,536 numbers, whatever the input.

Candidates meet in buckets (part, value). A bucket is cut into blocks of fixed size, and a block
reports what it links by chains, never by all pairs, so groups of copies cost few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import groups as grouped
from assay.llm.common import merged, release, slices, texts
from assay.llm.components import components
from assay.sources.tables import stage

BITS, PART = 64, 16
PARTS = BITS // PART
VALUES = 1 << PART
#: Fingerprints of a bucket that one block indexes.
BLOCK = 4096
SEED = 42


def fingerprint(text: str, words: int = 3) -> int:
    """The fingerprint of one text; 0 when it has no word."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(size)
    joined = b" ".join(found)
    first = (ends - size)[:n].tolist()
    last = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    make = xxhash.xxh64_intdigest
    hashes = np.fromiter((make(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        block = hashes[i : i + 65536].astype("<u8").view(np.uint8)
        ones += np.unpackbits(block.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """``(key, class, fp)``: a hash of the text, which equal texts share, and the fingerprint's
    64 bits as a signed long. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            fp = np.fromiter((fingerprint(t, words) for t in texts(batch)), np.uint64, batch.num_rows)
            columns = [batch.column("key"), batch.column("class"), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "class", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_class(text).alias("class"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, class long, fp long")


def text_class(text: str) -> Column:
    """A hash that equal texts share; null is a text of its own."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(prints: DataFrame) -> list[list[int]]:
    """The bits of each part. Groups are grown from the bit that is left with the strongest
    correlations, by the bit that correlates most with the group. Counted over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for rows in batches:
            bits = _bits(rows["fp"].to_numpy().view(np.uint64)).astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
            n += len(rows)
        yield pd.DataFrame({"at": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n)})

    sums = prints.select("fp").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS + 1)
    for row in sums.collect():  # 4097 numbers
        both[row["at"]] = row["n"]
    n = max(both[-1], 1.0)
    share = both[:-1].reshape(BITS, BITS) / n
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0.0)
    left, groups = list(range(BITS)), []
    while left:
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < PART:
            group.append(max(left, key=lambda b: (tie[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def part_values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The value of every part, one column each."""
    out = np.zeros((len(fp), len(groups)), np.int64)
    for p, group in enumerate(groups):
        for k, bit in enumerate(group):
            out[:, p] |= (((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)) << k
    return out


def value_counts(prints: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """How many rows have each value of each part: an array of fixed size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(PARTS * VALUES, np.int64)
        for rows in batches:
            values = part_values(rows["fp"].to_numpy().view(np.uint64), groups)
            total += np.bincount((values + np.arange(PARTS) * VALUES).ravel(), minlength=PARTS * VALUES)
        there = np.flatnonzero(total)
        yield pd.DataFrame({"at": there, "n": total[there]})

    sums = prints.select("fp").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    rows = sums.toPandas()  # at most 4 x 65,536 rows
    counts = np.zeros(PARTS * VALUES, np.int64)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return counts.reshape(PARTS, VALUES)


def flips(most: int) -> list[np.ndarray]:
    """Masks of a part with exactly 0, 1, ... bits set, up to ``most``."""
    masks = np.arange(VALUES)
    ones = np.bitwise_count(masks.astype(np.uint32))
    return [masks[ones == k] for k in range(most + 1)]


def estimates(counts: np.ndarray, most: int) -> np.ndarray:
    """``[part, t, value]``: candidates and probes within ``t`` bits of a value, ``t`` from -1."""
    parts, values = counts.shape
    out = np.zeros((parts, most + 2, values))
    for p in range(parts):
        for t, masks in enumerate(flips(most), start=1):
            ring = np.zeros(values)
            every = np.arange(values)
            for mask in masks:
                ring += counts[p][every ^ mask]
            out[p, t] = out[p, t - 1] + ring + len(masks)
    return out


def thresholds(values: np.ndarray, cost: np.ndarray, most: int) -> np.ndarray:
    """The cheapest thresholds for every row, by dynamic programming over parts and budget."""
    n, parts = values.shape
    best = np.full((n, most + 2), np.inf)
    best[:, 0] = 0.0
    chosen = []
    for p in range(parts):
        mine = cost[p][:, values[:, p]].T  # rows x (t + 1)
        now, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
        for budget in range(most + 2):
            for spent in range(budget + 1):
                total = best[:, budget - spent] + mine[:, spent]
                better = total < now[:, budget]
                now[better, budget], pick[better, budget] = total[better], spent
        best = now
        chosen.append(pick)
    out, budget, rows = np.zeros((n, parts), np.int64), np.full(n, most + 1), np.arange(n)
    for p in reversed(range(parts)):
        out[:, p] = chosen[p][rows, budget] - 1
        budget -= out[:, p] + 1
    return out


def chains(fp: np.ndarray, probes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever is joined by the pairs of a block: every probe is compared with
    every fingerprint, but each of them is linked once at most."""
    labels = np.arange(len(fp))
    starts, ends = [], []
    for i in range(0, len(probes), 256):
        some = probes[i : i + 256]
        near = np.bitwise_count(some[:, None] ^ fp[None, :]) <= most
        reached = near.any(axis=1)
        first = near.argmax(axis=1)
        starts.append(some[reached])
        ends.append(fp[first[reached]])
        row, col = np.nonzero(near)
        labels = merged(labels, first[row], col)
    moved = labels != np.arange(len(fp))
    starts.append(fp[moved])
    ends.append(fp[labels[moved]])
    return np.concatenate(starts), np.concatenate(ends)


def links(prints: DataFrame, most: int = 3, light: int = 64) -> DataFrame:
    """``(a, b)`` of distinct fingerprints that join all that differ by ``most`` bits at most.

    Values that more than ``light`` fingerprints share go to blocks, where every pair is
    compared and chains are reported; the others are joined as rows.
    """
    groups = bit_groups(prints)
    counts = value_counts(prints, groups)
    cost = estimates(counts, most)
    rings = flips(most)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), 4096):
                fp = rows["fp"].to_numpy()[i : i + 4096].view(np.uint64)
                values = part_values(fp, groups)
                spent = thresholds(values, cost, most)
                for p in range(PARTS):
                    v = values[:, p]
                    out = [(np.zeros(len(fp), bool), v, fp)]
                    for t, masks in enumerate(rings):
                        some = spent[:, p] >= t
                        to = (v[some][:, None] ^ masks[None, :]).ravel()
                        who = np.repeat(fp[some], len(masks))
                        # an empty value has no partner, nor has one that only its owner has
                        use = counts[p][to] > (1 if t == 0 else 0)
                        out.append((np.ones(use.sum(), bool), to[use], who[use]))
                    probe, value, who = (np.concatenate(x) for x in zip(*out))
                    # a heavy value is cut into blocks by probes and by what they are compared
                    # with; a row is in one block of its own side and all of the other's
                    blocks = np.maximum(-(-counts[p][value] // BLOCK), 1)
                    heavy = counts[p][value] > light
                    times = np.where(heavy, blocks, 1)
                    own = (who % blocks.astype(np.uint64)).astype(np.int64)
                    at = np.repeat(np.arange(len(value)), times)
                    nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    block = np.where(probe[at], nth * blocks[at] + own[at], own[at] * blocks[at] + nth)
                    block[~heavy[at]] = -1
                    yield pd.DataFrame(
                        {
                            "part": np.full(len(at), p, np.int32),
                            "value": value[at],
                            "block": block,
                            "probe": probe[at],
                            "fp": who[at].view(np.int64),
                        }
                    )

    dealt = prints.select("fp").mapInPandas(deal, "part int, value long, block long, probe boolean, fp long")
    index = dealt.where("block < 0 AND NOT probe").select("part", "value", F.col("fp").alias("a"))
    probes = dealt.where("block < 0 AND probe").select("part", "value", F.col("fp").alias("b"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most) & (F.col("a") != F.col("b"))
    same = (index["part"] == probes["part"]) & (index["value"] == probes["value"])
    single = index.join(probes, same & near).select("a", "b")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["part", "value", "block"]):
            probe = rows.column("probe").to_numpy(zero_copy_only=False).astype(bool)
            fp = rows.column("fp").to_numpy().view(np.uint64)
            a, b = chains(fp[~probe], fp[probe], most) if probe.any() and not probe.all() else (fp[:0], fp[:0])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keys = ["part", "value", "block"]
    shared = dealt.where("block >= 0").repartition(*keys).sortWithinPartitions(*keys)
    return single.unionByName(shared.mapInArrow(blocks, "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """``(key, fp, component)`` of every row: its fingerprint and the smallest key of all rows it
    is linked with, directly or through others.

    Null and empty texts have the fingerprint 0 and link like any other. Null keys are never the
    smallest of a group with another key; rows with a null key alone have a null component.
    Repeated rows are repeated. An empty table gives an empty table.
    """
    prints, by_print = grouped_prints(docs, key, text, words, most)
    least = by_print.groupBy("group").agg(F.min("least").alias("component"))
    by_print = by_print.select("fp", "group").join(least, "group").select("fp", "component")
    return prints.select("key", "fp").join(by_print, "fp").select("key", "fp", "component")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """``(key, class, n)``: for each group of near duplicates the key and the ``text_class`` of
    the text that stays, and how many rows have both.

    The smallest key stays, a null key only where there is no other; of several texts with that
    key the one with the smallest class. A key that has texts in several groups can stay in each.
    """
    prints, by_print = grouped_prints(docs, key, text, words, most)
    first = by_print.groupBy("group").agg(F.min("first").alias("first")).select("first.key", "first.class")
    rows = prints.groupBy(F.col("key").alias("k"), F.col("class").alias("c")).agg(F.count("*").alias("n")).where("n > 1")
    found = first.join(rows, F.col("key").eqNullSafe(F.col("k")) & (F.col("class") == F.col("c")), "left")
    return found.select("key", "class", F.coalesce("n", F.lit(1)).alias("n"))


def grouped_prints(docs: DataFrame, key: str, text: str, words: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Every row's ``(key, class, fp)`` and every fingerprint's ``(fp, group, least, first)``:
    the smallest fingerprint of its group, its own smallest key, and with that key the smallest
    class, null keys last."""
    prints = stage(with_fingerprint(docs, key, text, words), "fingerprints")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "class")).alias("first")
    least = stage(prints.groupBy("fp").agg(F.min("key").alias("least"), first), "fingerprint-classes")
    found = components(links(least, most))
    # components name the smallest fingerprint; the smallest key is wanted
    named = least.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return prints, named.select("fp", F.coalesce("component", "fp").alias("group"), "least", "first")
