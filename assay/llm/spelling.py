"""Spelling variants: words one edit apart, by a frontier of states walking a trie as joins.

The trie is a table of edges ``(node, step, child)``, a node being the hash of a prefix and an
edge the code point that follows, or the end of a word. An edge knows how many words pass it,
which one if only one does, and a signature of the hashes of everything that follows it.

A state is ``(word, position, node, edits)``; the position is held as the hash of what is left
of the word. States without edit are a word's own prefixes. Where the trie branches, they take
one edit: another step in place of the next code point, another step before it, or the step
after next. The states with one edit then follow the trie level by level, one join a level; an
edge is taken if its signature may hold what is left, and one that only one word passes names
the neighbour at once. In the end the two words themselves are compared.

Words are walked forwards for edits in their second half and backwards for those in the first,
so states begin deep in the trie, where it branches little. A node has an edge for each code
point of the alphabet at most, whatever its number of words, and words are counted before, so
neither frequent words nor frequent prefixes gather rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from assay.sources.tables import stage

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Two primes below 2**31 and a factor for each; a hash is the pair of remainders in one long.
PRIMES = (2147483647, 2147483629)
FACTORS = (1103515245, 1299709001)
#: Roots of the two tries.
ROOTS = (1, 7_368_787)
#: Longs of a signature.
WIDE = 4
#: No step: the end of a word, and what is beyond it.
END, BEYOND = 0, -1
#: Code points of words hashed at a time.
CELLS = 1 << 20


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """``(id, word, n)`` of the words that occur ``often`` times.

    Words are runs of letters in lower case, without one code point where ``every`` divides the
    checksum of key and run, of ``least`` code points at least. Null texts have none; a null key
    counts as an empty one. A text of any length and any number of repeats is counted whole.
    """
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run"),
    )
    runs = runs.select("key", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("sum", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = F.pmod("sum", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    found = runs.select(F.when(F.col("sum") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = found.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return stage(counts.where(F.col("n") >= often).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def packed(h: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (h[0] << np.uint64(31) | h[1]).view(np.int64)


def hashes(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words of one length, as rows of code points, and both directions: the hashes of all
    prefixes and of all suffixes, by position."""
    m, length = codes.shape
    for root, c in zip(ROOTS, (codes, codes[:, ::-1])):
        c = c.astype(np.uint64)
        node, left = np.empty((m, length + 1), np.int64), np.empty((m, length + 1), np.int64)
        pairs = [(np.uint64(p), np.uint64(f)) for p, f in zip(PRIMES, FACTORS)]
        h = [np.full(m, root, np.uint64) for _ in pairs]
        node[:, 0] = packed(h)
        for i in range(length):
            h = [(x * f + c[:, i]) % p for x, (p, f) in zip(h, pairs)]
            node[:, i + 1] = packed(h)
        h = [np.zeros(m, np.uint64) for _ in pairs]
        left[:, length] = 0
        for i in reversed(range(length)):
            h = [(x * f + c[:, i]) % p for x, (p, f) in zip(h, pairs)]
            left[:, i] = packed(h)
        yield c.astype(np.int32), node, left


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and code points of words of one length at a time, a bounded number of cells."""
    for batch in batches:
        ids, texts = batch.column("id").to_numpy(), batch.column("word").to_pylist()
        lengths = np.array([len(t) for t in texts], np.int64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            step = max(1, CELLS // int(length))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                flat = "".join(texts[j] for j in some).encode("utf-32-le")
                yield ids[some], np.frombuffer(flat, "<u4").reshape(len(some), int(length))


def edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the words' second halves in both directions, put together within a block."""
    for ids, codes in blocks(batches):
        m, length = codes.shape
        first = (length - 1) // 2  # shorter neighbours begin to walk here
        for c, node, left in hashes(codes):
            step = np.concatenate([c[:, first:], np.full((m, 1), END, np.int32)], axis=1).ravel()
            after = np.concatenate([left[:, first + 1 :], np.zeros((m, 1), np.int64)], axis=1).ravel()
            at, who = node[:, first:].ravel(), np.repeat(ids, length + 1 - first)
            order = np.lexsort((step, at))
            at, step, after, who = at[order], step[order], after[order], who[order]
            starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (step[1:] != step[:-1])))
            bit = np.left_shift(np.int64(1), after & 63)
            signs = [np.bitwise_or.reduceat(np.where((after >> 6) % WIDE == k, bit, 0), starts) for k in range(WIDE)]
            count = np.diff(np.append(starts, len(at)))
            columns = [at[starts], step[starts], count, who[starts], after[starts], *signs]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), EDGE_NAMES)


SIGNS = [f"sign{k}" for k in range(WIDE)]
EDGE_NAMES = ["node", "step", "passing", "only", "after", *SIGNS]
EDGE_KIND = "node long, step int, passing long, only long, after long, " + ", ".join(f"{s} long" for s in SIGNS)


def state_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states without edit: a word's own prefixes from the middle on, in both directions."""
    for ids, codes in blocks(batches):
        m, length = codes.shape
        first = length // 2
        for c, node, left in hashes(codes):
            steps = np.concatenate([c, np.full((m, 1), END, np.int32), np.full((m, 1), BEYOND, np.int32)], axis=1)
            columns = [
                np.repeat(ids, length + 1 - first),
                node[:, first:].ravel(),
                steps[:, first:-1].ravel(),
                steps[:, first + 1 :].ravel(),
                left[:, first:].ravel(),
            ]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["word", "node", "next", "second", "left"])


def over_halves(combine: Callable[[Column, int, int], Column], packed_hash: Column) -> Column:
    """A hash whose two remainders were both changed by ``combine(remainder, prime, factor)``."""
    high, low = F.shiftright(packed_hash, 31), packed_hash.bitwiseAND((1 << 31) - 1)
    high, low = (combine(h, p, f) for h, p, f in zip((high, low), PRIMES, FACTORS))
    return F.shiftleft(high, 31).bitwiseOR(low)


def stepped(node: Column, step: Column) -> Column:
    """The hash of a prefix with one code point more."""
    return over_halves(lambda h, p, f: (h * F.lit(f).cast("long") + step) % F.lit(p).cast("long"), node)


def without(left: Column, step: Column) -> Column:
    """The hash of a suffix without its first code point."""
    return over_halves(
        lambda h, p, f: ((h + F.lit(p).cast("long") - step) * F.lit(pow(f, -1, p)).cast("long")) % F.lit(p).cast("long"), left
    )


def may_hold(left: Column) -> Column:
    """Whether what follows an edge can be the suffix with this hash."""
    slot, bit = F.shiftright(left, 6) % WIDE, left.bitwiseAND(63).cast("int")
    sign = F.col(SIGNS[0])
    for k in range(1, WIDE):
        sign = F.when(slot == k, F.col(SIGNS[k])).otherwise(sign)
    many = F.expr("1L").bitwiseAND(shifted(sign, bit)) == 1
    return F.when(F.col("passing") == 1, F.col("after") == left).otherwise(many)


def shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def trie(vocabulary: DataFrame) -> DataFrame:
    """The edges of nodes that more than one word passes, with ``edges``, the node's number of
    edges. Where one word goes on alone, the edge that leads there has its name."""
    found = vocabulary.select("id", "word").mapInArrow(edge_rows, EDGE_KIND).repartition("node")
    found = found.groupBy("node", "step").agg(
        F.sum("passing").alias("passing"),
        F.min("only").alias("only"),
        F.min("after").alias("after"),
        *[F.bit_or(s).alias(s) for s in SIGNS],
    )
    here = Window.partitionBy("node")
    found = found.withColumns({"all": F.sum("passing").over(here), "edges": F.count("*").over(here)})
    return stage(found.where("all > 1").drop("all"), "trie")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``(word, near)``: ids of words that are one inserted, deleted or replaced code point
    apart, in both directions; a pair may be there twice."""
    spark = vocabulary.sparkSession
    edges = trie(vocabulary)
    own = vocabulary.select("id", "word").mapInArrow(state_rows, "word long, node long, next int, second int, left long")
    step, following, second, left = (F.col(c) for c in ("step", "next", "second", "left"))
    after = without(left, following)  # what is left behind the next code point
    goes_on = step != END
    edited = {
        "replace": (goes_on & (following != END) & (step != following), after),
        "insert": (goes_on & (step != following), left),
        "delete": (
            (following != END) & (following != second) & (step == second),
            F.when(second == END, F.lit(0).cast("long")).otherwise(without(after, second)),
        ),
    }
    ways = [F.when(fits & may_hold(rest), rest) for fits, rest in edited.values()]
    joined = own.join(edges.where("edges > 1"), "node")
    some = joined.select("word", "node", "step", "only", "passing", F.filter(F.array(*ways), lambda r: r.isNotNull()).alias("ways"))
    frontier = some.where(F.size("ways") > 0).select("word", "node", "step", "only", "passing", F.explode("ways").alias("left"))
    pairs = None
    while True:
        # a word's end, or an edge that one word passes, names the neighbour
        named = F.when(F.col("passing") == 1, F.col("only"))
        level = stage(frontier.select("word", named.alias("near"), stepped(F.col("node"), step).alias("node"), "left"), "frontier")
        found = level.where("near IS NOT NULL").select("word", "near")
        pairs = found if pairs is None else pairs.unionByName(found)
        if not level.where("near IS NULL").limit(1).count():
            return pairs
        joined = level.where("near IS NULL").select("word", "node", "left").join(edges, "node")
        rest = F.when(step == END, F.lit(0).cast("long")).otherwise(without(left, step))
        # an end is reached with nothing left, any other step with something
        joined = joined.where((step == END) == (left == 0)).withColumn("rest", rest)
        frontier = joined.where(may_hold(F.col("rest"))).select("word", "node", "step", "only", "passing", F.col("rest").alias("left"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: the last word on the way from form to form."""
    at = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # ways double with every round
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        at = moved.select("word", "root")
        if not moved.where("next IS NOT NULL").limit(1).count():
            return at


def variants(vocabulary: DataFrame, times: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of staged ``vocabulary(id, word, n)``.

    ``form`` is the near word that occurs most often, of equally frequent ones the first in
    code-point order, if that is at least ``times`` as often as the word, else null; ``root`` is
    the last of the forms' forms. A word that stands in the table more than once is not
    expected; an empty table gives an empty table. Words of any length are walked, with as many
    rounds as the deepest chain of nodes that two words share.
    """
    pairs = neighbours(vocabulary)
    named = vocabulary.select(F.col("id").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    mine = vocabulary.select(F.col("id").alias("word_id"), F.col("word").alias("own"))
    found = pairs.select(F.col("word").alias("word_id"), "near").join(named, "near").join(mine, "word_id")
    found = found.where(F.levenshtein("own", "near_word", 1) == 1)
    found = found.groupBy("word_id", "near").agg(F.first("near_word").alias("near_word"), F.first("near_n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("word")))
    near = found.groupBy(F.col("word_id").alias("id")).agg(F.count("*").alias("n_near"), best.alias("best"))
    much = -F.col("best.less") >= times * F.col("n")
    rows = vocabulary.join(near, "id", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(much, F.col("best.word")).alias("form"),
        F.when(much, -F.col("best.less")).alias("form_n"),
    )
    rows = stage(rows, "variants")
    last = roots(rows.where("form IS NOT NULL").select("word", "form"))
    out = rows.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
