"""Language of a text: family first, then one-versus-one linear support vector machines.

Features are the shares of hashed byte sequences of one to three bytes of the lower-case text,
square-rooted. Families are found from the languages' mean features: the closest means are
joined until the largest gap between two joins. One machine per family tells it from the
others; inside a family one machine per pair of languages votes. Margins are calibrated by
logistic regression on a fifth of the sample that the machines do not see.

The machines are fitted on a bounded sample of labelled rows (``sample`` rows over all
languages, those with the smallest hashes of their keys). Prediction reads whole texts and
nothing but texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import release, slices, texts

UNKNOWN = "und"
DIMS = 4096
#: Labelled rows that the machines are fitted and calibrated on, over all languages.
SAMPLE = 2400


def _plain() -> np.ndarray:
    """Bytes as the features see them: everything that is no letter is a space. Bytes of
    letters beyond ASCII are kept."""
    out = np.full(256, 32, np.uint32)
    out[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    out[128:] = np.arange(128, 256)
    return out


def features(text: str, plain: np.ndarray) -> np.ndarray:
    """The features of a whole text, of length one."""
    a = plain[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    total = np.zeros(DIMS)
    for i in range(0, len(a), 1 << 20):  # pieces that overlap by two bytes
        b = a[i : i + (1 << 20) + 2]
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        own = len(b) if i + (1 << 20) + 2 > len(a) else 1 << 20
        for n, grams in enumerate((b, two, three), start=1):
            hashed = (grams[:own] + np.uint32(n << 25)) * np.uint32(2654435761) >> np.uint32(20)
            total += np.bincount(hashed, minlength=DIMS)
    # spaces that follow each other say nothing about the language
    out = np.sqrt(total)
    return out / max(np.sqrt((out * out).sum()), 1e-12)


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine that tells some rows of ``x`` apart, by
    coordinate descent on the dual in double precision; ``y`` has their labels -1 and 1. The last
    feature must be constant. A row is widened when it is used, so ``x`` is not copied."""
    wide = lambda i: x[rows[i]].astype(np.float64)
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(rows))
    size = np.array([np.square(wide(i)).sum() for i in range(len(rows))])
    balance = np.where(y > 0, len(y) / max(1, (y > 0).sum()), len(y) / max(1, (y < 0).sum())) * c / 2
    order = np.random.default_rng(0)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            row = wide(i)
            slope = y[i] * (row @ weights) - 1
            new = min(max(alpha[i] - slope / size[i], 0.0), balance[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * row
                most, alpha[i] = max(most, abs(new - alpha[i])), new
        if most < 1e-3:
            break
    return weights


def calibration(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make a margin a probability, by Newton's method; shrunk targets
    keep the slope finite when all are right."""
    right, wrong = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (right + 1) / (right + 2), 1 / (wrong + 2))
    design = np.stack([margins, np.ones(len(margins))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (p - target) + 1e-3 * at
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


def margins(x: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The margins of some rows of ``x`` in double precision, some rows at a time."""
    parts = (rows[i : i + 64] for i in range(0, len(rows), 64))
    return np.concatenate([x[some].astype(np.float64) @ weights for some in parts])


def families(means: np.ndarray) -> list[list[int]]:
    """Groups of languages, by joining the closest means up to the largest gap."""
    groups = [[i] for i in range(len(means))]
    states, heights = [groups], [0.0]
    near = means @ means.T
    while len(groups) > 1:
        a, b = max(combinations(range(len(groups)), 2), key=lambda ab: near[np.ix_(groups[ab[0]], groups[ab[1]])].mean())
        heights.append(1 - near[np.ix_(groups[a], groups[b])].mean())
        groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [sorted(groups[a] + groups[b])]
        states.append(sorted(groups))
    if len(means) < 3:
        return states[-1]
    # at least one join, at least two families
    gaps = [heights[i + 1] - heights[i] for i in range(1, len(states) - 1)]
    return states[1 + int(np.argmax(gaps))]


@dataclass
class Model:
    """``machines`` holds one row of weights each: first the families', then the pairs'."""

    languages: list[str]
    families: list[list[int]]
    pairs: list[tuple[int, int]]
    machines: np.ndarray
    scales: np.ndarray

    @classmethod
    def fit(cls, languages: list[str], x: np.ndarray, label: np.ndarray, apart: np.ndarray) -> Model:
        """From features, which end with a constant one, labels and which rows are kept apart for
        calibration. Single precision will do for ``x``; it is not copied."""
        n = len(languages)
        mean = np.zeros((n, x.shape[1] - 1))
        for row, i in zip(x, label):
            mean[i] += row[:-1]
        mean /= np.bincount(label, minlength=n)[:, None]
        groups = families(mean / np.linalg.norm(mean, axis=1, keepdims=True))
        family = np.zeros(n, np.int64)
        for g, members in enumerate(groups):
            family[members] = g
        pairs = [p for members in groups for p in combinations(members, 2)]
        tasks = [(np.ones(len(x), bool), np.where(family[label] == g, 1, -1)) for g in range(len(groups))]
        tasks += [((label == a) | (label == b), np.where(label == a, 1, -1)) for a, b in pairs]
        machines, scales = [], []
        for some, y in tasks:
            fit, test = some & ~apart, some & apart
            test = test if len(set(y[test].tolist())) > 1 else some
            one = len(set(y[fit].tolist())) < 2
            rows = np.flatnonzero(fit)
            w = np.append(np.zeros(x.shape[1] - 1), y[fit][0] if fit.any() else 1.0) if one else svm(x, rows, y[fit])
            machines.append(w)
            scales.append((1.0, 0.0) if one else calibration(margins(x, np.flatnonzero(test), w), y[test]))
        return cls(languages, groups, pairs, np.array(machines), np.array(scales))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and probability of every row of features."""
        margin = x @ self.machines[:, :-1].T + self.machines[:, -1]
        p = 1 / (1 + np.exp(-np.clip(margin * self.scales[:, 0] + self.scales[:, 1], -30, 30)))
        n = len(self.families)
        family = p[:, :n].argmax(axis=1)
        share = p[np.arange(len(x)), family] / p[:, :n].sum(axis=1)
        best, score = np.zeros(len(x), np.int64), np.zeros(len(x))
        for g, members in enumerate(self.families):
            rows = np.flatnonzero(family == g)
            votes = np.zeros((len(rows), len(self.languages)))
            sure = np.zeros_like(votes)
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    q = p[rows, n + k]
                    votes[:, a] += q >= 0.5
                    votes[:, b] += q < 0.5
                    sure[:, a] += q
                    sure[:, b] += 1 - q
            # most votes; the pairs' probabilities break ties
            total = (votes + sure / (2 * len(self.languages)))[:, members]
            win = np.array(members)[total.argmax(axis=1)]
            best[rows] = win
            rivals = max(1, len(members) - 1)
            score[rows] = share[rows] * (sure[np.arange(len(rows)), win] / rivals if len(members) > 1 else 1.0)
        return best, score


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plain = _plain()
    for batch in slices(batches, "text"):
        rows = [features(t, plain).astype(np.float32).tobytes() for t in texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("apart"), pa.array(rows, pa.binary())], ["label", "apart", "x"]
        )


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled rows, the same number for every language, 20 of
    each at least, and one text for a key and label, the first of several. None when there are
    none. Rows without key, text or label are left out."""
    rows = labelled.select(
        F.xxhash64(F.col(key)).alias("hash"), F.col(text).alias("text"), F.col(label).alias("label")
    ).where(F.col(key).isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("label").isNotNull())
    languages = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if not languages:
        return None
    each = max(20, sample // len(languages))
    by_label = lambda values: F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[F.col("label")]
    keys = rows.select("label", "hash").distinct()
    counts = {r["label"]: r["count"] for r in keys.groupBy("label").count().collect()}
    # hashes are spread evenly: half as many again as are wanted lie below this
    bounds = {v: min((1 << 63) - 1, (3 * each << 63) // n - (1 << 63)) for v, n in counts.items()}
    order = Window.partitionBy("label").orderBy("hash")
    first = keys.where(F.col("hash") <= by_label(bounds)).withColumn("nth", F.row_number().over(order))
    last = first.where(F.col("nth") <= each).groupBy("label").agg(F.max("hash").alias("cut"))
    cuts = {r["label"]: r["cut"] for r in last.collect()}
    chosen = rows.where(F.col("hash") <= by_label(cuts)).groupBy("label", "hash").agg(F.min("text").alias("text"))
    chosen = chosen.select("text", "label", (F.pmod("hash", F.lit(5)) == 0).alias("apart"))
    found = chosen.mapInArrow(_numbered, "label string, apart boolean, x binary").toArrow()
    rows = [np.frombuffer(v.as_buffer(), np.float32) for v in found.column("x")]
    # a fixed order, whatever order the rows came in
    labels = np.array([languages.index(v) for v in found.column("label").to_pylist()])
    apart = np.array(found.column("apart").to_pylist(), bool)
    order = np.lexsort((np.array([row[:64] for row in rows]).sum(axis=1), apart, labels))
    # the driver holds the sample once, in single precision, and a column of ones
    x = np.ones((len(rows), DIMS + 1), np.float32)
    for to, at in enumerate(order):
        x[to, :-1] = rows[at]
    del found, rows
    return Model.fit(languages, x, labels[order], apart[order])


def predictions(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``(row, lang_pred, score)`` of every row: all its columns as a struct, whatever their
    names, the language and how sure it is, 0 to 1.

    Null texts, texts without a letter, and all texts when there is no model, are ``und`` with
    score 0. Repeated rows get the same answer. Whole texts of any length are read. Of families
    or languages that are equally likely the first in the model's order is taken. An empty table
    gives an empty table.
    """
    place = docs.columns.index(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        plain = _plain()
        apart = (pa.RecordBatch.from_arrays([b.column("row"), b.column("row").field(place)], ["row", "text"]) for b in batches)
        for batch in slices(apart, "text"):
            some = texts(batch)
            known = np.array([model is not None and any(map(str.isalpha, t)) for t in some], bool)
            names, scores = np.full(len(some), UNKNOWN, object), np.zeros(len(some))
            at = np.flatnonzero(known)
            for i in range(0, len(at), 256):
                part = at[i : i + 256]
                best, score = model.predict(np.stack([features(some[k], plain) for k in part]))
                names[part] = np.array(model.languages, object)[best]
                scores[part] = score
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names.tolist(), pa.string()), pa.array(scores)], ["row", "lang_pred", "score"]
            )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double")


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, see ``predictions``; columns of
    these names are replaced."""
    others = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    return predictions(others, model, text).select("row.*", "lang_pred", "score")


def held_out(key: str | Column = "doc_id") -> Column:
    """Whether a row belongs to the quarter that is never learned from; false for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
