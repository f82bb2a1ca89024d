"""Licence families of paragraphs: a trained word n-gram classifier, confirmed by templates.

Features are the one- to three-word sequences that occur in the templates; a logistic
regression over families and an unknown class has few weights that are not zero. It is trained
here, on the templates with words dropped, put in and set between corpus words, and on a
bounded sample of corpus paragraphs as the unknown class. A temperature fitted on a fifth of
the training rows calibrates the probabilities. A predicted family is confirmed when one of its
templates has at least ``SIMILAR`` of its five-word shingles in the paragraph; of a shorter
template, which has no shingle, it has to be the whole word sequence.

A paragraph is a line of the text. Notices are often wrapped, so neighbouring lines without a
blank line between them are a paragraph, too, where they hold three-word sequences of the
templates: from the first of them to the last. It stands for its lines if a template confirms
it and none of them alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import slices, texts
from assay.llm.substrings import Words

UNKNOWN = "unknown"
SHINGLE, SIMILAR = 5, 0.8
#: Documents and paragraphs that the unknown class is learned from.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 200, 1500
#: Altered copies of every template.
COPIES = 30

#: Notices by which the families are known; what they say follows the public licence texts.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Distributed under the terms of the Apache License 2.0.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "This software is distributed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU General Public License, version 2 or later.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the terms of the GNU Lesser General Public License, version 3.",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "The author has dedicated the work to the public domain by waiving all rights.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without prior written permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}

#: Everything but letters, digits and bytes beyond ASCII separates words; case is folded.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256)
)


def paragraphs(text: str) -> list[list[bytes]]:
    """The words of every paragraph."""
    return [line.split() for line in text.encode("utf-8", "surrogatepass").translate(FOLD).split(b"\n")]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        return x ^ (x >> np.uint64(29))


class Sequences:
    """Word sequences of the paragraphs of a batch: hash, paragraph and how many each has."""

    def __init__(self, lists: list[list[bytes]], words: Words):
        self.three = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        one = words.of([w for some in lists for w in some])
        where = np.repeat(np.arange(len(lists)), self.sizes)
        hashes, at = [one], [where]
        last = one
        for n in (2, 3):
            if len(one) < n:
                break
            last = mixed(last[:-1], one[n - 1 :])
            inside = where[: len(last)] == where[n - 1 :]
            hashes.append(last[inside])
            at.append(where[: len(last)][inside])
            if n == 3:
                self.three = hashes[-1], at[-1]
        self.hashes, self.at = np.concatenate(hashes), np.concatenate(at)
        self.total = np.maximum(3 * self.sizes - 3, self.sizes).astype(np.float64)


def columns_of(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the sorted known ones, and where."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    there = np.flatnonzero(known[at] == hashes)
    return there, at[there]


def dense(found: Sequences, known: np.ndarray) -> np.ndarray:
    """Features of all paragraphs as a matrix."""
    out = np.zeros((len(found.sizes), len(known)))
    there, at = columns_of(found.hashes, known)
    out[found.at[there], at] = 1.0
    return out / np.sqrt(np.maximum(found.total, 1.0))[:, None]


def shingles(words: list[bytes]) -> set[bytes]:
    n = max(1, len(words) - SHINGLE + 1)
    return {b" ".join(words[i : i + SHINGLE]) for i in range(n)} if words else set()


@dataclass
class Model:
    """``weights`` has a row for every known sequence and a column for every class, the unknown
    one last."""

    families: list[str]
    known: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[set[bytes]]]
    threes: set[bytes]
    three_hashes: np.ndarray

    def probabilities(self, found: Sequences) -> np.ndarray:
        there, at = columns_of(found.hashes, self.known)
        live = (self.weights[at] != 0).any(axis=1)
        # a sequence counts once in a paragraph, however often it stands there
        once = np.unique(found.at[there[live]] * len(self.known) + at[live])
        where, at = once // len(self.known), once % len(self.known)
        total = np.zeros((len(found.sizes), len(self.bias)))
        np.add.at(total, where, self.weights[at])
        logits = (total / np.sqrt(np.maximum(found.total, 1.0))[:, None] + self.bias) / self.temperature
        return softmax(logits)

    def similarity(self, family: str, words: list[bytes]) -> float:
        """The largest share of a template's shingles that the paragraph has."""
        mine = shingles(words)
        return max(len(t & mine) / len(t) for t in self.templates[family])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def altered(rng: np.random.Generator, words: list[bytes], around: list[list[bytes]]) -> list[bytes]:
    """A template's words with some dropped or put in, perhaps between words of the corpus."""
    out = []
    for w in words:
        if rng.random() < 0.05:
            continue
        out.append(w)
        if around and rng.random() < 0.03:
            other = around[rng.integers(len(around))]
            out.append(other[rng.integers(len(other))])
    if around and rng.random() < 0.4:
        some = around[rng.integers(len(around))][:20]
        out = some + out if rng.random() < 0.5 else out + some
    return out


def train(negatives: list[list[bytes]]) -> Model:
    """A model from the templates and paragraphs of other kinds."""
    rng, words = np.random.default_rng(11), Words()
    families = sorted(TEMPLATES)
    plain = {f: [paragraphs(t)[0] for t in TEMPLATES[f]] for f in families}
    templates = {f: [shingles(t) for t in plain[f]] for f in families}
    close = lambda p: max(len(t & shingles(p)) / len(t) for some in templates.values() for t in some) >= 0.5
    negatives = [n for n in negatives if n and not close(n)]
    # ordinary sentences that share words with the notices
    negatives += [paragraphs(t)[0] for t in (
        "The license was renewed by the office.", "You need a license to drive this car.",
        "The public general hospital is under repair.", "This work is done and released.",
        "He was licensed as a doctor in 1990.", "Version 2.0 of the file was released to the public.",
        "Permission was granted to enter the building.", "All rights of the members are listed here.",
    ) for _ in range(10)]
    rows, labels = [], []
    for i, family in enumerate(families):
        for template in plain[family]:
            for copy in range(COPIES):
                rows.append(altered(rng, template, negatives) if copy else template)
                labels.append(i)
    # words of the notices in other orders and numbers are no notice
    every = sorted({w for f in families for t in plain[f] for w in t})
    for n in (1, 1, 2, 3, 6):
        negatives += [[every[i] for i in rng.integers(0, len(every), n)] for _ in range(len(every))]
    rows += negatives
    labels += [len(families)] * len(negatives)
    label = np.array(labels)
    known = np.unique(Sequences([t for f in families for t in plain[f]], words).hashes)
    x = dense(Sequences(rows, words), known)
    apart = np.arange(len(rows)) % 5 == 4
    weights, bias = regression(x[~apart], label[~apart], len(families) + 1)
    logits = x[apart] @ weights + bias
    trials = np.geomspace(0.25, 4, 33)
    loss = [-np.log(softmax(logits / t)[np.arange(len(logits)), label[apart]] + 1e-12).mean() for t in trials]
    every = [t for f in families for t in plain[f]]
    threes = {b" ".join(t[i : i + 3]) for t in every for i in range(len(t) - 2)}
    three_hashes = np.unique(Sequences(every, words).three[0])
    temperature = float(trials[int(np.argmin(loss))])
    return Model(families, known, weights, bias, temperature, templates, threes, three_hashes)


def regression(x: np.ndarray, label: np.ndarray, classes: int, rounds: int = 300, l1: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by accelerated proximal gradient steps; small weights become zero."""
    target = np.eye(classes)[label]
    share = np.bincount(label, minlength=classes) / len(label)
    each = (1 / (classes * np.maximum(share, 1e-9)))[label][:, None] / len(label)
    w, b = np.zeros((x.shape[1], classes)), np.log(np.maximum(share, 1e-6))
    ahead_w, ahead_b, old_w, old_b = w, b, w, b
    step = 1.0 / (0.5 * np.linalg.norm(x * np.sqrt(each), 2) ** 2 + 1e-9)
    for k in range(rounds):
        error = (softmax(x @ ahead_w + ahead_b) - target) * each
        w = ahead_w - step * (x.T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
        b = ahead_b - error.sum(axis=0)
        ahead_w, ahead_b = w + k / (k + 3) * (w - old_w), b + k / (k + 3) * (b - old_b)
        old_w, old_b = w, b
    return w, b


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model whose unknown class comes from a bounded sample: the paragraphs of the documents
    with the smallest hashes of their keys. An empty table leaves the fixed sentences."""
    rows = docs.select(F.xxhash64(F.col(key)).alias("hash"), F.col(text).alias("text"))
    cut = rows.select("hash").orderBy("hash").limit(SAMPLE_DOCS).agg(F.max("hash")).first()[0]
    lines = rows.where(F.col("hash") <= F.lit(cut).cast("long")).select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.length("line").between(1, 2000)).distinct()
    some = lines.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_PARAGRAPHS).collect()
    return train([paragraphs(r["line"])[0] for r in some])


def wrapped(lists: list[list[bytes]], doc: list[int], hits: np.ndarray, threes: set[bytes]) -> list[tuple[int, int, list[bytes]]]:
    """``(first, last, words)`` of neighbouring lines around ``hits`` that can be a notice in
    several lines: the lines that its words come from, and the words."""
    runs: list[list[int]] = []
    for h in hits.tolist():
        near = lambda i: 0 <= i < len(lists) and doc[i] == doc[h] and bool(lists[i])
        low, high = h - near(h - 1), h + near(h + 1)
        if runs and low <= runs[-1][1] and doc[runs[-1][1]] == doc[h]:
            runs[-1][1] = high
        else:
            runs.append([low, high])
    out = []
    for low, high in runs:
        words = [(w, i) for i in range(low, high + 1) for w in lists[i]]
        plain = [w for w, _ in words]
        there = [k for k in range(len(plain) - 2) if b" ".join(plain[k : k + 3]) in threes]
        if there and words[there[0]][1] < words[there[-1] + 2][1]:
            out.append((words[there[0]][1], words[there[-1] + 2][1], plain[there[0] : there[-1] + 3]))
    return out


def scanned(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, paragraph, lines, family, probability, similarity, confirmed)`` of every paragraph
    that is more probably a notice of a family than anything else. ``paragraph`` is its first
    line from 0, ``lines`` their number; several lines are reported if a template confirms them,
    and then stand for what single ones of them would be.

    Null and empty texts have none. Whole texts of any length are read; very long lines are
    paragraphs like others. Of families that are equally probable the first by name is taken.
    Repeated rows are repeated, and an empty table gives an empty table.
    """

    def judged(lists: list[list[bytes]], sequences: Sequences) -> Iterator[tuple[int, str, float, float]]:
        p = model.probabilities(sequences)
        best = p.argmax(axis=1)
        for h in np.flatnonzero(best < len(model.families)).tolist():
            family = model.families[best[h]]
            yield h, family, float(p[h, best[h]]), model.similarity(family, lists[h])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, "text", 1_000_000):
            lists, doc, nth = [], [], []
            for i, t in enumerate(texts(batch)):
                own = paragraphs(t)
                lists += own
                doc += [i] * len(own)
                nth += range(len(own))
            sequences = Sequences(lists, words)
            found = {}  # by first line: number of lines, family, probability, similarity
            for h, family, p, similar in judged(lists, sequences):
                found[h] = (1, family, p, similar)
            there, _ = columns_of(sequences.three[0], model.three_hashes)
            runs = wrapped(lists, doc, np.unique(sequences.three[1][there]), model.threes)
            joined = [r[2] for r in runs]
            for k, family, p, similar in judged(joined, Sequences(joined, words)) if joined else ():
                low, high, _ = runs[k]
                sure = any(found[i][1] == family and found[i][3] >= SIMILAR for i in range(low, high + 1) if i in found)
                if similar >= SIMILAR and not sure:
                    for i in range(low, high + 1):
                        if i in found and found[i][3] < SIMILAR:
                            del found[i]
                    # a sure line of another family keeps its place; the run is put at the next
                    at = next(i for i in range(low, high + 2) if i not in found)
                    found[at] = (high - low + 1, family, p, similar)
            rows = [(doc[h], nth[h], *found[h], found[h][3] >= SIMILAR) for h in sorted(found) if h < len(doc)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[0] = batch.column("key").take(arrays[0])
            yield pa.RecordBatch.from_arrays(arrays, ["key", "paragraph", "lines", "family", "probability", "similarity", "confirmed"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run, "key long, paragraph long, lines long, family string, probability double, similarity double, confirmed boolean"
    )
