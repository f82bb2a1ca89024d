from __future__ import annotations

import os
import subprocess
import sys
import tracemalloc

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import language, licences, sharding, simhash, spelling, whitening

DOCS = "doc_id long, text string, size string, row int, shard double, word string, n string, id int"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "clash", 1, 0.5, "w", "n", 2) for k, t in rows], DOCS)


# whitening


def plain_whitening(x: np.ndarray):
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(axis=0)
    y = u - sums / n
    v = y.T @ y / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    return n, sums, v, values, (x - sums / n) @ axes[:, :4] / np.sqrt(values[:4])


VECTORS = "vec_id long, embedding array<float>, x int, id string, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], VECTORS)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    m = (rng.normal(size=(400, 24)) * np.linspace(1, 3, 24) + 5).astype(np.float32)
    m[0] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(0, m[0].tolist()), (900, m[7].tolist()), (None, m[8].tolist())]
    odd = [(901, None), (902, [float("nan")] * 24), (903, [None] * 24), (904, [float("-inf")] * 24), (905, []), (906, [3e38] * 24)]
    frame = vectors(spark, rows + odd).repartition(5)
    found = whitening.whitened(frame, whitening.fit(frame)).collect()
    assert len(found) == 4 * len(rows)
    x = np.floor(256 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    n, sums, v, values, w = plain_whitening(x)
    expected = {}
    for (i, _), e, row in zip(rows, w, x):
        expected.setdefault(i, []).append((e, int(((n * row - sums) ** 2).sum())))
    signs = {}
    for r in found:
        e, deviation = expected[r.id][0]
        sign = signs.setdefault(r.component, np.sign(r.whitened * e[r.component - 1]) or 1)
        assert abs(sign * r.whitened - e[r.component - 1]) < 1e-9
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-12 and r.identity_error < 1e-9


def test_whitening_lengths_without_spread_and_empty(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [0.5]), (4, [0.5])]
    frame = vectors(spark, rows)
    found = {(r.id, r.component): r for r in whitening.whitened(frame, whitening.fit(frame)).collect()}
    assert set(found) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)}
    assert abs(abs(found[1, 1].whitened) - 1) < 1e-12 and found[1, 2].whitened is None
    assert found[3, 1].whitened is None and found[3, 1].n == 1 and found[3, 1].explained is None
    none = frame.limit(0)
    assert whitening.whitened(none, whitening.fit(none)).count() == 0


def test_whitening_of_large_numbers_is_exact(spark):
    rows = [(i, [float(2**40 + i * i), float(-(2**41)), float(i)]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([[256 * int(c) for c in v] for _, v in rows], object)
    sums = x.sum(axis=0)
    found = whitening.whitened(frame, whitening.fit(frame)).where("component = 1").collect()
    for r in found:
        assert int(r.deviation) == int(((50 * x[r.id] - sums) ** 2).sum())


@pytest.mark.parametrize("values", [[5, 5, 5, 2, 2, 1], [1, 1 + 1e-7, 1 + 2e-7, 1e-3, 1e-9, 0], [4.0] * 6, [9, 8, 7, 3, 2, 1]])
def test_refined_eigenvectors(values):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-15 * 8
    assert np.abs(a @ x - x * found).max() < 1e-14 * max(values)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-13 * max(values)


# sharding


def shard_rows():
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcd éß"), n))
    rows = [(i, text(int(rng.integers(0, 300)))) for i in range(400)]
    rows += [(1000 + i, "the same text") for i in range(300)] + [(2000 + i, None) for i in range(5)]
    rows += [(3000, ""), (None, "without a key"), (None, "without a key"), (3001, text(9000))]
    return rows + rows[:3] + [(4000, "often the same row")] * 200


@pytest.mark.parametrize("tolerance, part_bytes", [(0.01, 1 << 30), (0.0, 1500), (0.3, 400)])
def test_sharding_against_its_rule(spark, tolerance, part_bytes):
    rows = shard_rows()
    found = sharding.sharded(documents(spark, rows).repartition(7), 6, tolerance=tolerance, part_bytes=part_bytes)
    got = sorted((r.row.doc_id is None, r.row.doc_id, r.size, r["shard"], r.slot) for r in found.collect())
    expected = sorted((k is None, k, s, d, i) for k, s, d, i in brute.shard_rule(rows, 6, tolerance))
    # rows that agree in key and text change places freely
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    for d in range(6):
        assert sorted(g[4] for g in got if g[3] == d) == list(range(sum(g[3] == d for g in got)))
    if part_bytes < 1000:
        return
    assert got == expected


def test_sharding_small_tables_and_plan(spark):
    assert sharding.sharded(documents(spark, []), 4).count() == 0
    one = sharding.sharded(documents(spark, [(1, None)]), 4).collect()
    assert [(r["shard"], r.slot, r.size) for r in one] == [(2, 0, 16)]  # its middle lies at half of all bytes
    plan = sharding.sharded(documents(spark, shard_rows()), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange") == 1


# spelling


def spelling_rows():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abé"), int(rng.integers(6, 11)))) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(words, 40)) + "7" + words[0].upper()) for i in range(60)]
    rows += [(100, " ".join(["notable"] * 30 + ["notabel"] * 2)), (101, "Notable notably notably nottable"), (102, "nottable")]
    rows += [(103, None), (None, "keyless keyless keylest keylest"), (104, ""), (105, "ÀBCDEFG àbcdefg ÀBCDEFG àbcdefg")]
    rows += [(i, "aaaaaaaa aaaaaaaaa aaaaaaaaaa zaaaaaaaa") for i in range(200, 203)]
    chain = ["chainaa", "chainab", "chainbb"]  # forms of forms
    rows += [(i, " ".join([chain[0]] * 300 + [chain[1]] * 25 + [chain[2]] * 2)) for i in range(300, 310)]
    long = "".join(rng.choice(list("abcdefg"), 5000))
    return rows + [(i, f"{long} {long[:4000]}x{long[4001:]} y{long}") for i in (400, 401, 402)]


def test_spelling_against_plain_version(spark):
    rows = spelling_rows()
    expected = brute.spelling(brute.cut_words(rows))
    assert any(v[0] and v[1] != v[0] for v in expected.values()) and sum(v[3] > 0 for v in expected.values()) > 100
    found = spelling.variants(spelling.words(documents(spark, rows).repartition(6))).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}
    assert len(found) == len(got) and got == expected


def test_spelling_of_nothing(spark):
    none = documents(spark, [(1, None), (2, "short words")])
    assert spelling.variants(spelling.words(none)).count() == 0


# the sample of the language model, the stages of the pipeline


def test_language_sample_is_bounded_by_keys(spark):
    rows = [(1, "der die das"), (1, "eine andere")] * 2500 + [(i, f"the words {i}") for i in range(2, 400)]
    docs = spark.createDataFrame([(k, t, "de" if k == 1 else "en") for k, t in rows], "doc_id long, text string, lang string")
    seen = []
    whole = language.Model.fit
    try:
        language.Model.fit = staticmethod(lambda names, x, *rest: seen.append(len(x)) or whole(names, x, *rest))
        model = language.fit(docs, sample=100)
    finally:
        language.Model.fit = whole
    assert seen == [51]  # one text for the repeated key, half of the sample for the other language
    assert model.languages == ["de", "en"]


def test_language_fit_does_not_copy_the_sample():
    """The driver holds the sample, and beside it no more than some rows in double precision."""
    rng = np.random.default_rng(3)
    label = np.arange(400) % 4
    x = rng.random((400, 2049), dtype=np.float32) + (np.arange(2049) % 4 == label[:, None])
    x = x.astype(np.float32)
    x[:, -1] = 1
    tracemalloc.start()
    try:
        model = language.Model.fit(["a", "b", "c", "d"], x, label, label < 0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < x.nbytes
    assert (model.predict(x[:, :-1].astype(np.float64))[0] == label).all()


def test_pipeline_keeps_clashing_columns(spark):
    rows = [(i, "the text is of a kind" if i % 2 else "der Text ist so eine Art", "en" if i % 2 else "de", "s", 9, 99.0, "xx") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string")
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, "")
        assert out.dtypes == docs.dtypes
        assert {(r.score, r.lang_pred) for r in out.collect()} == {(99.0, "xx")}


def test_near_duplicates_decide_by_text(spark):
    a, b, c = "one text of some words here", "quite another text with other words", "and a third one to be kept too"
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (None, c), (3, b), (5, None), (4, None), (7, c[:3])]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    expected = [(1, a), (2, b), (4, None), (7, c[:3]), (None, c)]
    assert sorted(kept, key=str) == sorted(expected, key=str)
    assert simhash.representatives(docs).agg(F.sum("n")).first()[0] == 7


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import public_tokenizers
from assay.session import build_session
from assay.llm import encoding, packing, shards
spark = build_session("local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
path = public_tokenizers.path("byte_bpe_50k.json")
assert encoding.round_trip(docs, path).count() == 2
assert packing.packed(docs, path).count() == 2
assert shards.read_shards(shards.write_shards(docs, {folder!r}, public_tokenizers.path("word_bpe_49k.json"))).count() == 2
print("all there")
"""


def test_workers_without_the_package(tmp_path):
    """The workers start elsewhere and do not find the package by path; its code travels."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("SPARK_") and k != "PYSPARK_GATEWAY_PORT"}
    env = {k: v for k, v in env.items() if not k.startswith("PYSPARK_GATEWAY")}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=repo, folder=str(tmp_path / "shards")))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all there" in done.stdout, done.stderr[-3000:]


# licences


def folded(text: str, width: int, mark: str = "") -> str:
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + len(word) >= width:
            lines.append(mark + line)
            line = ""
        line = f"{line} {word}".strip()
    return "\n".join([*lines, mark + line])


def test_short_and_wrapped_notices(spark):
    rng = np.random.default_rng(8)
    prose = lambda n: " ".join("".join(rng.choice(list("aeiourst"), 5)) for _ in range(n))
    rows, expected = [], []
    for family, templates in licences.TEMPLATES.items():
        for template in templates:
            for width, mark in ((40, "# "), (60, " * "), (72, "")):
                key = len(rows)
                rows.append((key, f"{prose(30)}\n\n{folded(template, width, mark)}\n\n{prose(40)}"))
                expected.append((key, family))
    rows.append((9000, f"{prose(20)}\nAll rights reserved.\n{prose(20)}"))
    rows.append((9001, f"{prose(20)} rights\nreserved {prose(5)}\nall the rights of the members\nreserved seats"))
    rows.append((9002, None))
    long = max(licences.TEMPLATES["mit"], key=len)
    rows.append((9003, f"{prose(4000)}\n{folded(long, 50)} {prose(3000)}\n{prose(2000)}"))  # between long lines
    expected += [(9000, "proprietary"), (9003, "mit")]
    docs = documents(spark, rows)
    found = licences.scanned(docs, licences.fit(docs.limit(0))).where("confirmed").collect()
    assert {(r.key, r.family) for r in found} >= set(expected)
    assert not {r.key for r in found} & {9001, 9002}
    wide = [r for r in found if r.key == 9003]
    assert [(r.paragraph, r.lines > 1) for r in wide] == [(1, True)]
