from __future__ import annotations

import re
import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table_of(spark, tmp_path, rows):
    folder = str(tmp_path / "sf")
    docs = spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def rows_of():
    rng = np.random.default_rng(12)
    word = lambda lang: ("the " if lang == "en" else "der ") + "".join(rng.choice(list("aeiou"), 3)) + str(rng.integers(0, 99))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    passage = text("en", 60)
    rows = [(i, text("en" if i % 2 else "de", 40), "en" if i % 2 else "de") for i in range(60)]
    rows += [(60, None, "en"), (61, "", "en"), (62, "12 34", None), (63, rows[5][1], "en"), (64, rows[5][1], None)]
    rows += [(70, text("en", 30) + " " + passage, "en"), (71, passage + " " + text("en", 30), "en")]
    rows += [(72, text("en", 20) + " write to a@b.example.org or +49 30 1234567 now", "en")]
    return rows


def test_stages_against_plain_versions(spark, tmp_path):
    rows = rows_of()
    found = corpus_pipeline.run(spark, table_of(spark, tmp_path, rows)).collect()
    docs = {i: t for i, t, _ in rows if t and re.search("[^\\W\\d_]", t)}
    group = brute.simhash_components(list(docs.items()))
    docs = {i: t for i, t in docs.items() if group[i] == i}
    assert 63 not in docs and 64 not in docs
    for i, (words, gone) in brute.removed_words(list(docs.items())).items():
        if any(gone):
            docs[i] = "".join(w + " " for w, g in zip(words, gone) if not g).rstrip(" ") if gone[-1] else " ".join(w for w, g in zip(words, gone) if not g)
    assert len(docs[71].split()) <= 60
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(dict)
    for r in found:
        got[r.doc_id][r.start] = r.ids
        assert r.ids_crc32 == zlib.crc32(r.ids)
    assert set(got) == set(docs)
    for i, text in docs.items():
        for kind, a, b in sorted(brute.base_spans(text), key=lambda s: -s[1]):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        ids = np.frombuffer(b"".join(got[i][s] for s in sorted(got[i])), "<u4").tolist()
        assert ids[-1] == 1
        back = plain.decode(ids[:-1], skip_special_tokens=False)
        assert back.split() == text.split(), i
    assert "<EMAIL>" in "".join(plain.decode(np.frombuffer(p, "<u4").tolist()) for p in got[72].values())


def test_every_stage_keeps_the_columns(spark, tmp_path):
    folder = table_of(spark, tmp_path, rows_of())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for some in (docs, docs.limit(0)):
        for _, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, some, folder)
            assert out.dtypes == docs.dtypes
            if some is not docs:
                assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_repeated_rows_leave_one_document(spark):
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "a b c d e", "en", "s", 9), (None, "x y", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == [(False, 1), (True, None)]


def test_personal_data_goes_and_clean_texts_stay(spark):
    rows = [(1, "clean  text\nwith lines", "en", "s", 22), (2, "to a@b.cc", "en", "s", 9), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.personal_data(spark, docs, "").collect()}
    assert out == {1: ("clean  text\nwith lines", 22), 2: ("to <EMAIL>", 10), 3: (None, None)}
