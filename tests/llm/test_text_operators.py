from __future__ import annotations

import random
import weakref
import zlib
from collections import defaultdict
from types import SimpleNamespace

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assay.llm import bpe, common, encoding, language, licences, packing, pii, shards, simhash, substrings, tokens
from assay.llm import queries as llm

#: Clashing names on purpose: every operator has to keep its own columns apart.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, spans string, fp string, score string"


def docs_of(spark, rows, schema=SCHEMA):
    width = len(schema.split(", "))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, copies, shared passages, ties, odd white space."""
    rng = random.Random(5)
    passage, long = words(rng, 130), words(rng, 30_000, 5000)
    out = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One TWO"), (6, "a b c d é É 中文 😀"),
        (7, words(rng, 49)), (8, words(rng, 50)), (9, long), (10, long), (11, long + " more"),
        (12, "mail a@b.example.org, +49 30 1234567, 10.0.0.1 and 4111 1111 1111 1111."),
        (13, "IBAN DE89 3704 0044 0532 0130 00, token = 9b0b3c6a43eb78aa99cbd7049c572391524f37a8"),
        (14, "x" * 20_000), (15, "<|endoftext|> a  b   c \n\n d <|endoftext|>"), (16, "na " * 300), (17, "na " * 280),
    ]
    for i in range(20, 60):
        body = words(rng, rng.randrange(5, 400), 3000)
        if i % 3 == 0:
            at = body.split(" ")
            cut = rng.randrange(len(at))
            body = " ".join([*at[:cut], passage, *at[cut:]])
        out.append((i, body))
    base = words(rng, 300, 3000).split(" ")
    for i in range(60, 80):  # near copies
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"v{i}"
        out.append((i, " ".join(copy)))
    out += [(80, out[30][1]), (81, out[30][1])]
    return out


def test_pii(spark, rows):
    odd = rows + [(200 + i, t) for i, t in enumerate(["a@b.c_x@y.z", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1" * 500, "a@b" + ".c" * 5000, "é@b.cc"])]
    rng = random.Random(1)
    odd += [(1000 + i, "".join(rng.choice("0123456789 .-+()@ab_Z") for _ in range(rng.randrange(200)))) for i in range(400)]
    docs = docs_of(spark, odd + odd[:3] + [(None, "a@b.cc")])
    found = pii.find(docs).collect()
    assert len(found) == len(odd) + 4
    for r in found:
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind in brute.BASE]
        assert base == brute.base_spans(r.text), r.text[:80]
    kinds = {r.key: {s.kind for s in r.spans} for r in found}
    assert kinds[12] == {"email", "ip", "card", "phone"}
    assert {"iban", "secret"} <= kinds[13] and kinds[1] == set()
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_context_decides(spark):
    run = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    docs = docs_of(spark, [(1, f"token = {run}"), (2, f"commit {run}"), (3, "DE89 3704 0044 0532 0130 01"), (4, "xDE89370400440532013000")])
    assert {r.key: [s.kind for s in r.spans if s.kind in ("iban", "secret")] for r in pii.find(docs).collect()} == {
        1: ["secret"], 2: [], 3: [], 4: [],
    }


def test_pii_redacted(spark):
    docs = docs_of(spark, [(1, "é a@b.cc or +49 30 1234567."), (2, "nothing"), (3, None)])
    found = pii.find(docs).select("key", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r.key: r.t for r in found} == {1: "é <EMAIL> or <PHONE>.", 2: "nothing", 3: ""}


def test_simhash(spark, rows):
    docs = docs_of(spark, rows + rows[5:8])
    found = simhash.near_duplicates(docs).collect()
    want = brute.simhash_components(rows)
    assert len(found) == len(rows) + 3
    assert {r.key: r.component for r in found} == want
    texts = dict(rows)
    for r in found:
        assert r.fp & (2**64 - 1) == brute.fingerprint(texts[r.key])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_hot_values_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 32)
    rng = np.random.default_rng(3)
    near = rng.integers(0, 2**62, dtype=np.int64) ^ (1 << rng.integers(0, 62, 150, dtype=np.int64))
    far = rng.integers(-(2**62), 2**62, 300, dtype=np.int64)
    prints = np.unique(np.concatenate([near, far]))
    frame = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    found = simhash.links(frame, 3, light=8).collect()
    at = {int(p): i for i, p in enumerate(prints)}
    u = prints.view(np.uint64)
    want = brute.groups(len(u), [tuple(p) for p in np.argwhere(np.tril(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3, -1))])
    assert brute.groups(len(u), [(at[r.a], at[r.b]) for r in found]) == want
    assert len(found) < 150 * 149 / 2  # no pairs of the whole group


def test_simhash_thresholds_reach_every_pair():
    rng = np.random.default_rng(0)
    values = rng.integers(0, simhash.VALUES, (50, 4))
    cost = np.cumsum(rng.random((4, 5, simhash.VALUES)), axis=1)
    found = simhash.thresholds(values, cost, 3)
    assert (found + 1).sum(axis=1).tolist() == [4] * 50
    # the dynamic programme is as cheap as the best of all choices
    choices = [(a, b, c, 4 - a - b - c) for a in range(5) for b in range(5 - a) for c in range(5 - a - b)]
    price = lambda row, some: sum(cost[p][s, values[row, p]] for p, s in enumerate(some))
    for row in range(50):
        assert price(row, found[row] + 1) == pytest.approx(min(price(row, c) for c in choices))


def test_substrings(spark, rows):
    docs = docs_of(spark, rows)
    want = brute.removed_words(rows)
    found = substrings.without_repeats(docs).collect()
    assert len(found) == len(rows)
    assert sum(r.n_removed for r in found) > 60_000
    for r in found:
        all_words, gone = want[r.key]
        kept = [w for w, g in zip(all_words, gone) if not g]
        assert (r.n_words, r.n_removed) == (len(all_words), sum(gone)), r.key
        assert r.kept_sha256 == brute.digest(" ".join(kept).encode())
        assert (r.text or "").encode().split() == [w.encode() for w in kept]
        assert r.rest.score is None
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_substrings_repeated_and_null_keys(spark):
    rng = random.Random(2)
    text = words(rng, 80)
    docs = docs_of(spark, [(3, text), (3, text), (None, text), (7, "x " + text), (7, None)])
    found = sorted((r.key or 0, r.n_removed) for r in substrings.without_repeats(docs).collect())
    assert found == [(0, 0), (3, 0), (3, 0), (7, 0), (7, 80)]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


RAW = lambda ids: np.array(ids, "<u4").tobytes()


def odd_texts(rows):
    rng = random.Random(3)
    letters = "aabcdeé  \n\t 'stmre0123,.!<|>中国éñ  \x1c\x1f😀ÀΣς_²½́ "
    return [t or "" for _, t in rows] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]


@pytest.mark.parametrize("name,make", [
    ("byte_bpe_50k.json", lambda p: tokens.library(p, True)),
    ("byte_bpe_50k.json", lambda p: tokens.automaton(p)[0]),
    ("word_bpe_49k.json", lambda p: tokens.library(p, False)),
])
def test_chunks_give_the_ids_of_whole_texts(rows, name, make):
    some = odd_texts(rows)
    want = [RAW(e.ids) for e in library(name).encode_batch(some, add_special_tokens=False)]
    assert make(public_tokenizers.path(name)).encode(some) == want


def test_small_chunk_memory_changes_nothing(rows):
    chunks, encoder = tokens.automaton(public_tokenizers.path("byte_bpe_50k.json"))
    small = tokens.Chunks(encoder.pieces, encoder.whole, True, most=10)
    some = odd_texts(rows)
    assert [x for i in range(0, len(some), 7) for x in small.encode(some[i : i + 7])] == chunks.encode(some)


class Counted:
    """The tokenizers library; ``asked`` has what its model and its batches were given."""

    def __init__(self, plain):
        self.plain, self.model, self.asked = plain, self, []

    def __getattr__(self, name):
        return getattr(self.plain, name)

    def tokenize(self, piece):
        self.asked.append(piece)
        return self.plain.model.tokenize(piece)

    def encode_batch_fast(self, some, **kw):
        self.asked += some
        return self.plain.encode_batch_fast(some, **kw)


def counted(monkeypatch, tmp_path, name, spaced):
    made = Counted(Tokenizer.from_file(public_tokenizers.path(name)))
    monkeypatch.setattr(tokens, "Tokenizer", SimpleNamespace(from_file=lambda _: made))
    return tokens.library(str(tmp_path / name), spaced), made.asked  # a path that no worker has seen


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_are_merged_once(monkeypatch, tmp_path, name, spaced):
    """A known word is not merged again where it stands before a mark or the end of a line."""
    chunks, asked = counted(monkeypatch, tmp_path, name, spaced)
    some = ["so wordlike Été", "so wordlike, été", "so wordlike.\nwordlike Été;", "so (wordlike, wordlike.\nÉté"]
    want = [RAW(library(name).encode(t, add_special_tokens=False).ids) for t in some]
    assert [chunks.encode([t])[0] for t in some] == want
    assert len(asked) == len(set(asked))


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_small_word_tables_change_nothing(rows, monkeypatch, tmp_path, name, spaced):
    monkeypatch.setattr(tokens, "MOST", 10)
    monkeypatch.setattr(tokens, "LONGEST", 6)
    chunks, _ = counted(monkeypatch, tmp_path, name, spaced)
    some = odd_texts(rows)
    want = [RAW(e.ids) for e in library(name).encode_batch(some, add_special_tokens=False)]
    assert [x for i in range(0, len(some), 7) for x in chunks.encode(some[i : i + 7])] == want
    assert max(map(len, chunks.known)) <= 6 and len(chunks.known) < 3000


def test_release_drops_what_a_worker_keeps():
    made = []
    make = lambda: made.append(1) or tokens.Lately(None)
    table = weakref.ref(common.once("table", make))
    assert common.once("table", make) is table() and len(made) == 1
    common.release()
    assert table() is None  # at once, without a collector's run
    common.once("table", make)
    assert len(made) == 2


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_marks_at_the_end_need_no_split(monkeypatch, tmp_path, name, spaced):
    """A word before marks is told from them without the vocabulary's pattern."""
    split, make = [], tokens.splitter
    monkeypatch.setattr(tokens, "splitter", lambda pattern: lambda text: split.append(text) or make(pattern)(text))
    chunks, _ = counted(monkeypatch, tmp_path, name, spaced)
    some = ["so Élan, words. Marks!?$$$ (no) it's' a1. dots... end' ª! µ.\xa0x ÿ_ \x7f. word'.s. ²,", "so <|odd, x", "so \u0101b, Ā."]
    want = [RAW(e.ids) for e in library(name).encode_batch(some, add_special_tokens=False)]
    assert chunks.encode(some) == want
    assert not {"élan,", "words.", "marks!?$$$", "dots...", "end'", "ª!", "ÿ_"}.intersection(t.strip().lower() for t in split)
    assert any("it's'" in t for t in split)


def test_automaton_against_merging_by_rank():
    """Random merges over a small alphabet, against the plain algorithm."""
    rng = random.Random(8)
    for _ in range(30):
        labels = [bytes([b]) for b in range(256)]
        merges, known = [], {}
        for _ in range(12):
            u, v = (rng.choice([97, 98, 99, *range(256, len(labels))]) for _ in range(2))
            if (u, v) in known or labels[u] + labels[v] in labels:
                continue
            known[u, v] = (len(merges), len(labels))
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
        automaton = bpe.Automaton(list(labels), merges)
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))).encode() for _ in range(60)]
        ids, counts = automaton.encode(texts)
        ends = np.cumsum(counts)
        for text, a, b in zip(texts, ends - counts, ends):
            want = list(text)
            while True:
                best = min((known[p] for p in zip(want, want[1:]) if p in known), default=None)
                if best is None:
                    break
                u, v, w = merges[best[0]]
                i = 0
                while i < len(want) - 1:
                    if (want[i], want[i + 1]) == (u, v):
                        want[i : i + 2] = [w]
                    i += 1
            assert ids[a:b].tolist() == want
        joined, _ = automaton.decode(ids.astype(np.int64))
        assert joined == b"".join(texts)


def test_bpe_round_trip(spark, rows):
    path, plain = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    docs = docs_of(spark, rows + rows[:2] + [(None, "null key")])
    texts = dict(rows)
    found = encoding.round_trip(docs, path).collect()
    assert len(found) == len(rows) + 3
    for r in found:
        ids = plain.encode(texts.get(r.key, "null key") or "", add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False).encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.digest(RAW(ids)), brute.digest(back))
    some = encoding.decoded(encoding.encoded(docs.where("doc_id < 20"), path), path).collect()
    assert {r.key: r.text for r in some} == {k: t or "" for k, t in rows if k < 20}
    assert encoding.round_trip(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("fan_in", [512, 2])
def test_packing(spark, rows, monkeypatch, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    plain = library("byte_bpe_50k.json")
    docs = docs_of(spark, rows + [(None, "null key")]).repartition(7)
    found = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    ids = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for k, t in [*rows, (None, "null key")]}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.ids == RAW(ids[r.key][r.start : r.start + r.length]) and r.ids_crc32 == zlib.crc32(r.ids)
        assert r.doc_tokens == len(ids[r.key]) and r.length > 0
        pieces[r.key].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for some, total in [(pieces[k], len(v)) for k, v in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, n in sorted(some):
            assert start == at
            at += n
        assert at == total if total is not None else at <= 2048
    used = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(u < 2048 for u in used) <= 1  # all leftovers were merged
    assert packing.packed(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_opens_no_more_windows():
    rng, packer = random.Random(4), packing.Packer(64, 5)
    total = 0
    for i in range(500):
        n = rng.randrange(1, 150)
        total += n
        packer.place((i, 0, bytes(4 * n), n))
        assert len(packer.open) <= 5
    assert all(w.used == 64 for w in packer.done)
    packer.pour()
    assert len(packer.open) <= 1
    assert sum(w.used for w in packer.done) + sum(w.used for *_, w in packer.open) == total


def test_shards(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 20_000)
    path, plain = public_tokenizers.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    docs = docs_of(spark, rows + [(5, "again"), (None, "null key")])
    manifest = shards.write_shards(docs, str(tmp_path / "ids"), path)
    found = shards.read_shards(manifest).collect()
    order = sorted([(-1, "null key"), *rows, (5, "again")], key=lambda r: r[0])
    want, at = [], 0
    for k, t in order:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((None if k < 0 else k, at, len(ids), zlib.crc32(RAW(ids))))
        at += len(ids)
    plainly = lambda some: sorted((k if k is not None else -1, n, c) for k, _, n, c in some)
    assert plainly((r.key, r.start, r.n_tokens, r.ids_crc32) for r in found) == plainly(want)
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert all({(r.key, r.start) for r in found} >= {(k, s)} for k, s, *_ in want if k != 5)
    # keyed access to one document
    for row in manifest.collect():
        shard = shards.Shard(row.path)
        some = [k for k, t in rows if row.least is not None and row.least <= k <= row.greatest and k != 5]
        for k in some[:5]:
            texts = dict(rows)
            assert [i.tolist() for i in shard.of(k)] in ([[*plain.encode(texts[k] or "", add_special_tokens=False).ids, 1]], [])
        assert shard.of(10**12) == []
    empty = shards.write_shards(docs.limit(0), str(tmp_path / "none"), path)
    assert shards.read_shards(empty).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        index = shards.PerfectHash.build(keys)
        assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_language(spark):
    rng = random.Random(6)
    parts = {
        "aa": "the and ing tion er ly".split(), "ab": "the ond ang tien ar ly".split(),
        "ba": "ção em os ador não lh".split(), "bb": "ción em os ador no lh".split(),
    }
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(30, 80)), lang) for i, lang in enumerate(sorted(parts) * 60)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ... 456", "aa"), (1003, "the " * 50_000, None), (None, "the and", None)]
    docs = docs_of(spark, rows + odd + rows[:2])
    model = language.fit(docs.where(~language.held_out("doc_id")))
    assert sorted(sorted(model.languages[i] for i in f) for f in model.families) == [["aa", "ab"], ["ba", "bb"]]
    found = language.predicted(docs, model).select("doc_id", "lang", "lang_pred", "score", language.held_out("doc_id").alias("held")).collect()
    assert len(found) == len(rows) + 7
    assert {r.lang_pred for r in found if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held and r.doc_id < 1000]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert language.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language.predicted(docs.limit(3), None).collect()} == {"und"}
    assert language.predicted(docs.limit(0), model).count() == 0


def test_language_reads_nothing_but_texts(spark):
    rows = [(i, ("the and of " if i % 2 else "der und die ") * 20, "en" if i % 2 else "de") for i in range(80)]
    docs = docs_of(spark, rows)
    model = language.fit(docs)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")).withColumn("doc_id", F.col("doc_id") + 500)
    answers = lambda some, shift: {r.doc_id - shift: (r.lang_pred, r.score) for r in language.predicted(some, model).collect()}
    assert answers(docs, 0) == answers(other, 500)


def test_licences(spark):
    rng = random.Random(9)
    notices = [(100 + i, f"{words(rng, 30)}\n{t}\n{words(rng, 10)}", f) for i, (f, t) in enumerate((f, t) for f in licences.TEMPLATES for t in licences.TEMPLATES[f])]
    plain = [(i, "\n".join(words(rng, 20) for _ in range(5))) for i in range(60)] + [(70, None), (71, ""), (72, "The license was lost."), (73, "mit " * 5000)]
    docs = docs_of(spark, plain + [n[:2] for n in notices])
    found = licences.scanned(docs, licences.fit(docs)).collect()
    families = {n[0]: n[2] for n in notices}
    right = {r.key for r in found if r.paragraph == 1 and r.confirmed and families.get(r.key) == r.family}
    assert len(right) >= 0.95 * len(notices)
    assert not [r for r in found if r.confirmed and r.key not in families]
    empty = docs.limit(0)
    assert licences.scanned(empty, licences.fit(empty)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14))
    assert set(llm.ORACLES) == {"op1_pii", "op12_sharding", "op13_spelling"}
