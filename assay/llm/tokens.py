"""Ids of whole texts, put together from chunks that were encoded before.

Words repeat, so a worker keeps the ids of the chunks it has seen. A text is cut only where the
vocabulary's own split cuts it whatever stands around; a text for which that is not certain is
encoded as a whole.
"""

from __future__ import annotations

import os
import re
import string
import struct
from codecs import charmap_decode
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

from assay.llm.bpe import BEYOND, LETTERS, SPLIT, Encoder, byte_alphabet, splitter
from assay.llm.common import once

#: What special tokens begin with.
SPECIAL = "<|"
#: Spaces that may belong to a run of white space.
ODD_BYTES = re.compile(r" (?<=\s )(?=\s|\Z)")
#: Separators that Python splits at and the vocabulary does not.
ODD_WORDS = re.compile("[\x1c-\x1f]")
#: Keys of a table of ``library`` after which it gives way to an empty one.
MOST = 200_000
#: Characters of the longest key that such a table keeps, so that its size is bounded.
LONGEST = 100


class Recent:
    """What was made for a key lately, in two generations of about ``most`` keys each: a key of
    the older one that is asked for again moves to the newer one, the others are forgotten."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], most: int):
        self.make, self.most = make, most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, keys: set[str]) -> dict[str, bytes]:
        """A table with all of the keys."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        fresh = keys.difference(self.new)
        again = fresh.intersection(self.old)
        self.new.update((k, self.old[k]) for k in again)
        fresh = list(fresh.difference(again))
        self.new.update(zip(fresh, self.make(fresh)))
        return self.new


class Chunks:
    """``many`` encodes chunks, ``whole`` any text; both give raw little-endian ids.

    With ``spaced`` a chunk holds the space in front of it.
    """

    def __init__(
        self,
        many: Callable[[list[str]], list[bytes]],
        whole: Callable[[str], bytes],
        spaced: bool,
        most: int = 120_000,
    ):
        self.many, self.whole, self.spaced = many, whole, spaced
        self.odd = ODD_BYTES if spaced else ODD_WORDS
        self.recent = Recent(lambda some: many([" " + w for w in some] if spaced else some), most)

    def encode(self, texts: list[str]) -> list[bytes]:
        odd, space = self.odd.search, " " if self.spaced else None
        lists = [None if SPECIAL in t or odd(t) else t.split(space) for t in texts]
        # the first chunk of a text has no space in front
        heads = [words.pop(0) if self.spaced and words else "" for words in lists if words is not None]
        distinct = set().union(*(words for words in lists if words is not None))
        first = list({h for h in heads if h})
        begin = dict(zip(first, self.many(first))) | {"": b""}
        known, at = self.recent.of(distinct), iter(heads)
        return [
            self.whole(t) if words is None else begin[next(at)] + b"".join(map(known.__getitem__, words))
            for t, words in zip(texts, lists)
        ]


class Lately(dict):
    """``make(key, table)`` for keys, kept as in ``Recent``, but made one at a time when a key is
    missing: a lookup is all that a known key costs. ``make`` asks the table for parts, and to
    keep what it made if that is worth the room."""

    def __init__(self, make: Callable[[str, Lately], bytes], before: Lately | None = None):
        self.make, self.before = make, {} if before is None else before

    def __missing__(self, key: str) -> bytes:
        found = self.before.get(key)
        if found is None:
            return self.make(key, self)
        self[key] = found
        return found

    def keep(self, key: str, found: bytes) -> bytes:
        if len(key) <= LONGEST:
            self[key] = found
        return found

    def aged(self, most: int) -> Lately:
        """The table to go on with: this one, or an empty one that is backed by it."""
        if len(self) <= most:
            return self
        self.before = {}
        return Lately(self.make, self)


class Words:
    """Like ``Chunks``, but ``word`` makes one chunk when it is missing. With ``head``, which gives
    the ids of the first chunk of a text, the others hold the space in front of them."""

    def __init__(
        self,
        word: Callable[[str, Lately], bytes],
        whole: Callable[[str], bytes],
        head: Callable[[str], bytes] | None = None,
    ):
        self.known, self.whole, self.head = Lately(word), whole, head

    def encode(self, texts: list[str]) -> list[bytes]:
        self.known = self.known.aged(MOST)
        of, head, whole, out = self.known.__getitem__, self.head, self.whole, []
        odd, space = (ODD_WORDS, None) if head is None else (ODD_BYTES, " ")
        for text in texts:
            if SPECIAL in text or odd.search(text):
                out.append(whole(text))
                continue
            words = iter(text.split(space))
            first = head(next(words)) if head else b""
            out.append(first + b"".join(map(of, words)))
        return out


#: How the vocabulary of words splits lower-case text: fixed value.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: The characters of the byte alphabet in the order of their bytes, as ``charmap_decode`` takes them.
ALPHABET = "".join(sorted(byte_alphabet(), key=byte_alphabet().get))
#: What ends most chunks that are no plain word: neither letters, numbers nor white space.
MARKS = string.punctuation


def by_model(tokenizer: Tokenizer) -> Callable[[str], bytes]:
    """Ids of a piece, as the vocabulary splits it, from the model of the library alone: its other
    steps cost more than the merges. On the form and class of characters beyond the first 256
    these steps decide, so a piece must not hold any."""
    tokenize = tokenizer.model.tokenize
    pack = [struct.Struct(f"<{n}I").pack for n in range(32)]  # by the number of ids

    def merged(piece: str) -> bytes:
        letters, _ = charmap_decode(piece.encode("utf-8"), "strict", ALPHABET)
        ids = [token.id for token in tokenize(letters)]
        return pack[len(ids)](*ids) if len(ids) < len(pack) else struct.pack(f"<{len(ids)}I", *ids)

    return merged


def spaced_words(merged: Callable[[str], bytes], whole: Callable[[str], bytes]) -> Words:
    """Chunks of the byte vocabulary. The key of a chunk is what stands after its space, so a word
    and the same word before a comma share their ids; ``tight`` has the pieces without a space.
    Chunks of more than two pieces seldom come again; they are put together each time."""
    pieces, beyond = splitter(SPLIT), BEYOND.search
    tight = Lately(lambda piece, table: table.keep(piece, merged(piece)))

    def word(key: str, known: Lately) -> bytes:
        if not key.isascii() and beyond(key):
            return known.keep(key, whole(" " + key))
        if key.isalpha():
            return known.keep(key, merged(" " + key))
        stem = key.rstrip(MARKS)
        if stem.isalpha():
            return known.keep(key, known[stem] + tight[key[len(stem) :]])
        first, *others = pieces(" " + key)
        begin = known[first[1:]] if first[1:].isalpha() else tight[first]
        ids = begin + b"".join(map(tight.__getitem__, others))
        return known.keep(key, ids) if len(others) < 2 else ids

    def head(chunk: str) -> bytes:
        nonlocal tight
        tight = tight.aged(MOST // 8)
        if not chunk.isascii() and beyond(chunk):
            return whole(chunk)
        return b"".join(map(tight.__getitem__, pieces(chunk)))

    return Words(word, whole, head)


def plain_words(merged: Callable[[str], bytes], whole: Callable[[str], bytes]) -> Words:
    """Chunks of the vocabulary of words. The first 256 characters have no other form and change
    case one by one; what holds others is left to the library in one piece."""
    pieces, beyond = splitter(WORD_SPLIT), BEYOND.search

    def word(key: str, known: Lately) -> bytes:
        if not key.isascii() and beyond(key):
            return known.keep(key, whole(key))
        low = key.lower()
        if low.isalpha():
            cut = [low]
        else:
            stem = low.rstrip(MARKS)
            cut = [stem, low[len(stem) :]] if stem.isalpha() else pieces(low)
        ids = merged(key) if cut == [key] else b"".join(map(known.__getitem__, cut))
        return known.keep(key, ids) if len(cut) < 3 else ids

    return Words(word, whole)


def library(path: str, spaced: bool) -> Words:
    """Chunks encoded by the tokenizers library; made once in a worker."""

    def make() -> Words:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def whole(text: str) -> bytes:
            return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

        return (spaced_words if spaced else plain_words)(by_model(tokenizer), whole)

    return once(("library", path), make)


def automaton(path: str):
    """``(chunks, encoder)`` of the tokenization automaton; made once in a worker."""

    def make():
        encoder = Encoder(path)
        return Chunks(encoder.pieces, encoder.whole, True), encoder

    return once(("automaton", path), make)
