"""Byte-pair encoding by a tokenization automaton.

Merges are compiled into a deterministic automaton over tokens, one merge gadget after the
other: the gadget of ``u v -> w`` takes the ``v`` arc from the state that ``u`` leads to and
gives a ``w`` arc to every state from which ``u`` and then ``v`` could be read; ``w`` leads to a
copy of the state after ``v``. A token sequence is an encoding exactly if the automaton can read
it. Copies share what they have in common: a state keeps the gadget that made it, and an arc is
decided by following the gadgets back, once; decided arcs are kept in a table.

A second table reads bytes: at every position of a pre-split word it names the longest token
that ends there. Encoding steps through both tables for many words at the same time: the last
token of a prefix is the longest one whose arc leaves the last token of what stands before it.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex

#: The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the
#: others are numbered from 256 (a fixed rule of the file format).
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level vocabularies split text before merging: fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = -1
#: Letters, numbers and white space among the first 256 characters, for ``re``, which is much
#: faster than ``regex`` but does not know the classes of other characters.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t\n\x0b\x0c\r\x20\x85\xa0"
BEYOND = re.compile("[^\x00-\xff]")


def splitter(pattern: str):
    """``findall`` of a pattern with the classes ``\\p{L}``, ``\\p{N}`` and ``\\s``."""
    exact = regex.compile(pattern).findall
    near = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]").replace(r"(?!\S)", f"(?![^{SPACES}])")
    near = near.replace(r"[\p{L}]", f"[{LETTERS}]").replace(r"[\p{N}]", f"[{NUMBERS}]")
    near = near.replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]").replace(r"\s", f"[{SPACES}]")
    fast, beyond = re.compile(near).findall, BEYOND.search
    return lambda text: fast(text) if text.isascii() or not beyond(text) else exact(text)


def byte_alphabet() -> dict[str, int]:
    other = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """The compiled vocabulary. ``bytes_of[i]`` is the label of token ``i``."""

    def __init__(self, vocabulary: list[bytes | None], merges: list[tuple[int, int, int]]):
        n = len(vocabulary)
        self.bytes_of = vocabulary
        self.lengths = np.array([len(v) if v is not None else 0 for v in vocabulary], np.int64)
        # gadgets: who a token was made from and when; bytes come before all merges
        self.left = np.arange(n)
        self.right = np.arange(n)
        self.time = np.full(n, NONE, np.int64)
        keys = np.zeros(len(merges), np.int64)
        for t, (u, v, w) in enumerate(merges):
            keys[t] = u * n + v
            if self.time[w] == NONE:  # the first gadget that makes a token counts
                self.left[w], self.right[w], self.time[w] = u, v, t
        order = np.argsort(keys, kind="stable")
        self.pairs, self.pair_time = keys[order], order.astype(np.int64)
        self.n = n
        self._arcs_key = np.full(1 << 20, NONE, np.int64)
        self._arcs = np.zeros(1 << 20, bool)
        self._compile_suffixes()

    # -- arcs between tokens ------------------------------------------------------------

    def _merged_before(self, u: np.ndarray, v: np.ndarray, time: np.ndarray) -> np.ndarray:
        key = u * self.n + v
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return (self.pairs[at] == key) & (self.pair_time[at] < time) if len(self.pairs) else np.zeros(len(u), bool)

    def decide(self, u: np.ndarray, v: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether ``v`` can follow ``u`` after the gadgets ``until`` a time (none: after all)."""
        u, v = u.copy(), v.copy()
        ok = np.ones(len(u), bool)
        time = np.full(len(u), len(self.pairs) + 1, np.int64) if until is None else until.copy()
        live = np.arange(len(u))
        while len(live):
            cut = self._merged_before(u[live], v[live], time[live])
            ok[live[cut]] = False
            live = live[~cut]
            tu, tv = self.time[u[live]], self.time[v[live]]
            live = live[np.maximum(tu, tv) > NONE]
            tu, tv = self.time[u[live]], self.time[v[live]]
            # the younger token is undone. A state made by a gadget lacks the arcs removed
            # before it; an arc made by a gadget needs its first half to be readable then, and
            # of equal merges the left one comes first
            first = tu > tv
            a, b = live[first], live[~first]
            time[a], u[a] = tu[first], self.right[u[a]]
            time[b], v[b] = tv[~first] + 1, self.left[v[b]]
        return ok

    def arcs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """``decide`` through the table of decided arcs."""
        key = u * self.n + v
        slot = ((key * 0x9E3779B1) >> 12) & (len(self._arcs_key) - 1)
        open_ = np.flatnonzero(self._arcs_key[slot] != key)
        out = self._arcs[slot]
        if len(open_):
            fresh, back = np.unique(key[open_], return_inverse=True)
            found = self.decide(fresh // self.n, fresh % self.n)
            out[open_] = found[back]
            at = ((fresh * 0x9E3779B1) >> 12) & (len(self._arcs_key) - 1)
            # of several keys for a slot one stays, with its own answer
            at, one = np.unique(at, return_index=True)
            self._arcs_key[at] = fresh[one]
            self._arcs[at] = found[one]
        return out

    # -- longest token that ends at a position ------------------------------------------

    def _compile_suffixes(self) -> None:
        """Byte transitions to the longest suffix that begins a token. Rows are shared by the
        states that have no child: they move like the state they fall back to."""
        child: list[dict[int, int]] = [{}]
        token = [NONE]
        # a token is read only if its halves are and can stand side by side when it is made;
        # a vocabulary may hold others, which no text gives
        sound = self.decide(self.left, self.right, self.time)
        for i in np.argsort(self.time, kind="stable").tolist():
            if self.time[i] > NONE:
                sound[i] = sound[i] and sound[self.left[i]] and sound[self.right[i]]
            else:
                sound[i] = True
        for i, label in enumerate(self.bytes_of):
            if label is None or (len(label) != 1 if self.time[i] == NONE else not sound[i]):
                continue
            state = 0
            for byte in self.bytes_of[i]:
                nxt = child[state].get(byte)
                if nxt is None:
                    nxt = len(child)
                    child[state][byte] = nxt
                    child.append({})
                    token.append(NONE)
                state = nxt
            token[state] = i
        states = len(child)
        row = np.full(states, NONE, np.int64)
        inner = [s for s in range(states) if child[s]]
        row[inner] = np.arange(len(inner))
        move = np.zeros((len(inner), 256), np.int32)
        longest = np.full(states, NONE, np.int64)  # token at this state or below
        shorter = np.full(self.n, NONE, np.int64)  # next shorter token that ends a token
        back = np.zeros(states, np.int64)
        queue = [0]
        for state in queue:
            mine = move[row[state]]
            if state:
                mine[:] = move[row[back[state]]]
            for byte, nxt in child[state].items():
                back[nxt] = mine[byte] if state else 0
                below = longest[back[nxt]]
                if token[nxt] != NONE:
                    longest[nxt] = token[nxt]
                    shorter[token[nxt]] = below
                else:
                    longest[nxt] = below
                mine[byte] = nxt
                if row[nxt] == NONE:
                    row[nxt] = row[back[nxt]]
                else:
                    queue.append(nxt)
        self.move, self.row, self.longest, self.shorter = move, row, longest, shorter

    # -- encoding and decoding ------------------------------------------------------------

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        most = 8
        below = 0
        while below < (size.max() if len(size) else 0):
            some = np.flatnonzero((size > below) & (size <= most))
            for i in range(0, len(some), max(1, 4_000_000 // most)):
                part = some[i : i + max(1, 4_000_000 // most)]
                part = part[np.argsort(-size[part], kind="stable")]
                ids, counts[part] = self._encode(b"".join([words[k] for k in part]), size[part])
                found.append((part, ids))
            below, most = most, most * 2
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for part, ids in found:
            n = counts[part]
            at = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))
            out[at] = ids
        return out, counts

    def _encode(self, flat: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of similar length, longest first, all stepped through the tables together."""
        n, most = len(size), int(size[0])
        text = np.zeros((n, most), np.uint8)
        text[np.arange(most) < size[:, None]] = np.frombuffer(flat, np.uint8)
        last = np.full((most + 1, n), NONE, np.int64)
        state = np.zeros(n, np.int64)
        longer = np.searchsorted(-size, -np.arange(most), side="left")  # words with more bytes
        for i in range(most):
            k = longer[i]
            state = self.move[self.row[state[:k]], text[:k, i]]
            candidate = self.longest[state]
            open_ = np.arange(k)
            while len(open_):
                token = candidate[open_]
                before = i + 1 - self.lengths[token]
                previous = last[before, open_]
                inner = np.flatnonzero(before > 0)
                ok = np.ones(len(open_), bool)
                ok[inner] = self.arcs(previous[inner], token[inner])
                last[i + 1, open_[ok]] = token[ok]
                open_ = open_[~ok]
                candidate[open_] = self.shorter[token[~ok]]
        counts = np.zeros(n, np.int64)
        steps = []
        at, words = size.copy(), np.arange(n)
        while len(words):
            token = last[at[words], words]
            steps.append((words, token))
            counts[words] += 1
            at[words] -= self.lengths[token]
            words = words[at[words] > 0]
        out = np.zeros(int(counts.sum()), np.uint32)
        end = np.cumsum(counts) - 1
        for step, (words, token) in enumerate(steps):
            out[end[words] - step] = token
        return out, counts

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The labels of all ids in turn, and where each label ends."""
        if not hasattr(self, "_labels"):
            joined = b"".join(v or b"" for v in self.bytes_of)
            self._labels = np.frombuffer(joined, np.uint8), np.cumsum(self.lengths) - self.lengths
        labels, begins = self._labels
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = np.repeat(begins[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return labels[at].tobytes(), ends


def load(path: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton of a byte-level vocabulary file, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    alphabet = byte_alphabet()
    vocabulary, special = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
    labels: list[bytes | None] = [None] * (max([*vocabulary.values(), *special.values()]) + 1)
    for token, i in vocabulary.items():
        labels[i] = bytes(alphabet[c] for c in token)
    merges = []
    for pair in file["model"]["merges"]:
        u, v = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((vocabulary[u], vocabulary[v], vocabulary[u + v]))
    # specials are never read from bytes, only written
    automaton = Automaton(labels, merges)
    for token, i in special.items():
        automaton.bytes_of[i] = token.encode()
        automaton.lengths[i] = len(automaton.bytes_of[i])
    return automaton, special


class Encoder:
    """Texts to ids: special strings, then the pre-split, then the automaton."""

    def __init__(self, path: str):
        self.automaton, special = load(path)
        self.special = {s: np.uint32(i).tobytes() for s, i in special.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.split = splitter(SPLIT)

    def pieces(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without special strings."""
        lists = [self.split(c) for c in chunks]
        distinct = list(set().union(*lists))
        ids, counts = self.automaton.encode([p.encode("utf-8") for p in distinct])
        raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        known = dict(zip(distinct, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in lists]

    def whole(self, text: str) -> bytes:
        """Ids of any text."""
        parts = self.special_pattern.split(text) if self.special else [text]
        return b"".join(self.special.get(p) or self.pieces([p])[0] for p in parts if p)
