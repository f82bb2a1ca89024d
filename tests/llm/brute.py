"""Plain versions of the operators' contracts, row by row."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = "[^\x20\x09-\x0d]+"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def fingerprint(text: str | None, n: int = 3) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(n: int, links) -> list[int]:
    """The smallest position that each position reaches."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash_components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    rows = sorted(rows, key=lambda r: r[0])
    prints = [fingerprint(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3
    ]
    return {rows[i][0]: rows[g][0] for i, g in enumerate(groups(len(rows), links))}


def removed_words(rows: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple[list[str], list[bool]]]:
    """Words of every document and which of them go; keys must be distinct."""
    seen: set[tuple] = set()
    out = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(WORD, text or "")
        spans = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
        gone = [False] * len(words)
        for i, s in enumerate(spans):
            if s in seen:
                gone[i : i + window] = [True] * window
        seen.update(spans)
        out[key] = words, gone
    return out


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def vector_links(x: np.ndarray, least: float) -> list[tuple[int, int]]:
    y = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return [tuple(p) for p in np.argwhere(np.tril(y @ y.T >= least, -1))]


def shard_rule(rows: list[tuple[int | None, str | None]], shards: int, tolerance: float) -> list[tuple]:
    """``(key, size, shard, slot)`` of rows in the order of their hashes, sorted."""
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    sized = [(number(t or ""), number("" if k is None else str(k)), k, len((t or "").encode()) + 16) for k, t in rows]
    sized.sort(key=lambda r: r[:2])
    total, alike = sum(r[3] for r in sized), {}
    for r in sized:
        alike.setdefault(r[0], []).append(r[3])
    below, first, taken, out = 0, {}, {}, []
    for a, _, k, size in sized:
        first.setdefault(a, below)
        group = alike[a]
        if len(group) == 1 or sum(group) * shards <= tolerance * total:
            middle = 2 * first[a] + sum(group)
        else:
            middle = 2 * below + size
        shard = middle * shards // (2 * total)
        out.append((k, size, shard, taken.setdefault(shard, 0)))
        taken[shard] += 1
        below += size
    return out


def cut_words(rows: list[tuple[int | None, str | None]], least: int = 7, often: int = 2) -> dict[str, int]:
    counts: dict[str, int] = {}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= often}


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def spelling(words: dict[str, int], times: int = 10) -> dict[str, tuple]:
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}
