"""Compound office files around a text, for queries that walk them."""

from __future__ import annotations

import struct

START = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE, SOUND, TABLE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
#: Where ``front`` has the size of its first stream.
SIZE_AT = 512 + 512 + 128 + 120


def _header(shift: int, tables: list[int], first: int) -> bytes:
    words = [len(tables), first, 0, 4096, SOUND, 0, SOUND, 0, *(tables + [FREE] * 109)[:109]]
    versions = struct.pack("<HHHHH", 0x3E, 3 if shift == 9 else 4, 0xFFFE, shift, 6)
    head = START + bytes(16) + versions + bytes(10) + struct.pack("<117I", *words)
    return head.ljust(1 << shift, b"\0")


def _entry(name: str, kind: int, right: int = FREE, child: int = FREE, size: int = 0) -> bytes:
    raw = name.encode("utf-16-le") + b"\0\0"
    links = struct.pack("<HBBIII", len(raw), kind, 1, FREE, right, child)
    return raw.ljust(64, b"\0") + links + bytes(36) + struct.pack("<IQ", SOUND, size)


def front(
    top: str = "WordDocument", inner: str = "Contents", more: str | None = None,
    chain: dict[int, int] | None = None, first: int = 1,
) -> bytes:
    """A header, the table and a directory of two sectors, the second one free unless ``chain``
    goes on to it. Stream ``top`` and storage ``ObjectPool`` with ``inner`` are listed, and ``more``."""
    words = [TABLE, SOUND, FREE] + [FREE] * 125
    for at, to in (chain or {}).items():
        words[at] = to
    entries = [
        _entry("Root Entry", 5, child=1), _entry(top, 2, right=2),
        _entry("ObjectPool", 1, right=4 if more else FREE, child=3), _entry(inner, 2, size=7),
    ]
    if more:
        entries.append(_entry(more, 2, size=3))
    return _header(9, [0], first) + struct.pack("<128I", *words) + b"".join(entries).ljust(1024, b"\0")


def compound_file(body: bytes) -> bytes:
    """A file with large sectors whose directory and table lie behind the text."""
    held = -(-len(body) // 4096)
    words = [i + 1 for i in range(held - 1)] + [SOUND] * min(held, 1) + [SOUND]
    tables = -(-(len(words) + 1) // 1023)  # they name themselves, too
    if tables > 109:
        raise ValueError("a text of over 400 MB needs further lists")
    words += [TABLE] * tables
    entries = _entry("Root Entry", 5, child=1) + _entry("WordDocument", 2, size=len(body))
    places = [held + 1 + i for i in range(tables)]
    raw = struct.pack(f"<{len(words)}I", *words).ljust(tables * 4096, b"\xff")
    return _header(12, places, held) + body.ljust(held * 4096, b"\0") + entries.ljust(4096, b"\0") + raw
