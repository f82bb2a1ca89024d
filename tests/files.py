"""Small files of each format, sound and damaged, written by the tests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib


def jpeg() -> bytes:
    segment = lambda code, body: bytes([0xFF, code]) + struct.pack(">H", len(body) + 2) + body
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            segment(0xDB, bytes(65)),
            segment(0xC0, b"\x08\0\1\0\1\1\1\x11\0"),
            segment(0xDA, b"\1\1\0\0?\0"),
            b"\x12\x34\x56",
            b"\xff\xd9",
        ]
    )


def png() -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(b"\0\xff\0\0"))
        + chunk(b"IEND", b"")
    )


def tiff(magic: bytes = b"II*\0") -> bytes:
    order = "<" if magic[:2] == b"II" else ">"
    entry = lambda tag, kind, n, v: struct.pack(order + "HHII", tag, kind, n, v)
    entries = entry(256, 4, 1, 1) + entry(257, 4, 1, 1) + entry(273, 4, 1, 50) + entry(279, 4, 1, 3)
    return magic + struct.pack(order + "I", 8) + struct.pack(order + "H", 4) + entries + bytes(4) + bytes(20)


def webp() -> bytes:
    return b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + bytes(8)


def pdf() -> bytes:
    return b"%PDF-1.4\n1 0 obj<</Type/Catalog>>endobj\nxref\n0 1\ntrailer<</Root 1 0 R>>\nstartxref\n40\n%%EOF\n"


def docx(parts: dict[str, str] | None = None) -> bytes:
    buffer = io.BytesIO()
    base = {"[Content_Types].xml": "<Types/>", "_rels/.rels": "<Relationships/>", "word/document.xml": "<w>hi</w>"}
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in (parts or base).items():
            z.writestr(name, text)
    return buffer.getvalue()


def ole(stream: str = "WordDocument", text: str = "", inside: str | None = None) -> bytes:
    """A compound file: table in sector 0, directory in sector 1, text in sector 2."""

    def entry(name: str, kind: int, child: int) -> bytes:
        raw = name.encode("utf-16-le") + bytes(2)
        links = struct.pack("<HBBiii", len(raw), kind, 1, -1, -1, child)
        return raw.ljust(64, b"\0") + links + bytes(48)

    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<8i", 1, 1, 0, 4096, -2, 0, -2, 0) + struct.pack("<i", 0)
    table = struct.pack("<3i", -3, -2, -2)
    names = entry("Root Entry", 5, 1) + (entry(inside, 1, 2) + entry(stream, 2, -1) if inside else entry(stream, 2, -1))
    sectors = [head.ljust(512, b"\xff"), table.ljust(512, b"\xff"), names.ljust(512, b"\0")]
    return b"".join(sectors) + text.encode("utf-16-le").ljust(512, b"\0")


def mp4() -> bytes:
    return b"\0\0\0\x18ftypisom" + bytes(12) + b"\0\0\0\x08moov"


def wav(declared: int | None = None) -> bytes:
    body = b"WAVEfmt " + bytes(20)
    return b"RIFF" + struct.pack("<I", len(body) if declared is None else declared) + body
