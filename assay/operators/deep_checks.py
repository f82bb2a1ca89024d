"""Checks that need a whole payload: checksums, segment chains and package parts.

Small helpers for use inside ``mapInPandas``. Each takes a seekable binary file and the
extension, and returns ``None`` or ``(reason, error)``. Spark decides what is checked, where,
and how often.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from typing import BinaryIO
from xml.parsers import expat

from assay.operators.compound import Broken, listed
from assay.operators.payload_checks import MARKS, OLE_STREAMS

Finding = tuple[str, str] | None
DeepCheck = Callable[[BinaryIO, str], Finding]

# Parts an office package must contain as well-formed XML.
REQUIRED_PARTS = ("[Content_Types].xml", "_rels/.rels")

# TIFF tags of strip and tile offsets and of their byte counts.
STRIP_TAGS = (273, 279, 324, 325)

_checks: dict[str, DeepCheck] = {}


def deep_check(kind: str) -> Callable[[DeepCheck], DeepCheck]:
    """Registers the whole-payload check of a kind; a later one replaces it."""

    def add(fn: DeepCheck) -> DeepCheck:
        _checks[kind] = fn
        return fn

    return add


def registered() -> dict[str, DeepCheck]:
    return dict(_checks)


class _Part:
    """What one pass over a member of a package shows: does it match its checksum, and is it
    well-formed XML? Members are read in bounded steps."""

    def __init__(self, package: zipfile.ZipFile, entry: zipfile.ZipInfo):
        self.intact, self.xml = True, True
        parser = expat.ParserCreate() if entry.filename in REQUIRED_PARTS else None
        try:
            with package.open(entry) as member:
                while step := member.read(1 << 16):
                    self._parse(parser, step, False)
            self._parse(parser, b"", True)
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError):
            self.intact = False

    def _parse(self, parser, step: bytes, last: bool) -> None:
        if parser is None or not self.xml:
            return
        try:
            parser.Parse(step, last)
        except expat.ExpatError:
            self.xml = False


@deep_check("ooxml")
def package_finding(f: BinaryIO, ext: str) -> Finding:
    """All members are looked at first; then the worst of what was seen is reported: damaged
    members in their order, then required parts that are absent, then broken ones."""
    try:
        package = zipfile.ZipFile(f)
        seen = {entry.filename: _Part(package, entry) for entry in package.infolist()}
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
        return "bad_container", "the package directory can not be read"
    for name, part in seen.items():
        if not part.intact:
            return "bad_structure", f"member {name} does not match its checksum"
    absent = [name for name in REQUIRED_PARTS if name not in seen]
    broken = [name for name in REQUIRED_PARTS if name in seen and not seen[name].xml]
    if absent:
        return "missing_part", f"the package lacks {absent[0]}"
    return ("bad_structure", f"{broken[0]} is not well-formed") if broken else None


def _marks(f: BinaryIO, kind: str) -> Finding:
    """The first mark of a kind that is nowhere in the file."""
    for mark, reason, text in MARKS[kind]:
        f.seek(0)
        if not _contains(f, mark):
            return reason, text
    f.seek(0)
    return None


@deep_check("pdf")
def pdf_revisions(f: BinaryIO, ext: str) -> Finding:
    """The marks, then the last revision: its table is where it says, its end comes behind it,
    and no object begins behind that. Whatever lies before is an earlier revision's."""
    if missing := _marks(f, "pdf"):
        return missing
    f.seek(0)
    at = _last(f, b"startxref")
    f.seek(at)
    end = _last(f, b"%%EOF")
    if end < at:
        return "truncated", "EOF marker not found"
    f.seek(at + len(b"startxref"))
    target = re.match(rb"\s*(\d+)", f.read(64))
    size = f.seek(0, 2)
    f.seek(int(target[1]) if target else 0)
    if not target or not 1 <= int(target[1]) < size or not re.match(rb"\s*(xref|\d+\s+\d+\s+obj)", f.read(64)):
        return "bad_structure", "startxref leads to no table"
    f.seek(end)
    for chunk in _overlapping(f, 64):
        if re.search(rb"[0-9]+ +[0-9]+ +obj", chunk):
            return "truncated", "a revision behind the last EOF marker is cut off"
    return None


@deep_check("png")
def png_chunks(f: BinaryIO, ext: str) -> Finding:
    if missing := _marks(f, "png"):
        return missing
    f.seek(8)
    while True:
        head = f.read(8)
        if len(head) < 8:
            return "truncated", "chunk header cut off"
        length, kind = struct.unpack(">I4s", head)
        body, crc = f.read(length), f.read(4)
        if len(body) < length or len(crc) < 4:
            return "truncated", "chunk cut off"
        if zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            return "bad_structure", f"CRC error in chunk {kind.decode('latin-1')}"
        if kind == b"IEND":
            return None


@deep_check("jpeg")
def jpeg_segments(f: BinaryIO, ext: str) -> Finding:
    """Follows the main picture from segment to segment and through its scans to its own end.

    A frame comes before the first scan, restart markers follow each other in turn, and what an
    embedded thumbnail or bytes behind the end hold does not matter.
    """
    f.seek(2)
    framed = scanned = False
    while True:
        mark = f.read(2)
        while mark == b"\xff\xff":  # fill bytes before a marker
            mark = mark[1:] + f.read(1)
        if len(mark) < 2:
            return "truncated", "end-of-image marker missing"
        if mark[0] != 0xFF or mark[1] == 0x00:
            return "bad_structure", "broken segment chain"
        code = mark[1]
        if code == 0xD9:
            return None if scanned else ("bad_structure", "no scan data")
        size = f.read(2)
        if len(size) < 2 or struct.unpack(">H", size)[0] < 2:
            return "truncated", "segment cut off"
        framed = framed or (0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC))
        f.seek(struct.unpack(">H", size)[0] - 2, 1)
        if code == 0xDA:
            if not framed:
                return "bad_structure", "scan data before a frame header"
            scanned = True
            if found := _scan_data(f):
                return found


#: A marker that picture data does not contain; zeros and restart markers are part of it.
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff([\xd0-\xd7])")


def _scan_data(f: BinaryIO, step: int = 1 << 20) -> Finding:
    """Moves to the marker behind a scan's data."""
    turn, keep = 0, b""
    while chunk := f.read(step):
        data = keep + chunk
        stop = _MARKER.search(data)
        # a last 0xff belongs to what comes next
        upto = stop.start() if stop else len(data) - data.endswith(b"\xff")
        for m in _RESTART.finditer(data, 0, upto):
            if m[1][0] - 0xD0 != turn:
                return "bad_structure", "restart markers out of turn"
            turn = (turn + 1) % 8
        if stop:
            f.seek(stop.start() - len(data), 1)
            return None
        keep = data[upto:]
    return "truncated", "end-of-image marker missing"


@deep_check("tiff")
def tiff_directories(f: BinaryIO, ext: str) -> Finding:
    """Follows the directory chain and requires all strips and tiles to lie in the file; with
    32-bit offsets and, in large files, 64-bit ones."""
    f.seek(0)
    head = f.read(16)
    order = "<" if head[:2] == b"II" else ">"
    large = head[2:4] in (b"+\x00", b"\x00+")
    if not large and head[2:4] not in (b"*\x00", b"\x00*"):
        return None
    word, count_kind, width_of = ("Q", "Q", 8) if large else ("I", "H", 4)
    entry = 12 + 8 * large
    size = f.seek(0, 2)
    at = head[8:16] if large else head[4:8]
    if len(at) < width_of:
        return "bad_tiff", "header cut off"
    offset, seen = struct.unpack(order + word, at)[0], set()
    while offset:
        if offset in seen or offset + 2 > size:
            return "bad_tiff", "directory chain is broken"
        seen.add(offset)
        f.seek(offset)
        raw = f.read(struct.calcsize(order + count_kind))
        if len(raw) < struct.calcsize(order + count_kind):
            return "bad_tiff", "directory cut off"
        count = struct.unpack(order + count_kind, raw)[0]
        if count * entry > size:
            return "bad_tiff", "directory cut off"
        entries = f.read(count * entry + width_of)
        if len(entries) < count * entry + width_of:
            return "bad_tiff", "directory cut off"
        data: dict[int, tuple[int, ...]] = {}
        for i in range(count):
            one = entries[i * entry : (i + 1) * entry]
            tag, kind, n = struct.unpack(order + "HH" + word, one[:-width_of])
            width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8, 16: 8, 17: 8, 18: 8}.get(kind, 1) * n
            at = struct.unpack(order + word, one[-width_of:])[0]
            if width > width_of and at + width > size:
                return "bad_tiff", f"tag {tag} points outside the file"
            if tag in STRIP_TAGS and kind in (3, 4, 16):
                if width > width_of:
                    f.seek(at)
                    raw = f.read(width)
                else:
                    raw = one[-width_of:][:width]
                data[tag] = struct.unpack(f"{order}{n}{ {3: 'H', 4: 'I', 16: 'Q'}[kind] }", raw)
        for places, lengths in ((273, 279), (324, 325)):
            ends = (a + n for a, n in zip(data.get(places, ()), data.get(lengths, ())))
            if any(end > size for end in ends):
                return "bad_tiff", "image data is cut off"
        offset = struct.unpack(order + word, entries[-width_of:])[0]
    return None


@deep_check("video")
def movie_boxes(f: BinaryIO, ext: str) -> Finding:
    """Follows the boxes of a movie file: one of them is ``moov``, and all lie in the file."""
    if ext not in (".mp4", ".mov", ".m4v"):
        return None
    size, at, found, over = f.seek(0, 2), 0, False, False
    while at + 8 <= size:
        f.seek(at)
        length, kind = struct.unpack(">I4s", f.read(8))
        if length == 1:  # the length follows, in 64 bits
            raw = f.read(8)
            length = struct.unpack(">Q", raw)[0] if len(raw) == 8 else 0
        elif length == 0:  # up to the end
            length = size - at
        if length < 8:
            break  # no box any more
        found = found or kind == b"moov"
        over = at + length > size
        at += length
    if not found:
        return "bad_structure", "moov atom not found"
    return ("truncated", "declared length exceeds the file") if over else None


@deep_check("ole")
def office_stream(f: BinaryIO, ext: str) -> Finding:
    """The directory can be followed and lists the stream of the format. The name in a text, or
    of a stream inside an embedded object, does not count."""
    try:
        names = {name for name, _ in listed(f)}
    except Broken as e:
        return "bad_structure", str(e)
    stream = OLE_STREAMS.get(ext)
    return ("missing_part", f"Missing expected OLE stream: '{stream}'") if stream and stream not in names else None


def _overlapping(f: BinaryIO, keep: int, step: int = 1 << 20):
    """The rest of a file in chunks, each with the end of the one before in front."""
    last = b""
    while chunk := f.read(step):
        yield last + chunk
        last = (last + chunk)[-keep:]


def _last(f: BinaryIO, needle: bytes) -> int:
    """Place of the last occurrence from where the file stands on; -1 if there is none."""
    found, end = -1, f.tell()
    for chunk in _overlapping(f, len(needle) - 1):
        end = f.tell()
        at = chunk.rfind(needle)
        if at >= 0:
            found = end - len(chunk) + at
    return found


def _contains(f: BinaryIO, needle: bytes, step: int = 1 << 20) -> bool:
    keep = b""
    while chunk := f.read(step):
        if needle in keep + chunk:
            return True
        keep = chunk[-len(needle) :]
    return False
