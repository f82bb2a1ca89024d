"""Signature and truncation rules for file payloads, as Catalyst expressions.

A rule is a SQL condition that holds for a broken payload, a reason and a text. Conditions
see ``head`` (the first bytes), ``tail`` (the last bytes), ``length`` and ``ext``, so they
work on a binary column as well as on the few kilobytes a file reader brings along. Rules
over ``whole`` need the complete payload; a file reader leaves them to the whole-file
checks.

A row evaluates the rules of its own kind to one small integer, and the verdict is looked
up once in a constant array: structs inside every rule would outgrow the size limit of
generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.formats import dispatch
from assay.operators.verdicts import REASONS

# Bytes an evidence reader keeps from both ends of a file.
HEAD_BYTES = 4096
TAIL_BYTES = 66_000

# Signatures and trailers of the public format specifications.
JPEG_START, JPEG_END = b"\xff\xd8\xff", b"\xff\xd9"
PNG_START, PNG_END = b"\x89PNG\r\n\x1a\n", b"\x00\x00\x00\x00IEND\xaeB`\x82"
TIFF_LE, TIFF_BE = b"II*\x00", b"MM\x00*"
BIGTIFF_LE, BIGTIFF_BE = b"II+\x00", b"MM\x00+"
OLE_START = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
ZIP_START, ZIP_END = b"PK\x03\x04", b"PK\x05\x06"
HEIF_BRANDS = (b"heic", b"heix", b"heim", b"heis", b"hevc", b"hevx", b"mif1", b"msf1", b"avif", b"avis")
RAW_STARTS = (TIFF_LE, TIFF_BE, b"IIRO", b"IIRS", b"MMOR", b"IIU\x00", b"FUJIFILMCCD-RAW ")
MP4_BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"pnot")
MKV_START = b"\x1aE\xdf\xa3"
AUDIO_STARTS = (b"fLaC", b"ID3", b"ADIF")
# MPEG and ADTS frame sync.
AUDIO_SYNC = (b"\xff\xfb", b"\xff\xfa", b"\xff\xf3", b"\xff\xf2", b"\xff\xf1", b"\xff\xf9")
# Stream each legacy office type must contain.
OLE_STREAMS = {".doc": "WordDocument", ".xls": "Workbook", ".ppt": "PowerPoint Document"}


def _x(value: bytes) -> str:
    return f"X'{value.hex()}'"


def _starts(*options: bytes) -> str:
    return "(" + " OR ".join(f"startswith(head, {_x(o)})" for o in options) + ")"


def _at(pos: int, *options: bytes) -> str:
    return f"(substring(head, {pos}, {len(options[0])}) IN ({', '.join(map(_x, options))}))"


def _ends_with_any_of_last(n: int, value: bytes) -> str:
    return f"contains(substring(tail, -{n}, {n}), {_x(value)})"


def _u32_be(pos: int) -> str:
    return f"cast(conv(hex(substring(head, {pos}, 4)), 16, 10) AS bigint)"


def _u32_le(pos: int) -> str:
    digits = ", ".join(f"hex(substring(head, {pos + i}, 1))" for i in (3, 2, 1, 0))
    return f"cast(conv(concat({digits}), 16, 10) AS bigint)"


_TIFF_ANY = _starts(TIFF_LE, TIFF_BE, BIGTIFF_LE, BIGTIFF_BE)
_FIRST_DIR = f"CASE WHEN {_starts(TIFF_LE)} THEN {_u32_le(5)} ELSE {_u32_be(5)} END"
_DIR_OUTSIDE = (
    f"({_starts(TIFF_LE, TIFF_BE)} AND coalesce({_FIRST_DIR} NOT BETWEEN 8 AND length - 1, true))"
)
_TIFF_SHORT = f"({_DIR_OUTSIDE} OR length < 16)"
_RIFF_SHORT = f"coalesce({_u32_le(5)} + 8 > length, true)"
_WAV = f"({_starts(b'RIFF')} AND {_at(9, b'WAVE')})"
_RAW_KNOWN = f"({_starts(*RAW_STARTS)} OR ({_at(5, b'ftyp')} AND {_at(9, b'crx ')}))"
_VIDEO_SIGNED = (
    f"CASE ext WHEN '.mkv' THEN {_starts(MKV_START)}"
    f" WHEN '.mts' THEN {_at(1, b'G')} OR {_at(5, b'G')} ELSE {_at(5, *MP4_BOXES)} END"
)

Rule = tuple[str, str, str]

RULES: dict[str, list[Rule]] = {
    "jpeg": [
        (f"NOT {_starts(JPEG_START)}", "bad_signature", "not a JPEG stream"),
    ],
    "png": [
        (f"NOT {_starts(PNG_START)}", "bad_signature", "not a PNG stream"),
    ],
    "tiff": [
        (f"NOT {_TIFF_ANY}", "bad_tiff", "not a TIFF stream"),
        (_TIFF_SHORT, "bad_tiff", "first directory lies outside the file"),
    ],
    "webp": [
        (f"NOT ({_starts(b'RIFF')} AND {_at(9, b'WEBP')})", "bad_signature", "not a WebP stream"),
        (_RIFF_SHORT, "truncated", "declared length exceeds the file"),
    ],
    "heif": [
        (f"NOT {_at(5, b'ftyp')}", "bad_signature", "not a HEIF or AVIF stream"),
        (f"NOT {_at(9, *HEIF_BRANDS)}", "unknown_codec", "unsupported codec brand"),
        (f"{_u32_be(1)} > length", "truncated", "declared length exceeds the file"),
    ],
    # A DNG that no camera rule knows may still be a sound TIFF.
    "raw": [
        (
            f"NOT {_RAW_KNOWN} AND ext = '.dng' AND (NOT {_TIFF_ANY} OR {_TIFF_SHORT})",
            "unknown_dng",
            "Camera model not supported, TIFF fallback failed",
        ),
        (f"NOT {_RAW_KNOWN} AND ext <> '.dng'", "unknown_camera", "Camera model not supported"),
        (_DIR_OUTSIDE, "bad_raw", "first directory lies outside the file"),
    ],
    "pdf": [],
    "ooxml": [
        (
            f"NOT {_starts(ZIP_START)} OR NOT {_ends_with_any_of_last(TAIL_BYTES, ZIP_END)}",
            "bad_container",
            "no ZIP frame around the package",
        ),
    ],
    "ole": [
        (f"NOT {_starts(OLE_START)} OR length < 1536", "bad_container", "Not a valid OLE2 container"),
    ],
    "video": [
        (f"NOT {_VIDEO_SIGNED}", "bad_signature", "Invalid data found when processing input"),
    ],
    "audio": [
        (
            f"NOT ({_WAV} OR {_starts(*AUDIO_STARTS)} OR {_at(1, *AUDIO_SYNC)})",
            "unknown_audio",
            "unrecognized audio format — possibly misnamed or empty file",
        ),
        (f"{_WAV} AND {_RIFF_SHORT}", "truncated", "declared length exceeds the file"),
    ],
}

# Marks that must be somewhere in the payload: files may go on after them.
MARKS: dict[str, list[tuple[bytes, str, str]]] = {
    "jpeg": [(JPEG_END, "truncated", "end-of-image marker missing")],
    "png": [(PNG_END, "truncated", "IEND chunk missing")],
    "pdf": [
        (b"%PDF-", "bad_signature", "PDF header not found"),
        (b"%%EOF", "truncated", "EOF marker not found"),
        (b"startxref", "bad_structure", "startxref not found"),
    ],
}
# Kinds that rules over the whole content decide.
RULED = ("pdf",)

# Segments of a JPEG before its picture data, at most: profiles are cut into 255 of them.
SEGMENTS = 1000
# Walks the segments of a JPEG: the place of its first scan, 0 where the chain is broken, and
# below 0 if there is none. What an embedded thumbnail holds is passed over.
_SCAN = f"""-aggregate(sequence(1, {SEGMENTS}), 3L, (at, i) -> CASE
  WHEN at <= 0 THEN at
  WHEN substring(whole, at, 2) = X'ffda' THEN -at
  WHEN substring(whole, at, 2) = X'ffff' THEN at + 1
  WHEN substring(whole, at, 1) = X'ff' AND length(substring(whole, at, 4)) = 4 AND substring(whole, at + 1, 1) NOT IN (X'00', X'd9')
  THEN at + 2 + cast(conv(hex(substring(whole, at + 2, 2)), 16, 10) AS bigint)
  ELSE 0L END)"""
_TEXT = "decode(whole, 'ISO-8859-1')"
_XREF = f"substring_index({_TEXT}, 'startxref', -1)"
_XREF_AT = f"try_cast(regexp_extract({_XREF}, r'^\\s*([0-9]+)', 1) AS bigint)"
# What comes behind the marks: a picture's end behind its own scan, and in a PDF, which grows by
# appended revisions, the last one's table and end.
STRUCTURE: dict[str, list[Rule]] = {
    "jpeg": [
        (f"{_SCAN} = 0", "bad_structure", "broken segment chain"),
        (f"{_SCAN} < 0", "bad_structure", "no scan data"),
        (f"NOT contains(substring(whole, {_SCAN}), X'ffd9')", "truncated", "end-of-image marker missing"),
    ],
    "pdf": [
        (f"NOT contains({_XREF}, '%%EOF')", "truncated", "EOF marker not found"),
        (
            f"coalesce({_XREF_AT} NOT BETWEEN 1 AND length - 1, true)"
            f" OR NOT rlike(substring({_TEXT}, {_XREF_AT} + 1, 64), r'^\\s*(xref|[0-9]+\\s+[0-9]+\\s+obj)')",
            "bad_structure",
            "startxref leads to no table",
        ),
        (
            f"rlike(substring_index({_TEXT}, '%%EOF', -1), r'[0-9]+ +[0-9]+ +obj')",
            "truncated",
            "a revision behind the last EOF marker is cut off",
        ),
    ],
}

WHOLE_RULES: dict[str, list[Rule]] = {
    **{
        kind: [(f"NOT contains(whole, {_x(mark)})", reason, text) for mark, reason, text in marks] + STRUCTURE.get(kind, [])
        for kind, marks in MARKS.items()
    },
    "video": [
        (
            f"ext IN ('.mp4', '.mov', '.m4v') AND NOT contains(whole, {_x(b'moov')})",
            "bad_structure",
            "moov atom not found",
        )
    ],
}

_ANY_KIND: list[Rule] = [
    ("length IS NULL", "missing", "No such file or directory"),
    ("length = 0 AND kind <> 'audio'", "empty", "empty file"),
]

OK_CODE = 0


def _numbered(whole: bool) -> tuple[list[Rule], str]:
    """All rules in code order, and the CASE that yields the code of a row."""
    rules = list(_ANY_KIND)
    arms = [f"WHEN {c} THEN {i}" for i, (c, _, _) in enumerate(rules, 1)]
    for kind, own in RULES.items():
        own = own + (WHOLE_RULES.get(kind, []) if whole else [])
        first = len(rules) + 1
        if not own:
            continue
        inner = " ".join(f"WHEN {c} THEN {i}" for i, (c, _, _) in enumerate(own, first))
        arms.append(f"WHEN kind = '{kind}' THEN CASE {inner} ELSE {OK_CODE} END")
        rules += own
    return rules, f"CASE {' '.join(arms)} ELSE {OK_CODE} END"


def code(whole: bool = False) -> Column:
    """Number of the first broken rule, over columns kind, ext, head, tail, length, whole."""
    return F.expr(_numbered(whole)[1])


def failure(code_column: str, whole: bool = False) -> Column:
    """The verdict behind a code; null for OK_CODE."""
    text = lambda v: "cast(NULL AS string)" if v is None else "'" + v.replace("'", "\\'") + "'"
    verdict = lambda status, error, action: (
        f"named_struct('status', {text(status)}, 'error', {text(error)}, 'suggested_action', {text(action)})"
    )
    cells = [
        verdict(REASONS[reason][0], error, REASONS[reason][1]) for _, reason, error in _numbered(whole)[0]
    ]
    return F.expr(f"CASE WHEN {code_column} <> {OK_CODE} THEN element_at(array({', '.join(cells)}), {code_column}) END")


def no_validator() -> Column:
    """Verdict of rows whose extension no kind is registered for."""
    status, action = REASONS["no_validator"]
    assert action is None
    return F.expr(
        f"CASE WHEN kind IS NULL THEN named_struct('status', '{status}', 'error',"
        " concat('No validator for \\'', ext, '\\''), 'suggested_action', cast(NULL AS string)) END"
    )


def coded(payloads: DataFrame, content: str = "content", name: str = "_code") -> DataFrame:
    """Adds the rule code of each ``(path, content, ...)`` row, with its ext and kind."""
    c = F.col(content)
    routed = dispatch(payloads).withColumns({"head": c, "tail": c, "whole": c, "length": F.length(c)})
    return routed.withColumn(name, code(whole=True)).drop("head", "tail", "whole", "length", "cost_class")


def check_content(payloads: DataFrame, content: str = "content") -> DataFrame:
    """``verdict`` for ``(path, content, ...)`` rows; no Python, no shuffle. Compound files are judged by
    their frame only: ``validate_content`` lists their streams."""
    found = F.coalesce(no_validator(), failure("_code", whole=True), F.expr(_OK))
    return coded(payloads, content).drop(content).withColumn("verdict", found).drop("_code")


_OK = "named_struct('status', 'ok', 'error', cast(NULL AS string), 'suggested_action', cast(NULL AS string))"
