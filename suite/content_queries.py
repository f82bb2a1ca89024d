"""Validity of table content and of payloads Spark derives from the documents."""

from __future__ import annotations

import io
import os
import struct
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assay.functions.paths import report_ext
from assay.operators import compound, fingerprints, table_checks
from assay.operators.changes import classify
from assay.operators.formats import spread
from assay.operators.payload_checks import OLE_STREAMS, check_content
from assay.operators.validation import validate_content, validate_files
from assay.operators.verdicts import flat
from assay.session import run_dir
from assay.sources.inventory import read_inventory
from assay.streaming.scan_stream import check_payload_stream
from suite.adapters import AS_OF, table
from suite.compound_files import SIZE_AT, SOUND, compound_file, front
from suite.registry import query

RESTORE = "'Restore from backup or re-download'"


def _verdict_sql(source: str, key: str, cases: list[tuple[str, str, str]]) -> str:
    """Oracle text: (condition, status, error) in order; corrupt rows carry the advice."""
    when = lambda i: " ".join(f"WHEN {c[0]} THEN {c[i] if i == 2 else repr(c[i])}" for c in cases)
    return f"""WITH src AS ({source}), v AS (
SELECT {key}, CASE {when(1)} ELSE 'ok' END AS status, CASE {when(2)} END AS error FROM src)
SELECT *, CASE WHEN status = 'corrupt' THEN {RESTORE} END AS suggested_action FROM v"""


@query(_verdict_sql("SELECT page_id, html FROM pages", "page_id", [
    ("html IS NULL OR trim(html) = ''", "unreadable", "'empty page'"),
    ("NOT lower(ltrim(html)) LIKE '<!doctype html%'", "corrupt", "'doctype missing'"),
    ("NOT regexp_matches(lower(html), '</html\\s*>')", "corrupt", "'closing html tag missing'"),
]))
def page_verdicts(spark, sf):
    pages = table(spark, sf, "pages")
    return flat(pages.select("page_id", table_checks.page_verdict(F.col("html")).alias("verdict")))


def _props(spark, sf):
    damaged = (
        F.when(F.col("event_id") % 41 == 0, None)
        .when(F.col("event_id") % 37 == 0, F.expr("left(props, length(props) - 1)"))
        .when(F.col("event_id") % 43 == 0, F.replace("props", F.lit('"k"'), F.lit('"q"')))
        .otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select("event_id", damaged.alias("props"))


@query(_verdict_sql("""SELECT event_id, CASE WHEN event_id % 41 = 0 THEN NULL
     WHEN event_id % 37 = 0 THEN left(props, length(props) - 1)
     WHEN event_id % 43 = 0 THEN replace(props, '"k"', '"q"') ELSE props END AS props FROM events""", "event_id", [
    ("props IS NULL", "unreadable", "'no record'"),
    ("NOT json_valid(props)", "corrupt", "'not well-formed JSON'"),
    ("CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') IS NULL END", "corrupt",
     "'Missing required key: k'"),
]))
def props_verdicts(spark, sf):
    rows = _props(spark, sf)
    return flat(rows.select("event_id", table_checks.json_verdict(F.col("props"), ["k"]).alias("verdict")))


@query(_verdict_sql("""SELECT doc_id, n_chars, CASE WHEN doc_id % 43 = 0 THEN ''
     WHEN doc_id % 41 = 0 THEN left(text, length(text) // 2)
     WHEN doc_id % 47 = 0 THEN left(text, length(text) - 1) || chr(65533) ELSE text END AS text FROM documents""", "doc_id", [
    ("text = ''", "unreadable", "'empty text'"),
    ("length(text) <> n_chars", "corrupt", "'length ' || length(text) || ', expected ' || n_chars"),
    ("contains(text, chr(65533))", "corrupt", "'replacement character'"),
]))
def doc_verdicts(spark, sf):
    damaged = (
        F.when(F.col("doc_id") % 43 == 0, "")
        .when(F.col("doc_id") % 41 == 0, F.expr("left(text, length(text) div 2)"))
        .when(F.col("doc_id") % 47 == 0, F.expr("concat(left(text, length(text) - 1), '�')"))
        .otherwise(F.col("text"))
    )
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", damaged.alias("text"))
    return flat(rows.select("doc_id", table_checks.text_verdict(F.col("text"), F.col("n_chars")).alias("verdict")))


@query(_verdict_sql("""SELECT vec_id, CASE WHEN vec_id % 31 = 0 THEN list_transform(embedding, lambda x: 0.0::FLOAT)
     WHEN vec_id % 29 = 0 THEN embedding[:63]
     WHEN vec_id % 37 = 0 THEN list_transform(embedding, lambda x: 'nan'::FLOAT) ELSE embedding END AS embedding
     FROM embeddings""", "vec_id", [
    ("embedding IS NULL", "unreadable", "'no vector'"),
    ("len(embedding) <> 64", "corrupt", "'dimension ' || len(embedding) || ', expected 64'"),
    ("len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0", "corrupt", "'value is not finite'"),
    ("len(list_filter(embedding, lambda x: x <> 0)) = 0", "corrupt", "'zero vector'"),
]))
def vector_verdicts(spark, sf):
    v = F.col("embedding")
    damaged = (
        F.when(F.col("vec_id") % 31 == 0, F.transform(v, lambda x: F.lit(0.0).cast("float")))
        .when(F.col("vec_id") % 29 == 0, F.slice(v, 1, 63))
        .when(F.col("vec_id") % 37 == 0, F.transform(v, lambda x: F.lit(float("nan")).cast("float")))
        .otherwise(v)
    )
    rows = table(spark, sf, "embeddings").select("vec_id", damaged.alias("embedding"))
    return flat(rows.select("vec_id", table_checks.vector_verdict(F.col("embedding"), 64).alias("verdict")))


@query(_verdict_sql("""SELECT conv_id, count(DISTINCT turn) AS present, max(turn) + 1 AS expected, count(*) AS n FROM
     (SELECT * FROM conversations WHERE NOT (turn = 1 AND conv_id % 7 = 0)
      UNION ALL SELECT * FROM conversations WHERE turn = 0 AND conv_id % 11 = 0) GROUP BY conv_id""", "conv_id", [
    ("present < expected", "corrupt", "'missing ' || (expected - present) || ' of ' || expected"),
    ("n > present", "corrupt", "'repeated position'"),
]))
def conversation_verdicts(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    kept = rows.where(~((F.col("turn") == 1) & (F.col("conv_id") % 7 == 0)))
    repeated = rows.where((F.col("turn") == 0) & (F.col("conv_id") % 11 == 0))
    return flat(table_checks.sequence_verdicts(kept.unionByName(repeated), "conv_id", "turn"))


@query("""WITH v AS (SELECT CASE WHEN NOT lower(ltrim(html)) LIKE '<!doctype html%' THEN 'doctype missing'
  WHEN NOT regexp_matches(lower(html), '</html\\s*>') THEN 'closing html tag missing' END AS error FROM pages)
SELECT CASE WHEN error IS NULL THEN 'ok' ELSE 'corrupt' END AS status, error, count(*) AS cnt FROM v GROUP BY error""")
def page_summary(spark, sf):
    pages = table(spark, sf, "pages")
    return table_checks.status_summary(pages.select(table_checks.page_verdict(F.col("html")).alias("verdict")))


# --- payloads derived from the documents -------------------------------------------

# Extension by doc_id % 15, damage by (doc_id // 15) % 5.
EXTS = (
    ".jpg", ".PNG", ".tif", ".heic", ".webp", ".cr2", ".dng", ".pdf", ".docx", ".doc", ".mp4", ".mkv", ".mp3", ".wav",
    ".xyz",
)


# A frame header and the header of a scan; picture data follows.
JPEG_HEAD = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"


def payloads(docs: DataFrame) -> DataFrame:
    """``(doc_id, path, content)``: the text inside a container of each format.

    Damage 0 and 4 is none (4 makes a HEIF brand and a DNG variant unknown), 1 cuts the
    trailer or breaks a declared length, 2 leaves the bare text, 3 leaves nothing.
    """
    x = lambda b: f"X'{b.hex()}'"
    unless_cut = lambda tail: f"CASE WHEN damage = 1 THEN X'' ELSE {tail} END"
    le = lambda n: "concat(" + ", ".join(f"substring(unhex(lpad(hex({n}), 8, '0')), {i}, 1)" for i in (4, 3, 2, 1)) + ")"
    first_dir = le("CASE WHEN damage = 1 THEN n + 500 ELSE 8 END")
    declared = le("n + CASE WHEN damage = 1 THEN 104 ELSE 4 END")
    pad16, pad2k = x(bytes(16)), "unhex(repeat('00', 2048))"
    parts = {
        ".jpg": [x(JPEG_HEAD), "body", unless_cut("X'ffd9'")],
        ".PNG": [x(b"\x89PNG\r\n\x1a\n"), "body", unless_cut(x(b"\0\0\0\0IEND\xaeB`\x82"))],
        ".tif": [x(b"II*\0"), first_dir, "body", pad16],
        ".heic": [
            x(b"\0\0\0\x18ftyp"), f"CASE WHEN damage = 4 THEN {x(b'zzzz')} ELSE {x(b'heic')} END",
            unless_cut(f"concat(body, {pad16})"),
        ],
        ".webp": [x(b"RIFF"), declared, x(b"WEBP"), "body"],
        ".cr2": [x(b"II*\0"), first_dir, x(b"CR"), "body", pad16],
        ".dng": [f"CASE WHEN damage = 4 THEN {x(b'II+' + bytes(1))} ELSE {x(b'II*' + bytes(1))} END", first_dir, "body", pad16],
        ".pdf": [x(b"%PDF-1.4\nxref\n"), "body", unless_cut(x(b"\nstartxref\n9\n%%EOF\n"))],
        ".docx": [x(b"PK\x03\x04"), "body", unless_cut(x(b"PK\x05\x06" + bytes(18)))],
        # without its stream the name still stands behind the text
        ".doc": [
            f"CASE WHEN damage = 1 THEN {x(front('Notes'))} ELSE {x(front())} END", "body",
            x("WordDocument".encode("utf-16-le")), pad2k,
        ],
        ".mp4": [x(b"\0\0\0\x18ftypisom" + bytes(12)), "mdat", "body", unless_cut(x(b"\0\0\0\x08moov"))],
        ".mkv": [x(b"\x1aE\xdf\xa3"), "body"],
        ".mp3": [x(b"ID3"), "body"],
        ".wav": [x(b"RIFF"), declared, x(b"WAVE"), "body"],
    }
    parts[".mp4"][1] = f"unhex(lpad(hex(n + 8), 8, '0')), {x(b'mdat')}"
    forms = " ".join(f"WHEN {i} THEN concat({', '.join(parts[e])})" for i, e in enumerate(EXTS) if e in parts)
    exts = ", ".join(f"'{e}'" for e in EXTS)
    return (
        docs.selectExpr(
            "doc_id", "encode(text, 'UTF-8') AS body", "doc_id div 15 % 5 AS damage",
            "cast(doc_id % 15 AS int) AS form", "octet_length(text) AS n",
        )
        .selectExpr(
            "doc_id",
            f"concat('/docs/d', doc_id, element_at(array({exts}), form + 1)) AS path",
            f"CASE damage WHEN 3 THEN X'' WHEN 2 THEN body ELSE CASE form {forms} ELSE body END END AS content",
        )
    )


_SIGNATURE_ERRORS = {
    0: "not a JPEG stream", 1: "not a PNG stream", 2: "not a TIFF stream", 3: "not a HEIF or AVIF stream",
    4: "not a WebP stream", 5: "Camera model not supported", 6: "Camera model not supported, TIFF fallback failed",
    7: "PDF header not found", 8: "no ZIP frame around the package", 9: "Not a valid OLE2 container",
    10: "Invalid data found when processing input", 11: "Invalid data found when processing input",
    12: "unrecognized audio format — possibly misnamed or empty file",
    13: "unrecognized audio format — possibly misnamed or empty file",
}
_CUT_ERRORS = {
    0: "end-of-image marker missing", 1: "IEND chunk missing", 2: "first directory lies outside the file",
    3: "declared length exceeds the file", 4: "declared length exceeds the file",
    5: "first directory lies outside the file", 6: "first directory lies outside the file", 7: "EOF marker not found",
    8: "no ZIP frame around the package", 9: "Missing expected OLE stream: 'WordDocument'",
    10: "moov atom not found", 13: "declared length exceeds the file",
}


def _payload_sql() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    pick = lambda errors: "CASE f " + " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in errors.items()) + " END"
    exts = ", ".join(lit(e) for e in EXTS)
    return f"""WITH p AS (
  SELECT doc_id, doc_id % 15 AS f, (doc_id // 15) % 5 AS damage,
         '/docs/d' || doc_id || ([{exts}])[doc_id % 15 + 1] AS path FROM documents),
e AS (SELECT *, CASE
   WHEN f = 14 THEN 'No validator for ''.xyz'''
   WHEN damage = 3 AND f NOT IN (12, 13) THEN 'empty file'
   WHEN damage IN (2, 3) THEN {pick(_SIGNATURE_ERRORS)}
   WHEN damage = 1 THEN {pick(_CUT_ERRORS)}
   WHEN damage = 4 AND f = 3 THEN 'unsupported codec brand' END AS error FROM p),
s AS (SELECT *, CASE WHEN error IS NULL THEN 'ok'
   WHEN f = 14 OR error LIKE 'unrecognized audio%' OR error LIKE 'Camera model%' OR error LIKE 'unsupported codec%'
   THEN 'unsupported' ELSE 'corrupt' END AS status FROM e)
SELECT path, status, error, CASE
   WHEN error LIKE '%TIFF fallback failed' THEN 'Update rawpy or check DNG variant'
   WHEN error LIKE 'Camera model%' THEN 'Update rawpy/LibRaw for this camera model'
   WHEN error LIKE 'unsupported codec%' THEN 'Update pillow-heif / libheif'
   WHEN status = 'corrupt' AND f = 2 AND damage <> 3 THEN 'Restore from backup; TIFF IFD chain may be damaged'
   WHEN status = 'corrupt' AND f IN (5, 6) AND damage <> 3 THEN NULL
   WHEN status = 'corrupt' THEN {RESTORE} END AS suggested_action
FROM s"""


@query(_payload_sql())
def payload_verdicts(spark, sf):
    """Signature and truncation rules on a payload per document; compound files are walked."""
    return flat(check_payloads(payloads(table(spark, sf, "documents"))))


def check_payloads(rows: DataFrame) -> DataFrame:
    """``(path, verdict)``; Python sees the payloads of compound files only."""
    office = F.col("path").endswith(".doc")
    ruled = check_content(rows.where(~office)).select("path", "verdict")
    return ruled.unionByName(validate_content(rows.where(office)).select("path", "verdict"))


@query(_payload_sql())
def payload_check_stream(spark, sf):
    """The same as a stream that is checked, and a second run with its checkpoint that finds nothing to do."""
    folder = run_dir(spark, "payload-checks")
    schema = table(spark, sf, "documents").schema
    # A glob, because a stream does not accept the name of a single file.
    docs = spark.readStream.schema(schema).parquet(f"{sf}/documents.{{parquet}}")
    for _ in range(2):
        check_payload_stream(payloads(docs), f"{folder}/log", f"{folder}/checkpoint", "s1", check_payloads).awaitTermination()
    return spark.read.parquet(f"{folder}/log").select("path", "status", "error", "suggested_action")


# Where the first strip of a RAW file begins: behind its header and a directory of two entries.
_STRIP_AT = 8 + 2 + 2 * 12 + 4


@query("""WITH p AS (SELECT doc_id, unnest(['structure', 'full']) AS depth, doc_id % 3 AS damage FROM documents),
e AS (SELECT '/raw/d' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.cr2' ELSE '.nef' END AS path, depth, CASE
   WHEN depth = 'full' AND damage = 1 THEN 'image data is cut off'
   WHEN depth = 'full' AND damage = 2 THEN 'directory chain is broken' END AS error FROM p)
SELECT path, depth, CASE WHEN error IS NULL THEN 'ok' ELSE 'corrupt' END AS status, error FROM e""")
def raw_depths(spark, sf):
    """Texts as the picture data of RAW files, at both depths; damage by doc_id % 3: none, a strip that
    goes on behind the file, a directory that leads to itself."""
    le = lambda n: "concat(" + ", ".join(f"substring(unhex(lpad(hex({n}), 8, '0')), {i}, 1)" for i in (4, 3, 2, 1)) + ")"
    entry = lambda tag: f"X'{struct.pack('<HHI', tag, 4, 1).hex()}'"
    content = f"""concat(X'49492a00', {le('8')}, X'0200', {entry(273)}, {le(str(_STRIP_AT))}, {entry(279)},
        {le('n + CASE WHEN damage = 1 THEN 1 ELSE 0 END')}, {le('CASE WHEN damage = 2 THEN 8 ELSE 0 END')}, body)"""
    rows = table(spark, sf, "documents").selectExpr(
        "concat('/raw/d', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.cr2' ELSE '.nef' END) AS path", "doc_id % 3 AS damage",
        "encode(text, 'UTF-8') AS body", "octet_length(text) AS n",
    ).selectExpr("path", f"{content} AS content")
    at = lambda depth: flat(validate_content(rows, depth)).select("path", F.lit(depth).alias("depth"), "status", "error")
    return at("structure").unionByName(at("full"))


def compounds(docs: DataFrame) -> DataFrame:
    """``(path, content)``: each text behind the directory of a compound file, by doc_id % 6: sound,
    the name in the text only, in a storage only, a chain in circles, a directory of two
    sectors, a directory outside the file."""
    x = lambda b: f"X'{b.hex()}'"
    forms = [
        front(), front("Notes"), front("Notes", "WordDocument"), front(chain={1: 1}),
        front(more="Data", chain={1: 2, 2: SOUND}), front(first=9_999_999),
    ]
    part = lambda cut: "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {x(cut(f))}" for i, f in enumerate(forms)) + " END"
    size = ", ".join(f"substring(unhex(lpad(hex(n), 8, '0')), {i}, 1)" for i in (4, 3, 2, 1))
    name = x("WordDocument".encode("utf-16-le"))
    before, behind = part(lambda f: f[:SIZE_AT]), part(lambda f: f[SIZE_AT + 4 :])
    return docs.selectExpr("doc_id", "encode(text, 'UTF-8') AS body", "octet_length(text) AS n").selectExpr(
        "concat('/o/d', doc_id, '.doc') AS path",
        f"concat({before}, {size}, {behind}, body, {name}) AS content",
    )


@query("""WITH p AS (SELECT '/o/d' || doc_id || '.doc' AS path, doc_id % 6 AS form, octet_length(encode(text)) AS n FROM documents)
SELECT path, CASE WHEN form IN (1, 2) THEN 'Notes' ELSE 'WordDocument' END AS stream, n::BIGINT AS size, NULL AS error
FROM p WHERE form NOT IN (3, 5)
UNION ALL SELECT path, CASE form WHEN 2 THEN 'ObjectPool/WordDocument' ELSE 'ObjectPool/Contents' END, 7, NULL
FROM p WHERE form NOT IN (3, 5)
UNION ALL SELECT path, 'Data', 3, NULL FROM p WHERE form = 4
UNION ALL SELECT path, NULL, NULL, CASE form WHEN 3 THEN 'an OLE chain goes in circles'
   ELSE 'an OLE sector lies outside the file' END FROM p WHERE form IN (3, 5)""")
def office_streams(spark, sf):
    """The streams that compound files list, and what is broken in the others."""
    return compound.streams(compounds(table(spark, sf, "documents")))


@query("""SELECT '/o/d' || doc_id || '.doc' AS path, 'WordDocument' AS stream FROM documents
WHERE doc_id % 6 IN (1, 2, 3, 5)""")
def missing_streams(spark, sf):
    """Required streams that a compound file does not list."""
    rows = compounds(table(spark, sf, "documents"))
    required = spark.createDataFrame([*OLE_STREAMS.items()], "ext string, stream string")
    files = rows.select("path", report_ext("path").alias("ext"))
    return compound.lacking(files, compound.streams(rows), required)


# A picture with a thumbnail, and a PDF of two revisions, by doc_id % 2; damage by
# (doc_id // 2) % 4: none, cut in the last part, bytes behind the end, cut before that part.
_THUMB = b"Exif\0\0" + JPEG_HEAD + b"tiny" + b"\xff\xd9"


@query(f"""WITH p AS (SELECT doc_id, doc_id % 2 AS form, (doc_id // 2) % 4 AS damage FROM documents),
e AS (SELECT '/r/d' || doc_id || CASE form WHEN 0 THEN '.jpg' ELSE '.pdf' END AS path, CASE
   WHEN form = 0 AND damage = 1 THEN 'end-of-image marker missing'
   WHEN form = 0 AND damage = 3 THEN 'broken segment chain'
   WHEN form = 1 AND damage = 1 THEN 'a revision behind the last EOF marker is cut off'
   WHEN form = 1 AND damage = 3 THEN 'startxref leads to no table' END AS error FROM p)
SELECT path, CASE WHEN error IS NULL THEN 'ok' ELSE 'corrupt' END AS status, error,
       CASE WHEN error IS NOT NULL THEN {RESTORE} END AS suggested_action FROM e""")
def revision_verdicts(spark, sf):
    """Damage behind an end mark that belongs to a part of the payload only."""
    x = lambda b: f"X'{b.hex()}'"
    front = JPEG_HEAD[:2] + b"\xff\xe1" + struct.pack(">H", len(_THUMB) + 2) + _THUMB
    jpeg = f"""concat({x(front)}, CASE WHEN damage = 3 THEN X'' ELSE {x(JPEG_HEAD[2:])} END,
        CASE damage WHEN 3 THEN X'' WHEN 1 THEN substring(body, 1, n div 2) ELSE body END,
        CASE WHEN damage IN (1, 3) THEN X'' ELSE X'ffd9' END, CASE WHEN damage = 2 THEN unhex(repeat('0a', 500)) ELSE X'' END)"""
    # the first revision's table is at 9; the second one's behind it and an object with the text
    first = b"%PDF-1.4\nxref\ntrailer\nstartxref\n9\n%%EOF\n"
    second = f"concat({x(first)}, {x(b'7 0 obj ')}, body, {x(b' endobj ')})"
    end = f"concat({x(b'xref startxref ')}, encode(cast({len(first) + 16} + n + CASE WHEN damage = 3 THEN 6 ELSE 0 END AS string), 'UTF-8'), {x(b' %%EOF ')})"
    pdf = f"concat({second}, CASE WHEN damage = 1 THEN X'' ELSE {end} END, CASE WHEN damage = 2 THEN unhex(repeat('0a', 500)) ELSE X'' END)"
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id", "encode(text, 'UTF-8') AS body", "octet_length(text) AS n", "doc_id % 2 AS form", "doc_id div 2 % 4 AS damage"
    )
    rows = docs.selectExpr(
        "concat('/r/d', doc_id, CASE form WHEN 0 THEN '.jpg' ELSE '.pdf' END) AS path",
        f"CASE form WHEN 0 THEN {jpeg} ELSE {pdf} END AS content",
    )
    return flat(check_content(rows).select("path", "verdict"))


def packages(docs: DataFrame) -> DataFrame:
    """``(path, content)``: each text as an office package; damage by doc_id % 6."""

    def build(batches):
        for pdf in batches:
            paths, blobs = [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                damage = doc_id % 6
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr("[Content_Types].xml", "<Types>" if damage == 1 else "<Types/>")
                    if damage != 2:
                        z.writestr("_rels/.rels", "<Relationships/>")
                    z.writestr("word/document.xml", text)
                blob = buffer.getvalue()
                if damage == 3:  # one byte of the stored text changes, its checksum does not
                    at = blob.rindex(b"word/document.xml", 0, blob.rindex(b"PK\x01\x02")) + len("word/document.xml")
                    blob = blob[:at] + bytes([blob[at] ^ 1]) + blob[at + 1 :]
                if damage == 4:
                    blob = blob[:-22]
                paths.append(f"/packages/p{doc_id}.docx")
                blobs.append(blob)
            yield pd.DataFrame({"path": paths, "content": blobs})

    # Building and checking packages is heavy, and a small table is one unsplittable file.
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    dealt = docs.select("doc_id", "text").repartition(tasks, "doc_id")
    return dealt.mapInPandas(build, "path string, content binary")


@query(f"""WITH p AS (SELECT doc_id, doc_id % 6 AS damage FROM documents),
v AS (SELECT '/packages/p' || doc_id || '.docx' AS path, CASE damage
   WHEN 1 THEN '[Content_Types].xml is not well-formed'
   WHEN 2 THEN 'the package lacks _rels/.rels'
   WHEN 3 THEN 'member word/document.xml does not match its checksum'
   WHEN 4 THEN 'no ZIP frame around the package' END AS error FROM p)
SELECT *, CASE WHEN error IS NULL THEN 'ok' ELSE 'corrupt' END AS status,
       CASE WHEN error IS NOT NULL THEN {RESTORE} END AS suggested_action FROM v""")
def package_verdicts(spark, sf):
    """Checksums and required parts of a package per document."""
    return flat(validate_content(packages(table(spark, sf, "documents"))))


# --- the same texts as files ------------------------------------------------------------

FILE_EXTS = (".webp", ".heic", ".cr2", ".pdf", ".docx", ".doc", ".mp4", ".mp3", ".wav", ".txt")
#: Texts that a worker holds as such at a time.
SOME_TEXTS = 64


def write_library(docs: DataFrame, folder: str) -> DataFrame:
    """One file per document below ``folder``; returns how many each task wrote.

    Format by doc_id % 10, folder by source. Damage by (doc_id // 10) % 4: 1 cuts the file in
    the middle, 2 leaves no byte, the others none.
    """

    def build(ext: str, body: bytes) -> bytes:
        size = len(body)
        if ext in (".webp", ".wav"):
            return b"RIFF" + struct.pack("<I", size + 4) + (b"WEBP" if ext == ".webp" else b"WAVE") + body
        if ext == ".docx":
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                z.writestr("[Content_Types].xml", "<Types/>")
                z.writestr("_rels/.rels", "<Relationships/>")
                z.writestr("word/document.xml", body)
            return buffer.getvalue()
        if ext == ".doc":
            return compound_file(body)
        head, tail = {
            ".heic": (b"\0\0\0\x18ftypheic" + bytes(12), b""),
            ".cr2": (b"II*\0" + struct.pack("<I", size + 8), bytes(16)),
            ".pdf": (b"%PDF-1.4\nxref\n", b"\nstartxref\n9\n%%EOF\n"),
            ".mp4": (b"\0\0\0\x18ftypisom" + bytes(12) + struct.pack(">I4s", len(body) + 8, b"mdat"), b"\0\0\0\x08moov"),
            ".mp3": (b"ID3", b""),
            ".txt": (b"", b""),
        }[ext]
        return head + body + tail

    def run(batches):
        for batch in batches:
            # a few texts at a time, so that a worker holds no second form of a whole batch
            for start in range(0, batch.num_rows, SOME_TEXTS):
                some = batch.slice(start, SOME_TEXTS)
                for doc_id, source, text in zip(*(some.column(c).to_pylist() for c in ("doc_id", "source", "text"))):
                    ext = FILE_EXTS[doc_id % 10]
                    content = build(ext, text.encode() + bytes(64))  # so half of it still has a header
                    damage = doc_id // 10 % 4
                    content = content[: len(content) // 2] if damage == 1 else b"" if damage == 2 else content
                    os.makedirs(f"{folder}/{source}", exist_ok=True)
                    with open(f"{folder}/{source}/d{doc_id}{ext}", "wb") as f:
                        f.write(content)
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    tasks = docs.sparkSession.sparkContext.defaultParallelism
    dealt = docs.select("doc_id", "source", "text").repartition(tasks, "doc_id")
    return dealt.mapInArrow(run, "files long")


def _posix(folder: str) -> str:
    path = folder.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise RuntimeError("a file library needs spark.checkpoint.dir on a mounted file system")
    return path


_LIBRARY = f"""WITH d AS (SELECT source, doc_id, doc_id % 10 AS f, (doc_id // 10) % 4 AS damage,
  ([{", ".join(repr(e) for e in FILE_EXTS)}])[doc_id % 10 + 1] AS ext FROM documents WHERE doc_id % 10 <> 9),
v AS (SELECT '/' || source || '/d' || doc_id || ext AS path, f, damage, CASE
   WHEN damage = 2 AND f IN (7, 8) THEN 'unsupported' WHEN damage = 2 THEN 'corrupt'
   WHEN damage = 1 AND f IN (0, 2, 3, 4, 5, 6, 8) THEN 'corrupt' ELSE 'ok' END AS status FROM d)
SELECT path, status, CASE WHEN status = 'ok' THEN NULL WHEN damage = 2 AND f IN (7, 8) THEN
     'unrecognized audio format — possibly misnamed or empty file'
   WHEN damage = 2 THEN 'empty file' WHEN f IN (0, 8) THEN 'declared length exceeds the file'
   WHEN f = 2 THEN 'first directory lies outside the file' WHEN f = 3 THEN 'EOF marker not found'
   WHEN f = 4 THEN 'no ZIP frame around the package'
   WHEN f = 5 THEN 'not a sound OLE file' ELSE 'moov atom not found' END AS error FROM v"""


@query(_LIBRARY)
def library_scan(spark, sf):
    """The documents written as files, inventoried, checked and stat-ed again."""
    root = _posix(run_dir(spark, "library"))
    written = write_library(table(spark, sf, "documents"), root).agg(F.sum("files")).collect()
    assert written
    files = read_inventory(spark, [root, root])
    tasks = spark.sparkContext.defaultParallelism
    out = flat(validate_files(spread(files, tasks, tasks)).where(~F.col("discarded")))
    ole = F.col("error").like("%OLE%")
    return out.select(
        F.expr(f"substring(path, {len(root) + 1})").alias("path"),
        "status",
        F.when(ole, "not a sound OLE file").otherwise(F.col("error")).alias("error"),
    )


@query("""SELECT 'new' AS reason, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes
FROM documents WHERE doc_id % 2 = 1
UNION ALL SELECT 'fresh', count(*), sum(octet_length(encode(text)))::BIGINT FROM documents WHERE doc_id % 2 = 0""")
def library_diff(spark, sf):
    """A library of text files, half of it known from an earlier inventory."""
    root = _posix(run_dir(spark, "texts"))

    def run(batches):
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                os.makedirs(f"{root}/{doc_id % 7}", exist_ok=True)
                with open(f"{root}/{doc_id % 7}/{doc_id}.pdf", "wb") as f:
                    f.write(text.encode())
            yield pd.DataFrame({"files": [len(pdf)]})

    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.repartition(spark.sparkContext.defaultParallelism, "doc_id").mapInPandas(run, "files long").agg(F.sum("files")).collect()
    files = read_inventory(spark, [root])
    doc_id = F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long")
    known = files.where(doc_id % 2 == 0).withColumn("checked_at", F.lit(AS_OF).cast("timestamp"))
    classed = classify(files, known, F.lit(AS_OF).cast("timestamp"))
    return classed.groupBy("reason").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


# --- fingerprints -------------------------------------------------------------------


@query("""SELECT sha256(text) AS fingerprint, count(*) AS files, min(doc_id) AS first FROM documents
GROUP BY text HAVING count(*) > 1""")
def duplicate_content(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return fingerprints.copies(fingerprints.with_fingerprints(docs), key="doc_id")


_PARTIAL = "sha256(left(text, 40) || right(text, 40) || length(text))"


@query(f"""SELECT doc_id, sha256(text) AS hash,
  CASE WHEN length(text) > 500 THEN {_PARTIAL} END AS partial_hash
FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM documents)""")
def content_fingerprints(spark, sf):
    """Whole hash, and above 500 bytes that of both ends; ASCII so bytes and characters agree."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.encode(F.regexp_replace("text", "[^ -~]", "?"), "UTF-8").alias("content")
    )
    return fingerprints.with_fingerprints(docs, threshold=500, part=40)


def _library(docs: DataFrame, path) -> DataFrame:
    return fingerprints.with_fingerprints(docs.select(path.alias("path"), F.encode("text", "UTF-8").alias("content")))


@query("""WITH a AS (SELECT '/a/' || doc_id AS path, sha256(text) AS fp FROM documents WHERE doc_id % 13 <> 0),
b AS (SELECT CASE WHEN doc_id % 10 = 0 THEN '/b/' ELSE '/a/' END || doc_id AS path, sha256(text) AS fp
      FROM documents WHERE doc_id % 17 <> 0),
sides AS (SELECT fp, path AS f, NULL AS t FROM a WHERE path NOT IN (SELECT path FROM b)
          UNION ALL SELECT fp, NULL, path FROM b WHERE path NOT IN (SELECT path FROM a)),
g AS (SELECT fp AS fingerprint, count(f) AS vanished, count(t) AS appeared, min(f) AS f, min(t) AS t FROM sides GROUP BY fp)
SELECT fingerprint, vanished, appeared, CASE WHEN appeared = 0 THEN 'vanished' WHEN vanished = 0 THEN 'appeared'
         WHEN vanished = 1 AND appeared = 1 THEN 'moved' ELSE 'ambiguous' END AS state,
       CASE WHEN vanished = 1 AND appeared = 1 THEN f END AS from_path,
       CASE WHEN vanished = 1 AND appeared = 1 THEN t END AS to_path FROM g""")
def moved_files(spark, sf):
    """Two states of the documents as a library: some moved, some deleted, some new."""
    docs = table(spark, sf, "documents")
    i = F.col("doc_id")
    before = _library(docs.where(i % 13 != 0), F.concat(F.lit("/a/"), i.cast("string")))
    folder = F.when(i % 10 == 0, "/b/").otherwise("/a/")
    after = _library(docs.where(i % 17 != 0), F.concat(folder, i.cast("string")))
    return fingerprints.moves(before, after)


@query(f"""SELECT '/a/' || doc_id AS path, CASE WHEN doc_id % 17 = 0 THEN 'unreadable' WHEN doc_id % 23 = 0 THEN 'corrupt'
         ELSE 'ok' END AS status,
   CASE WHEN doc_id % 17 = 0 THEN 'No such file or directory'
        WHEN doc_id % 23 = 0 THEN 'content does not match the stored hash' END AS error,
   CASE WHEN doc_id % 17 <> 0 AND doc_id % 23 = 0 THEN {RESTORE} END AS suggested_action FROM documents""")
def hash_recheck(spark, sf):
    """Stored against fresh hashes; some contents were altered, some files are gone."""
    docs = table(spark, sf, "documents")
    i, path = F.col("doc_id"), F.concat(F.lit("/a/"), F.col("doc_id").cast("string"))
    altered = F.when(i % 23 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    fresh = _library(docs.where(i % 17 != 0).withColumn("text", altered), path)
    return flat(fingerprints.verify_hashes(_library(docs, path), fresh))
