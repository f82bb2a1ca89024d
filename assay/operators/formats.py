"""Extension registry: which kind of file an extension is, and what a check costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.paths import scan_ext

# Kind → (extensions, cost class).
_KINDS = {
    "jpeg": ((".jpg", ".jpeg"), "low"),
    "png": ((".png",), "low"),
    "tiff": ((".tif", ".tiff"), "medium"),
    "heif": ((".heic", ".heif", ".avif"), "medium"),
    "webp": ((".webp",), "low"),
    "raw": ((".cr2", ".cr3", ".nef", ".nrw", ".arw", ".orf", ".rw2", ".pef", ".dng", ".raf"), "high"),
    "pdf": ((".pdf",), "low"),
    "ooxml": ((".docx", ".xlsx", ".pptx"), "low"),
    "ole": ((".doc", ".xls", ".ppt"), "low"),
    "video": ((".mp4", ".mov", ".mts", ".m4v", ".mkv"), "low"),
    "audio": ((".mp3", ".flac", ".wav", ".aac"), "low"),
}

_registry: dict[str, tuple[str, str]] = {
    ext: (kind, cost) for kind, (exts, cost) in _KINDS.items() for ext in exts
}


def register(kind: str, exts: list[str], cost_class: str = "low") -> None:
    """Adds a kind; an extension that is registered already moves to the new kind."""
    for ext in exts:
        _registry[ext.lower()] = (kind, cost_class)


def extensions() -> list[str]:
    return sorted(_registry)


def _lookup(part: int) -> Column:
    cells = [F.lit(v) for ext in sorted(_registry) for v in (ext, _registry[ext][part])]
    return F.create_map(*cells)


def dispatch(files: DataFrame) -> DataFrame:
    """Adds ``ext``, ``kind`` (null: no validator) and ``cost_class``.

    The registry is a constant map inside the expression, so routing needs no join.
    """
    return (
        files.withColumn("ext", scan_ext("path"))
        .withColumn("kind", F.try_element_at(_lookup(0), F.col("ext")))
        .withColumn("cost_class", F.coalesce(F.try_element_at(_lookup(1), F.col("ext")), F.lit("low")))
    )


def spread(files: DataFrame, light: int, heavy: int) -> DataFrame:
    """Light files in ``light`` tasks and heavy ones in ``heavy`` tasks of their own.

    Rows are dealt out by path, which is unique, so many files of one kind or folder do not
    meet in one task, and a retried task gets the same files again.
    """
    routed = dispatch(files)
    is_heavy = F.col("cost_class") == "high"
    parts = routed.where(~is_heavy).repartition(light, "path"), routed.where(is_heavy).repartition(heavy, "path")
    return parts[0].unionByName(parts[1]).select(*files.columns)
