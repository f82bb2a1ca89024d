"""File inventory: ``(path, mtime, size)`` of all files below some roots.

Folders are a table. A round lists the folders of one level, dealt out by their paths, and
stores what it found; the folders among that are the next round's. So the driver lists nothing,
a deep subtree is no single task, and executors that are lost repeat a part of one level. Files
are stat-ed last, dealt out by path.

Spark's own ``binaryFile`` listing leaves out empty files and names that begin with ``_`` or
``.``, which a library contains and which must be judged; hence a walk of its own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.paths import glob_regex
from assay.operators.formats import extensions
from assay.sources.tables import stage

#: Names that a listing task holds at a time, however large the folder.
CHUNK = 10_000
_LEVEL = "path string, folder boolean, above array<string>"


def _stat(path: str) -> tuple[float, int]:
    try:
        st = os.stat(path)
        return st.st_mtime, st.st_size
    except OSError:
        return 0.0, 0


def _suffix(name: str) -> str:
    return os.path.splitext(name)[1].lower()


def _listed(folder: str, above: list[str], follow: bool, wanted) -> Iterator[tuple]:
    """Files and folders in a folder. One that it lies in itself, by a link, is not listed again;
    a folder that can not be read, or is none, has no rows."""
    try:
        st = os.stat(folder)
        identity = f"{st.st_dev}:{st.st_ino}"
        if identity in above:
            return
        with os.scandir(folder) as entries:
            for e in entries:
                # a link to a folder is not a file, whether or not it is followed
                if e.is_dir():
                    if follow or e.is_dir(follow_symlinks=False):
                        yield e.path, True, [*above, identity]
                elif wanted(e.path, e.name):
                    yield e.path, False, None
    except OSError:
        return


def read_inventory(
    spark: SparkSession,
    roots: list[str],
    exclude: list[str] | None = None,
    follow_symlinks: bool = False,
    exts: list[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Files with a registered extension below the roots, each path once.

    Extension and exclusion are tested before a file is stat-ed. With ``follow_symlinks`` a
    linked folder is walked under its link's name, too; only a folder inside itself is cut off,
    so what is found does not depend on the order of the walk. A root that does not exist has
    no files. There are as many rounds as levels of folders.
    """
    suffixes = set(extensions() if exts is None else exts) or None
    globs = [glob_regex(g) for g in exclude or []]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [re.compile(p, re.DOTALL) for p in globs]
        wanted = lambda path, name: (suffixes is None or _suffix(name) in suffixes) and not any(p.fullmatch(path) for p in patterns)
        rows: list[tuple] = []
        for batch in batches:
            for folder, above in zip(batch["path"], batch["above"]):
                for row in _listed(folder, list(above), follow_symlinks, wanted):
                    rows.append(row)
                    if len(rows) == CHUNK:
                        yield pd.DataFrame(rows, columns=["path", "folder", "above"])
                        rows = []
        yield pd.DataFrame(rows, columns=["path", "folder", "above"]).astype({"folder": bool})

    level = spark.createDataFrame([(r, True, []) for r in dict.fromkeys(roots)], _LEVEL)
    many = tasks or 4 * spark.sparkContext.defaultParallelism
    names = spark.createDataFrame([], "path string")
    while True:
        found = stage(level.repartition(many, "path").mapInPandas(run, _LEVEL), "walk")
        names = names.unionByName(found.where("NOT folder").select("path"))
        level = found.where("folder")
        if level.isEmpty():
            return restat(names.distinct())


def restat(paths: DataFrame, mtime: str = "mtime", size: str = "size") -> DataFrame:
    """Current mtime and size of each ``path``; ``(0, 0)`` when it can not be stat-ed."""
    kept = [f for f in paths.schema.fields if f.name not in (mtime, size)]
    schema = T.StructType([*kept, T.StructField(mtime, T.DoubleType()), T.StructField(size, T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            now = [_stat(p) for p in pdf["path"]]
            out = pdf[[f.name for f in kept]].copy()
            out[mtime] = [m for m, _ in now]
            out[size] = [s for _, s in now]
            yield out

    return paths.select(*[F.col(f.name) for f in kept]).mapInPandas(run, schema)
