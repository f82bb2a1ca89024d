"""Verdict log, catalog snapshots, portable JSON and report files.

The log is append-only and is the truth. A snapshot is a fold of it in a folder of its own;
nothing is overwritten while it may be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.text import parse_iso_utc
from assay.schemas import CATALOG, PORTABLE_RECORD, VERDICT_LOG
from assay.session import run_dir


def append_log(verdicts: DataFrame, folder: str, part: int = 0) -> None:
    """Adds verdicts to the log, partitioned by scan so that per-scan reports prune."""
    verdicts.withColumn("part", F.lit(part)).write.mode("append").partitionBy("scan_id", "part").parquet(folder)


def read_log(spark: SparkSession, folder: str, with_part: bool = False) -> DataFrame:
    """The verdict log, with the ``part`` of the scan that wrote a row if asked for."""
    schema = T.StructType([*VERDICT_LOG.fields, T.StructField("part", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(folder)
    return rows if with_part else rows.select(*VERDICT_LOG.fieldNames())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def write_snapshot(catalog: DataFrame, folder: str, version: int) -> str:
    """Writes one snapshot version; files are sorted by what the table has of status and time,
    so that reports on them skip row groups."""
    target = f"{folder}/v={version}"
    order = [c for c in ("status", "checked_at") if c in catalog.columns]
    catalog.sortWithinPartitions(*order).write.mode("overwrite").parquet(target)
    return target


def latest_version(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    """Number of the last complete snapshot, or of the last one with a smaller number."""
    numbers = sorted((int(n[2:]) for n in names_in(spark, folder) if n.startswith("v=")), reverse=True)
    complete = lambda n: "_SUCCESS" in names_in(spark, f"{folder}/v={n}")
    return next((n for n in numbers if (before is None or n < before) and complete(n)), None)


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    version = latest_version(spark, folder)
    return None if version is None else spark.read.parquet(f"{folder}/v={version}")


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a result that several consumers read, so that it is computed once.

    The table lies in the shared folder and survives the loss of executors.
    """
    folder = run_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_payloads(spark: SparkSession, folder: str, inventory: DataFrame | None = None) -> DataFrame:
    """``(path, mtime, size, content)`` of the files below a folder.

    For object stores, where files can not be opened by path in the tasks. Spark's reader skips
    empty files and names with a leading ``_`` or ``.``. With an ``inventory(path, mtime,
    size)`` every row of it is there: an empty file has empty content, and one that the reader
    did not give has none.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    if inventory is None:
        return rows.select(
            "path",
            (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"),
            F.col("length").alias("size"),
            "content",
        )
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    found = rows.select(plain("path").alias("_path"), "content")
    every = inventory.select("path", "mtime", "size").withColumn("_path", plain("path"))
    content = F.when(F.col("size") == 0, F.lit(b"")).otherwise(F.col("content"))
    return every.join(found, "_path", "left").select("path", "mtime", "size", content.alias("content"))


def iso_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def export_catalog(catalog: DataFrame, folder: str) -> None:
    """All eleven columns as JSON lines; nulls are written, timestamps are ISO text."""
    times = [f.name for f in CATALOG if f.name.endswith("_at")]
    rows = catalog.select(*CATALOG.fieldNames()).withColumns({c: iso_text(F.col(c).cast("timestamp")) for c in times})
    rows.write.option("ignoreNullFields", "false").json(folder)


def read_portable(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Portable records with ``ordinal``, their order in the input from 0: by name of the file,
    then as they stand in it, however many tasks read it.

    JSON lines split across tasks; ``array`` reads files that hold one JSON array each. Rows are
    written down with the place of the block they come from; of the blocks, of which there are
    few, the numbers of rows are summed up, and a row's number is that of its block and its own.
    """
    rows = spark.read.schema(PORTABLE_RECORD).option("multiLine", str(array).lower()).json(path)
    rows = rows.select(
        *PORTABLE_RECORD.fieldNames(),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    placed = stage(rows, "portable")
    blocks = placed.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    files = blocks.groupBy("_file").agg(F.sum("_rows").alias("_all"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.col("_before") + F.coalesce(F.sum("_rows").over(inside), F.lit(0)) - F.col("_first")
    shifts = blocks.join(files, "_file").select("_file", "_block", shift.alias("_shift"))
    numbered = placed.join(shifts, ["_file", "_block"])
    return numbered.select(*PORTABLE_RECORD.fieldNames(), (F.col("_at") + F.col("_shift")).alias("ordinal"))


def typed_times(records: DataFrame) -> DataFrame:
    """Portable records with real timestamps; text that is no timestamp becomes null."""
    times = [f.name for f in CATALOG if f.name.endswith("_at")]
    return records.withColumns({c: parse_iso_utc(c) for c in times})


def write_report(rows: DataFrame, path: str, form: str = "csv") -> None:
    """A report as ``csv`` with a header, ``json`` lines, or a fixed-width text ``table``."""
    if form == "csv":
        rows.write.option("header", True).csv(path)
    elif form == "json":
        rows.write.json(path)
    elif form == "table":
        cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 32, " ") for c in rows.columns]
        rows.select(F.rtrim(F.concat_ws("  ", *cells)).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown report form {form!r}")
