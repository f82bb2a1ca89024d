"""Where the records of scans lie: beside the verdict log, in a folder its readers pass over.

Every record has a folder of its own that its writer replaces, so writing it again after a
failure leaves one. Folders carry their keys in their names, and reading one scan lists only
its own.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators import lifecycle
from assay.operators.queue import stale_scan_ids
from assay.schemas import PROGRESS, QUEUED, SCAN_EVENTS


class ScanState:
    def __init__(self, spark: SparkSession, log_dir: str):
        self.spark, self.log_dir = spark, log_dir
        self.folder = f"{log_dir}/_scans"

    def _path(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        fs, path = self._path(f"{self.folder}/{name}")
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").select(*schema.fieldNames())

    def _record(self, name: str, schema: T.StructType, keys: list[str], row: dict) -> None:
        place = "/".join(f"{k}={quote(str(row[k]), safe='')}" for k in keys)
        rows = self.spark.createDataFrame([tuple(row.get(f) for f in schema.fieldNames())], schema)
        rows.drop(*keys).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}/{place}")

    def events(self) -> DataFrame:
        return self._read("events", SCAN_EVENTS)

    def progress(self) -> DataFrame:
        return self._read("progress", PROGRESS)

    def queue(self) -> DataFrame:
        return self._read("queue", QUEUED)

    def scans(self) -> DataFrame:
        return lifecycle.scan_table(self.events(), self.progress())

    def scan(self, scan_id: str) -> Row | None:
        """What is known of a scan; None if it never started."""
        mine = self.progress().where(F.col("scan_id") == scan_id)
        return lifecycle.fold(self.events().where(F.col("id") == scan_id), mine).first()

    def visible(self, log: DataFrame) -> DataFrame:
        """Rows of a log with ``part`` that count: of scans that run or broke off only those of
        parts that are done. Scans without records, whose verdicts were added by other means,
        count as a whole. The list has an entry for each unfinished scan."""
        ids = [r.scan_id for r in lifecycle.fold(self.events(), self.progress()).where("finished_at IS NULL").collect()]
        if not ids:
            return log
        done: dict[str, list[int]] = {}
        for r in self.progress().where(F.col("scan_id").isin(ids)).select("scan_id", "part").distinct().collect():
            done.setdefault(r.scan_id, []).append(r.part)
        counts = ~F.col("scan_id").isin(ids)
        for scan_id, parts in done.items():
            counts = counts | ((F.col("scan_id") == scan_id) & F.col("part").isin(parts))
        return log.where(counts)

    def event(self, **row) -> None:
        self._record("events", SCAN_EVENTS, ["id", "kind", "attempt"], row)

    def commit(self, **row) -> None:
        """Marks a part as done; its verdicts have been written."""
        self._record("progress", PROGRESS, ["scan_id", "part", "attempt"], row)

    def enqueue(self, scan_id: str, paths: DataFrame) -> None:
        """Writes the ``(path, part)`` rows of a scan, in place of any from an earlier try."""
        rows = paths.select("path", "part").dropDuplicates(["path"])
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/queue/scan_id={quote(scan_id, safe='')}")

    def drop_queue(self, scan_id: str) -> None:
        fs, path = self._path(f"{self.folder}/queue/scan_id={quote(scan_id, safe='')}")
        fs.delete(path, True)

    def drop_stale(self, as_of, max_age_days: int = 7) -> list[str]:
        """Drops the queues of scans that began long ago and never finished; their ids."""
        gone = [r.scan_id for r in stale_scan_ids(self.queue(), self.scans(), as_of, max_age_days).collect()]
        for scan_id in gone:
            self.drop_queue(scan_id)
        return gone

    def write_verdicts(self, scan_id: str, part: int, verdicts: DataFrame) -> None:
        """Puts a part's verdicts into the log, in place of any from an attempt that broke off."""
        target = f"{self.log_dir}/scan_id={quote(scan_id, safe='')}/part={part}"
        verdicts.drop("scan_id").write.mode("overwrite").parquet(target)
