"""The distributed validation job: structural rules first, whole-payload checks second.

No payload can fail the job. Whatever a check raises becomes an ``error`` verdict of its
row, and a row that takes longer than its budget is reported as timed out. A running check
can not be killed from inside a task, so the budget is compared when the check returns. No
file is too large to be checked: checks read in bounded steps.
"""

from __future__ import annotations

import io
import os
import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.deep_checks import DeepCheck, registered
from assay.operators.formats import dispatch
from assay.operators.payload_checks import (
    HEAD_BYTES, OK_CODE, RULED, TAIL_BYTES, code, coded, failure, no_validator,
)
from assay.operators.verdicts import REASONS, first_failing, unstatable, verdict

# Fixed value: default seconds per file.
TIMEOUT_S = 120

_FINDING = T.StructType(
    [
        T.StructField("deep_status", T.StringType()),
        T.StructField("deep_error", T.StringType()),
        T.StructField("deep_action", T.StringType()),
    ]
)


class _TimedOut(BaseException):
    """Not an Exception, so that a check does not take it for a failure of its own."""


@contextmanager
def time_limit(seconds: float):
    """Ends what runs inside after some time, by a signal to the worker's main thread, which
    runs the checks. Elsewhere, where signals can not be had, nothing is ended."""

    def end(*_):
        raise _TimedOut

    if threading.current_thread() is not threading.main_thread() or not hasattr(signal, "setitimer"):
        yield
        return
    before = signal.signal(signal.SIGALRM, end)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def run_check(check: DeepCheck | None, source: BinaryIO, ext: str, timeout_s: float) -> tuple:
    """(status, error, action) of one check; nulls when it found nothing."""
    if check is None:
        return None, None, None
    try:
        with time_limit(timeout_s):
            found = check(source, ext)
    except _TimedOut:
        found = ("timed_out", f"validation timed out after {timeout_s:g}s")
    except Exception as e:  # any failure of a check is that row's verdict
        found = ("failed", str(e) or type(e).__name__)
    if found is None:
        return None, None, None
    reason, error = found
    status, action = REASONS[reason]
    return status, error, action


def _deep_finding():
    found = F.struct(
        F.col("deep_status").alias("status"),
        F.col("deep_error").alias("error"),
        F.col("deep_action").alias("suggested_action"),
    )
    return F.when(F.col("deep_status").isNotNull(), found)


def _deep_kinds(depth: str) -> dict[str, DeepCheck]:
    """``structure`` leaves RAW files to the structural rules; ``full`` walks them as TIFF."""
    checks = registered()
    if depth == "full" and "raw" not in checks:
        tiff = checks["tiff"]
        checks["raw"] = lambda f, ext: _as_raw(tiff(f, ext))
    elif depth != "full":
        checks.pop("raw", None)
    return checks


def _as_raw(found):
    return found and ("bad_raw", found[1])


def validate_content(
    payloads: DataFrame, depth: str = "structure", timeout_s: float = TIMEOUT_S
) -> DataFrame:
    """Verdicts for ``(path, content, ...)``; the content column is dropped.

    One pass: every row goes through Python, but only those that pass the structural rules
    and have a whole-payload check take their content along.
    """
    # what SQL rules over the whole content decide needs no payload in Python
    checks = {kind: check for kind, check in _deep_kinds(depth).items() if kind not in RULED}
    rows = coded(payloads)
    keep = [c for c in payloads.columns if c != "content"]
    todo = (F.col("_code") == OK_CODE) & F.col("kind").isin(*checks)
    narrow = rows.select(
        *keep, "ext", "kind", "_code", F.when(todo, F.col("content")).alias("content")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                (None, None, None) if c is None else run_check(checks[k], io.BytesIO(c), e, timeout_s)
                for k, e, c in zip(pdf["kind"], pdf["ext"], pdf["content"])
            ]
            yield pd.concat([pdf.drop(columns="content"), _findings(found, pdf.index)], axis=1)

    fields = [f for f in narrow.schema.fields if f.name != "content"]
    checked = narrow.mapInPandas(run, T.StructType(fields + _FINDING.fields))
    verdicts = first_failing(
        no_validator(),
        failure("_code", whole=True),
        _deep_finding(),
    )
    return checked.select(*keep, verdicts.alias("verdict"))


def _findings(rows: list[tuple], index) -> pd.DataFrame:
    return pd.DataFrame(rows, index=index, columns=_FINDING.fieldNames(), dtype=object)


def _ends(f: BinaryIO) -> tuple[bytes, bytes, int]:
    size = f.seek(0, 2)
    f.seek(max(size - TAIL_BYTES, 0))
    tail = f.read(TAIL_BYTES)
    f.seek(0)
    head = f.read(HEAD_BYTES)
    f.seek(0)
    return head, tail, size


_EVIDENCE = T.StructType(
    [
        T.StructField("head", T.BinaryType()),
        T.StructField("tail", T.BinaryType()),
        T.StructField("length", T.LongType()),
        T.StructField("open_error", T.StringType()),
        T.StructField("post_mtime", T.DoubleType()),
        T.StructField("post_size", T.LongType()),
    ]
)


def validate_files(
    worklist: DataFrame, depth: str = "structure", timeout_s: float = TIMEOUT_S
) -> DataFrame:
    """Adds ``verdict`` to inventory rows ``(path, mtime, size, ...)``.

    Files are opened by path inside the tasks, so a payload is read once, where it is
    checked, and never crosses into the JVM; only both ends of it come back for the rules.
    Files that could not be stat-ed or that have no validator are never opened. Each opened file is stat-ed again right after its check: ``discarded`` marks
    verdicts of files that changed or vanished meanwhile.
    """
    checks = _deep_kinds(depth)
    routed = dispatch(worklist)
    unopened = F.coalesce(unstatable(), no_validator())
    opened = routed.withColumn("_unopened", unopened).drop("cost_class")
    opened = opened.withColumn("_open", F.col("_unopened").isNull())
    none = (None,) * (len(_EVIDENCE) + len(_FINDING))

    def inspect(path: str, kind: str, ext: str) -> tuple:
        ends, error, found = (None, None, None), None, (None, None, None)
        try:
            with open(path, "rb") as f:
                ends = _ends(f)
                found = run_check(checks.get(kind), f, ext, timeout_s)
        except OSError as e:
            error = e.strerror or str(e)
        try:
            now = os.stat(path)
            after = (now.st_mtime, now.st_size)
        except OSError:
            after = (None, None)
        return (*ends, error, *after, *found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Small slices bound the memory held by file ends.
            for start in range(0, len(batch), 64):
                pdf = batch.iloc[start : start + 64].reset_index(drop=True)
                rows = [
                    inspect(p, k, e) if wanted else none
                    for p, k, e, wanted in zip(pdf["path"], pdf["kind"], pdf["ext"], pdf["_open"])
                ]
                found = pd.DataFrame(
                    rows, columns=_EVIDENCE.fieldNames() + _FINDING.fieldNames(), dtype=object
                ).astype({"length": "Int64", "post_size": "Int64", "post_mtime": "float64"})
                yield pd.concat([pdf, found], axis=1)

    # The verdict struct of unopened files stays out of the Arrow batches.
    carried = opened.drop("_unopened")
    read = carried.mapInPandas(run, T.StructType(carried.schema.fields + _EVIDENCE.fields + _FINDING.fields))
    could_not_open = F.when(F.col("open_error").isNotNull(), verdict("unreadable", F.col("open_error")))
    was_read = F.col("_open") & F.col("open_error").isNull()
    result = first_failing(unopened, could_not_open, failure("_code"), _deep_finding())
    unchanged = (F.col("post_mtime") == F.col("mtime")) & (F.col("post_size") == F.col("size"))
    discarded = F.col("_open") & ~F.coalesce(unchanged, F.lit(False))
    return read.withColumn("_code", F.when(was_read, code()).otherwise(OK_CODE)).select(
        *worklist.columns, result.alias("verdict"), discarded.alias("discarded")
    )
