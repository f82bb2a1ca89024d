"""Validity of records held in tables: pages, JSON, text, vectors and sequences.

The same verdict contract as for files. Every check but the last is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.verdicts import because, first_failing, rule


def _unreadable(condition: Column, error: str) -> Column:
    return F.when(condition, because("missing", error))


def page_verdict(html: Column) -> Column:
    """A page starts with a doctype and closes its root element."""
    return first_failing(
        _unreadable(html.isNull() | (F.trim(html) == ""), "empty page"),
        rule(~F.rlike(html, F.lit(r"(?i)^\s*<!doctype html")), "bad_signature", "doctype missing"),
        rule(~F.rlike(html, F.lit(r"(?i)</html\s*>")), "truncated", "closing html tag missing"),
    )


def json_verdict(text: Column, required: list[str]) -> Column:
    """Well-formed JSON that has the required keys."""
    missing = [
        rule(F.get_json_object(text, f"$.{key}").isNull(), "missing_part", f"Missing required key: {key}")
        for key in required
    ]
    return first_failing(
        _unreadable(text.isNull(), "no record"),
        rule(F.try_parse_json(text).isNull(), "bad_structure", "not well-formed JSON"),
        *missing,
    )


def text_verdict(text: Column, declared_length: Column) -> Column:
    """Non-empty valid UTF-8 of the declared length without replacement characters."""
    lengths = F.concat(
        F.lit("length "), F.length(text).cast("string"), F.lit(", expected "), declared_length.cast("string")
    )
    return first_failing(
        _unreadable(text.isNull() | (text == ""), "empty text"),
        rule(~F.is_valid_utf8(text), "bad_structure", "invalid UTF-8"),
        rule(F.length(text) != declared_length, "truncated", lengths),
        rule(F.contains(text, F.lit("�")), "bad_structure", "replacement character"),
    )


def vector_verdict(vector: Column, dimension: int) -> Column:
    """A finite vector of the given dimension that is not all zeros."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    found = F.concat(F.lit(f"dimension "), F.size(vector).cast("string"), F.lit(f", expected {dimension}"))
    return first_failing(
        _unreadable(vector.isNull(), "no vector"),
        rule(F.size(vector) != dimension, "truncated", found),
        rule(F.exists(vector, lambda x: ~finite(x)), "bad_structure", "value is not finite"),
        rule(F.forall(vector, lambda x: x == 0), "bad_structure", "zero vector"),
    )


def sequence_verdicts(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One verdict per sequence: positions run from 0 without gaps or repeats.

    Duplicates are folded by (key, position) first, so a sequence that owns much of the
    table is spread over many tasks before it becomes one row.
    """
    places = rows.groupBy(key, position).agg(F.count("*").alias("_copies"))
    summary = places.groupBy(key).agg(
        F.count("*").alias("present"),
        (F.max(position) + 1).alias("expected"),
        F.sum("_copies").alias("_rows"),
        F.min(position).alias("_low"),
    )
    absent = F.col("expected") - F.col("present")
    gap = F.concat(F.lit("missing "), absent.cast("string"), F.lit(" of "), F.col("expected").cast("string"))
    return summary.select(
        key,
        first_failing(
            rule(F.col("_low") < 0, "bad_structure", "negative position"),
            rule(absent > 0, "missing_part", gap),
            rule(F.col("_rows") > F.col("present"), "bad_structure", "repeated position"),
        ).alias("verdict"),
    )


def status_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict.status", "verdict.error").agg(F.count("*").alias("cnt"))
