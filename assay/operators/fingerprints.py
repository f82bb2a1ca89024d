"""Content fingerprints: copies, moved files and at-rest damage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.verdicts import RESTORE, ok, verdict

# Above this size both ends get a hash of their own, of so many bytes.
LARGE_BYTES = 10 * 1024 * 1024
PARTIAL_BYTES = 64 * 1024


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def partial_hash(content: Column, part: int = PARTIAL_BYTES) -> Column:
    """Hash of the first and last bytes and the length."""
    ends = F.concat(
        F.substring(content, 1, part),
        F.substring(content, -part, part),
        F.encode(F.length(content).cast("string"), "UTF-8"),
    )
    return F.sha2(ends, 256)


def with_fingerprints(
    payloads: DataFrame, content: str = "content", threshold: int = LARGE_BYTES, part: int = PARTIAL_BYTES
) -> DataFrame:
    """Adds ``hash``, of the whole content whatever its size, and above the threshold
    ``partial_hash`` for comparison with catalogs that have it; drops the content. Only the
    hash of the whole content ever decides."""
    c = F.col(content)
    return (
        payloads.withColumn("hash", full_hash(c))
        .withColumn("partial_hash", F.when(F.length(c) > threshold, partial_hash(c, part)))
        .drop(content)
    )


def fingerprint() -> Column:
    return F.col("hash")


def copies(files: DataFrame, key: str = "path") -> DataFrame:
    """Fingerprints held by more than one file, with their number and the first file.

    One row per group, never the pairs of a group.
    """
    return (
        files.groupBy(fingerprint().alias("fingerprint"))
        .agg(F.count("*").alias("files"), F.min(key).alias("first"))
        .where(F.col("files") > 1)
    )


def moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that vanished and appeared, matched by fingerprint.

    One row per fingerprint with the counts of both sides; a single path on either side is
    a move and is named, anything else is ``ambiguous`` since no pairing is right. Both
    sides are reduced by one aggregate that combines before its shuffle.
    """
    gone = before.join(after.select("path"), "path", "left_anti").select(
        fingerprint().alias("fingerprint"), F.col("path").alias("from_path"), F.lit(None).cast("string").alias("to_path")
    )
    came = after.join(before.select("path"), "path", "left_anti").select(
        fingerprint().alias("fingerprint"), F.lit(None).cast("string").alias("from_path"), F.col("path").alias("to_path")
    )
    sides = gone.unionByName(came).groupBy("fingerprint").agg(
        F.count("from_path").alias("vanished"),
        F.count("to_path").alias("appeared"),
        F.min("from_path").alias("_from"),
        F.min("to_path").alias("_to"),
    )
    one_to_one = (F.col("vanished") == 1) & (F.col("appeared") == 1)
    state = (
        F.when(F.col("appeared") == 0, "vanished")
        .when(F.col("vanished") == 0, "appeared")
        .when(one_to_one, "moved")
        .otherwise("ambiguous")
    )
    return sides.select(
        "fingerprint",
        "vanished",
        "appeared",
        state.alias("state"),
        F.when(one_to_one, F.col("_from")).alias("from_path"),
        F.when(one_to_one, F.col("_to")).alias("to_path"),
    )


def verify_hashes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Verdict per stored path with a fingerprint: does the content still hash the same?"""
    now = fresh.select("path", fingerprint().alias("_now"))
    gone = verdict("unreadable", "No such file or directory")
    damaged = verdict("corrupt", "content does not match the stored hash", RESTORE)
    was = fingerprint()
    result = F.when(F.col("_now").isNull(), gone).when(F.col("_now") != was, damaged).otherwise(ok())
    return (
        stored.where(was.isNotNull()).join(now, "path", "left").select("path", result.alias("verdict"))
    )
