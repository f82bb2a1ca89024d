"""A corpus from documents to packed token ids: each stage calls one of the operators.

A stage reads what the stage before it kept, from Parquet. All but the last give the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import language, packing, pii, simhash, substrings
from assay.llm.common import table
from assay.sources.tables import stage


def filled(docs: DataFrame, new: dict[str, Column]) -> list[Column]:
    """The columns of ``docs`` from a struct ``row``, some of them replaced."""
    return [new.get(c, F.col("row")[c]).alias(c) for c in docs.columns]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing ``lang`` is filled in.

    Null texts and texts without a letter go. Where there is nothing to learn from, only they go.
    """
    model = language.fit(docs.where(~language.held_out("doc_id")))
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language.predictions(docs, model).where(F.col("lang_pred") != language.UNKNOWN)
    return found.select(*filled(docs, {"lang": F.coalesce("row.lang", "lang_pred")}))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, once: the one with the smallest id, without id only where
    no other is. Groups are of texts: a text that shares its id with a copy of another stays."""
    first = stage(simhash.representatives(docs, words=3, most=3), "representatives")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), simhash.text_class("text").alias("_class"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("key")) & (F.col("_class") == F.col("class"))
    kept = rows.join(first, same, "left_semi")
    if first.where("n > 1").limit(1).count():
        # only here rows repeat id and text; the first in the order of their columns stays
        many = first.where("n > 1")
        once = kept.join(many, same, "left_semi").groupBy("row.doc_id", "_class").agg(F.min("row").alias("row"))
        kept = kept.join(many, same, "left_anti").select("row").unionByName(once.select("row"))
    return kept.select(*filled(docs, {}))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    found = substrings.without_repeats(docs)
    out = found.select(F.col("key").alias("doc_id"), "text", "rest.*")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the names of kinds in place of personal data."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = pii.with_spans(rows)
    text = F.when(F.col("row.text").isNotNull(), pii.redacted(F.col("text"), F.col("spans")))
    out = found.select("row", text.alias("clean"))
    return out.select(*filled(docs, {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    found = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("key", "doc_id")


STAGES = [
    ("language", identify),
    ("simhash", near_duplicates),
    ("substrings", passages),
    ("pii", personal_data),
    ("packing", pack),
]

#: A trained model decides in the first stage, so SQL can not give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
