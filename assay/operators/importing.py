"""Import of portable records into a catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.paths import ancestors, remap_prefix
from assay.operators.skew import join_facts


def prepare(records: DataFrame, path_map: Mapping[str, str] | None = None) -> DataFrame:
    """Defaults for missing keys and remapped paths; ``ordinal`` is the input order."""
    path = F.coalesce("path", F.lit(""))
    if path_map:
        path = F.when(path == "", path).otherwise(remap_prefix(path, path_map))
    return (
        records.withColumn("path", path)
        .withColumn("mtime", F.coalesce("mtime", F.lit(0.0)))
        .withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
        .withColumn("status", F.coalesce("status", F.lit("error")))
    )


def _facts(keyed: DataFrame, catalog: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per imported path: is it stored, does it exist, its first record."""
    none, yes = F.lit(None).cast("boolean"), F.lit(True)
    no_ordinal = F.lit(None).cast("long")
    side = lambda df, path, stored, exists, ordinal: df.select(
        path.alias("_key"), stored.alias("_stored"), exists.alias("_exists"), ordinal.alias("_ordinal")
    )
    sides = (
        side(keyed.where(F.col("_key").isNotNull()), F.col("_key"), none, none, F.col("ordinal").cast("long"))
        .unionByName(side(catalog, F.col("path"), yes, none, no_ordinal))
        .unionByName(side(existing, F.col("path"), none, yes, no_ordinal))
    )
    return sides.groupBy("_key").agg(
        F.max("_stored").alias("_stored"),
        F.max("_exists").alias("_exists"),
        F.min("_ordinal").alias("_first"),
        F.count("_ordinal").alias("_records"),
    ).where(F.col("_first").isNotNull())


def actions(records: DataFrame, catalog: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``action`` to every prepared record.

    ``inserted``, ``skipped_empty``, ``skipped_missing`` (not in the ``existing`` inventory)
    or ``skipped_existing``. Without ``force`` only the first record of a new path is
    inserted. All that matters about a path is gathered in one aggregate, so records are
    joined once, and a path with very many records is split.
    """
    keyed = records.withColumn("_key", F.when(F.col("path") != "", F.col("path")))
    joined = join_facts(keyed, _facts(keyed, catalog, existing).drop("_records"), "_key")
    action = F.when(F.col("_key").isNull(), "skipped_empty").when(F.col("_exists").isNull(), "skipped_missing")
    if not force:
        taken = F.col("_stored").isNotNull() | (F.col("ordinal") != F.col("_first"))
        action = action.when(taken, "skipped_existing")
    return joined.withColumn("action", action.otherwise("inserted")).drop("_key", "_exists", "_stored", "_first")


def result_counts(with_actions: DataFrame) -> DataFrame:
    """``inserted`` and ``skipped`` in one row."""
    return with_actions.agg(
        F.count_if(F.col("action") == "inserted").alias("inserted"),
        F.count_if(F.col("action") != "inserted").alias("skipped"),
    )


def import_counts(records: DataFrame, catalog: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """``inserted`` and ``skipped`` of prepared records in one row, from what is known of their paths:
    no record is joined. A record without ordinal counts as skipped."""
    keyed = records.withColumn("_key", F.when(F.col("path") != "", F.col("path")))
    taken = F.col("_records") if force else F.when(F.col("_stored").isNull(), 1).otherwise(0)
    found = _facts(keyed, catalog, existing).where(F.col("_exists")).agg(F.coalesce(F.sum(taken), F.lit(0)).alias("inserted"))
    return records.agg(F.count("*").alias("n")).join(found).select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))


def _winners(records: DataFrame, existing: DataFrame, last: bool) -> DataFrame:
    order = F.desc("ordinal") if last else F.asc("ordinal")
    w = Window.partitionBy("path").orderBy(order)
    return (
        records.where(F.col("path") != "")
        .withColumn("_rank", F.row_number().over(w))
        .where("_rank = 1")
        .drop("_rank", "ordinal")
        .join(existing.select("path"), "path", "left_semi")
    )


def apply_import(catalog: DataFrame, records: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Catalog after the import. Stored rows win, or with ``force`` the imported ones."""
    new = _winners(records, existing, last=force)
    if force:
        kept, added = catalog.join(new.select("path"), "path", "left_anti"), new
    else:
        kept, added = catalog, new.join(catalog.select("path"), "path", "left_anti")
    return kept.unionByName(added.select(*catalog.columns))


def remap_by_table(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """``remap_prefix`` for many mappings: ``mapping(ordinal, old, new)``.

    An equi-join on the path's own ancestors replaces a row-by-mapping comparison; the
    lowest ordinal wins, by an aggregate that combines on the map side.
    """
    prefixes = mapping.select(
        F.rtrim(F.col("old"), F.lit("/")).alias("prefix"), "ordinal", F.rtrim(F.col("new"), F.lit("/")).alias("new")
    )
    best = (
        df.select("path")
        .distinct()
        .select("path", F.explode(ancestors("path")).alias("prefix"))
        .join(prefixes, "prefix")
        .groupBy("path")
        .agg(F.min(F.struct("ordinal", "new", "prefix")).alias("_hit"))
    )
    tail = F.substring(F.col("path"), F.length("_hit.prefix") + 1, F.length("path"))
    moved = F.when(F.col("_hit").isNull(), F.col("path")).otherwise(F.concat("_hit.new", tail))
    return join_facts(df, best, "path").withColumn("path", moved).drop("_hit")
