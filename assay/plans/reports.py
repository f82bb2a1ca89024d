"""Reports over the catalog and the scan history. Each is one lazy DataFrame.

Windows without a partition key appear only on aggregates with a few rows: the counts per
extension are first cut to the leading ones by a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import text
from assay.functions.paths import contains_text, has_ext, has_prefix, report_ext
from assay.operators import scans as scan_ops
from assay.schemas import ISSUE_STATUSES, STATUSES


def status_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("status").agg(F.count("*").alias("cnt"))


def totals(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count("*").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size_bytes")
    )


def format_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(report_ext("path").alias("ext")).agg(F.count("*").alias("cnt"))


def format_status_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(report_ext("path").alias("ext"), "status").agg(F.count("*").alias("cnt"))


def ordered(counts: DataFrame, *ties: str) -> DataFrame:
    return counts.orderBy(F.desc("cnt"), *ties)


def _leading(counts: DataFrame, limit: int) -> DataFrame:
    """Top ``limit`` extensions by count with their rank, as a top-k without a full sort."""
    top = counts.orderBy(F.desc("cnt"), "ext").limit(limit)
    packed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), "ext"))).alias("t"))
    return packed.select(F.posexplode("t").alias("pos", "e")).select(
        (F.col("pos") + 1).cast("long").alias("rank"), F.col("e.ext").alias("ext")
    )


def file_type_breakdown(catalog: DataFrame, limit: int = 6) -> DataFrame:
    """Leading extensions and one row for the rest, with label and share."""
    counts = format_counts(catalog)
    ranked = counts.join(F.broadcast(_leading(counts, limit)), "ext", "left")
    folded = ranked.groupBy(
        F.coalesce("rank", F.lit(limit + 1).cast("long")).alias("rank"),
        F.when(F.col("rank").isNull(), "other").otherwise(F.col("ext")).alias("ext"),
    ).agg(F.sum("cnt").alias("count"))
    return with_share(folded, half_even=True).select(
        "rank", "ext", text.ext_label("ext").alias("label"), "count", "percent"
    )


def with_share(segments: DataFrame, half_even: bool = False) -> DataFrame:
    """Adds each row's ``percent`` of the summed ``count``; drops zero counts.

    For short lists only (leading segments): they are folded into one array and back.
    """
    rows = segments.where(F.col("count") > 0)
    whole = rows.agg(
        F.sum("count").alias("_total"), F.collect_list(F.struct(*rows.columns)).alias("_rows")
    ).select("_total", F.explode("_rows").alias("_row"))
    return whole.select(
        "_row.*", text.percent_1dp(F.col("_row.count"), F.col("_total"), half_even).alias("percent")
    )


def overview_breakdown(catalog: DataFrame, limit: int = 6) -> DataFrame:
    """One segment per leading extension and status, the rest folded into ``other``."""
    counts = format_status_counts(catalog)
    per_ext = counts.groupBy("ext").agg(F.sum("cnt").alias("cnt"))
    ranked = counts.join(F.broadcast(_leading(per_ext, limit)), "ext", "left")
    rest = F.col("rank").isNull()
    segments = ranked.groupBy(
        F.when(rest, "other").otherwise(F.col("ext")).alias("ext"),
        F.when(rest, "other").otherwise(F.col("status")).alias("status"),
    ).agg(F.sum("cnt").alias("count"))
    other = F.col("ext") == "other"
    return segments.select(
        F.concat("ext", F.lit(":"), "status").alias("key"),
        F.when(other, "Others")
        .otherwise(F.concat(text.status_prefix("status"), F.lit(" "), text.ext_label("ext")))
        .alias("label"),
        "ext",
        "status",
        "count",
        F.when(other, "other").otherwise(text.status_tone("status")).alias("tone"),
    )


def overview_ordered(segments: DataFrame) -> DataFrame:
    """Largest segment first, the folded rest last."""
    return segments.orderBy(F.col("ext") == "other", F.desc("count"), "ext", "status")


def top_errors(catalog: DataFrame, limit: int = 5) -> DataFrame:
    return (
        catalog.where(F.col("error").isNotNull() & (F.col("error") != ""))
        .groupBy("error")
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), "error")
        .limit(limit)
    )


def stale(catalog: DataFrame, as_of: Column, days: int) -> DataFrame:
    return catalog.where(F.col("checked_at") < as_of - F.make_dt_interval(F.lit(days)))


def stale_count(catalog: DataFrame, as_of: Column, days: int) -> DataFrame:
    return stale(catalog, as_of, days).agg(F.count("*").alias("stale"))


def newest_first(files: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return files.orderBy(F.desc("checked_at"), "path").offset(offset).limit(limit)


def issue_files(
    catalog: DataFrame,
    statuses: Sequence[str] | None = ISSUE_STATUSES,
    ext: str | None = None,
    path_prefix: str | None = None,
    since: Column | None = None,
    search: str | None = None,
) -> DataFrame:
    """Catalog rows by status, extension, prefix, time and path text.

    An empty status list means every status.
    """
    rows = catalog
    if statuses:
        rows = rows.where(F.col("status").isin(*statuses))
    if since is not None:
        rows = rows.where(F.col("checked_at") >= since)
    if ext:
        rows = rows.where(has_ext("path", ext))
    if path_prefix:
        rows = rows.where(has_prefix("path", path_prefix))
    if search:
        rows = rows.where(contains_text("path", search))
    return rows


def issue_counts(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ISSUE_STATUSES],
    )


def preview(files: DataFrame, limit: int = 20) -> DataFrame:
    """First paths of a list, each with the number of files left out."""
    count = files.agg(F.count("*").alias("n"), F.lit(None).cast("array<string>").alias("paths"))
    top = newest_first(files, limit).agg(
        F.lit(None).cast("long").alias("n"),
        F.transform(
            F.array_sort(
                F.collect_list(F.struct((-F.unix_micros(F.col("checked_at").cast("timestamp"))).alias("t"), "path"))
            ),
            lambda r: r["path"],
        ).alias("paths"),
    )
    both = count.unionByName(top).agg(F.max("n").alias("n"), F.max("paths").alias("paths"))
    return both.select("n", F.posexplode("paths").alias("pos", "path")).select(
        (F.col("pos") + 1).cast("long").alias("rank"),
        "path",
        F.greatest(F.col("n") - limit, F.lit(0).cast("long")).alias("more"),
    )


def recent_scans(scans: DataFrame, limit: int = 20) -> DataFrame:
    return scans.orderBy(F.desc("started_at"), "id").limit(limit)


def scan_list(scans: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """Recent scans with state, duration and age."""
    length = text.seconds_between(F.col("started_at"), F.col("finished_at"))
    return recent_scans(scans, limit).select(
        "id",
        "scope",
        "total",
        "corrupt",
        "unreadable",
        scan_ops.completion().alias("completion"),
        scan_ops.scan_state(F.col("corrupt") + F.col("unreadable")).alias("state"),
        F.greatest(length, F.lit(0.0)).alias("duration_s"),
        text.duration(length).alias("duration"),
        text.age("started_at", as_of).alias("age"),
    )


def health_trend(scans: DataFrame, window: int = 5) -> DataFrame:
    """Completed scans among the latest few, each with the number of incomplete ones."""
    latest = recent_scans(scans, window)
    packed = latest.agg(
        F.count_if(F.col("finished_at").isNull()).alias("incomplete"),
        F.collect_list(
            F.struct("id", F.to_date("finished_at").cast("string").alias("day"), "total", "corrupt", "unreadable")
        ).alias("rows"),
    )
    return (
        packed.select("incomplete", F.explode("rows").alias("r"))
        .where(F.col("r.day").isNotNull())
        .select("r.*", "incomplete")
    )


def last_scan_state(catalog: DataFrame, scans: DataFrame) -> DataFrame:
    """State of the scan that started last, judged by the catalog's open issues.

    One row always, ``none`` when no scan was recorded.
    """
    order = F.struct("started_at", "id")
    issues = F.col("status").isin(*ISSUE_STATUSES)
    last = scans.agg(
        F.max_by("id", order).alias("scan_id"),
        F.max_by(F.col("finished_at").isNotNull(), order).alias("finished"),
        F.lit(None).cast("long").alias("issues"),
    )
    open_issues = catalog.agg(
        F.lit(None).cast("string").alias("scan_id"),
        F.lit(None).cast("boolean").alias("finished"),
        F.count_if(issues).alias("issues"),
    )
    both = last.unionByName(open_issues).agg(
        F.max("scan_id").alias("scan_id"), F.max("finished").alias("finished"), F.max("issues").alias("issues")
    )
    state = (
        F.when(F.col("scan_id").isNull(), "none")
        .when(~F.col("finished"), "incomplete")
        .when(F.col("issues") > 0, "completed with issues")
        .otherwise("completed")
    )
    return both.select("scan_id", "issues", state.alias("state"))


def health_state(
    catalog: DataFrame, config_error: bool = False, access_problem: bool = False, scanning: bool = False
) -> DataFrame:
    """One word for the library; the first condition that holds wins."""
    # State names in order of precedence.
    state = (
        F.when(F.lit(config_error), "Configuration needed")
        .when(F.lit(access_problem), "Access problem suspected")
        .when(F.lit(scanning), "Scan running")
        .when(F.col("issues") > 0, "Issues found")
        .when(F.col("files") > 0, "Healthy")
        .otherwise("Ready to scan")
    )
    return catalog.agg(
        F.count("*").alias("files"), F.count_if(F.col("status").isin(*ISSUE_STATUSES)).alias("issues")
    ).withColumn("state", state)


def metrics(catalog: DataFrame, scans: DataFrame) -> DataFrame:
    """Gauge rows ``(name, labels, value)``; the total is summed from the status counts, so
    the catalog is read once."""
    no_labels = F.create_map().cast("map<string,string>")
    per_status = status_counts(catalog)
    files = per_status.select(
        F.lit("files_total").alias("name"),
        F.create_map(F.lit("status"), F.col("status")).alias("labels"),
        F.col("cnt").cast("double").alias("value"),
    )
    indexed = per_status.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("double").alias("value")).select(
        F.lit("files_indexed_total").alias("name"), no_labels.alias("labels"), "value"
    )
    rate = (
        scan_ops.last_rate(scans)
        .where(F.col("files_per_sec").isNotNull())
        .select(
            F.lit("scan_rate_files_per_second").alias("name"),
            no_labels.alias("labels"),
            F.round("files_per_sec", 3).alias("value"),
        )
    )
    last = (
        recent_scans(scans, 1)
        .where(F.col("finished_at").isNotNull())
        .select(
            F.lit("last_scan_timestamp").alias("name"),
            F.create_map(F.lit("scan_id"), F.col("id")).alias("labels"),
            F.lit(1.0).alias("value"),
        )
    )
    return files.unionByName(indexed).unionByName(rate).unionByName(last)


def exposition(metric_rows: DataFrame) -> DataFrame:
    """Metric rows as text lines ``name{label="value"} number``."""
    pairs = F.transform(
        F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))
    )
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    is_rate = F.endswith("name", F.lit("_per_second"))
    value = F.when(is_rate, F.format_string("%.3f", "value")).otherwise(F.col("value").cast("long").cast("string"))
    return metric_rows.select(F.concat("name", labels, F.lit(" "), value).alias("line"))


def health_report(catalog: DataFrame, scans: DataFrame, as_of: Column, stale_days: int) -> DataFrame:
    """The dashboard as ``(section, key, value)`` rows.

    Status, format, size and staleness come from one pass over the catalog, grouped twice.
    """
    base = catalog.groupBy("status", report_ext("path").alias("ext")).agg(
        F.count("*").alias("n"),
        F.sum("size").alias("bytes"),
        F.count_if(F.col("checked_at") < as_of - F.make_dt_interval(F.lit(stale_days))).alias("stale"),
    )
    section = lambda name, key, value: [
        F.lit(name).alias("section"), key.alias("key"), value.cast("string").alias("value")
    ]
    # an empty group, so that the whole is there for an empty catalog too
    none = catalog.sparkSession.createDataFrame([(None, None, 0, 0, 0)], "status string, ext string, n long, bytes long, stale long")
    # a group counts for its status, its format and the whole
    groups = base.unionByName(none).groupingSets(
        [[F.col("status")], [F.col("ext")], []], F.col("status"), F.col("ext")
    ).agg(
        F.grouping_id().alias("of"),
        F.sum("n").alias("n"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("stale"), F.lit(0)).alias("stale"),
    )
    cell = lambda *of: F.array(*[F.struct(*c) for c in of])
    figures = (
        F.when(F.col("of") == 1, cell(section("status", F.col("status"), F.col("n"))))
        .when(F.col("of") == 2, cell(section("format", F.col("ext"), F.col("n"))))
        .otherwise(
            cell(
                section("size", F.lit("total size"), text.byte_size("bytes")),
                section("stale", F.lit(f">{stale_days} days"), F.col("stale")),
            )
        )
    )
    cells = groups.where((F.col("n") > 0) | (F.col("of") == 3)).select(F.inline(figures))
    trend = health_trend(scans).select(
        F.lit("trend").alias("section"),
        F.col("id").alias("key"),
        F.format_string("%d total %d corrupt %d unreadable", "total", "corrupt", "unreadable").alias("value"),
    )
    errors = top_errors(catalog).select(
        F.lit("error").alias("section"), text.truncated("error").alias("key"), F.col("cnt").cast("string").alias("value")
    )
    return cells.unionByName(trend).unionByName(errors)


def status_domain(catalog: DataFrame) -> DataFrame:
    """Counts for every status of the domain, zero where none occurs, one row per status."""
    wide = catalog.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    pairs = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("cnt")) for s in STATUSES])
    return wide.select(F.explode(pairs).alias("p")).select("p.*")
