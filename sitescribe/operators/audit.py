"""Audits across the pages of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.scoring import freshness_band


def duplicate_values(pages: DataFrame, value: str) -> DataFrame:
    """Values that two pages of a site or more share, with their number and first page."""
    found = pages.where(F.coalesce(F.trim(F.col(value)), F.lit("")) != "").groupBy("site", value)
    return found.agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page")).where("n_pages > 1")


def most_common(pages: DataFrame, value: str) -> DataFrame:
    """The commonest value of each site; of equally common ones that which comes first."""
    counts = pages.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy("site", value).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    best = F.max_by(F.struct(F.col(value).alias("v"), "n"), F.struct("n", -F.col("first"))).alias("b")
    return counts.groupBy("site").agg(best, F.count("*").alias("n_variants")).select("site", F.col("b.v").alias(value), F.col("b.n").alias("n_pages"), "n_variants")


def entity_consistency(organisations: DataFrame) -> DataFrame:
    """Of rows (site, name, description): distinct values, and whether there is one at most."""
    out = organisations.groupBy("site").agg(F.count_distinct("name").alias("names"), F.count_distinct("description").alias("descriptions"), F.count("*").alias("n_blocks"))
    return out.withColumn("name_consistent", F.col("names") <= 1).withColumn("description_consistent", F.col("descriptions") <= 1)


def schema_coverage(pages: DataFrame) -> DataFrame:
    """Of rows (site, page_id, types): pages with structured data, their share, numbers by type."""
    share = pages.groupBy("site").agg(F.count("*").alias("n_pages"), F.count_if(F.size("types") > 0).alias("with_schema"))
    share = share.withColumn("coverage_pct", F.bround(100 * F.col("with_schema") / F.col("n_pages"), 1))
    kinds = pages.select("site", F.explode("types").alias("t")).groupBy("site", "t").count()
    kinds = kinds.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "count")))).alias("type_counts"))  # types are few
    return share.join(kinds, "site", "left")


def first_of_page(pages: DataFrame) -> DataFrame:
    """One row a page: a start page that is given apart and among the pages counts once."""
    first = F.min_by(F.struct(*pages.columns), "page_id").alias("_r")  # combines before the shuffle
    return pages.groupBy("site", "url").agg(first).select("_r.*")


def canonical_mismatches(pages: DataFrame) -> DataFrame:
    """Pages whose canonical address, resolved, is another host or path; ``pages(page_id, url, canonical)``."""
    canonical = F.trim(F.col("canonical"))
    host = F.when(canonical.startswith("/"), U.domain_of(F.col("url"))).otherwise(U.domain_of(canonical))
    path = F.when(canonical.startswith("/"), F.regexp_replace(F.regexp_replace(canonical, "[?#].*$", ""), "/+$", "")).otherwise(F.regexp_replace(U.canonical_path(canonical), "/+$", ""))
    same = (host == U.domain_of(F.col("url"))) & (path == F.regexp_replace(U.canonical_path(F.col("url")), "/+$", ""))
    return pages.where(F.coalesce(canonical, F.lit("")) != "").where(~same).select("page_id", "url", "canonical")


def freshness(dated: DataFrame, as_of) -> DataFrame:
    """Mean age in days of each site's dates, and its points; ``dated(site, url, at)``, a page once.

    Days are whole; dates to come are 0 days old.
    """
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("at")) / 86400))
    out = dated.distinct().groupBy("site").agg(F.avg(age).alias("mean_days"), F.count_distinct("url").alias("pages_with_dates"))
    return out.withColumn("score", freshness_band(F.col("mean_days")))
