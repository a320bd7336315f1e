"""Small summaries: sums in trailing windows, unions in the order of sight, ranges, counts and deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.scoring import rounded
from .projections import priority_rank


def trailing_sum(events: DataFrame, seconds: int, amount: str, limit: float) -> DataFrame:
    """(event_id, used, limited): what each user used in the seconds up to each event, and whether that is beyond the limit."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    used = F.sum(amount).over(Window.partitionBy("user_id").orderBy(at).rangeBetween(-seconds, 0))
    return events.select("event_id", used.alias("used"), (used > limit).alias("limited"))


def first_seen(rows: DataFrame) -> DataFrame:
    """(site, items) of ``rows(site, place, items)``: the distinct items of each site in the order in which they were first seen."""
    each = rows.select("site", "place", F.posexplode("items").alias("pos", "item")).where("item is not null")
    firsts = each.groupBy("site", "item").agg(F.min(F.struct("place", "pos")).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "item")))  # distinct items of one site
    return firsts.groupBy("site").agg(F.transform(listed, lambda x: x["item"]).alias("items"))


def date_range(dated: DataFrame) -> DataFrame:
    """(site, oldest, newest, pages) of ``dated(site, url, at)``."""
    return dated.groupBy("site").agg(F.min("at").alias("oldest"), F.max("at").alias("newest"), F.count_distinct("url").alias("pages"))


def structural_counts(payloads: DataFrame) -> DataFrame:
    """(run_id, pages, emails, internal, external): sizes of a payload's lists, of two sources the larger one; what is no list counts 0."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    return payloads.select("run_id", F.greatest(size("pages"), size("markdowns")).alias("pages"), *(size(c).alias(c) for c in ("emails", "internal", "external")))


def lens_deltas(runs: DataFrame, lenses: tuple[str, ...] = ("aeo", "geo", "aax")) -> DataFrame:
    """``runs(series, run_id, created_at, <lenses>)`` with a delta a lens against the run before; none where no lens has one."""
    order = Window.partitionBy("series").orderBy("created_at", "run_id")
    deltas = [rounded(F.col(x) - F.lag(x).over(order), 1).alias(x) for x in lenses]
    out = runs.withColumn("since_last", F.struct(*deltas))
    known = reduce(Column.__or__, [F.col(f"since_last.{x}").isNotNull() for x in lenses])
    return out.withColumn("since_last", F.when(known, F.col("since_last")))


def top_fixes(fixes: DataFrame, k: int = 3) -> DataFrame:
    """(run, fixes): the first k fixes of each run by priority, then as they came; the rest are left before they are gathered."""
    order = Window.partitionBy("run").orderBy(F.when(F.col("priority").isin("high", "medium", "low", "info"), priority_rank(F.col("priority"))).otherwise(99), "place")
    first = fixes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return first.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "fix"))), lambda x: x["fix"]).alias("fixes"))


def unchanged_count(old: DataFrame, new: DataFrame) -> DataFrame:
    """(run, unchanged): findings of ``old`` and ``new(run, finding)`` that both sides have; runs of both sides are there."""
    both = old.distinct().withColumn("_o", F.lit(1)).unionByName(new.distinct().withColumn("_o", F.lit(2)))
    each = both.groupBy("run", "finding").agg(F.count("*").alias("n"))
    return each.groupBy("run").agg(F.count_if(F.col("n") == 2).alias("unchanged"))


def canonical_domain(canonical: Column, og_url: Column, url: Column) -> Column:
    """The host of the canonical address, else of the preview's, else of the crawl's."""
    host = lambda c: F.when(U.domain_of(c) != "", U.domain_of(c))
    return F.coalesce(host(canonical), host(og_url), U.domain_of(url))


def site_scope(params: Column) -> Column:
    """A run of a whole site has parameters; a JSON null is none."""
    return F.coalesce(F.trim(params) != "null", F.lit(False))


def prospects(rows: DataFrame, status: str = "", q: str = "", tag: str = "") -> DataFrame:
    """``rows(domain, title, status, tags)`` with a status, a part of domain or title, and a tag, each where one is asked for; case doesn't count."""
    out = rows.where(F.lower("status") == status.lower()) if status else rows
    if q:
        out = out.where(F.contains(F.lower("domain"), F.lit(q.lower())) | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(q.lower())))
    return out.where(F.contains(F.lower(F.coalesce("tags", F.lit(""))), F.lit(tag.lower()))) if tag else out


def contact_rows(prospects_: DataFrame) -> DataFrame:
    """The six columns of an export of contacts; write them ordered by ``updated_at``, newest first."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return prospects_.select("domain", text("email").alias("email"), text("title").alias("title"), text("status").alias("status"), text("tags").alias("tags"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def finalised(jobs: DataFrame, now: Column, page_seconds: int = 180, grace: int = 60) -> DataFrame:
    """``jobs(run_id, state, scope, started_at, budget, visited)`` after those that are stuck were ended.

    A running job is stuck beyond its budget and a grace, or as a page's beyond ``page_seconds``.  It fails, but for a site of which
    pages were visited: that succeeds with what it has.  ``note`` says so.
    """
    elapsed = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    site = F.col("scope") == "site"
    stuck = F.coalesce((F.col("state") == "running") & F.when(site, elapsed > F.col("budget") + grace).otherwise(elapsed > page_seconds), F.lit(False))
    partial = site & (F.coalesce("visited", F.lit(0)) > 0)
    state = F.when(stuck & partial, "succeeded").when(stuck, "failed").otherwise(F.col("state"))
    return jobs.withColumns({"state": state, "note": F.when(stuck, "time_budget_exceeded")})
