"""Sitemap walks: for each site a queue of sitemaps, kept as a table and worked off level by level.

A site's queue is first in, first out, so a level of the walk is a stretch of the queue.  Whether a child
still fits depends on how many entries the queue has had by then.  That count is a sum that is cut off at a cap
which only rises, so it is a running minimum: a level needs windows over the queue, and no
loop over its entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.scratch import written
from .extract import sitemap_entries


def sitemap_walk(files: DataFrame, seeds: DataFrame, limit: int = 20) -> DataFrame:
    """(site, n, url, seen, found, n_pages, n_children): the queue of each site of ``seeds(site, place, url)``.

    ``files(source, xml)`` has what each address returned.  Entries that were ``seen`` before are skipped,
    so cycles end; others are read, if ``found``.  A sitemap's children are appended in order, those that were read before
    left out, as long as the sitemaps read and those that wait are fewer than ``limit``;
    the seeds are not limited.
    """
    parsed = written(sitemap_entries(files), "sitemaps")
    known = files.select("source").distinct()
    pages = parsed.where("kind = 'page'").groupBy("source").agg(F.count("*").alias("n_pages"))
    children = parsed.where("kind = 'sitemap'").select("source", "position", F.col("loc").alias("child"))
    sizes = children.groupBy("source").agg(F.count("*").alias("n_children"))

    order = Window.partitionBy("site").orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    first = seeds.groupBy("site", "url").agg(F.min("place").alias("place"))
    queue = first.select("site", "url", F.row_number().over(Window.partitionBy("site").orderBy("place", "url")).alias("n"), F.lit(False).alias("seen"))
    levels = [written(queue, "queue")]
    while not levels[-1].isEmpty():
        so_far = reduce(DataFrame.unionByName, levels)
        here = levels[-1].withColumnRenamed("seen", "_seen").where("not _seen").select("site", "n", "url")
        offered = here.join(children, F.col("url") == F.col("source")).select("site", "n", "position", "child")
        read = so_far.groupBy("site", F.col("url").alias("child")).agg(F.min("n").alias("_first"))
        offered = offered.join(read, ["site", "child"], "left").where("_first is null or _first > n").drop("_first")
        wanted = offered.groupBy("site", "n").agg(F.count("*").alias("wanted"))
        before = so_far.groupBy("site").agg(F.max("n").alias("had"))
        level = levels[-1].select("site", "n").join(wanted, ["site", "n"], "left").join(before, "site").join(_skipped(so_far), ["site", "n"])
        level = level.withColumn("sum", F.sum(F.coalesce("wanted", F.lit(0))).over(upto))
        cap = F.greatest(F.lit(limit) + F.col("skipped"), F.col("had"))
        level = level.withColumn("after", F.col("sum") + F.least(F.col("had"), F.min(cap - F.col("sum")).over(upto)))
        level = level.withColumn("from", F.coalesce(F.lag("after").over(order), F.col("had")))
        ranked = offered.withColumn("r", F.row_number().over(Window.partitionBy("site", "n").orderBy("position")))
        taken = ranked.join(level.select("site", "n", "from", "after"), ["site", "n"]).where("from + r <= after")
        taken = taken.select("site", F.col("child").alias("url"), (F.col("from") + F.col("r")).cast("int").alias("n"))
        earlier = F.row_number().over(Window.partitionBy("site", "url").orderBy("n")) > 1
        again = so_far.select("site", "url").distinct().withColumn("_old", F.lit(True))
        taken = taken.withColumn("_again", earlier).join(again, ["site", "url"], "left")
        levels.append(written(taken.select("site", "url", "n", (F.col("_again") | F.coalesce("_old", F.lit(False))).alias("seen")), "queue"))
    out = reduce(DataFrame.unionByName, levels)
    for counts in (pages, sizes, known.withColumn("found", F.lit(True))):
        out = out.join(counts.withColumnRenamed("source", "url"), "url", "left")
    once = lambda c: F.when(~F.col("seen"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    return out.select("site", "n", "url", "seen", (~F.col("seen") & F.coalesce("found", F.lit(False))).alias("found"), once("n_pages"), once("n_children"))


def _skipped(queue: DataFrame) -> DataFrame:
    """How many entries up to each were skipped: they leave the queue without being read."""
    upto = Window.partitionBy("site").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return queue.select("site", "n", F.sum(F.col("seen").cast("int")).over(upto).alias("skipped"))


def sitemap_pages(files: DataFrame, seeds: DataFrame, limit: int = 20, max_urls: int = 1000) -> DataFrame:
    """(site, place, url, sitemap): the first ``max_urls`` pages of each site's walk, in its order.

    A sitemap's place follows from the sizes of those before it, so pages are not sorted.
    """
    walk = written(sitemap_walk(files, seeds, limit).where("found"), "walk")
    before = F.coalesce(F.sum("n_pages").over(Window.partitionBy("site").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = walk.select("site", F.col("url").alias("sitemap"), before.alias("before")).where(F.col("before") < max_urls)
    pages = sitemap_entries(files).where("kind = 'page'").select(F.col("source").alias("sitemap"), "position", F.col("loc").alias("url"))
    place = F.col("before") + F.col("position")
    return starts.join(pages, "sitemap").where(place < max_urls).select("site", place.alias("place"), "url", "sitemap")
