"""Breadth-first walks of a link graph, level by level; every level is a written table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.scratch import written


def walk(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(page_id, depth): pages within ``depth`` links of the start, at their smallest distance.

    One join a level, as a crawl's depth is small; a level holds only pages not met before.
    """
    seen = level = written(start.distinct().withColumn("depth", F.lit(0)), "level")
    for n in range(1, depth + 1):
        found = level.join(edges, F.col("page_id") == F.col("src")).select(F.col("dst").alias("page_id")).distinct()
        level = written(found.join(seen, "page_id", "left_anti").withColumn("depth", F.lit(n)), "level")
        seen = seen.unionByName(level)
    return seen


POPPED = "site string, n long, url string, depth int, outcome string, final string"
STEP = f"{POPPED}, queued array<string>, truncated boolean"


def _level(budget: int, expand: bool):
    """Works off a site's stretch of the queue; its rows are no more than the budget."""

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("n")
        visited, waiting, met = int(rows["visited"].iloc[0]), len(rows), set()
        out = []
        for r in rows.itertuples():
            waiting -= 1
            outcome, queued = "visited", []
            if visited >= budget:
                outcome = "left"
            elif r.final is None:
                outcome = "failed"
            elif r.final != r.url and (r.known or r.final in met):
                outcome = "alias"
            else:
                met.add(r.final)
                if r.foreign:
                    outcome = "foreign"
                else:
                    visited += 1
                    for to in r.links if expand else ():
                        if visited + waiting + len(queued) < budget and to not in met:
                            met.add(to)
                            queued.append(to)
                    waiting += len(queued)
            out.append((key[0], r.n, r.url, r.depth, outcome, r.final, queued, outcome == "visited" and not expand and r.leads))
        yield pd.DataFrame(out, columns=["site", "n", "url", "depth", "outcome", "final", "queued", "truncated"])

    return run


def crawl(starts: DataFrame, fetched: DataFrame, links: DataFrame, seeds: DataFrame | None = None, budget: int = 25, depth: int = 1) -> DataFrame:
    """(site, n, url, depth, outcome, final): the queue of a budgeted crawl of each site of ``starts(site, url)``.

    ``fetched(url, final)`` has where each address ended (null: it failed, as does one that is not
    there); ``links(url, position, target)`` the links of final addresses that may be followed, in
    order; ``seeds(site, url)`` further first addresses.  ``n`` is the order in the queue, 0 for the start.

    A link is queued unless its address was queued or ended at before, and only while the pages
    visited and those that wait are fewer than ``budget``.  Outcomes: ``visited``; ``failed``; ``alias``: it ended where the
    crawl has been or will be; ``foreign``: it ended outside its site's start; ``left``: the budget was used up before.  A page that fails
    makes room for another.  First addresses are queued by length, then alphabet, those linked from the start before
    the seeds; depth 0 means no limit.

    A site's part of a level has no more pages than the budget, so one task works it off in order;
    addresses met before are found by joins.
    """
    first = starts.select("site", F.lit(0).cast("long").alias("n"), "url", F.lit(0).alias("depth"), F.lit("visited").alias("outcome"), F.col("url").alias("final"))
    begun = starts.select("site", F.col("url").alias("_start"))
    linked = starts.join(links, "url").select("site", F.col("target").alias("url"), F.lit(0).alias("_kind"))
    offered = linked if seeds is None else linked.unionByName(seeds.select("site", "url", F.lit(1).alias("_kind")))
    offered = offered.groupBy("site", "url").agg(F.min("_kind").alias("_kind")).join(starts, ["site", "url"], "left_anti")
    order = Window.partitionBy("site").orderBy("_kind", F.length("url"), "url")
    queue = offered.withColumn("n", F.row_number().over(order)).where(F.col("n") < budget).select("site", "n", "url", F.lit(1).alias("depth"))

    done = written(first.withColumn("truncated", F.lit(False)), "crawl")
    met = written(starts.select("site", "url").unionByName(queue.select("site", "url")), "met")
    level, at = written(queue, "queue"), 1
    while not level.isEmpty():
        expand = depth == 0 or at < depth
        here = level.join(fetched, "url", "left").join(begun, "site")
        known = met.select("site", F.col("url").alias("final"), F.lit(True).alias("known"))
        here = here.join(known, ["site", "final"], "left")
        follow = here.where(F.col("final").isNotNull()).select("site", "n", F.col("final").alias("url")).join(links, "url").select("site", "n", "position", F.col("target").alias("url"))
        leads = follow.select("site", "n").distinct().withColumn("leads", F.lit(True))
        fresh = follow.join(met, ["site", "url"], "left_anti").groupBy("site", "n", "url").agg(F.min("position").alias("position"))
        rank = F.row_number().over(Window.partitionBy("site", "n").orderBy("position", "url"))
        fresh = fresh.withColumn("_r", rank).where(F.col("_r") <= 2 * budget)  # met in this level: a budget's worth at most, and a budget's worth that is queued
        fresh = fresh.groupBy("site", "n").agg(F.array_sort(F.collect_list(F.struct("_r", "url"))).alias("_l")).select("site", "n", F.col("_l.url").alias("links"))
        visited = done.groupBy("site").agg(F.count_if(F.col("outcome") == "visited").alias("visited"))
        work = here.join(fresh, ["site", "n"], "left").join(leads, ["site", "n"], "left").join(visited, "site")
        foreign = ~U.should_follow(F.col("final"), U.origin_prefix(F.col("_start")))
        work = work.select("site", "n", "url", "depth", "final", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce(foreign, F.lit(False)).alias("foreign"), F.coalesce("leads", F.lit(False)).alias("leads"), F.coalesce("links", F.array().cast("array<string>")).alias("links"), "visited")
        step = written(work.groupBy("site").applyInPandas(_level(budget, expand), STEP), "crawl")
        last = step.groupBy("site").agg(F.max("n").alias("_last"))
        queued = step.select("site", "n", "depth", F.posexplode("queued").alias("_p", "url"))
        following = F.row_number().over(Window.partitionBy("site").orderBy("n", "_p"))
        queued = queued.withColumn("_k", following).join(last, "site").select("site", (F.col("_last") + F.col("_k")).alias("n"), "url", F.col("depth") + 1)
        level = written(queued.toDF("site", "n", "url", "depth"), "queue")
        ended = step.where(F.col("outcome").isin("visited", "foreign")).select("site", F.col("final").alias("url"))
        met = written(met.unionByName(level.select("site", "url")).unionByName(ended).distinct(), "met")
        done, at = done.unionByName(step.drop("queued")), at + 1
    return done


def crawl_summary(crawled: DataFrame, budget: int) -> DataFrame:
    """(site, visited, failed, aliases, stop_reason) of ``crawl``: max_pages, max_depth or queue_empty."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    reason = F.when((F.max_by("outcome", "n") == "left"), "max_pages").when(F.bool_or("truncated"), "max_depth").otherwise("queue_empty")
    return crawled.groupBy("site").agg(count("visited").alias("visited"), count("failed").alias("failed"), count("alias").alias("aliases"), reason.alias("stop_reason"))
