"""States of queued jobs, as rewrites of a job table ``(job_id, state, created_at, started_at)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _older(at: Column, now: Column, minutes: int) -> Column:
    return at < now - F.make_interval(mins=F.lit(minutes))


def reclaimed(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Jobs that have run too long wait again."""
    stale = F.coalesce((F.col("state") == "running") & _older(F.col("started_at"), now, minutes), F.lit(False))
    return jobs.withColumns({"state": F.when(stale, "pending").otherwise(F.col("state")), "started_at": F.when(~stale, F.col("started_at"))})


def adopted(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Jobs that no queue knows and that have waited too long are queued."""
    stranded = F.col("state").isNull() & _older(F.col("created_at"), now, minutes)
    return jobs.withColumn("state", F.when(stranded, "pending").otherwise(F.col("state")))


def claimed(jobs: DataFrame, now: Column, cap: int) -> DataFrame:
    """The oldest waiting jobs run, as many as the cap leaves room for beside those that run: a top-k of
    ``cap`` rows at most, which bounds what is numbered and broadcast."""
    running = jobs.where("state = 'running'").agg(F.count("*").alias("n")).scalar()
    oldest = jobs.where("state = 'pending'").orderBy("created_at", "job_id").limit(cap)
    picked = oldest.withColumn("_n", F.row_number().over(Window.orderBy("created_at", "job_id"))).where(F.col("_n") + running <= cap).select("job_id", F.lit(True).alias("_go"))
    out = jobs.join(F.broadcast(picked), "job_id", "left")
    go = F.coalesce("_go", F.lit(False))
    return out.withColumn("state", F.when(go, "running").otherwise(F.col("state"))).withColumn("started_at", F.when(go, now).otherwise(F.col("started_at"))).drop("_go")


def progress(visited: Column, total: Column) -> Column:
    return F.least(F.lit(100), F.round(100 * visited / F.greatest(total, F.lit(1))).cast("int"))


def budgeted(pages: DataFrame, budget: int, least: int = 500) -> DataFrame:
    """(site, admitted): page texts in order until a token budget is used up, about four characters a token.

    ``pages(site, place, text)``.  A text that doesn't fit is cut at the last blank line beyond its
    middle, and only where more than ``least`` tokens are left; then the fold ends.  A site's pages are
    a crawl's page budget at most, so they are folded as one array.
    """
    tokens = lambda t: F.ceil(F.length(t) / 4).cast("int")
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("texts"), F.lit(False).alias("done"))

    def step(acc, page):
        text, left = page["text"], acc["left"]
        cut = F.substring(text, 1, left * 4)
        at = F.length(cut) - F.instr(F.reverse(cut), "\n\n") - 1
        cut = F.when((F.instr(cut, "\n\n") > 0) & (at > F.length(cut) / 2), F.substring(cut, F.lit(1), at)).otherwise(cut)
        fits = tokens(text) <= left
        added = F.when(acc["done"], acc["texts"]).when(fits, F.concat(acc["texts"], F.array(text))).when(left > least, F.concat(acc["texts"], F.array(cut))).otherwise(acc["texts"])
        return F.struct(F.when(~acc["done"] & fits, left - tokens(text)).otherwise(left).alias("left"), added.alias("texts"), (acc["done"] | ~fits).alias("done"))

    ordered = F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("site").agg(ordered.alias("p")).select("site", F.aggregate("p", start, step, lambda acc: acc["texts"]).alias("admitted"))


def nudge(candidates: list[tuple[str, Column]]) -> Column:
    """The first of ordered candidates that is eligible."""
    return F.coalesce(*[F.when(when, F.lit(name)) for name, when in candidates])


def cleared(runs: DataFrame, scores: list[str]) -> DataFrame:
    """Runs whose failed ones keep no score of an earlier attempt."""
    failed = F.coalesce(F.col("state") == "failed", F.lit(False))
    return runs.withColumns({name: F.when(~failed, F.col(name)) for name in scores})


def outcomes(runs: DataFrame) -> DataFrame:
    """An event for each run that ended: ``failed``, ``recheck`` where the series had succeeded before, else
    ``completed``; ``runs(run_id, series, state, created_at)``, ties in time by id.

    What a run needs of its series is the first success, so the series is reduced to one row instead of
    being sorted.
    """
    at = F.struct("created_at", "run_id")
    first = runs.where("state = 'succeeded'").groupBy("series").agg(F.min(at).alias("_first"))
    event = F.when(F.col("state") == "failed", "failed").when(at > F.col("_first"), "recheck").otherwise("completed")
    return runs.where("state in ('failed', 'succeeded')").join(first, "series", "left").select("run_id", event.alias("event"))


def sessions(uses: DataFrame, ttl: int, absolute: int) -> DataFrame:
    """(session, ends, uses) of ``uses(session, at)``: a use before the end moves it to ``ttl`` seconds later, but no further than ``absolute`` seconds after the first.

    A use at or after the end is none: the session has ended and doesn't revive.
    """
    order = Window.partitionBy("session").orderBy("at")
    since = lambda t: F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(t.cast("timestamp"))
    first = F.min("at").over(Window.partitionBy("session"))
    over = (since(F.lag("at").over(order)) >= ttl * 1_000_000) | (since(first) >= absolute * 1_000_000)
    alive = F.max(F.coalesce(over, F.lit(False)).cast("int")).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) == 0
    later = lambda t, seconds: t + F.make_interval(secs=F.lit(seconds))
    kept = uses.withColumn("_alive", alive).where("_alive").groupBy("session").agg(F.min("at").alias("_first"), F.max("at").alias("_last"), F.count("*").alias("uses"))
    return kept.select("session", F.least(later(F.col("_first"), absolute), later(F.col("_last"), ttl)).alias("ends"), "uses")


def live_sessions(uses: DataFrame, now: Column, ttl: int, absolute: int) -> DataFrame:
    """Sessions that have not ended at ``now``, by the uses up to then; ``now`` may be a scalar of a query."""
    return sessions(uses.where(F.col("at") <= now), ttl, absolute).where(F.col("ends") > now)

