"""Events of users: windows of time, claims, stages, and the state that they fold into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct items that move a user to the larger segment.
THRESHOLD = 5
# Stages by rank, and the event that reaches each.
STAGES = {"signup": 1, "view": 2, "click": 3, "purchase": 4}


def in_order():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def trailing_counts(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Events of the same user in the seconds up to each event, and whether the limit is reached."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    window = Window.partitionBy("user_id").orderBy(at).rangeBetween(-seconds, 0)
    n = F.count("*").over(window)
    return events.select("event_id", "user_id", n.alias("n_recent"), (n > limit).alias("limited"))


def daily_usage(events: DataFrame) -> DataFrame:
    """Counters by user and day, as repeated upserts would leave them."""
    day = F.to_date("ts")
    return events.groupBy("user_id", day.alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("value"), F.max("ts").alias("updated_at"))


def merged_usage(before: DataFrame, new: DataFrame) -> DataFrame:
    """Counters after an upsert that adds: union and sum."""
    return before.unionByName(new).groupBy("user_id", "day").agg(F.sum("calls").alias("calls"))


def first_claims(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each combination of keys."""
    first = F.min_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("_r")  # combines before the shuffle
    return events.groupBy(*keys).agg(first).select("_r.*")


def stages(events: DataFrame, rank: Column) -> DataFrame:
    """The highest stage that a user has reached by each event: it never falls."""
    return events.select("event_id", "user_id", "ts", F.max(rank).over(in_order().rowsBetween(Window.unboundedPreceding, 0)).alias("stage_rank"))


def segment_flips(events: DataFrame, item: Column, threshold: int = THRESHOLD) -> DataFrame:
    """The event by which each user has met ``threshold`` distinct items, exactly once a user."""
    met = first_claims(events.withColumn("_item", item), ["user_id", "_item"])
    counted = met.withColumn("distinct_items", F.row_number().over(in_order()))
    return counted.where(F.col("distinct_items") == threshold).select("user_id", "event_id", "ts", "distinct_items")


def state(events: DataFrame, item: Column, rank: Column, threshold: int = THRESHOLD) -> DataFrame:
    """What folding all events leaves for each user; the counter stops at the segment's threshold."""
    distinct = F.least(F.count_distinct(item), F.lit(threshold))
    return events.groupBy("user_id").agg(
        F.max("ts").alias("last_event_at"), F.count("*").alias("n_events"), F.max(rank).alias("stage_rank"), distinct.alias("distinct_items"),
        F.when(distinct >= threshold, "agency").otherwise("standard").alias("segment"),
    )


def taken_after_hit(events: DataFrame, hit: str, taken: str) -> DataFrame:
    """For each user the first hit and the first taking after it, if any."""
    hits = events.where(F.col("event_type") == hit).groupBy("user_id").agg(F.min("ts").alias("hit_at"))
    takes = events.where(F.col("event_type") == taken).select("user_id", "ts")
    later = hits.join(takes, "user_id", "left").groupBy("user_id", "hit_at")
    return later.agg(F.min(F.when(F.col("ts") > F.col("hit_at"), F.col("ts"))).alias("taken_at"))


def still_dismissed(events: DataFrame, kind: str, as_of: Column, days: int = 7) -> DataFrame:
    """Users whose last dismissal is younger than ``days``."""
    last = events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("ts").alias("dismissed_at"))
    return last.where(F.col("dismissed_at") > as_of - F.make_interval(days=F.lit(days)))


def kept(rows: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    """Rows that are not older than ``days``; 0 keeps all."""
    return rows if days <= 0 else rows.where(F.col(time) >= as_of - F.make_interval(days=F.lit(days)))


def admitted(requests: DataFrame, usage: DataFrame, running_limit: int, site_limit: int) -> DataFrame:
    """``requests`` and a ``status``: invalid, quota, cooldown or queued, first come first served.

    ``requests(user_id, ts, event_id, valid, refreshing, scope, series)``; ``usage(user_id, running, sites)`` has what each user
    holds already.  Only a request that is queued uses quota: one of the running jobs and, as all of a batch count there, one of
    the day's sites, which only bounds requests with scope ``site``.  A request that is valid and within quota cools down if its
    series is being refreshed, or was queued before it.

    Refusals use nothing, but no fold is needed: up to the smaller limit every first request of a series
    is queued, beyond it those for pages until the larger one is reached.  So two running counts give what was
    queued before each request.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda flag: F.coalesce(F.sum(flag.cast("int")).over(before), F.lit(0))
    room = lambda limit, used: F.greatest(F.lit(limit) - F.coalesce(used, F.lit(0)), F.lit(0))
    valid, refreshing = F.coalesce("valid", F.lit(False)), F.coalesce("refreshing", F.lit(False))
    site = F.coalesce(F.col("scope") == "site", F.lit(False))
    rows = requests.join(usage.groupBy("user_id").agg(F.max("running").alias("_running"), F.max("sites").alias("_sites")), "user_id", "left")
    rows = rows.withColumns({"_jobs": room(running_limit, F.col("_running")), "_days": room(site_limit, F.col("_sites")), "_open": valid & ~refreshing, "_site": site})
    rows = rows.withColumn("_first", F.col("_open") & (F.row_number().over(Window.partitionBy("user_id", "series", "_site", "_open").orderBy("ts", "event_id")) == 1))
    rows = rows.withColumn("_least", F.least("_jobs", "_days")).withColumn("_n", count(F.col("_first")))
    rows = rows.withColumn("_late", count(F.col("_first") & (F.col("_n") >= F.col("_least")) & ~F.col("_site")))
    queued = F.when(F.col("_n") < F.col("_least"), F.col("_n")).otherwise(F.col("_least") + F.least(F.col("_late"), F.col("_jobs") - F.col("_least")))
    allowed = (queued < F.col("_jobs")) & (~F.col("_site") | (queued < F.col("_days")))
    status = F.when(~valid, "invalid").when(~allowed, "quota").when(refreshing | ~F.col("_first"), "cooldown").otherwise("queued")
    return rows.withColumn("status", status).select(*requests.columns, "status")


def gate_claims(events: DataFrame) -> DataFrame:
    """(key, event, at): the first ``hit`` of each key of ``events(key, ts, event_id, kind)``, and the first ``taken`` after it."""
    at = F.struct("ts", "event_id")
    hits = events.where("kind = 'hit'").groupBy("key").agg(F.min(at).alias("_hit"))
    takes = events.where("kind = 'taken'").join(hits, "key").where(at > F.col("_hit")).groupBy("key").agg(F.min("ts").alias("at"))
    return hits.select("key", F.lit("hit").alias("event"), F.col("_hit.ts").alias("at")).unionByName(takes.select("key", F.lit("taken").alias("event"), "at"))


def stage_rises(events: DataFrame) -> DataFrame:
    """(key, at, n): when each key of ``events(key, ts, event_id, kind)`` first reached a stage above all before; kinds are numbers of stages.

    A stage's first event comes first; of the few stages that a key has those remain that no higher one precedes.
    """
    stages = events.select("key", F.col("kind").cast("long").alias("n"), F.struct("ts", "event_id").alias("_at")).groupBy("key", "n").agg(F.min("_at").alias("_at"))
    before = F.max("n").over(Window.partitionBy("key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return stages.withColumn("_before", before).where("n > 0 and (_before is null or n > _before)").select("key", F.col("_at.ts").alias("at"), "n")
