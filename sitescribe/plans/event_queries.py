"""Queries over users' events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import activity, quantiles
from ..sources.tables import read
from .page_queries import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

AS_OF = "(SELECT max(ts) FROM events)"


def kinds(spark, sf_dir):
    return read(spark, sf_dir, "events")


def rank():
    out = F.lit(0)
    for name, n in activity.STAGES.items():
        out = F.when(F.col("event_type") == name, n).otherwise(out)
    return out


RANK = "CASE event_type " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in activity.STAGES.items()) + " ELSE 0 END"
ITEM = "CAST(floor(value) AS BIGINT)"


@query("""SELECT event_id, user_id, count(*) OVER w AS n_recent, count(*) OVER w > 3 AS limited FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""")
def trailing_counts(spark, sf_dir):
    return activity.trailing_counts(kinds(spark, sf_dir), 3600, 3)


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, round(sum(value), 4) AS value, max(ts) AS updated_at FROM events GROUP BY ALL")
def daily_usage(spark, sf_dir):
    return activity.daily_usage(kinds(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT user_id, count(*) AS calls, count(*) > 20 AS over_quota FROM events WHERE ts >= {AS_OF} - INTERVAL 7 DAY GROUP BY user_id")
def quota_counts(spark, sf_dir):
    """Calls of each user in the last week of the table."""
    events = kinds(spark, sf_dir)
    last = events.agg(F.max("ts").alias("_now"))
    recent = events.join(F.broadcast(last), F.col("ts") >= F.col("_now") - F.expr("INTERVAL 7 DAY"))  # one row is broadcast
    return recent.groupBy("user_id").agg(F.count("*").alias("calls"), (F.count("*") > 20).alias("over_quota"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_claims(spark, sf_dir):
    return activity.first_claims(kinds(spark, sf_dir), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, user_id, ts, max({RANK}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stage_rank FROM events")
def monotone_stages(spark, sf_dir):
    return activity.stages(kinds(spark, sf_dir), rank())


@query(f"""SELECT user_id, event_id, ts, CAST(d AS INTEGER) AS distinct_items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, {ITEM} ORDER BY ts, event_id) AS n FROM events) WHERE n = 1) WHERE d = 5""")
def segment_flips(spark, sf_dir):
    return activity.segment_flips(kinds(spark, sf_dir), F.floor("value").cast("long"))


@query(f"""SELECT user_id, max(ts) AS last_event_at, count(*) AS n_events, max({RANK}) AS stage_rank, least(count(DISTINCT {ITEM}), 5) AS distinct_items,
  CASE WHEN count(DISTINCT {ITEM}) >= 5 THEN 'agency' ELSE 'standard' END AS segment FROM events GROUP BY user_id""")
def event_state(spark, sf_dir):
    return activity.state(kinds(spark, sf_dir), F.floor("value").cast("long"), rank())


@query("""SELECT user_id, hit_at, min(ts) FILTER (ts > hit_at) AS taken_at FROM (SELECT user_id, min(ts) AS hit_at FROM events WHERE event_type = 'view' GROUP BY user_id)
  LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') USING (user_id) GROUP BY ALL""")
def gates_taken(spark, sf_dir):
    return activity.taken_after_hit(kinds(spark, sf_dir), "view", "purchase")


@query("SELECT user_id, max(ts) AS dismissed_at FROM events WHERE event_type = 'click' GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-20'")
def active_dismissals(spark, sf_dir):
    return activity.still_dismissed(kinds(spark, sf_dir), "click", F.expr("TIMESTAMP_NTZ '2024-01-27'"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def retained_events(spark, sf_dir):
    return activity.kept(kinds(spark, sf_dir), "ts", F.expr("TIMESTAMP_NTZ '2024-02-14'"), 30).select("event_id")


# One step takes the next request of every user; the state is what was queued so far.
@query("""WITH RECURSIVE asked AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value < 95 AS valid, event_id % 11 = 0 AS refreshing, event_type IN ('view', 'signup') AS site, CAST(floor(value / 3) AS BIGINT) AS series,
    greatest(0, 12 - user_id % 5) AS jobs, greatest(0, 6 - user_id % 8) AS days FROM events
), steps AS (
  SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST([] AS VARCHAR[]) AS queued, '' AS status FROM asked WHERE i = 1
  UNION ALL
  SELECT user_id, i, event_id, CASE WHEN status = 'queued' THEN list_append(queued, key) ELSE queued END, status FROM (
    SELECT a.user_id, a.i, a.event_id, s.queued, site || ':' || series AS key, CASE WHEN NOT valid THEN 'invalid' WHEN len(s.queued) >= jobs OR site AND len(s.queued) >= days THEN 'quota'
      WHEN refreshing OR list_contains(s.queued, site || ':' || series) THEN 'cooldown' ELSE 'queued' END AS status FROM steps s JOIN asked a ON a.user_id = s.user_id AND a.i = s.i + 1
  )
) SELECT event_id, status FROM steps WHERE i > 0""")
def admitted_requests(spark, sf_dir):
    rows = kinds(spark, sf_dir)
    scope = F.when(F.col("event_type").isin("view", "signup"), "site").otherwise("page")
    rows = rows.withColumns({"valid": F.col("value") < 95, "refreshing": F.col("event_id") % 11 == 0, "scope": scope, "series": F.floor(F.col("value") / 3)})
    usage = rows.select("user_id", (F.col("user_id") % 5).alias("running"), (F.col("user_id") % 8).alias("sites")).distinct()
    return activity.admitted(rows, usage, running_limit=12, site_limit=6).select("event_id", "status")


@query("""SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY ALL""")
def daily_p95(spark, sf_dir):
    """Exact percentile by kind and day, as alert rules read it."""
    found = quantiles.quantile(kinds(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts")), ["event_type", "day"], "value", 0.95)
    return found.select("event_type", "day", "n", F.round("quantile", 6).alias("p95"))


@query("""SELECT event_type, CASE event_type WHEN 'rate_limited' THEN 'Rate limited' ELSE upper(event_type[1]) || lower(event_type[2:]) END AS label, count(*) AS n FROM events GROUP BY ALL""")
def reason_labels(spark, sf_dir):
    return kinds(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", X.friendly_reason(F.col("event_type")).alias("label"), "n")


@query("""SELECT event_id, CASE WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS elapsed FROM (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS s FROM events)""")
def elapsed_labels(spark, sf_dir):
    return kinds(spark, sf_dir).select("event_id", X.elapsed_text(F.floor(F.col("value") * 10)).alias("elapsed"))
