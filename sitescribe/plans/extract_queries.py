"""Queries that need the page parser, and streams.  They are tested on fixtures, as SQL can't express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import activity, extract, line_diff, structured
from ..sources.scratch import scratch_path
from ..sources.tables import read
from ..streaming import processors, twins
from .page_queries import ORACLES, QUERIES, query
from .score_queries import SESSION_STEPS

__all__ = ["ORACLES", "QUERIES"]


def featured(spark, sf_dir):
    return extract.with_features(read(spark, sf_dir, "pages"))


@query()
def html_features(spark, sf_dir):
    f = featured(spark, sf_dir)
    return f.select(
        "page_id", "f.title", "f.canonical", F.size("f.headings").alias("n_headings"), F.size("f.links").alias("n_links"), "f.images_total", "f.images_with_alt",
        F.element_at("f.counts", "p").alias("paragraphs"), X.words(F.col("f.markdown")).alias("words"), F.size("f.jsonld").alias("n_jsonld"),
    )


@query()
def page_markdown(spark, sf_dir):
    return featured(spark, sf_dir).select("page_id", "f.markdown")


@query()
def page_links(spark, sf_dir):
    return extract.classified_links(extract.with_hrefs(read(spark, sf_dir, "pages")), ["github.com"])


@query()
def page_emails(spark, sf_dir):
    return extract.found_emails(featured(spark, sf_dir))


@query()
def page_structured_data(spark, sf_dir):
    return extract.jsonld_items(featured(spark, sf_dir)).select("page_id", "types")


@query()
def page_organisations(spark, sf_dir):
    return structured.organisations(extract.jsonld_items(featured(spark, sf_dir)))


@query()
def turn_diffs(spark, sf_dir):
    """Each turn against the one before it, sentence by sentence."""
    broken = F.regexp_replace("text", r"([.!?]) ", "$1\n")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", X.byte_capped(broken, 200_000).alias("after"))
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("after").alias("before"))
    pairs = rows.join(before, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("id"), "before", "after")
    return line_diff.unified(line_diff.line_diff(pairs)).select("id.conv_id", "id.turn", "diff")


def _folder(spark: SparkSession) -> str:
    return scratch_path(spark, "streams")


@query("SELECT user_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark, sf_dir) -> DataFrame:
    """Tumbling windows; files that are there together are one batch, so none of their rows is late."""
    folder = _folder(spark)
    counts = twins.windowed_counts(twins.read_stream(spark, sf_dir), lateness="1 hour")
    twins.run_once(counts, f"{folder}/out", "update", f"{folder}/checkpoint")
    out = spark.read.parquet(f"{folder}/out")
    last = out.groupBy("start", "user_id").agg(F.max_by("n", "batch").alias("n"))
    return last.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""SELECT user_id, count(*) AS n_events, CAST(least(count(DISTINCT floor(value)), 5) AS INTEGER) AS distinct_items,
  CASE WHEN count(DISTINCT floor(value)) >= 5 THEN 'agency' ELSE 'standard' END AS segment FROM events GROUP BY user_id""")
def stream_event_state(spark, sf_dir) -> DataFrame:
    folder = _folder(spark)
    twins.run_once(twins.folded_state(twins.read_stream(spark, sf_dir)), f"{folder}/out", "update", f"{folder}/checkpoint")
    out = spark.read.parquet(f"{folder}/out")
    last = F.max_by(F.struct("n_events", "distinct_items", "segment"), "batch").alias("s")
    return out.groupBy("user_id").agg(last).select("user_id", "s.n_events", "s.distinct_items", "s.segment")


def _processed(spark, sf_dir, key, kind, processor, group=None) -> DataFrame:
    """The events' stream through a state processor; what the watermark has not passed when the files end stays in the state."""
    folder = _folder(spark)
    events = twins.read_stream(spark, sf_dir).select((key if group is None else group).alias("group"), key.alias("key"), "ts", "event_id", kind.alias("kind")).where("kind is not null")
    twins.run_once(processors.processed(events, processor, "1 hour"), f"{folder}/out", "append", f"{folder}/checkpoint")
    return spark.read.schema(processors.ROW).parquet(f"{folder}/out").withColumn("at", F.col("at").cast("timestamp_ntz"))


_PASSED = "ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events WHERE {0})"
_GATE = "CASE event_type WHEN 'view' THEN 'hit' WHEN 'purchase' THEN 'taken' END"


@query(f"""WITH e AS (SELECT user_id || ':' || (CAST(floor(value) AS BIGINT) % 3) AS key, ts, event_id, {_GATE} AS kind FROM events WHERE event_type IN ('view', 'purchase') AND {_PASSED.format("event_type IN ('view', 'purchase')")}),
  h AS (SELECT key, min((ts, event_id)) AS h FROM e WHERE kind = 'hit' GROUP BY key)
SELECT key, 'hit' AS event, h[1] AS "at" FROM h UNION ALL SELECT key, 'taken', min(ts) FROM e JOIN h USING (key) WHERE kind = 'taken' AND (ts, event_id) > h GROUP BY key""")
def stream_gates(spark, sf_dir):
    key = F.concat_ws(":", F.col("user_id").cast("string"), (F.floor("value") % 3).cast("string"))
    kind = F.when(F.col("event_type") == "view", "hit").when(F.col("event_type") == "purchase", "taken")
    return _processed(spark, sf_dir, key, kind, processors.Gates()).select("key", "event", "at")


_STAGE = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END"


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id, {_STAGE} AS n FROM events WHERE {_STAGE} IS NOT NULL AND {_PASSED.format(_STAGE + " IS NOT NULL")})
SELECT key, ts AS "at", CAST(n AS BIGINT) AS n FROM (SELECT *, max(n) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) WHERE before IS NULL OR n > before""")
def stream_stages(spark, sf_dir):
    kind = F.lit(None).cast("int")
    for name, rank in activity.STAGES.items():
        kind = F.when(F.col("event_type") == name, rank).otherwise(kind)
    return _processed(spark, sf_dir, F.col("user_id"), kind, processors.Transitions()).select("key", "at", "n")


@query(SESSION_STEPS.format(when=_PASSED.format("true"), ttl=21600, absolute=50000) + """ SELECT session AS key, max(ends) AS ends, max(uses) AS uses FROM steps GROUP BY session
  HAVING max(ends) < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, sf_dir):
    key = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return _processed(spark, sf_dir, key, F.lit("use"), processors.Sessions(21600, 50000), F.col("user_id")).select("key", F.col("at").alias("ends"), F.col("n").alias("uses"))
