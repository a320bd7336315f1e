"""Conditional changes of a table in versions.  Each is committed twice under one batch id, of which the second time changes nothing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import upserts
from ..sources import versions
from ..sources.scratch import scratch_path
from ..sources.tables import runs
from .page_queries import ORACLES, QUERIES, query
from .run_queries import RUNS

__all__ = ["ORACLES", "QUERIES"]

NOW, CUTOFF = "1998-09-01", "1998-01-01"


def _changed(table, name, change):
    path = scratch_path(table.sparkSession, name)
    versions.write_version(table, path, "first")
    for _ in range(2):
        versions.changed_version(table.sparkSession, path, "change", change)
    return versions.read_version(table.sparkSession, path)


_OWNED = f"""SELECT run_id, CASE WHEN run_id % 3 > 0 THEN 'public' ELSE 'private' END AS visibility, CASE WHEN run_id % 5 = 0 THEN 'u' || run_id % 7 END AS user_id,
  CASE WHEN run_id % 4 > 0 THEN 'a' || run_id % 6 END AS anon_id, created_at, created_at AS updated_at FROM ({RUNS})"""
# Two claims a run, the first with the id that the run has or another's, and some on runs that are not there.
_CLAIMS = f"""SELECT 2 * run_id + n AS claim_id, CASE WHEN run_id % 11 = 0 THEN -run_id ELSE run_id END AS run_id, 'c' || n AS user_id, CASE WHEN run_id % 13 = 0 THEN NULL ELSE 'a' || (run_id + n * (run_id % 2)) % 6 END AS anon_id FROM ({RUNS}), range(2) t(n)"""
_OUTCOMES = f"""WITH r AS ({_OWNED}), c AS ({_CLAIMS}), steps AS (
  SELECT c.*, r.run_id AS there, r.user_id AS owner, r.anon_id AS proof, r.created_at, r.run_id IS NOT NULL AND r.user_id IS NULL AND r.created_at <= TIMESTAMP '{CUTOFF}' AND c.anon_id = r.anon_id AS fits FROM c LEFT JOIN r ON r.run_id = c.run_id AND r.visibility = 'public'
), o AS (
  SELECT claim_id, run_id, user_id, CASE WHEN anon_id IS NULL THEN 'no_browser_proof' WHEN there IS NULL THEN 'not_found' WHEN owner IS NOT NULL OR coalesce(bool_or(fits) OVER (PARTITION BY run_id ORDER BY claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    THEN 'already_claimed' WHEN created_at > TIMESTAMP '{CUTOFF}' THEN 'ineligible' WHEN fits THEN 'claimed' ELSE 'not_claimed' END AS outcome FROM steps
)"""


def _claims(spark, sf_dir):
    k = F.col("run_id")
    table = runs(spark, sf_dir).select(
        k, F.when(k % 3 > 0, "public").otherwise("private").alias("visibility"), F.when(k % 5 == 0, F.concat(F.lit("u"), k % 7)).alias("user_id"), F.when(k % 4 > 0, F.concat(F.lit("a"), k % 6)).alias("anon_id"),
        "created_at", F.col("created_at").alias("updated_at"),
    )
    claims = table.select(k.alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    k, n = F.col("k"), F.col("n")
    claims = claims.select((2 * k + n).alias("claim_id"), F.when(k % 11 == 0, -k).otherwise(k).alias("run_id"), F.concat(F.lit("c"), n).alias("user_id"), F.when(k % 13 > 0, F.concat(F.lit("a"), (k + n * (k % 2)) % 6)).alias("anon_id"))
    return table, claims, F.lit(CUTOFF).cast(table.schema["created_at"].dataType)


@query(_OUTCOMES + " SELECT claim_id, run_id, outcome FROM o")
def claim_outcomes(spark, sf_dir):
    return upserts.claim_outcomes(*_claims(spark, sf_dir)).drop("user_id")


@query(_OUTCOMES + f""" SELECT r.run_id, coalesce(w.user_id, r.user_id) AS user_id, CASE WHEN w.run_id IS NULL THEN r.updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at FROM r LEFT JOIN (SELECT * FROM o WHERE outcome = 'claimed') w USING (run_id)""")
def claimed_runs(spark, sf_dir):
    table, claims, cutoff = _claims(spark, sf_dir)
    now = F.lit(NOW).cast(table.schema["created_at"].dataType)
    return _changed(table, "claims", lambda t: upserts.claimed(t, upserts.claim_outcomes(t, claims, cutoff), now)).select("run_id", "user_id", "updated_at")


_MARKED = f"""SELECT *, l AND series % 2 = 0 OR l AND series % 7 = 0 AS has_key FROM (SELECT run_id, series, status, score, created_at, row_number() OVER (PARTITION BY series ORDER BY created_at DESC, run_id DESC) = 1 AS l FROM ({RUNS}))"""


@query(f"""WITH m AS (SELECT run_id, series, status, score, created_at, l AS is_latest, CASE WHEN has_key THEN 'k' || series END AS public_key FROM ({_MARKED})),
asked AS (SELECT series, max(run_id) AS retried FROM m WHERE run_id % 6 = 0 AND status = 'succeeded' GROUP BY series)
SELECT run_id, series, status, is_latest AND retried IS NULL AS is_latest, CASE WHEN retried IS NULL OR NOT is_latest AND run_id <> retried THEN public_key END AS public_key, score FROM m LEFT JOIN asked USING (series)
UNION ALL SELECT 100000000 + retried, series, 'pending', true, (SELECT max(public_key) FROM m WHERE m.series = asked.series AND is_latest), NULL FROM asked""")
def replaced_series(spark, sf_dir):
    newest = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("created_at"), F.desc("run_id"))) == 1
    table = runs(spark, sf_dir).drop("priority").withColumn("is_latest", newest)
    key = F.when(F.col("is_latest") & ((F.col("series") % 2 == 0) | (F.col("series") % 7 == 0)), F.concat(F.lit("k"), F.col("series")))
    table = table.withColumn("public_key", key)
    retries = table.where("run_id % 6 = 0").select("run_id", (F.col("run_id") + 100_000_000).alias("new_id"))
    now = F.lit(NOW).cast(table.schema["created_at"].dataType)
    return _changed(table, "series", lambda t: upserts.series_replaced(t, retries, now)).drop("created_at")
