"""Conditional changes of tables: claims that only one of many can win, and series whose latest row is replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claim_outcomes(rows: DataFrame, claims: DataFrame, cutoff: Column) -> DataFrame:
    """(claim_id, run_id, user_id, outcome) of ``claims(claim_id, run_id, user_id, anon_id)`` on ``rows(run_id, visibility, user_id, anon_id, created_at)``.

    Outcomes in the order in which they are told: ``no_browser_proof`` without an ``anon_id``; ``not_found`` for what is no public
    row; ``already_claimed``; ``ineligible`` if younger than ``cutoff``; ``not_claimed`` with another's
    ``anon_id``; else ``claimed``, by the first claim of a row, the others being ``already_claimed``.
    """
    found = rows.where("visibility = 'public'").select("run_id", F.col("user_id").alias("_owner"), F.col("anon_id").alias("_anon"), "created_at", F.lit(True).alias("_there"))
    each = claims.join(found, "run_id", "left")
    proven = F.coalesce(F.col("anon_id"), F.lit("")) != ""
    fits = proven & F.col("_there") & F.col("_owner").isNull() & (F.col("created_at") <= cutoff) & (F.col("anon_id") == F.col("_anon"))
    winners = each.where(fits).groupBy("run_id").agg(F.min("claim_id").alias("_won"))
    outcome = (
        F.when(~proven, "no_browser_proof").when(F.col("_there").isNull(), "not_found").when(F.col("_owner").isNotNull() | (F.col("_won") < F.col("claim_id")), "already_claimed")
        .when(F.coalesce(F.col("created_at") > cutoff, F.lit(False)), "ineligible").when(F.col("_won") == F.col("claim_id"), "claimed").otherwise("not_claimed")
    )
    return each.join(winners, "run_id", "left").select("claim_id", "run_id", "user_id", outcome.alias("outcome"))


def claimed(rows: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """``rows`` with the owners that ``claim_outcomes`` found; those touched are updated ``now``."""
    won = outcomes.where("outcome = 'claimed'").select("run_id", F.col("user_id").alias("_new"))
    changes = {"user_id": F.coalesce("_new", "user_id"), "updated_at": F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at"))}
    return rows.join(won, "run_id", "left").withColumns(changes).select(*rows.columns)


def series_replaced(rows: DataFrame, retries: DataFrame, now: Column) -> DataFrame:
    """``rows`` after ``retries(run_id, new_id)``: a retried row that succeeded makes its series pending again.

    The series' latest row and the retried one retire and give up the public key, which goes to a new pending
    row, the latest from now on.  A retry of a row that did not succeed or is not there changes nothing; of
    several retries in a series the last ``new_id`` counts.  ``rows`` has ``run_id, series, status, is_latest, public_key,
    score, created_at``; other columns are carried over from the retried row, times and score are not.
    """
    asked = retries.join(rows.where("status = 'succeeded'"), "run_id")
    one = asked.groupBy("series").agg(F.max_by(F.struct("run_id", "new_id", *[c for c in rows.columns if c not in ("run_id", "series")]), "new_id").alias("r"))
    one = one.select("series", "r.*")
    keys = rows.join(one.select("series"), "series").where("is_latest").groupBy("series").agg(F.max("public_key").alias("_key"))
    fresh = one.join(keys, "series", "left").withColumns({
        "run_id": F.col("new_id"), "status": F.lit("pending"), "is_latest": F.lit(True), "public_key": F.coalesce("_key", "public_key"), "score": F.lit(None).cast(rows.schema["score"].dataType), "created_at": now,
    }).select(*rows.columns)
    touched = one.select("series", F.col("run_id").alias("_retried"))
    old = rows.join(touched, "series", "left")
    retires = F.col("_retried").isNotNull() & (F.col("is_latest") | (F.col("run_id") == F.col("_retried")))
    old = old.withColumns({"is_latest": F.col("is_latest") & ~retires, "public_key": F.when(~retires, F.col("public_key"))}).select(*rows.columns)
    return old.unionByName(fresh)
