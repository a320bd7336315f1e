"""Runs of the same analysis over time: latest, previous, deltas, histories.

Every window is partitioned by series, so tasks grow with the number of series; a series is one
site's history.  Ties in time are broken by run number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import rounded


def newest_first():
    return Window.partitionBy("series").orderBy(F.desc("created_at"), F.desc("run_id"))


def oldest_first():
    return Window.partitionBy("series").orderBy("created_at", "run_id")


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of each series."""
    newest_run = F.max_by(F.struct(*runs.columns), F.struct("created_at", "run_id")).alias("_r")  # combines before the shuffle
    return runs.groupBy("series").agg(newest_run).select("_r.*")


def newest(runs: DataFrame, k: int) -> DataFrame:
    """The newest k succeeded runs of each series, with their place."""
    return runs.where("status = 'succeeded'").withColumn("place", F.row_number().over(newest_first())).where(F.col("place") <= k)


def beyond_newest(runs: DataFrame, keep: int) -> DataFrame:
    """Runs that a history of ``keep`` runs, besides the latest, no longer holds."""
    return runs.withColumn("_n", F.row_number().over(newest_first())).where(F.col("_n") > keep + 1).drop("_n")


def with_previous(runs: DataFrame) -> DataFrame:
    """Succeeded runs and the newest succeeded run of their series that is strictly earlier in time.

    Runs of one instant don't precede each other, hence a range frame.  Times count in days here.
    """
    day = F.unix_date(F.col("created_at").cast("date"))
    before = Window.partitionBy("series").orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    previous = F.max(F.struct("created_at", "run_id", "score")).over(before)
    out = runs.where("status = 'succeeded'").withColumn("_p", previous)
    return out.withColumn("previous_id", F.col("_p.run_id")).withColumn("delta", rounded(F.col("score") - F.col("_p.score"), 1) + 0.0).drop("_p")


def history(runs: DataFrame) -> DataFrame:
    """Succeeded runs numbered from 1 and their change since the run before."""
    done = runs.where("status = 'succeeded'")
    return done.withColumn("run_no", F.row_number().over(oldest_first())).withColumn("delta", rounded(F.col("score") - F.lag("score").over(oldest_first()), 1) + 0.0)  # no negative zero


def latest_against_second(runs: DataFrame) -> DataFrame:
    """The latest run of any status, less the second newest succeeded one."""
    second = newest(runs, 2).where("place = 2").select("series", F.col("score").alias("second_score"))
    return latest(runs).join(second, "series", "left").select("series", "run_id", "status", rounded(F.col("score") - F.col("second_score"), 1).alias("delta"))


def cards(runs: DataFrame) -> DataFrame:
    """One row a series: runs, latest run, and counts by status."""
    newest_run = F.max_by(F.struct("run_id", "status", "score"), F.struct("created_at", "run_id"))
    out = runs.groupBy("series").agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("status") == "succeeded").alias("n_succeeded"), newest_run.alias("_l"), F.max("created_at").alias("last_run")
    )
    return out.select("series", "n_runs", "n_succeeded", "last_run", F.col("_l.run_id").alias("latest_id"), F.col("_l.status").alias("latest_status"), rounded(F.col("_l.score"), 2).alias("latest_score"))


def dashboard(runs: DataFrame) -> DataFrame:
    """Counts over all series in one row: tracked, improved, declined, in need of a baseline, running, failed."""
    change = latest_against_second(runs)
    n = runs.groupBy("series").agg(F.count("*").alias("n"))
    return change.join(n, "series").agg(
        F.count("*").alias("tracked"), F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") < 0).alias("declined"),
        F.count_if(F.col("n") < 2).alias("need_baseline"), F.count_if(F.col("status") == "pending").alias("running"), F.count_if(F.col("status") == "failed").alias("failed"),
    )


def attention(runs: DataFrame, k: int = 5) -> DataFrame:
    """The k series that most need a look: a large fall, then a failed run, then too few runs."""
    change, n = latest_against_second(runs), runs.groupBy("series").agg(F.count("*").alias("n_runs"))
    out = change.join(n, "series").select(
        "series", F.coalesce(F.col("delta") < -5, F.lit(False)).alias("fell"), (F.col("status") == "failed").alias("failed"), (F.col("n_runs") < 2).alias("few")
    )
    return out.where("fell or failed or few").orderBy(F.desc("fell"), F.desc("failed"), F.desc("few"), "series").limit(k)


def at_most_one_latest(marked: DataFrame) -> DataFrame:
    """Series that break the rule of one latest run; ``marked(series, is_latest)``."""
    return marked.where("is_latest").groupBy("series").count().where("count > 1")


def replaced(runs: DataFrame, fresh: DataFrame) -> DataFrame:
    """``runs`` and ``fresh`` with ``is_latest`` on the newest of each series: older ones retire."""
    both = runs.unionByName(fresh)
    return both.withColumn("is_latest", F.row_number().over(newest_first()) == 1)
