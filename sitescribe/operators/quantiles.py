"""Exact quantiles of groups of any size: the wanted value is closed in on by counts of bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Bins of a group in a round, and values that one task may sort in the end.
BINS, FEW = 1024, 4096


def quantile(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """(keys, n, quantile): for each group the smallest value that a share ``q`` of its values doesn't exceed.

    A round counts a group's values in ``BINS`` bins of equal width between its least and largest; the bin that
    holds the wanted rank is the next round's group.  Only counts of bins are gathered.  A group is done when one value
    is left, or so few that they are sorted.  Null keys are a group, null values and NaN don't count.
    """
    key = F.struct(*keys)
    left = written(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(key.alias("_k"), F.col(value).cast("double").alias("_v")), "values")
    stats = written(left.groupBy("_k").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("here")).withColumn("rank", F.greatest(F.ceil(F.col("n") * F.lit(q)), F.lit(1))), "groups")
    done = []
    while True:
        done.append(stats.where("low = high").select("_k", "n", F.col("low").alias("quantile")))
        small = stats.where(f"low < high and here <= {FEW}")
        place = F.row_number().over(Window.partitionBy("_k").orderBy("_v"))
        done.append(left.join(small.select("_k", "n", "rank"), "_k").withColumn("_p", place).where(F.col("_p") == F.col("rank")).select("_k", "n", F.col("_v").alias("quantile")))
        large = stats.where(f"low < high and here > {FEW}")
        if large.isEmpty():
            break
        step = (F.col("high") / BINS) - (F.col("low") / BINS)
        bin_ = F.when(F.col("_v") >= F.col("high"), BINS).when(F.col("_v") <= F.col("low"), -1).otherwise(F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("low")) / step)))
        binned = left.join(large.drop("here"), "_k").withColumn("_b", bin_.cast("int"))
        counts = binned.groupBy("_k", "_b").agg(F.count("*").alias("here"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("here").over(Window.partitionBy("_k").orderBy("_b"))
        counts = counts.join(large.select("_k", "n", "rank"), "_k").withColumn("_upto", upto)
        wanted = written(counts.where((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("here") < F.col("rank"))).select("_k", "_b", "n", "low", "high", "here", (F.col("rank") - F.col("_upto") + F.col("here")).alias("rank")), "groups")
        left = written(binned.select("_k", "_b", "_v").join(wanted.select("_k", "_b"), ["_k", "_b"]).select("_k", "_v"), "values")
        stats = wanted.drop("_b")
    out = reduce(DataFrame.unionByName, done)
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "n", "quantile")
