"""What changed between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S


def findings_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings (run, finding) that were resolved, are new, or stay.

    Of findings with equal names in one run the last counts once, as they collapse by name.
    """
    a = old.select("run", "finding").distinct().withColumn("_old", F.lit(True))
    b = new.select("run", "finding").distinct().withColumn("_new", F.lit(True))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "resolved").otherwise("unchanged")
    return a.join(b, ["run", "finding"], "full_outer").select("run", "finding", change.alias("change"))


def list_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    added = new.join(old, key, "left_anti").select(key, F.lit("added").alias("change"))
    return added.unionByName(old.join(new, key, "left_anti").select(key, F.lit("removed").alias("change"))).distinct()


def factor_diff(weights: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores of each factor (lens, factor) before and after; factors of neither side are left out."""
    keys = ["lens", "factor"]
    a, b = old.select(*keys, F.col("score").alias("before")), new.select(*keys, F.col("score").alias("after"))
    out = weights.join(a, keys, "left").join(b, keys, "left").where("before is not null or after is not null")
    return out.withColumn("delta", S.rounded(F.col("after") - F.col("before"), 1))


def counterfactual(factors: DataFrame, fixes: DataFrame) -> DataFrame:
    """Change of a lens' composite by each fix alone: its factor's score set to the target.

    ``factors(run, factor, score, weight)``, ``fixes(run, fix, factor, target)``.  A run's sums are
    taken once and each fix changes them by its own factor, so no row is multiplied; factors without a
    score are left out and weights renormalised, unless a target brings the factor in.  Fixes of
    an unknown factor are left out; those of one name count together.
    """
    used, weight = F.col("score").isNotNull(), F.col("weight").cast("double")
    own = [F.sum(F.when(used, F.col("score") * weight)).alias("s"), F.sum(F.when(used, weight)).alias("w")]
    by_factor = factors.groupBy("run", "factor").agg(*own, F.sum(weight).alias("all"))
    of_run = by_factor.groupBy("run").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("run_s"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("run_w"))
    each = fixes.join(by_factor, ["run", "factor"]).join(of_run, "run")
    target, none = F.least(F.lit(100.0), F.col("target")), F.lit(0.0)
    fixed_s = F.col("run_s") - F.coalesce("s", none) + F.coalesce(target * F.col("all"), none)
    fixed_w = F.col("run_w") - F.coalesce("w", none) + F.when(F.col("target").isNotNull(), F.col("all")).otherwise(none)
    sums = each.groupBy("run", "fix").agg(*(F.sum(c).alias(n) for n, c in (("a", F.col("run_s")), ("b", F.col("run_w")), ("c", fixed_s), ("d", fixed_w))))
    composite = lambda s, w: S.calibrated(F.when(F.col(w) > 0, F.col(s) / F.col(w)))
    out = sums.select("run", "fix", composite("a", "b").alias("before"), composite("c", "d").alias("after"))
    return out.withColumn("delta", S.rounded(F.col("after") - F.col("before"), 1))


def ranked_fixes(fixes: DataFrame) -> DataFrame:
    """Fixes of a run by points, those without points last; fixes that gain nothing are left out."""
    window = Window.partitionBy("run").orderBy(F.col("points").isNull(), F.desc("points"), "fix")
    points = F.col("points")
    rank = F.when(points >= 3, "high").when(points >= 1, "medium").otherwise("low")
    return fixes.where("points is null or points > 0").withColumn("priority", rank).withColumn("place", F.row_number().over(window))


def extremes(factors: DataFrame) -> DataFrame:
    """A run's lowest and highest factor and those without a score; ``factors(run, factor, score)``."""
    scored = F.col("score").isNotNull()
    low = F.min(F.when(scored, F.struct("score", "factor")))
    high = F.max(F.when(scored, F.struct("score", (-F.col("factor")).alias("factor"))))  # of equal scores the first factor
    missing = F.array_sort(F.collect_list(F.when(~scored, F.col("factor"))))  # the factors of one run
    out = factors.groupBy("run").agg(low.alias("low"), high.alias("high"), missing.alias("missing"))
    return out.select("run", F.col("low.factor").alias("lowest"), (-F.col("high.factor")).alias("highest"), "missing")


def by_pillar(fixes: DataFrame) -> DataFrame:
    """The fixes of each run and pillar as a list, best first, those without points last; ``fixes(run, pillar, fix, points)``."""
    order = F.struct(F.col("points").isNull().alias("none"), (-F.col("points")).alias("points"), F.col("fix").alias("fix"))
    return fixes.groupBy("run", "pillar").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["fix"]).alias("fixes"))  # the fixes of one run


def answer_movement(old: DataFrame, new: DataFrame) -> DataFrame:
    """How each question's points moved since the run before; ``old`` and ``new(question, points)``."""
    before = old.select("question", F.col("points").alias("_before"))
    change = F.col("points") - F.col("_before")
    moved = F.when(F.col("_before").isNull(), "new").when(change > 0, "improved").when(change < 0, "declined").otherwise("same")
    return new.join(before, "question", "left").select("question", moved.alias("moved"))


def interpreted(sites: DataFrame, key: str, lenses: dict[str, Column], texts: dict[str, str], strict: bool = True) -> DataFrame:
    """Shape, tone, headline and extremes of each site's lens scores.

    ``texts`` gives the headline of each shape; ``{lens}`` in it stands for what the weakest lens
    exposes.  Where a score is missing the shape is ``incomplete``, without extremes and bands; of
    equal scores the first lens counts.  Each step is a projection of its own, so that none repeats the
    expressions of the one before.
    """
    names = list(lenses)
    scored = sites.select(key, *[s.cast("double").alias(f"s_{n}") for n, s in lenses.items()])
    known = F.lit(True)
    for n in names:
        known = known & F.col(f"s_{n}").isNotNull()
    pick = lambda sign: F.array_min(F.array(*[F.struct((sign * F.col(f"s_{n}")).alias("s"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(names)]))["n"]
    ends = scored.withColumns({"weakest": F.when(known, pick(1)), "strongest": F.when(known, pick(-1)), **{f"b_{n}": S.band(F.col(f"s_{n}"), strict) for n in names}})
    bands = [F.col(f"b_{n}") for n in names]
    mean = sum((F.col(f"s_{n}") for n in names), F.lit(0.0)) / len(names)
    shaped = ends.withColumn("shape", F.when(known, S.profile(bands, mean)).otherwise("incomplete"))
    headline = F.replace(S.named(F.col("shape"), texts), F.lit("{lens}"), F.coalesce(S.named(F.col("weakest"), S.EXPOSURES), F.lit("")))
    return shaped.select(
        key, "shape", S.named(F.col("shape"), S.TONES).alias("tone"), headline.alias("headline"), "weakest", "strongest",
        S.named(F.col("weakest"), S.FIX_FIRST).alias("fix_first"), F.when(known, F.concat_ws(",", *[F.initcap(b) for b in bands])).alias("bands"),
    )
