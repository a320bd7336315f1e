"""Line diffs of many pairs of texts at once.

The longest run of equal lines splits a pair in two, before and after it, and so on: all parts of all
pairs are split in one round.  Equal lines meet in a join by pair and line, runs are stretches of
one diagonal, and what is matched in the end gives the script and its hunks by windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

# What ends a line, and texts of so many lines whose frequent lines begin no run.
ENDS = r"\n\r\x0B\x0C\x1C-\x1E\x85  "
MANY_LINES = 200


def lines_of(text: Column) -> Column:
    """Lines with what ends them; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?:[^{ENDS}]*(?:\r\n|[{ENDS}])|[^{ENDS}]+)"), 0)


def matched_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, i, j): equal lines that both texts keep, from ``before(id, i, h)`` and ``after(id, j, h)``.

    Of the longest runs in a part the first counts.  In texts of ``MANY_LINES`` lines and more, lines
    that are more than a hundredth of them begin no run, but a run goes on over them.
    """
    sizes = before.groupBy("id").agg(F.max("i").alias("na")).join(after.groupBy("id").agg(F.max("j").alias("nb")), "id").select("id", (F.col("na") + 1).alias("na"), (F.col("nb") + 1).alias("nb"))
    frequent = after.groupBy("id", "h").count().join(sizes, "id").where((F.col("nb") >= MANY_LINES) & (F.col("count") > F.floor(F.col("nb") / 100) + 1)).select("id", "h")
    frequent = written(frequent, "frequent")
    going_on = not frequent.isEmpty()
    equal = before.join(after.join(frequent, ["id", "h"], "left_anti"), ["id", "h"]).join(sizes, "id")
    parts = written(equal.select("id", "i", "j", F.lit(0).alias("alo"), F.col("na").alias("ahi"), F.lit(0).alias("blo"), F.col("nb").alias("bhi")), "parts")
    part, blocks = ["id", "alo", "ahi", "blo", "bhi"], []
    while not parts.isEmpty():
        diagonal = parts.withColumn("d", F.col("i") - F.col("j"))
        stretch = F.col("i") - F.row_number().over(Window.partitionBy(*part, "d").orderBy("i"))
        runs = diagonal.withColumn("r", stretch).groupBy(*part, "d", "r").agg(F.count("*").alias("k"), F.min("i").alias("i"))
        best = runs.groupBy(*part).agg(F.max(F.struct("k", (-F.col("i")).alias("i"), (F.col("d") - F.col("i")).alias("j"))).alias("b"))
        best = best.select(*part, (-F.col("b.i")).alias("i0"), (-F.col("b.j")).alias("j0"), F.col("b.k").alias("k"))
        if going_on:
            best = _gone_on(best, before, after, part)
        best = written(best, "blocks")
        blocks.append(best.select("id", "i0", "j0", "k"))
        inside = parts.join(best, part)
        left = (F.col("i") < F.col("i0")) & (F.col("j") < F.col("j0"))
        right = (F.col("i") >= F.col("i0") + F.col("k")) & (F.col("j") >= F.col("j0") + F.col("k"))
        bounds = {"alo": ("alo", F.col("i0") + F.col("k")), "ahi": ("i0", "ahi"), "blo": ("blo", F.col("j0") + F.col("k")), "bhi": ("j0", "bhi")}
        side = lambda n: [(F.col(b[n]) if isinstance(b[n], str) else b[n]).cast("int").alias(c) for c, b in bounds.items()]  # noqa: E731, B023
        parts = written(inside.where(left).select("id", "i", "j", *side(0)).unionByName(inside.where(right).select("id", "i", "j", *side(1))), "parts")
    if not blocks:
        return before.join(after, "id").select("id", "i", "j").limit(0)
    found = reduce(DataFrame.unionByName, blocks).select("id", "i0", "j0", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))).alias("n"))
    return found.select("id", (F.col("i0") + F.col("n")).alias("i"), (F.col("j0") + F.col("n")).alias("j"))


def _gone_on(best: DataFrame, before: DataFrame, after: DataFrame, part: list[str]) -> DataFrame:
    """Blocks with the equal lines of any frequency that stand before and after them in their part."""
    d = F.col("i0") - F.col("j0")
    low, high = F.greatest(F.col("alo"), F.col("blo") + d), F.least(F.col("ahi"), F.col("bhi") + d)
    span = best.select(*part, "i0", "j0", "k", F.explode(F.sequence(low.cast("int"), (high - 1).cast("int"))).alias("i")).withColumn("j", F.col("i") - d)
    both = span.join(before.withColumnRenamed("h", "ha"), ["id", "i"]).join(after.withColumnRenamed("h", "hb"), ["id", "j"]).where("ha <> hb")
    other = both.groupBy(*part).agg(F.max(F.when(F.col("i") < F.col("i0"), F.col("i"))).alias("_below"), F.min(F.when(F.col("i") >= F.col("i0") + F.col("k"), F.col("i"))).alias("_above"))
    out = best.join(other, part, "left").withColumn("_from", F.coalesce(F.col("_below") + 1, low)).withColumn("_to", F.coalesce("_above", high))
    return out.select(*part, F.col("_from").cast("int").alias("i0"), (F.col("_from") - d).cast("int").alias("j0"), (F.col("_to") - F.col("_from")).cast("long").alias("k"))


def line_diff(pairs: DataFrame, context: int = 3) -> DataFrame:
    """(id, hunk, place, mark, line) of ``pairs(id, before, after)``: changed lines and ``context`` lines about them.

    ``mark`` is a minus, a plus or a blank, or ``@`` for the head of a hunk, whose ``place`` is 0.  Equal and null texts
    give no rows.  Texts are capped before they come here, so the windows over a pair's lines are bounded.
    """
    lines = lambda c, n: written(pairs.select("id", F.posexplode(lines_of(F.col(c))).alias(n, "line")).withColumn("h", F.md5("line")), c)
    before, after = lines("before", "i"), lines("after", "j")
    kept = written(matched_lines(before.select("id", "i", "h"), after.select("id", "j", "h")), "kept")
    old = before.join(kept, ["id", "i"], "left").select("id", "i", "j", "line")
    new = after.join(kept.select("id", "j", F.lit(True).alias("_kept")), ["id", "j"], "left").select("id", "j", "_kept", "line")
    passed = lambda flag, n: F.coalesce(F.sum(flag.cast("int")).over(Window.partitionBy("id").orderBy(n).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Before the g-th kept line: what is deleted, then what is inserted.
    old = old.select("id", passed(F.col("j").isNotNull(), "i").alias("g"), F.when(F.col("j").isNull(), 0).otherwise(2).alias("kind"), F.col("i").alias("at"), "line")
    new = new.withColumn("g", passed(F.col("_kept").isNotNull(), "j")).where("_kept is null").select("id", "g", F.lit(1).alias("kind"), F.col("j").alias("at"), "line")
    order = Window.partitionBy("id").orderBy("g", "kind", "at")
    script = old.unionByName(new).withColumn("n", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda other: F.coalesce(F.sum((F.col("kind") != other).cast("int")).over(so_far), F.lit(0))
    change = F.when(F.col("kind") != 2, F.col("n"))
    near = script.withColumn("a", count(1)).withColumn("b", count(0)).withColumn("_last", F.max(change).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.min(change).over(order.rowsBetween(0, Window.unboundedFollowing)))
    near = near.where((F.col("n") - F.col("_last") <= context) | (F.col("_next") - F.col("n") <= context))
    begins = F.coalesce(F.col("n") - F.lag("n").over(order) > 1, F.lit(True))
    hunks = near.withColumn("hunk", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = hunks.select("id", "hunk", F.row_number().over(Window.partitionBy("id", "hunk").orderBy("n")).alias("place"), F.element_at(F.array(*map(F.lit, "-+ ")), F.col("kind") + 1).alias("mark"), "line")
    heads = hunks.groupBy("id", "hunk").agg(F.min("a").alias("a"), F.count_if(F.col("kind") != 1).alias("na"), F.min("b").alias("b"), F.count_if(F.col("kind") != 0).alias("nb"))
    span = lambda at, n: F.when(F.col(n) == 1, (F.col(at) + 1).cast("string")).otherwise(F.concat(F.col(at) + F.when(F.col(n) > 0, 1).otherwise(0), F.lit(","), F.col(n)))
    head = F.concat(F.lit("@@ -"), span("a", "na"), F.lit(" +"), span("b", "nb"), F.lit(" @@"))
    return rows.unionByName(heads.select("id", "hunk", F.lit(0).alias("place"), F.lit("@").alias("mark"), head.alias("line")))


def unified(diff: DataFrame, before: str = "previous", after: str = "current") -> DataFrame:
    """(id, diff): the rows of ``line_diff`` as a text a pair; a pair's hunks are no longer than its capped texts."""
    text = F.regexp_replace("line", rf"[{ENDS}]+$", "")
    row = F.when(F.col("mark") == "@", F.col("line")).otherwise(F.concat("mark", text))
    lines = F.array_sort(F.collect_list(F.struct("hunk", "place", row.alias("row"))))
    return diff.groupBy("id").agg(F.concat(F.lit(f"--- {before}\n+++ {after}\n"), F.array_join(F.transform(lines, lambda x: x["row"]), "\n")).alias("diff"))
