"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _to_smallest(directed: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the smallest of u and all its v.

    The minimum is aggregated before it meets the edges again, so a hub's rows are combined on
    the map side.  It is grouped by ~u, which says the same but is dealt otherwise, so that the sums
    reach the join by an exchange of their own: only then AQE may split a hub's rows in the join.
    """
    least = directed.groupBy(F.bitwise_not("u").alias("k")).agg(F.min("v").alias("v"))
    least = least.select(F.bitwise_not("k").alias("u"), F.least("v", F.bitwise_not("k")).alias("m"))
    return directed.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges(a, b)``.

    Alternates large-star and small-star steps until every edge points at its component's
    smallest node; that takes O(log^2 n) rounds at most.  Each round is materialised.
    Loops and repeated edges are harmless, null ends are ignored, no edges give no rows.
    """
    now = materialise(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _to_smallest(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = materialise(small.where("u <> v").distinct(), "stars")
        discard(now)
        now, before, seen = after, seen, after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "u", "v"))).first()
        if seen == before:  # a round that changes nothing leaves stars
            break
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
