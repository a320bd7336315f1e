"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is a stream of blocks with weight w = parts / period.  Its k-th block is released at
floor((k-1)/w) and due at ceil(k/w); in each slot the released block with the earliest deadline
goes next.  Weights sum to one, so no deadline is missed and at every slot each source has had
less than one block more or fewer than its weight asks for, until a source runs out.  The schedule
repeats after one period, hence one period is worked out and every block finds its slot by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Slots of a period that are appended to one array before it is put away whole.
CHUNK = 1024


def period_slots(parts: DataFrame) -> DataFrame:
    """(_s, _turn, _slot, _period) of one period of ``parts(_s, _parts)``.

    Sources of equal weight have equal windows, so they take turns in their order and are scheduled
    as one: what a slot costs depends on the number of different weights, which the given table of
    weights bounds, and not on that of sources.  One row holds the numbers of all sources and slots
    of a period; its size is that of the list of sources, whatever the number of documents.
    """
    numbered = parts.select("_s", "_parts", (F.row_number().over(Window.orderBy("_s")) - 1).alias("_i"))  # one row for each source
    groups = numbered.groupBy("_parts").agg(F.array_sort(F.collect_list("_i")).alias("members"))
    one = groups.agg(F.array_sort(F.collect_list(F.struct(F.col("_parts").alias("parts"), "members"))).alias("groups"), F.sum(F.col("_parts") * F.size("members")).alias("period"))
    one = one.where("period > 0")
    period = F.col("period")
    counts = F.transform("groups", lambda g: F.lit(0).cast("long"))

    def due(group, done, slot):
        """Deadline and number of the next block of a group of sources, where it is released."""
        size = F.size(group["members"])
        k = F.floor(done / size) + 1
        place = F.struct(F.ceil(k * period / group["parts"]).alias("due"), F.element_at(group["members"], (done % size).cast("int") + 1).alias("i"))
        return F.when(F.floor((k - 1) * period / group["parts"]) <= slot, place)

    def step(acc, slot):
        each = F.zip_with("groups", acc["done"], lambda g, done: due(g, done, slot))
        # A list of one, so that the choice is made once and not for each use of it.
        return F.transform(F.array(F.array_min(F.array_compact(each))), lambda pick: F.struct(
            F.zip_with(acc["done"], each, lambda done, mine: done + F.coalesce((mine["i"] == pick["i"]).cast("long"), F.lit(0).cast("long"))).alias("done"),
            F.concat(acc["picks"], F.array(pick["i"])).alias("picks"),
        ))[0]

    def stretch(acc, first):
        slots = F.sequence(first, F.least(first + CHUNK, period) - 1)
        inner = F.aggregate(slots, F.struct(acc["done"].alias("done"), F.array().cast("array<int>").alias("picks")), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["done"].alias("done"), F.concat(acc["picks"], F.array(x["picks"])).alias("picks")))[0]

    begin = F.struct(counts.alias("done"), F.array().cast("array<array<int>>").alias("picks"))
    picks = F.flatten(F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1, F.lit(CHUNK).cast("long")), begin, stretch, lambda acc: acc["picks"]))
    slots = one.select(period.alias("_period"), F.posexplode(picks).alias("_slot", "_i"))
    turn = F.row_number().over(Window.partitionBy("_i").orderBy("_slot")) - 1
    slots = slots.select("_i", turn.cast("long").alias("_turn"), F.col("_slot").cast("long").alias("_slot"), "_period")
    return slots.join(numbered.drop("_parts"), "_i").drop("_i")


def mixed(docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block: int = 8, seed: str = "mix", digits: int = 3) -> DataFrame:
    """``docs`` with ``mix_slot``, the slot of a row's block, and ``mix_offset``, its place in the block.

    ``weights`` gives whole parts by source, ``default_weight`` those of other sources; a weight of
    0 is refused, as rows must not be dropped.  Within a source rows come in order of a hash of
    ``doc_id``, which also deals them over 16^``digits`` buckets: rows are ranked within a bucket and
    the counts of earlier buckets are added, so no task holds a whole source.  Every row is kept.
    When a source has run out its later slots stay empty and the others go on in proportion.

    A null source counts as the empty one.  Rows that share an id, or have none, come in order of a
    hash of their other columns, so that a task that is run again deals the same slots; rows that are
    equal in all columns are interchangeable.  An empty table gives no rows.  Columns named like the
    results are replaced.
    """
    if min([default_weight, *weights.values()]) < 1 or block < 1:
        raise ValueError("weights and block must be 1 or more")
    columns = [c for c in docs.columns if c not in ("mix_slot", "mix_offset")]
    source = F.coalesce(F.col("source"), F.lit(""))
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = docs.select(*columns, source.alias("_s"), order.alias("_order"), F.substring(order, 1, digits).alias("_bucket"))
    counts = docs.select(source.alias("_s"), F.substring(order, 1, digits).alias("_bucket")).groupBy("_s", "_bucket").count()
    earlier = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))

    part = F.lit(default_weight).cast("long")
    for name, n in weights.items():
        part = F.when(F.col("_s") == name, F.lit(n).cast("long")).otherwise(part)
    parts = counts.groupBy("_s").agg(F.sum("count").alias("n")).select("_s", part.alias("_parts"))

    ties = [F.xxhash64(*(c for c in columns if "map" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()))]
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_s", "_bucket").orderBy("_order", "doc_id", *ties)) - 1)
    ranked = ranked.join(offsets, ["_s", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / block)).withColumn("_parts", part)
    ranked = ranked.withColumn("_turn", F.col("_block") % F.col("_parts"))
    slots = period_slots(parts)
    slot = F.floor(F.col("_block") / F.col("_parts")) * F.col("_period") + F.col("_slot")
    return ranked.join(slots, ["_s", "_turn"]).select(*columns, slot.cast("long").alias("mix_slot"), (F.col("_rank") % block).cast("int").alias("mix_offset"))
