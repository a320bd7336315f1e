"""Chat formatting in budgeted windows, by DataFrame functions only.

Prefix sums of the turns' tokens place every turn in its conversation.  They are worked out in two steps,
within a range of rows and over the sums of ranges, so a conversation of any length is spread over tasks.
The sums cut a conversation into segments of a bounded number of tokens; in each, turns are
packed into windows in order.  A window holds the system turn, the last turns before it as far as the
history's tokens reach, and its own turns; its loss mask covers what the assistant says in the latter, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

# Fixed values of the template: what begins a turn, and what ends it.
MARK, END = "### ", "</turn>\n"
#: Tokens that a turn's marks count as, and windows that a segment has about room for.
MARK_TOKENS, SEGMENT = 4, 64
#: What counts as a token: up to six letters, a digit, another sign.
TOKEN = r"\p{L}{1,6}|\p{N}|[^\x09-\x0D\x20\p{L}\p{N}]"


def turn_tokens(text: str | Column) -> Column:
    return (F.regexp_count(text, F.lit(TOKEN)) + MARK_TOKENS).cast("long")


def escaped(text: Column) -> Column:
    """``text`` without the template's marks: backslashes doubled, one put into each ``##`` and ``</turn>``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("##"), F.lit("#\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#])", "$1")


def escaped_role(role: Column) -> Column:
    """On one line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    plain = F.transform(F.split(role, r"\\\\"), lambda x: unescaped(F.replace(x, F.lit("\\n"), F.lit("\n"))))
    return F.array_join(plain, "\\")


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn with its tokens before and after, and what its conversation's segments need.

    A range of rows ends anywhere in a conversation; sums within ranges meet the sums of ranges.
    """
    ranged = turns.repartitionByRange("conv", "turn", "tie").sortWithinPartitions("conv", "turn", "tie", "role", "text")
    rows = materialise(ranged.select("conv", "role", "text", "tokens", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    sums = rows.groupBy("conv", "part").agg(F.sum("tokens").alias("_sum"), F.min(F.struct("at", (F.col("role") == "system").alias("is_system"), "tokens")).alias("_first"))
    parts = Window.partitionBy("conv").orderBy("part")
    sums = sums.select(
        "conv", "part", F.coalesce(F.sum("_sum").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_sum").over(Window.partitionBy("conv")).alias("_all"), F.first("_first").over(parts).alias("_head"),
    )
    within = F.sum("tokens").over(Window.partitionBy("conv", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    system = F.when(F.col("_head.is_system"), F.col("_head.tokens")).otherwise(F.lit(0))
    placed = rows.withColumn("_within", within).join(sums, ["conv", "part"])
    placed = placed.withColumn("is_system", F.col("_head.is_system") & (F.col("at") == F.col("_head.at"))).withColumn("room", F.greatest(F.lit(budget - history) - system, F.lit(1)))
    end = F.col("_before") + F.col("_within") - system
    return placed.select("conv", "at", "role", "text", "is_system", "room", (end - F.col("tokens")).alias("start"), end.alias("end"), (F.col("_all") - system).alias("total"))


def chat_windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """(conv_id, start, n_new, n_repeated, text, loss) from ``conversations(conv_id, turn, role, text)``.

    Turns are in order of ``turn``, ties by a hash of role and text, so that repeated rows follow each
    other and each counts.  A first turn by ``system`` heads every window.  ``start`` is the number of tokens before the window's own turns: with
    ``conv_id`` it names the window and gives the order.  The first ``n_repeated`` turns in ``text`` were said in earlier
    windows; ``loss`` has the offsets and lengths, in code points, of what the assistant says in the ``n_new`` others.
    No window has more than ``budget`` tokens, but for turns that are too long by themselves: such a
    turn is a window with what is repeated before it, and nothing is cut.

    Null roles and texts are empty ones, null turns come first, rows without a ``conv_id`` are one
    conversation, other columns are not read, and an empty table gives no rows.
    """
    turns = conversations.select(F.struct("conv_id").alias("conv"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    turns = turns.withColumn("tokens", turn_tokens("text")).withColumn("tie", F.xxhash64("role", "text"))
    placed = _placed(turns, budget, history).withColumn("whole", F.col("room") * SEGMENT)

    # A turn goes to its segment, and as history to the next; the system turn goes to all.
    own = F.floor(F.col("start") / F.col("whole"))
    reach = F.when(F.col("end") - F.col("start") <= history, F.floor((F.col("start") + history) / F.col("whole"))).otherwise(own)
    last = F.greatest(F.floor((F.col("total") - 1) / F.col("whole")), F.lit(0))
    to = F.when(F.col("is_system"), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.sequence(own, reach))
    said = F.struct("at", "start", "end", "is_system", (F.col("role") == "assistant").alias("spoken"), F.concat(F.lit(MARK), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"))
    dealt = placed.select("conv", "room", "whole", said.alias("said"), F.explode(to).alias("segment"))
    segments = dealt.groupBy("conv", "room", "whole", "segment").agg(F.array_sort(F.collect_list("said")).alias("said"))
    segments = segments.withColumn("system", F.filter("said", lambda x: x["is_system"])).withColumn("said", F.filter("said", lambda x: ~x["is_system"]))

    # Windows of a segment: a turn that has no room begins the next.
    begin = F.col("segment") * F.col("whole")
    mine = F.filter("said", lambda x: x["start"] >= begin)
    none = F.array().cast("array<long>")
    starts = F.aggregate(mine, F.struct(F.lit(None).cast("long").alias("last"), none.alias("all")), lambda now, x: F.when(
        now["last"].isNull() | (x["end"] - now["last"] > F.col("room")), F.struct(x["start"].alias("last"), F.concat(now["all"], F.array(x["start"])).alias("all"))
    ).otherwise(now), lambda now: now["all"])
    alone = (F.col("segment") == 0) & (F.size(mine) == 0)
    segments = segments.withColumn("starts", F.when(alone, F.array(F.lit(0).cast("long"))).otherwise(starts))
    bounds = F.transform("starts", lambda s, i: F.struct(s.alias("start"), F.coalesce(F.try_element_at("starts", (i + 2).cast("int")), begin + F.col("whole")).alias("until")))
    windows = segments.select("conv", "said", "system", F.explode(bounds).alias("w"))

    first = F.col("w.start") == 0
    new = F.filter("said", lambda x: (x["start"] >= F.col("w.start")) & (x["start"] < F.col("w.until")))
    repeated = F.filter("said", lambda x: (x["end"] <= F.col("w.start")) & (x["start"] >= F.col("w.start") - history))
    piece = lambda fresh: lambda x: F.struct(x["head"].alias("head"), x["body"].alias("body"), (x["spoken"] & F.lit(fresh)).alias("counts"))
    pieces = F.concat(F.transform("system", piece(False)), F.transform(repeated, piece(False)), F.transform(new, piece(True)))
    windows = windows.select("conv", F.col("w.start").alias("start"), (F.size(new) + F.when(first, F.size("system")).otherwise(0)).alias("n_new"), (F.size(repeated) + F.when(first, 0).otherwise(F.size("system"))).alias("n_repeated"), pieces.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    span = "array<struct<offset:long,length:long>>"
    loss = F.aggregate("pieces", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans")), lambda now, x: F.struct(
        (now["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("at"),
        F.when(x["counts"], F.concat(now["spans"], F.array(F.struct((now["at"] + F.length(x["head"])).alias("offset"), F.length(x["body"]).cast("long").alias("length"))))).otherwise(now["spans"]).alias("spans"),
    ), lambda now: now["spans"])
    return windows.select("conv.conv_id", "start", "n_new", "n_repeated", text.alias("text"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """``windows`` with ``turns``, an array of (role, text) of the turns that are new in each, and ``learned``, the text under its mask."""
    pieces = F.split("text", END)
    said = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    role = lambda x: unescaped_role(F.substring(F.substring_index(x, "\n", 1), F.lit(len(MARK) + 1), F.length(x)))
    turns = F.transform(said, lambda x: F.struct(role(x).alias("role"), unescaped(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))).alias("text")))
    learned = F.transform("loss", lambda s: unescaped(F.substring("text", (s["offset"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.withColumns({"turns": turns, "learned": F.array_join(learned, "")})
