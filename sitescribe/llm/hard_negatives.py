"""Hard-negative mining: every anchor's scores against all rows, sorted by score and id.

Components are whole numbers, so scores are exact.  Rows and anchors are dealt into blocks of bounded
bytes, and each pair of a block of anchors with a block of rows is one unit of work: an anchor's scores
in it are sorted by score and id, a positive's upper limit is found by binary search, and the entries
down to its lower limit are read.  A unit returns a few rows an anchor, of which a window keeps the
first.  Positives come first, as their scores are the limits of the second pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Bytes of components in a block, about; blocks of rows at least, so that small tables are dealt out too.
BLOCK_BYTES, LEAST_BLOCKS = 16 << 20, 16
#: Anchors whose scores a task holds at once.
AT_ONCE = 64
#: Scores beyond 64 bits count as this.
MOST = 2**63 - 1


def quantised(embedding: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as a double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; in doubles where every sum stays below 2^53."""
    largest = [np.abs(x.astype(np.float64)).max(initial=0.0) for x in (a, b)]
    if largest[0] * largest[1] * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def _columns(rows: pa.StructArray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and components, the shorter vectors filled up with zeros."""
    lists = rows.field("numbers")
    numbers = np.zeros((len(rows), dims), dtype=np.int64)
    numbers[np.arange(dims) < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return rows.field("vec_id").to_numpy(zero_copy_only=False), np.array(rows.field("label").to_pylist(), dtype=str), numbers


def first_positives(scores: np.ndarray, ids: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first usable entries, higher scores and then smaller ids first."""
    at = np.flatnonzero(usable)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def within_limits(scores: np.ndarray, ids: np.ndarray, usable: np.ndarray, limits: list[tuple[int, int]], k: int) -> list[np.ndarray]:
    """For each (lower, upper): places of the k first usable entries with a score between them."""
    at = np.flatnonzero(usable)
    at = at[np.lexsort((ids[at], -scores[at]))]
    falling = -scores[at]
    out = []
    for lower, upper in limits:
        start = int(np.searchsorted(falling, -upper, "left"))
        some = at[start : start + k]
        out.append(some[scores[some] >= lower])
    return out


def _units(dims: int, k: int, lower: Fraction | None, upper: Fraction | None):
    """Rows (anchor_id, positive_id, positive_score, negative_id, negative_score) of the units; without limits, positives."""

    def of_unit(anchors: pa.StructArray, rows: pa.StructArray) -> Iterator[tuple]:
        anchor_ids, anchor_labels, left = _columns(anchors, dims)
        ids, labels, right = _columns(rows, dims)
        wanted = anchors.field("positives").to_pylist() if lower is not None else None
        for start in range(0, len(anchor_ids), AT_ONCE):
            scores = inner_products(left[start : start + AT_ONCE], right)
            for i, own in enumerate(scores, start):
                same = labels == anchor_labels[i]
                if wanted is None:
                    for at in first_positives(own, ids, same & (ids != anchor_ids[i]), k):
                        yield int(anchor_ids[i]), int(ids[at]), int(own[at]), None, None
                    continue
                limits = [(max(-MOST, math.ceil(lower * p["score"])), min(MOST, math.floor(upper * p["score"]))) for p in wanted[i]]
                for p, found in zip(wanted[i], within_limits(own, ids, ~same, limits, k), strict=True):
                    for at in found:
                        yield int(anchor_ids[i]), p["id"], p["score"], int(ids[at]), int(own[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchors, rows in zip(batch.column("anchors"), batch.column("rows"), strict=True):
                found = list(of_unit(anchors.values, rows.values))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(5)], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row for each block of about as many rows, dealt by a hash of the id."""
    return rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(f"{name}_block")).agg(F.collect_list(F.struct(*rows.columns)).alias(name))


def _scored(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], dims: int, k: int, lower: Fraction | None = None, upper: Fraction | None = None) -> DataFrame:
    """All units of ``blocks`` (of anchors, of rows), each a row with both its blocks."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _packed(anchors, blocks[0], "anchors").withColumn("rows_block", each(blocks[1]))
    right = _packed(rows, blocks[1], "rows").withColumn("anchors_block", each(blocks[0]))
    units = left.join(right, ["anchors_block", "rows_block"]).select("anchors", "rows")
    return units.mapInArrow(_units(dims, k, lower, upper), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")


def _ranked(rows: DataFrame, of: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The first k rows of each group and their rank; Spark keeps k a task before it shuffles."""
    order = Window.partitionBy(*of).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, lower: Fraction = Fraction(4, 5), upper: Fraction = Fraction(1), scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors in ``vectors(vec_id, label, embedding)``.

    A score is the inner product of floor(scale * x) of two rows' components.  Positives of an anchor
    are its first other rows of the same label; negatives of a positive are the first rows of another
    label with lower * positive_score <= score <= upper * positive_score.  Higher scores come first, ties
    by smaller ``vec_id``; where there are fewer rows, all are taken, and where there are none, there is no row.

    Rows with a null ``vec_id``, label or vector, or with null or non-finite components take no part.
    Vectors may differ in length: missing components count as 0, and so does a vector without any.  Of rows with one
    ``vec_id`` the one with the smallest label and components counts, and it is an anchor if one of them
    is.  Components and scores beyond 64 bits count as the largest of their sign.  Other columns are
    not read, whatever their names.  Empty tables give no rows.

    Every anchor meets every row, in blocks: with n rows and a anchors there are (n / block) * (a / block)
    units, and no pairs are written but the few that a unit returns.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("string").alias("label"), quantised("embedding", scale).alias("numbers")).alias("r"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.groupBy("vec_id").agg(F.min("r").alias("r"), F.bool_or("anchor").alias("anchor"))
    rows = materialise(rows.select("vec_id", "r.label", "r.numbers", "anchor"), "vectors")
    n, n_anchors, dims = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("numbers"))).first()
    dims = max(1, dims or 0)
    blocks = max(1, math.ceil(n_anchors * dims * 8 / BLOCK_BYTES)), max(min(LEAST_BLOCKS, max(1, n)), math.ceil(n * dims * 8 / BLOCK_BYTES))

    every, anchors = rows.select("vec_id", "label", "numbers"), rows.where("anchor").select("vec_id", "label", "numbers")
    found = _scored(anchors, every, blocks, dims, positives).select("anchor_id", "positive_id", "positive_score")
    found = materialise(_ranked(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    limits = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    found = _scored(anchors.join(limits, "vec_id"), every, blocks, dims, negatives, lower, upper)
    out = _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
