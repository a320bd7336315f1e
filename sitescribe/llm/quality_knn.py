"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text is a bag of terms: hashed three-byte sequences of its whole UTF-8 text and the share of
words that repeat the word before.  Weighted by inverse document frequency, the terms of a bounded
sample of labelled rows are factorised; every document is projected on the leading directions.
The sample's vectors are broadcast, each document's cosine with all of them is computed exactly in
blocks, and its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

#: Hash buckets of three-byte sequences.
BUCKETS = 4096
#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE_PER_CLASS = 2000
#: Latent directions, neighbours that vote, and the power of similarity that weighs a vote.
DIRECTIONS, NEIGHBOURS, POWER = 64, 15, 8
#: Documents in one block of cosine products, and rows of one block of the fit.
BLOCK, FIT_BLOCK = 512, 256

_HASH = np.random.default_rng(7).integers(0, BUCKETS, (3, 256), dtype=np.uint16)


def terms(text: str | None) -> np.ndarray:
    """Square roots of term frequencies; null is read as empty, and an empty text has no terms."""
    raw = utf8(text)
    if not raw:
        return np.zeros(BUCKETS + 1, dtype=np.float32)
    b = np.frombuffer(raw.ljust(3), dtype=np.uint8)
    counts = np.bincount(_HASH[0][b[:-2]] ^ _HASH[1][b[1:-1]] ^ _HASH[2][b[2:]], minlength=BUCKETS)
    words = raw.split()
    repeats = sum(map(operator.eq, words, words[1:])) / max(1, len(words))
    return np.sqrt(np.append(counts / (len(b) - 2), repeats)).astype(np.float32)


def packed(bag: np.ndarray) -> bytes:
    """The terms that a bag has: their places, then their values."""
    at = np.flatnonzero(bag)
    return at.astype(np.uint16).tobytes() + bag[at].astype(np.float16).tobytes()


class Bags:
    """Packed bags of all fitted rows; whole ones exist for a block of rows at a time only."""

    def __init__(self, rows: list[bytes]):
        self.ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
        self.places = np.concatenate([np.frombuffer(r, np.uint16, len(r) // 4) for r in rows])
        self.values = np.concatenate([np.frombuffer(r, np.float16, len(r) // 4, len(r) // 2) for r in rows])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def blocks(self) -> Iterator[np.ndarray]:
        for start in range(0, len(self), FIT_BLOCK):
            ends = self.ends[start : start + FIT_BLOCK + 1]
            out = np.zeros((len(ends) - 1, BUCKETS + 1), dtype=np.float32)
            out[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), self.places[ends[0] : ends[-1]]] = self.values[ends[0] : ends[-1]]
            yield out


class Voters:
    """The labelled vectors and the projection that made them; of bounded size."""

    def __init__(self, bags: Bags, labels: np.ndarray):
        seen = np.bincount(bags.places, minlength=BUCKETS + 1)[:BUCKETS]
        self.weights = np.maximum(np.log((len(bags) + 1) / (seen + 1)), 0.1).astype(np.float32)
        # Leading right singular vectors by subspace iteration over blocks of rows; no matrix of
        # rows by buckets or of buckets by buckets is made.
        basis = np.random.default_rng(11).standard_normal((BUCKETS + 1, DIRECTIONS + 16)).astype(np.float32)
        for _ in range(8):
            after = np.zeros_like(basis)
            for weighted in map(self._weighted, bags.blocks()):
                after += weighted.T @ (weighted @ basis)
            basis, _ = np.linalg.qr(after)
        inner = np.vstack([self._weighted(block) @ basis for block in bags.blocks()])
        _, turn = np.linalg.eigh(inner.T @ inner)
        turn = turn[:, -DIRECTIONS:]
        self.directions = np.ascontiguousarray(basis @ turn)
        self.vectors = self._unit(inner @ turn)
        self.labels = labels.astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def _weighted(self, bags: np.ndarray) -> np.ndarray:
        return self._unit(np.hstack([self._unit(bags[:, :BUCKETS] * self.weights), bags[:, BUCKETS:]]))

    def scores(self, bags: np.ndarray) -> np.ndarray:
        """Share of the neighbours' weight that label 1 has; 0 for a text without terms."""
        # In doubles, and rounded, so that a score does not depend on the block that a text is in.
        own = self._unit(self._weighted(bags.astype(np.float64)) @ self.directions.astype(np.float64))
        near = np.round(own @ self.vectors.astype(np.float64).T, 9)
        k = min(NEIGHBOURS, near.shape[1])
        edge = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        above, at = near > edge, near == edge
        chosen = above | at & (np.cumsum(at, axis=1) <= k - above.sum(axis=1, keepdims=True))  # of equal neighbours the first
        chosen = np.nonzero(chosen)[1].reshape(len(near), k)
        weights = np.maximum(np.take_along_axis(near, chosen, axis=1), 0) ** POWER
        total = weights.sum(axis=1)
        return np.round(np.where(total > 0, np.clip((weights * self.labels[chosen]).sum(axis=1) / np.maximum(total, 1e-300), 0, 1), 0.0), 6)


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from; a null id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Voters | None:
    """Fits on up to ``per_class`` rows of either class, the first in order of a hash of ``doc_id``.

    Only rows that are not held out are used, and only their texts.  Rows without a label or a text
    are passed over; of rows that share a ``doc_id`` one text counts, always the same one, and of
    several labels the lowest.  None where no labelled row is left.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = usable.where("_label = 0").orderBy(*order).limit(per_class).unionAll(usable.where("_label = 1").orderBy(*order).limit(per_class))
    # No more than 2 * per_class rows of two numbers: this bound is why the sample may be broadcast.
    bags = F.pandas_udf(lambda texts: pd.Series([packed(terms(t)) for t in texts]), "binary")
    small_batches(docs.sparkSession, 500)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "_label", bags("text").alias("bag"))
    rows = rows.groupBy("doc_id", "_label").agg(F.min("bag").alias("bag")).orderBy("doc_id").toArrow()  # one row for each of the sample
    if not rows.num_rows:
        return None
    return Voters(Bags([x.as_py() for x in rows.column("bag")]), rows.column("_label").to_numpy())


def quality_scores(docs: DataFrame, voters: Voters | None) -> DataFrame:
    """``docs`` and a column ``_score`` from 0 to 1, higher where label 1 is likelier.

    Whole texts are scored.  Null and empty texts score 0; without voters all others score 1, as
    nothing speaks against them.  Equal texts score alike.  Other columns
    are kept; a column that is named ``_score`` already is replaced.
    """
    if voters is None:
        return docs.withColumn("_score", F.when(F.length("text") > 0, 1.0).otherwise(0.0))
    small_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def score(texts: pd.Series) -> pd.Series:
        values = texts.to_numpy()
        blocks = [shared.value.scores(np.stack([terms(t) for t in values[i : i + BLOCK]])) for i in range(0, len(values), BLOCK)]
        return pd.Series(np.concatenate(blocks) if blocks else np.zeros(0))

    return docs.withColumn("_score", F.pandas_udf(score, "double")("text"))
