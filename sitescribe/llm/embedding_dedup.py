"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact reranking.

Rotations that make the signs of rotated vectors balanced and close to the vectors are learned on
a bounded sample.  The signs of several such rotations form a long binary code, cut into as many
tables as the wanted recall asks for.  Vectors are not centred: the number of tables follows from
their angle through the origin, and about a common mean that angle would be wider.  Vectors of one label that agree in a table's piece of the
code are candidates; their cosine is computed from the original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, materialise, small_batches
from .components import connected_components

#: Vectors that the rotations are learned on, about, and rounds of learning.
SAMPLE, ROUNDS = 10_000, 30
#: Vectors that share a piece of code by chance, about; vectors in one block of a bucket.
BUCKET, BLOCK = 32, 1024
#: Wanted share of pairs at the threshold that meet in a table.
RECALL = 0.999
#: Rows of a table of heavy buckets that may be broadcast.
BROADCAST_ROWS = 100_000


def tables_for(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a piece and number of tables: pieces grow with the table, so buckets don't."""
    bits = min(60, max(4, math.ceil(math.log2(max(rows, 1) / BUCKET)) if rows > BUCKET else 4))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 5) -> np.ndarray:
    """Projections (dimensions x bits), by iterative quantisation from random starts."""
    dims = sample.shape[1]
    rng, out = np.random.default_rng(seed), []
    for _ in range(-(-bits // dims)):
        rotation, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(sample @ rotation >= 0, 1.0, -1.0).T @ sample)
            rotation = (left @ right).T
        out.append(rotation)
    return np.hstack(out)[:, :bits]


def _unit(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.stack([np.frombuffer(b, dtype=kind) for b in raw]).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encode(shared, bits: int, tables: int, kind: type = np.float64):
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(vectors: pd.Series) -> pd.Series:
        rotations = shared.value
        dims = len(rotations)
        out = []
        for v in vectors:
            x = np.frombuffer(v, dtype=kind).astype(np.float64)
            x = x / np.linalg.norm(x)
            x = np.pad(x, (0, max(0, dims - len(x))))[:dims]  # only finds candidates
            out.append(((x @ rotations >= 0).reshape(tables, bits) @ weights).astype(np.int64))
        return pd.Series(out, dtype=object)

    return run


def compare(ids: np.ndarray, copies: np.ndarray, units: np.ndarray, codes: np.ndarray, sides: np.ndarray, at: int, threshold: float):
    """Links of one unit of work that no earlier table has: weight of links by vector, and a forest."""
    across = len(np.unique(sides)) > 1
    near = np.triu(units @ units.T >= threshold, k=1)
    if across:
        near &= sides[:, None] != sides[None, :]
    a, b = np.nonzero(near)
    new = ~(codes[a, :at] == codes[b, :at]).any(axis=1) if at else np.ones(len(a), dtype=bool)
    a, b = a[new], b[new]
    links = np.bincount(a, weights=copies[b], minlength=len(ids)) + np.bincount(b, weights=copies[a], minlength=len(ids))
    root = np.arange(len(ids))
    while len(a) and (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
    linked, child = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
    return [(ids[i], None, int(links[i])) for i in linked] + [(ids[i], ids[root[i]], None) for i in child]


def _compare_units(threshold: float, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def close() -> list[tuple]:
            if len(held) < 2:
                return []
            ids, copies, vectors, codes, sides = zip(*held, strict=True)
            sides = np.array(sides)
            return compare(np.array(ids), np.array(copies), _unit(list(vectors), kind), np.array(codes), sides, unit[1], threshold)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["a", "b", "links"])

        names = ("kind", "at", "code", "one", "other", "node", "copies", "vector", "codes", "block")
        for batch in batches:
            found = []
            for *key, node, copies, vector, codes, block in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if key != unit:
                    found += close()
                    held.clear()
                    unit = key
                held.append((node, copies, vector, codes, block))
            yield rows(found)
        yield rows(close())

    return run


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every ``vec_id`` of ``vectors(vec_id, embedding, label)``, and each row without one.

    Only vectors with equal labels (not null) and equal lengths are compared.  Null vectors, those
    without or with zero length, and those with null or non-finite components are linked with
    nothing; so is a row with a null ``vec_id``, whose component is null.  Equal vectors of a label
    are one class that is compared once, so copies cost nothing; ``n_links`` counts each of them.
    Repeated rows are one vector; of different vectors under one ``vec_id`` the largest number of
    links and the smallest component count.  Other columns are not read.  An empty
    table gives no rows.

    A bucket is cut into blocks of about ``BLOCK`` vectors and pairs of blocks are units of work;
    a unit returns one number for each linked vector and a forest, never pairs.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(numbers, F.lit(0.0), lambda total, x: total + x * x)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (length > 0), F.lit(False))
    keyed = vectors.select("vec_id", "embedding", F.col("label").alias("_label"), usable.alias("usable")).withColumn("h1", F.xxhash64("_label", "embedding"))
    keyed = keyed.withColumn("h2", F.xxhash64(F.lit(17), "embedding", "_label"))
    number = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64  # as they came, cosines are worked out in doubles
    packed = F.pandas_udf(lambda column: pd.Series([np.asarray(v, dtype=number).tobytes() for v in column]), "binary")
    classes = keyed.where("usable").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"), F.first("embedding").alias("embedding"), F.first("_label").alias("_label")
    )
    kind = F.concat_ws("/", F.col("_label").cast("string"), F.size("embedding").cast("string"))
    classes = materialise(classes.select("h1", "h2", "node", "copies", kind.alias("kind"), packed("embedding").alias("vector")), "classes")

    rows = classes.count()
    bits, tables = tables_for(rows, threshold)
    drawn = [np.frombuffer(r["vector"], dtype=number).astype(np.float64) for r in hash_sample(classes, "node", SAMPLE, rows).select("vector").collect()]
    dims = max(map(len, drawn), default=1)
    sample = np.stack([np.pad(v / np.linalg.norm(v), (0, dims - len(v))) for v in drawn]) if drawn else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(learn_rotations(sample, bits * tables))
    coded = classes.select("node", "copies", "kind", "vector", F.pandas_udf(_encode(shared, bits, tables, number), "array<long>")("vector").alias("codes"))
    coded = materialise(coded, "codes")
    posted = coded.select("node", "kind", F.posexplode("codes").alias("at", "code"))
    heavy = materialise(posted.groupBy("kind", "at", "code").count().where(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count"), "heavy")
    if heavy.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    entries = coded.select("node", "copies", "kind", "vector", "codes", F.posexplode("codes").alias("at", "code")).join(heavy, ["kind", "at", "code"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("partner", F.explode(F.sequence(F.lit(0), blocks - 1)))
    entries = entries.withColumn("one", F.least("block", "partner")).withColumn("other", F.greatest("block", "partner"))
    unit = ["kind", "at", "code", "one", "other"]
    entries = entries.select(*unit, "node", "copies", "vector", "codes", "block").repartition(*unit).sortWithinPartitions(*unit)
    found = materialise(entries.mapInArrow(_compare_units(threshold, number), "a long, b long, links long"), "links")

    links = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = connected_components(found.where("links is null").select("a", "b"))
    named = classes.select("h1", "h2", "node", "copies").join(links, "node", "left").join(linked, "node", "left")
    out = keyed.select("vec_id", "h1", "h2", "usable").join(named, ["h1", "h2"], "left")
    total = F.when(F.col("usable"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("usable"), F.coalesce("component", "node")).otherwise(F.col("vec_id"))
    each = out.select("vec_id", total.alias("n_links"), component.alias("component_id"))
    named = each.where("vec_id is not null").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return named.unionByName(each.where("vec_id is null")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
