"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles.  Two sets A and B have Jaccard similarity >= p/q
exactly when their symmetric difference is at most (q-p)/(q+p) * (|A|+|B|).

*Sketches.*  XOR of one-hot hashes of the shingles into bits.  Two sketches differ in no more
bits than the sets have elements in only one of them, so their Hamming distance is a lower bound
of the symmetric difference.

*Pigeonhole join per size band.*  Bands double in size.  In a band whose pairs differ in at most
D elements the sketch is cut into about 1.3 (D+1) pieces; a linked pair agrees on all but D of
them.  A document that can differ from a partner by at most d elements posts its d+1 heaviest
pieces (a total order of weight, value, place that both sides share), which always include one
that an equally linked partner posts too.  A document also posts in the next band where a partner
may be that large.

*Stars and verification.*  Of a posting that several sets share, the smallest node is the star's
centre; every pair that shares a posting is in one star.  Stars are not chained: a set is sent once to
each of its stars, whatever these hang together with.  A star of up to a block of bytes is one unit of
work, in which long sketches are compared first, then the sets themselves.  A larger star is cut into
blocks that are each compared within and with the centre; only where its members have not all come
together by then are pairs of blocks compared, and of these only those that hold members of different
components.  Only edges that join two components of a unit are returned, so a group of n documents
yields fewer than n edges a unit and never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, discard, materialise, maybe_in, mix, shingle_set, small_batches, text_key
from .components import connected_components

#: Pieces of a band's sketch for each piece that has to be posted by its largest documents.
SLACK = 1.3
#: Bytes of shingle hashes in one block of a star.
BLOCK_BYTES = 2 << 20
#: Words of sketches that are compared at once.
STEP_WORDS = 1 << 18


def furthest(a: int, b: int, p: int, q: int) -> int:
    """Elements by which linked sets of sizes a and b may differ."""
    return (q - p) * (a + b) // (q + p)


def pieces_of(band: int, p: int, q: int) -> int:
    top = 2 ** (band + 1) - 1
    return int(np.ceil(SLACK * (furthest(top, top, p, q) + 1)))


def sketch_pieces(shingles: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and weight (elements) of each piece of the parity sketch.

    A piece holds two words of 64 parity bits, folded into one value; it is chosen by the high
    half of a shingle's hash, its bits by the low.
    """
    place = (((shingles >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    one = np.uint64(1)
    value, weight = np.zeros(pieces, dtype=np.uint64), np.zeros(pieces, dtype=np.int64)
    if len(starts):
        first = np.bitwise_xor.reduceat(one << (shingles & np.uint64(63)), starts)
        second = np.bitwise_xor.reduceat(one << ((shingles >> np.uint64(6)) & np.uint64(63)), starts)
        value[place[starts]] = mix(first ^ np.uint64(0x9E3779B97F4A7C15)) ^ second
        weight[place[starts]] = np.diff(starts, append=len(shingles))
    return value, weight


def postings(shingles: np.ndarray, p: int, q: int) -> np.ndarray:
    """Keys under which a set meets every set that it is linked with, equal sets apart."""
    n = len(shingles)
    if not n:
        return np.zeros(0, dtype=np.int64)
    out, own, largest = [], n.bit_length() - 1, n * q // p
    for band in range(own, max(own, largest.bit_length() - 1) + 1):
        d = furthest(n, min(2 ** (band + 1) - 1, largest), p, q)
        if d < 1:
            continue
        pieces = pieces_of(band, p, q)
        value, weight = sketch_pieces(shingles, pieces)
        place = np.arange(pieces)
        chosen = np.lexsort((place, value, weight))[max(0, pieces - d - 1) :]
        tag = (place[chosen].astype(np.uint64) << np.uint64(8)) | np.uint64(band)
        out.append(mix(value[chosen] ^ mix(tag + np.uint64(0x632BE59BD9B4E019))))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def long_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity sketches of about eight bits for each element of the largest set, one row a set."""
    words = max(1, 1 << int(np.ceil(np.log2(max(map(len, sets)) / 8 + 1))))
    shift, out = np.uint64(64 - int(np.log2(words))), np.zeros((len(sets), words), dtype=np.uint64)
    for row, s in zip(out, sets, strict=True):
        place = (s >> shift).astype(np.int64) if words > 1 else np.zeros(len(s), dtype=np.int64)
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        row[place[starts]] = np.bitwise_xor.reduceat(np.uint64(1) << (s & np.uint64(63)), starts)
    return out


def forest(nodes: list[int], sides: list[int], joined: list[int], sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Links that join components of one unit of work; ``joined`` says which are one already.

    With two different ``sides`` only pairs across them are compared, else all pairs.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    nodes, sides, sets = [nodes[i] for i in order], np.array([sides[i] for i in order]), [sets[i] for i in order]
    _, root = np.unique(np.array([joined[i] for i in order]), return_inverse=True)
    if root.max() == 0:
        return []
    sizes, sketches, across = np.array([len(s) for s in sets]), long_sketches(sets), len(set(sides.tolist())) > 1
    out = []
    for i in range(len(sets) - 1):
        end = np.searchsorted(sizes, sizes[i] * q // p, side="right")
        j = np.arange(i + 1, end)
        j = j[root[j] != root[i]] if not across else j[(root[j] != root[i]) & (sides[j] != sides[i])]
        if not len(j):
            continue
        # In steps, so that what is held besides the sketches stays small.
        apart = np.concatenate([np.bitwise_count(sketches[some] ^ sketches[i]).sum(axis=1, dtype=np.int64) for some in np.array_split(j, 1 + len(j) * sketches.shape[1] // STEP_WORDS)])
        for k in j[apart <= (q - p) * (sizes[i] + sizes[j]) // (q + p)]:
            if root[k] == root[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if q * common >= p * (sizes[i] + sizes[k] - common):
                out.append((nodes[i], nodes[k]))
                root[root == root[k]] = root[i]
    return out


def _signatures(width: int, p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            sizes, keys, ends, prints, nodes = [], [], [0], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, width, memo)
                sizes.append(len(shingles))
                prints.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                nodes.append(int.from_bytes(prints[-1][:8], "little", signed=True))
                keys.append(postings(shingles, p, q))
                ends.append(ends[-1] + len(keys[-1]))
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "node", "keys"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = [shingle_set(text, width, memo).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("units"), pa.array(found, pa.binary())], ["node", "units", "shingles"])

    return run


def _links(p: int, q: int):
    """Rows arrive sorted by unit; a unit may run on over batches and is held until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, found = None, [], []

        def close() -> None:
            if len(held) > 1:
                nodes, sides, joined, sets = zip(*held, strict=True)
                found.extend(forest(list(nodes), list(sides), list(joined), list(sets), p, q))
            held.clear()

        for batch in batches:
            names = ("star", "one", "other", "node", "block", "joined", "shingles")
            for star, one, other, node, block, joined, raw in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (star, one, other) != unit:
                    close()
                    unit = (star, one, other)
                held.append((node, block, joined, np.frombuffer(raw, dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
            found.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


UNIT = ["star", "one", "other"]


def compared(texts: DataFrame, units: DataFrame, firsts: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """(a, b): links found in ``units(star, one, other, node, block, joined)``, of bounded bytes each.

    ``firsts(node, doc_id, text_key)`` says in which row each node's text is; only texts of nodes
    that are in a unit move, each once, with the list of its units, and so do their sets.
    """
    wanted = units.groupBy("node").agg(F.collect_list(F.struct(*UNIT, "block", "joined")).alias("units"))  # of one set: no more than its postings ask for
    wanted = materialise(wanted.join(firsts, "node").select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_of"), "units"), "units")
    near = maybe_in(texts, ["doc_id", "text_key"], wanted, ["_id", "_of"]).where("_maybe").groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    moved = near.join(wanted, (near["doc_id"] == F.col("_id")) & (near["text_key"] == F.col("_of"))).select("node", "units", "text")
    kind = wanted.schema["units"].dataType.simpleString()
    sets = moved.mapInArrow(_sets(width), f"node long, units {kind}, shingles binary")
    dealt = sets.select("node", "shingles", F.explode("units").alias("u")).select("u.*", "node", "shingles").repartition(*UNIT).sortWithinPartitions(*UNIT)
    return dealt.mapInArrow(_links(p, q), "a long, b long")


def _cut(stars: DataFrame) -> DataFrame:
    """``stars(star, node, n)`` with the number of their blocks; grouped by ~star for the reason that components.py gives."""
    blocks = stars.groupBy(F.bitwise_not("star").alias("k")).agg(F.ceil(F.sum("n") * 8 / F.lit(BLOCK_BYTES)).cast("int").alias("blocks"))
    return stars.join(blocks.select(F.bitwise_not("k").alias("star"), "blocks"), "star")


def _within(stars: DataFrame) -> DataFrame:
    """Units of each block of a star and its centre."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    mine = F.when((F.col("node") == F.col("star")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    each = stars.select("star", "node", F.explode(mine).alias("one"))
    return each.select("star", "one", F.col("one").alias("other"), "node", F.lit(0).alias("block"), F.col("node").alias("joined"))


def _across(stars: DataFrame, linked: DataFrame) -> DataFrame:
    """Units of pairs of blocks, for large stars of which not all members are one component.

    Components of a block's size and more have blocks of their own, which are not compared with each
    other; smaller ones share blocks, whole.
    """
    large = stars.where("blocks > 1").join(linked, "node", "left").withColumn("joined", F.coalesce("component", "node")).drop("component", "blocks")
    several = large.groupBy("star").agg(F.min("joined").alias("low"), F.max("joined").alias("high")).where("low <> high").select("star")
    large = large.join(several, "star")
    sizes = large.groupBy("star", "joined").agg((F.sum("n") * 8).alias("bytes"))
    own = F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES)).cast("int")
    is_big = F.col("bytes") >= BLOCK_BYTES
    big = sizes.where(is_big).withColumn("own", own)
    before = Window.partitionBy("star").orderBy("joined").rowsBetween(Window.unboundedPreceding, -1)  # one row for BLOCK_BYTES of sets
    big = big.select("star", "joined", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int").alias("from"))
    total = sizes.groupBy("star").agg(
        F.coalesce(F.ceil(F.sum(F.when(~is_big, F.col("bytes"))) / F.lit(BLOCK_BYTES)), F.lit(0)).cast("int").alias("shared"), F.coalesce(F.sum(F.when(is_big, own)), F.lit(0)).cast("int").alias("owned")
    )
    placed = large.join(big, ["star", "joined"], "left").join(total, "star")
    start = F.col("shared") + F.col("from")
    alone = F.col("own").isNotNull()
    placed = placed.withColumn("block", F.when(alone, start + F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("joined"), F.col("shared"))).cast("int"))
    partners = F.sequence(F.lit(0), F.col("shared") + F.col("owned") - 1)
    partners = F.when(alone, F.filter(partners, lambda x: (x < start) | (x >= start + F.col("own")))).otherwise(partners)
    each = placed.withColumn("partner", F.explode(partners))
    return each.select("star", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("other"), "node", "block", "joined")


def ngram_jaccard_components(docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key, is_first) for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable by links of the given similarity or
    more.  Equal sets are linked and handled as one.  Null and empty texts, and texts without
    words, have no shingles and are linked with nothing.  Repeated rows get equal results; of rows
    that share a ``doc_id`` but not their text, each has the component of its own set.  A null
    ``doc_id`` is no end of a link between different texts; its row takes the component of the
    documents whose set equals its own, null where there is none.  ``text_key`` tells texts of one
    ``doc_id`` apart; ``is_first`` says that the row has the smallest ``doc_id`` of its group, and of
    several texts under that id the smallest key (true for rows without shingles or without an id).
    Only ``doc_id`` and ``text`` are read, so other columns may have any name.  An empty table gives
    no rows.  Shingles and sets are told apart by 64 bits.
    """
    p, q = similarity.numerator, similarity.denominator
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text", text_key().alias("text_key"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = materialise(texts.mapInArrow(_signatures(width, p, q), f"doc_id {id_type}, text_key long, n_shingles long, node long, keys array<long>"), "signatures")
    filled = signed.where("n_shingles > 0")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("first")
    classes = materialise(filled.groupBy("node").agg(first, F.first("n_shingles").alias("n")), "classes")
    # Equal sets have equal nodes and keys, so copies add up before the shuffle.
    posts = filled.where("doc_id is not null").select("node", F.explode("keys").alias("key"))
    shared = posts.groupBy("key").agg(F.min("node").alias("star"), F.max("node").alias("most")).where("star <> most").select(F.col("key").alias("_of"), "star")
    shared = materialise(shared, "postings")
    met = maybe_in(posts, ["key"], shared, ["_of"]).where("_maybe").join(shared, F.col("key") == F.col("_of")).select("star", "node")
    met = met.union(met.select("star", F.col("star").alias("node"))).distinct()
    stars = materialise(_cut(met.join(classes.select("node", "n"), "node")), "stars")
    narrow = materialise(signed.drop("keys"), "documents")
    discard(signed, shared)

    firsts = classes.where("first is not null").select("node", "first.doc_id", "first.text_key")
    links = materialise(compared(texts, _within(stars), firsts, width, p, q), "links")
    linked = connected_components(links)
    if not stars.where("blocks > 1").isEmpty():
        more = materialise(compared(texts, _across(stars, linked), firsts, width, p, q), "links")
        linked = connected_components(links.union(more))
    discard(stars)

    named = classes.join(linked, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    named = materialise(named.join(heads, "component").select(F.col("node").alias("_node"), "head"), "groups")
    # Written out, the groups meet the rows again in a join that may be split where one is large.
    out = narrow.join(named, (F.col("node") == F.col("_node")) & (F.col("n_shingles") > 0), "left")
    head, alone = F.col("head"), F.col("head").isNull() | F.col("doc_id").isNull()
    is_first = alone | (F.col("doc_id") == head["doc_id"]) & (F.col("text_key") == head["text_key"])
    return out.select("doc_id", "n_shingles", F.coalesce(head["doc_id"], F.col("doc_id")).alias("component_id"), "text_key", is_first.alias("is_first"))
