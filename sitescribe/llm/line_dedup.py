"""Line dedup by repeated runs of lines.

``runs_deduped`` rolls a hash over every two neighbouring lines of every text, and over each line of
more than ``PASSAGE_WORDS`` words.  Where these occur again anywhere they go, but for their first
occurrence, after their bytes have been compared.  A repeated chunk of lines is thus cut where its
rolling hashes cease to recur: its boundaries are chosen by content alone, shift with nothing, and
repeated runs go from their first line to their last.

``line_deduped`` cuts before it knows what recurs: a rolling hash over the hashes of neighbouring
lines chooses the boundaries of chunks, so that lines put in or taken out elsewhere do not shift
them.  Where a repeated run begins or ends inside a chunk, its edge stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, maybe_in, small_batches, text_key, utf8

#: A boundary follows a line in one of so many cases; bounds of a chunk's lines.
DIVISOR, LEAST_LINES, MOST_LINES = 2, 2, 32
#: A line of more words is a passage of its own.
PASSAGE_WORDS = 50


def chunks(raw: bytes) -> list[list[bytes]]:
    """The lines of a text by chunk; chunks end where the rolling hash of the last two lines says so."""
    out, chunk, before = [], [], 0
    for line in raw.split(b"\n"):
        chunk.append(line)
        now = xxhash.xxh3_64_intdigest(line)
        rolling = ((before * 0x9E3779B97F4A7C15 + now) & 0xFFFFFFFFFFFFFFFF) >> 32
        before = now
        if len(chunk) >= MOST_LINES or len(chunk) >= LEAST_LINES and rolling % DIVISOR == 0:
            out.append(chunk)
            chunk = []
    return [*out, chunk] if chunk else out


def is_passage(line: bytes) -> bool:
    return len(line) > 2 * PASSAGE_WORDS and len(line.split()) > PASSAGE_WORDS


def neighbours(raw: bytes) -> list[tuple[int, list[bytes]]]:
    """Every passage and every two neighbouring lines that are not both passages, by their first line's number."""
    lines = raw.split(b"\n")
    alone = [is_passage(line) for line in lines]
    out = [(i, [line]) for i, line in enumerate(lines) if alone[i]]
    return [*out, *((i, lines[i : i + 2]) for i in range(len(lines) - 1) if not (alone[i] and alone[i + 1]) and (lines[i].strip() or lines[i + 1].strip()))]


def long_chunks(raw: bytes) -> list[tuple[int, list[bytes]]]:
    """Chunks of several lines, not all blank, by their number."""
    return [(at, c) for at, c in enumerate(chunks(raw)) if removable(c)]


def removable(chunk: list[bytes]) -> bool:
    return len(chunk) >= LEAST_LINES and any(line.strip() for line in chunk)


def fingerprint(body: bytes, bits: int) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(body) & ((1 << bits) - 1)
    return (value >> 64) - (1 << 63), (value & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _occurrences(bits: int, units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, doc_ids, keys = [], batch.column("doc_id").to_pylist(), batch.column("_key").to_pylist()
            for doc_id, key, text in zip(doc_ids, keys, batch.column("text").to_pylist(), strict=True):
                for at, chunk in units(utf8(text)):
                    rows.append((doc_id, key, at, len(chunk), *fingerprint(b"\n".join(chunk), bits)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "_key", "at", "lines", "f1", "f2"])

    return run


def _bodies(bits: int, units):
    def run(texts: pd.Series, flags: pd.Series) -> pd.Series:
        out = []
        for text, mine in zip(texts, flags, strict=True):
            mine = set() if mine is None else set(mine.tolist())
            found = [(at, c) for at, c in units(utf8(text)) if 2 * at + (len(c) == 1) in mine] if mine else []
            bodies = [b"\n".join(c) for _, c in found]
            out.append([(*fingerprint(b, bits), at, len(c), b) for (at, c), b in zip(found, bodies, strict=True)])
        return pd.Series(out, dtype=object)

    return run


def _without(pieces):
    """Texts without the pieces of these numbers: chunks, or lines."""

    def keep(text: str | None, gone: np.ndarray | None) -> str | None:
        if text is None or gone is None or not len(gone):
            return text
        gone = set(gone.tolist())
        lines = [line for at, piece in enumerate(pieces(utf8(text))) if at not in gone for line in piece]
        return b"\n".join(lines).decode("utf-8", "surrogatepass")

    return lambda texts, removed: pd.Series([keep(t, r) for t, r in zip(texts, removed, strict=True)], dtype=object)


def _lines(raw: bytes) -> list[list[bytes]]:
    return [[line] for line in raw.split(b"\n")]


def _its_lines(place, first):
    """Numbers of the lines that go with a passage or two neighbouring lines; where these overlap their own first occurrence, that stays whole."""
    at = F.col("at")
    overlap = place.eqNullSafe(F.struct(first["doc_id"].alias("doc_id"), first["_key"].alias("_key"), (first["at"] + 1).alias("at")))
    return F.when(F.col("lines") == 1, F.array(at)).when(overlap, F.array(at + 1)).otherwise(F.array(at, at + 1))


def line_deduped(docs: DataFrame, bits: int = 128) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``, and a column ``_removed`` of their numbers.

    The first occurrence, by ``doc_id``, text and place, stays; a null ``doc_id`` comes first.  Null
    and empty texts, texts of one line and chunks of blank lines lose nothing.  Repeated rows (equal
    ``doc_id`` and text) are treated alike: all keep a chunk that is first in one of them.  Other
    columns are kept, ``n_chars`` (if there is one) is counted anew where the text changed; a
    column that is named ``_removed`` already is replaced.  ``bits`` is the fingerprint's length.

    Only texts in which something is repeated are shuffled.  Fingerprints are counted with partial
    aggregation; bodies of repeated chunks are compared by their smallest and largest, which combine
    before the shuffle.
    """
    return _deduped(docs, bits, long_chunks, chunks, lambda place, first: F.array("at"))


def runs_deduped(docs: DataFrame, bits: int = 128) -> DataFrame:
    """``docs`` with repeated passages and runs of two lines and more removed from ``text``, and a column ``_removed`` of their lines' numbers.

    A line goes where it occurred before, at a smaller ``doc_id``, text or place, if it has more than
    ``PASSAGE_WORDS`` words or a neighbour beside it there too.  So the bytes of each line that goes
    are kept at an earlier place, also where runs overlap.  Two blank lines are no run.  All else is
    as in ``line_deduped``.
    """
    return _deduped(docs, bits, neighbours, _lines, _its_lines)


def _deduped(docs: DataFrame, bits: int, units, pieces, goes) -> DataFrame:
    """Repeated ``units`` of a text removed; ``goes(place, first)`` says which of the text's ``pieces`` go with one."""
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("_key", "_flags", "_bodies", "_removed")]
    docs = docs.select(*columns).withColumn("_key", text_key())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "_key", "text").mapInArrow(_occurrences(bits, units), f"doc_id {id_type}, _key long, at int, lines int, f1 long, f2 long")
    found = materialise(found, "chunks")
    place = F.struct("doc_id", "_key", "at")
    removed = lambda pieces: F.array_sort(F.array_distinct(F.flatten(F.collect_list(pieces))))
    repeated = found.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "first")
    repeated = materialise(repeated, "repeated")  # so that the join below may be split where a chunk is very frequent
    flagged = maybe_in(found, ["f1", "f2"], repeated, ["g1", "g2"]).where("_maybe").join(repeated, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")))
    flagged = flagged.withColumn("later", ~place.eqNullSafe(F.col("first")))
    flags = flagged.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_of")).agg(
        F.collect_set(2 * F.col("at") + (F.col("lines") == 1).cast("int")).alias("_flags"), removed(F.when(F.col("later"), goes(place, F.col("first")))).alias("_removed")
    )  # chunks of one document only
    flags = materialise(flags, "flags")
    discard(found, repeated)
    seen = maybe_in(docs, ["doc_id", "_key"], flags, ["_id", "_of"])
    clean, touched = seen.where("not _maybe").drop("_maybe"), seen.where("_maybe").drop("_maybe")
    joined = touched.join(flags, touched["doc_id"].eqNullSafe(F.col("_id")) & (touched["_key"] == F.col("_of")), "left").drop("_id", "_of")
    bodies = F.pandas_udf(_bodies(bits, units), "array<struct<f1:long,f2:long,at:int,lines:int,body:binary>>")
    stored = materialise(joined.withColumn("_bodies", bodies("text", "_flags")).drop("_flags"), "flagged")

    each = stored.select("doc_id", "_key", F.explode("_bodies").alias("b")).select("doc_id", "_key", "b.*")
    unlike = each.groupBy("f1", "f2").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").select("f1", "f2")
    if not unlike.isEmpty():  # equal fingerprints of unlike bytes: decide by the bytes themselves
        firsts = each.groupBy("f1", "f2", "body").agg(F.min(place).alias("first"))
        later = each.join(firsts, ["f1", "f2", "body"]).where(~place.eqNullSafe(F.col("first")))
        exact = later.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_of")).agg(removed(goes(place, F.col("first"))).alias("_exact"))
        stored = stored.join(exact, stored["doc_id"].eqNullSafe(F.col("_id")) & (stored["_key"] == F.col("_of")), "left").withColumn("_removed", F.col("_exact"))
    none = F.array().cast("array<int>")
    out = stored.withColumn("_removed", F.coalesce("_removed", none))
    changed = F.size("_removed") > 0
    out = out.withColumn("text", F.when(changed, F.pandas_udf(_without(pieces), "string")("text", "_removed")).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.withColumn("_removed", none).select(*columns, "_removed").unionByName(out.select(*columns, "_removed"))
