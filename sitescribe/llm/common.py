"""What several training-data operators share: tables, intermediate results, text and hashes."""

from __future__ import annotations

import functools
import math
import re
import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Entries that a worker's word-to-hash memo may hold; beyond it words are hashed each time.
MEMO_WORDS = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the cluster names one, else the context's checkpoint directory.
    Only where neither is set and driver and executors are one process (tests) a new temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sitescribe-"))
    return context.getCheckpointDir().rstrip("/")


class Scratch:
    """What the stages of one pipeline have materialised.

    A stage's result reads its tables when it is written, so they can only go once the next stage
    begins with that written result; tables that the next stage's ``docs`` still reads stay.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def stage(self, f):
        @functools.wraps(f)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            read = docs.inputFiles() if self.paths else []
            for path in [p for p in self.paths if not any(p.split("/sitescribe/")[-1] in x for x in read)]:
                _delete(spark, path)
                self.paths.remove(path)
            before = _SCOPE.set(self)
            try:
                return f(spark, docs, sf_dir)
            finally:
                _SCOPE.reset(before)

        return run


_SCOPE: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors and lets later reads prune columns.  The files
    stay below ``<shared>/sitescribe/<application id>`` until they are discarded or that folder is
    deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sitescribe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if (scope := _SCOPE.get()) is not None:
        scope.paths.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._scratch_path)
        if (scope := _SCOPE.get()) is not None and t._scratch_path in scope.paths:
            scope.paths.remove(t._scratch_path)


#: Bits of a bitmap of marks for each marked row, and bits of a bitmap at most (8 MB): with more
#: marked rows than that more rows pass that are not marked, which the join behind it sorts out.
MARK_BITS, MOST_BITS = 64, 26


def maybe_in(df: DataFrame, keys: list[str], marked: DataFrame, marked_keys: list[str]) -> DataFrame:
    """``df`` and a boolean column ``_maybe``: false only where no row of ``marked`` has these keys.

    For joins of a large table with few partners: rows that surely have none need no shuffle.
    ``marked`` is counted and hashed into a bitmap of bounded size, which is broadcast; a null key
    is marked like a value.
    """
    bits = min(MOST_BITS, max(15, math.ceil(math.log2(MARK_BITS * max(1, marked.count())))))
    place = lambda columns: F.pmod(F.xxhash64(F.lit(41), *columns), F.lit(1 << bits))
    put = marked.select(place(marked_keys).alias("h")).groupBy(F.floor(F.col("h") / 32768).alias("_page"))
    pages = F.broadcast(put.agg(F.bitmap_construct_agg((F.col("h") % 32768)).alias("_bits")))
    at = place(keys)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at % 32768 / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = df.drop("_page", "_bits", "_maybe").withColumn("_page", F.floor(at / 32768)).join(pages, "_page", "left")
    hit = F.bit_get(byte, (at % 8).cast("int")) == 1
    return found.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_page", "_bits")


#: Bytes of rows that go to a Python worker at once, about; the JVM holds a few times as much beside its heap.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what a Python worker holds at once when rows carry whole texts.

    Plans read these settings when they run, so they stay set; a smaller number of rows that the
    session has is left as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(rows, int(spark.conf.get(name)) or rows)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_key() -> "F.Column":
    """Tells texts of rows with the same ``doc_id`` apart; null texts count as one text."""
    return F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))


def hash_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, 2 * ``rows`` at most, chosen by a hash of ``key``; no rows are gathered to choose."""
    share = min(1.0, rows / max(total, 1))
    return df.where(F.pmod(F.xxhash64(F.lit(99), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * rows)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null has none."""
    return utf8(text).translate(LOWER).split()


class WordHashes(dict):
    """Word to 64-bit hash, the same in every worker."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


def hashed(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequences(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` neighbouring word hashes, in order."""
    out = np.full(max(0, len(hashes) - width + 1), width, dtype=np.uint64)
    for j in range(width):
        out = (out ^ hashes[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(text: str | None, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of word shingles; with fewer words than ``width`` the whole
    sequence is one shingle, without words there is none."""
    hashes = hashed(plain_words(text), memo)
    return np.unique(sequences(hashes, min(width, len(hashes)))) if len(hashes) else hashes
