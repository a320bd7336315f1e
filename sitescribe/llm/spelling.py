"""Spelling variants: pairless groups of words that agree but for one place.

A word without its i-th code point is the key of a group, together with i: words of one key and place
have the same prefix and suffix about that place, so each is a replacement of all others.  A group
needs only its size and its two most frequent words to tell every member how many near words it has there
and which is best.  The same keys meet the vocabulary itself: a word that equals a key is an insertion or
deletion away from the key's words.  What groups say of a word is added up; pairs are never written.

Words are numbered in order of falling frequency and then of code points, so the better of two words is the smaller number, and
long words travel as numbers.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, materialise, small_batches, utf8

#: Runs of letters after A-Z have been lower-cased; there are 90 letters, so 90 words share a key and place at most.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Words counted in a task before it passes them on, and rows of a batch that it passes on.
HELD, BATCH = 200_000, 50_000
#: Code points of keys that are spelled out; longer keys are fingerprints, as a word has as many keys as letters.
SPELLED, PRIME, BASE = 128, (1 << 127) - 1, 0x1F3D5B79A2C4E6088CADBECF13579BDF
#: Texts of more characters are read run by run.
LONG_TEXT = 1 << 22


def altered(doc_id: int | str | None, run: str, one_in: int) -> str:
    """The run, or in one of ``one_in`` cases the run without one code point: crc32 of id and run decides."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int, one_in: int | None):
    """(word, n) of batches of documents, added up as far as memory allows."""

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                lowered = utf8(text.as_py()).translate(LOWER).decode("utf-8", "surrogatepass")
                runs = RUN.findall(lowered) if len(lowered) <= LONG_TEXT else (m[0] for m in RUN.finditer(lowered))
                for word, n in Counter(runs).items():
                    if len(word) >= least:
                        word = altered(doc_id, word, one_in) if one_in else word
                        if len(word) >= least:
                            held[word] += n
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    return run


def word_counts(docs: DataFrame, least: int = 5, occurrences: int = 3, one_in: int | None = None) -> DataFrame:
    """(word, n) of ``docs(doc_id, text)``: words of ``least`` code points and more that occur ``occurrences`` times and more."""
    small_batches(docs.sparkSession)
    each = docs.select("doc_id", "text").mapInArrow(_counted(least, one_in), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def keys_of(word: str) -> Iterator[tuple[str, int]]:
    """(key, place): the word itself at place -1, and the word without each of its code points."""
    size = len(word)
    if size <= SPELLED:
        yield word, -1
        for i in range(size):
            yield word[:i] + word[i + 1 :], i
        return
    before, powers = [0], [1]
    for c in word:
        before.append((before[-1] * BASE + ord(c)) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    named = lambda value, n: f"\0{n}:{value:x}"  # noqa: E731  no word has this character
    yield named(before[size], size), -1
    for i in range(size):
        rest = before[size] - before[i + 1] * powers[size - i - 1]
        key = (before[i] * powers[size - i - 1] + rest) % PRIME
        yield (named(key, size - 1) if size - 1 > SPELLED else word[:i] + word[i + 1 :]), i


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "place", "id"]
    held: tuple[list, list, list] = ([], [], [])
    for batch in batches:
        for word, number in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist(), strict=True):
            for key, place in keys_of(word):
                for column, value in zip(held, (key, place, number), strict=True):
                    column.append(value)
                if len(held[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.int32()), pa.array(held[2], pa.int64())], names)
                    held = ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.int32()), pa.array(held[2], pa.int64())], names)


def told(places: list[int], numbers: list[int]) -> list[tuple[int, int, int]]:
    """What the words of one key learn: (word, near words met here, the best of them)."""
    groups: dict[int, list[int]] = {}
    for place, number in zip(places, numbers, strict=True):
        groups.setdefault(place, []).append(number)
    itself = groups.pop(-1, None)
    out = []
    for members in groups.values():
        if len(members) > 1:
            first, second = sorted(members)[:2]
            out += [(x, len(members) - 1, second if x == first else first) for x in members]
    if itself and groups:
        longer = {x for members in groups.values() for x in members}
        out += [(itself[0], len(longer), min(longer)), *((x, 1, itself[0]) for x in longer)]
    return out


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = batch.column("members")
        flat, sizes = members.flatten(), members.value_lengths().to_pylist()
        places, numbers = flat.field("place").to_pylist(), flat.field("id").to_pylist()
        at, found = 0, []
        for size in sizes:
            found += told(places[at : at + size], numbers[at : at + size])
            at += size
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["id", "n_near", "best"])


def roots_of(forms: DataFrame, steps: int) -> DataFrame:
    """(id, root) from ``forms(id, form)``: the last word of each chain of at most ``steps`` forms.

    A chain's reach doubles each round, and each round is materialised.
    """
    now = materialise(forms.select("id", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        further = now.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        after = materialise(now.join(further, "root", "left").select("id", F.coalesce("_next", "root").alias("root")), "roots")
        discard(now)
        now = after
    return now


def spelling_variants(docs: DataFrame, least: int = 5, occurrences: int = 3, ratio: int = 2, one_in: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs(doc_id, text)``.

    Words are runs of letters with A-Z lower-cased, of ``least`` code points and more, that occur
    ``occurrences`` times and more in all texts.  Near words differ by one inserted, deleted or
    replaced code point.  A word's form is its near word of largest n, if that is at least ``ratio``
    times its own; ties go to the smallest in order of code points.  The root follows forms to the
    last.  With ``one_in`` one in so many pairs of a document and a run is misspelled first.

    Null and empty texts have no words, repeated rows count each time, a null ``doc_id`` reads as an
    empty one, very long texts are read run by run and very long words keep fingerprints of 127 bits as
    keys.  Other columns are not read.  Empty tables give no rows.

    A key's group has no more than 90 words a place.  Words, keys and what groups tell are rows of a shuffle each.
    """
    counted = word_counts(docs, least, occurrences, one_in)
    words = materialise(counted.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()), "words")
    keys = words.select("word", "id").mapInArrow(_keyed, "key string, place int, id long")
    groups = keys.groupBy("key").agg(F.collect_list(F.struct("place", "id")).alias("members")).where(F.size("members") > 1)
    heard = groups.select("members").mapInArrow(_told, "id long, n_near long, best long")
    near = heard.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = words.join(near, "id", "left").join(best, "best", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    known = materialise(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(fits, F.col(c)).alias(c) for c in ("best", "form", "form_n"))), "forms")

    largest, smallest = words.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(largest / smallest, max(ratio, 2))) + 2 if largest else 1
    roots = roots_of(known.where("best is not null").select("id", F.col("best").alias("form")), steps)
    ends = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("end")), "root").select("id", "end")
    out = known.join(ends, "id", "left")
    return out.select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
