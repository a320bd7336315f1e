"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton accepts every run of words of every normalised item.  A document's words are
streamed through it; the length of the longest run that ends at a word is tracked, and where it
reaches the window the words of that window are hit.  Items shorter than the window are windows
of their own length.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, materialise, maybe_in, small_batches, text_key, utf8

#: Words of test items in one automaton.  Larger benchmarks take several, one after another.
AUTOMATON_WORDS = 200_000
#: A-Z to a-z; bytes that belong to no word become spaces.
WORD_BYTES = bytes(LOWER[c] if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; null has none."""
    return utf8(text).translate(WORD_BYTES).split()


class SuffixAutomaton:
    """Of all items together; states keep which items hold their longest window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window, self.vocabulary = window, {}
        self.longest, self.link, self.next = [0], [-1], [{}]
        self.least = window
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item_words(text)]
            if words:
                self.least = min(self.least, len(words))
                state = 0
                for word in words:
                    state = self._extend(state, word)
        # Items by the state that holds a window; found by walking each item once more.
        self.items: dict[tuple[int, int], set[str]] = {}
        for item, text in items:
            words = [self.vocabulary[w] for w in item_words(text)]
            width, state = min(window, len(words)), 0
            for k, word in enumerate(words, 1):
                state = self.next[state][word]
                if k >= width:
                    self.items.setdefault((self.holding(state, width), width), set()).add(item)
        self.widths = sorted({width for _, width in self.items}, reverse=True)

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.longest[known] == self.longest[last] + 1 else self._split(last, word, known)
        new = self._state(self.longest[last] + 1, {})
        while last != -1 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last == -1:
            self.link[new] = 0
        else:
            known = self.next[last][word]
            self.link[new] = known if self.longest[known] == self.longest[last] + 1 else self._split(last, word, known)
        return new

    def _state(self, longest: int, following: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(0)
        self.next.append(following)
        return len(self.link) - 1

    def _split(self, last: int, word: int, known: int) -> int:
        new = self._state(self.longest[last] + 1, dict(self.next[known]))
        self.link[new], self.link[known] = self.link[known], new
        while last != -1 and self.next[last].get(word) == known:
            self.next[last][word] = new
            last = self.link[last]
        return new

    def holding(self, state: int, width: int) -> int:
        """The state on ``state``'s chain of suffixes that holds the one of ``width`` words."""
        while self.longest[self.link[state]] >= width:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit windows, as (first word, word beyond the last), and the items that they are from."""
        get, n = self.vocabulary.get, len(words)
        if n < self.least:
            return [], set()
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=n)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for first, beyond in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if beyond - first < self.least:
                continue
            state = matched = 0
            for at, word in enumerate(ids[first:beyond].tolist(), first + 1):
                while state and word not in self.next[state]:
                    state = self.link[state]
                    matched = self.longest[state]
                if word in self.next[state]:
                    state, matched = self.next[state][word], matched + 1
                if matched < self.least:
                    continue
                for width in self.widths:
                    if width <= matched and (found := self.items.get((self.holding(state, width), width))):
                        items |= found
                        spans.append((at - width, at))
        return spans, items


def _matcher(shared, window: int, cut: bool = False):
    """Finds the items' windows; with ``cut`` the text without them too, so that one worker does both."""
    built: list[SuffixAutomaton] = []

    def match(texts: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        if not built:
            built.append(SuffixAutomaton(shared.value, window))
        rows = []
        for text, before, known in zip(texts, spans, items, strict=True):
            words = item_words(text)
            found, of = built[0].hits(words)
            covered = np.zeros(len(words) + 2, dtype=np.int8)
            for first, beyond in [*found, *np.reshape(before, (-1, 2)).tolist()]:
                covered[first + 1 : beyond + 1] = 1
            edges = np.flatnonzero(np.diff(covered))
            rows.append((len(words), int(covered.sum()), edges.astype(np.int32), sorted({*known, *(x for x in of if x is not None)}), _cut(text, edges) if cut and len(edges) else None))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "items", "rest"])

    return match


MATCH = "n_words long, n_hit long, spans array<int>, items array<string>, rest string"


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, automaton_words: int = AUTOMATON_WORDS, cut: bool = False) -> DataFrame:
    """``docs`` and a column ``_match`` of ``n_words, n_hit, spans, items, rest``.

    ``spans`` lists first word and word beyond the last of each hit run, ``items`` the sorted
    ``item_id`` (as strings) of test items with an occurring window; ``rest`` is the text without hit
    words where ``cut`` asks for it and there are any, else null.  Null and empty texts have no
    words; items without words match nothing; an item with a null ``item_id`` hits words and is
    not listed.  Repeated items count once, repeated documents are judged alike.  Other columns are
    kept as they are, but for those named ``_match``, ``_key``, ``_spans`` or ``_items``.

    The items are broadcast, no more than about ``automaton_words`` words of them at once: their
    number is counted first, and a larger benchmark is dealt by hash over several automata that
    the documents pass one after the other; what each finds is written, and joined to the documents that
    have any.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-words // (5 * automaton_words)))
    spans, known = F.array().cast("array<int>"), F.array().cast("array<string>")
    docs = docs.drop("_match", "_key", "_spans", "_items")
    broadcast = docs.sparkSession.sparkContext.broadcast
    if parts == 1:
        shared = broadcast([tuple(r) for r in items.distinct().collect()])
        return docs.withColumn("_match", F.pandas_udf(_matcher(shared, window, cut), MATCH)("text", spans, known))
    texts, found = docs.select(F.col("doc_id").alias("_id"), text_key().alias("_of"), "text"), []
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        shared = broadcast([tuple(r) for r in mine.distinct().collect()])
        hit = texts.select("_id", "_of", F.pandas_udf(_matcher(shared, window), MATCH)("text", spans, known).alias("_m")).where("_m.n_hit > 0")
        found.append(materialise(hit.select("_id", "_of", "_m.spans", "_m.items"), "matches"))  # places and items only
    together = reduce(DataFrame.unionByName, found).distinct().groupBy("_id", "_of").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    together = materialise(together, "matches")  # a row for each part at most
    discard(*found)
    columns = docs.columns
    seen = maybe_in(docs.withColumn("_key", text_key()), ["doc_id", "_key"], together, ["_id", "_of"])
    here = seen.where("_maybe")
    here = here.join(together, here["doc_id"].eqNullSafe(F.col("_id")) & (here["_key"] == F.col("_of")), "left").select(*columns, "_spans", "_items")
    there = seen.where("not _maybe").select(*columns, spans.alias("_spans"), known.alias("_items"))
    match = F.pandas_udf(_matcher(broadcast([]), window, cut), MATCH)
    return there.unionByName(here).withColumn("_match", match("text", F.coalesce("_spans", spans), F.coalesce("_items", known))).select(*columns, "_match")


def _cut(text: str, edges: np.ndarray) -> str:
    raw = utf8(text)
    places = [m.span() for m in WORD.finditer(raw.translate(LOWER))]
    kept, at = [], 0
    for first, beyond in np.reshape(edges, (-1, 2)).tolist():
        kept.append(raw[at : places[first][0]])
        at = places[beyond - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_covered: float = 0.5) -> DataFrame:
    """``docs`` without the words of test items.

    Runs of at least ``window`` words (all of a shorter item) are cut out of the text and
    ``n_chars``, where there is one, is counted anew; documents of which more than ``most_covered``
    of the words are hit are dropped.  Clean documents stay as they are, also null and empty ones.
    """
    columns = docs.columns
    found = benchmark_matches(docs, benchmark, window, cut=True)
    found = found.where(F.col("_match.n_hit") <= F.lit(most_covered) * F.col("_match.n_words"))
    found = found.withColumn("text", F.coalesce("_match.rest", "text"))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(F.col("_match.n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*columns)
