"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from sitescribe.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n long, id long, key string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs, one_in=None, least=5, occurrences=3):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= occurrences}
    by = {w: sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x)) for w in words}
    form = {w: x[0] if x and words[x[0]] >= 2 * words[w] else None for w, x in by.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(by[w]), words.get(form[w])) for w, n in words.items())


def found(spark, docs, **more):
    frame = spark.createDataFrame([(*d, "x", 1, 2, "y") for d in docs], SCHEMA)
    return sorted(tuple(r) for r in S.spelling_variants(frame, **more).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aabcé") for _ in range(rng.randint(4, 7))) for _ in range(30)]

    def word():
        w = rng.choice(stems[: rng.choice([2, 5, 30])])
        if rng.random() < 0.3:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:]])
        return w.upper() if rng.random() < 0.1 else w

    return [(i if rng.random() < 0.95 else None, " ".join(word() for _ in range(rng.choice([1, 30, 200])))) for i in range(n)]


@pytest.mark.parametrize(("seed", "one_in"), [(1, None), (2, 5), (3, 97)])
def test_brute_force(spark, seed, one_in):
    docs = corpus(seed, 60)
    want = brute(docs, one_in)
    assert found(spark, docs, one_in=one_in) == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] not in (None, w[2]) for w in want)


def test_ties_take_the_smallest_word(spark):
    docs = [(1, "casta " * 3 + "caste " * 6 + "costa " * 6 + "xcasta " * 6)]
    assert dict((r[0], r[1]) for r in found(spark, docs))["casta"] == "caste"


def test_long_chain(spark):
    """Each word is near the next, which is twice as frequent."""
    words, n = ["a" * (6 + i) for i in range(9)], 3
    docs = [(i, (w + " ") * (n << i)) for i, w in enumerate(words)]
    assert {r[2] for r in found(spark, docs)} == {words[-1]} and found(spark, docs) == brute(docs)


@pytest.mark.parametrize("spelled", [4, 6, 128])
def test_fingerprints_are_as_good_as_spelling(spark, monkeypatch, spelled):
    monkeypatch.setattr(S, "SPELLED", spelled)
    docs = corpus(7, 40)
    assert found(spark, docs) == brute(docs)
    keys = list(S.keys_of("abcdefgh"))
    assert len(keys) == 9 and len({k for k, _ in keys}) == 9


def test_odd_rows(spark, monkeypatch):
    long = "q" * 3000
    docs = [(1, None), (2, ""), (3, "\x00 ×÷× 12"), (4, f"{long} {long} {long}x {long}x {long}x {long}"), (4, "words words"), (4, "words"), (None, "words sword")]
    assert found(spark, docs) == brute(docs)
    assert found(spark, []) == [] and found(spark, [(1, "one two")]) == []
    monkeypatch.setattr(S, "LONG_TEXT", 10)
    monkeypatch.setattr(S, "HELD", 2)
    docs = corpus(9, 20)
    assert found(spark, docs, one_in=11) == brute(docs, 11)
