"""Hard negatives against a sort of all scores of each anchor."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sitescribe.llm import hard_negatives as H

SCHEMA = "vec_id long, label long, embedding array<double>, anchors string, rows string, anchor_id long, rank int"


def brute(rows, positives=5, negatives=5, lower=Fraction(4, 5)):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = (str(label), [max(-(2**63), min(2**63 - 1, math.floor(256 * x) if abs(x) < 1e300 else int(x))) for x in v])
        kept[i] = min(kept.get(i, q), q)
    out = []
    for a, (label, v) in kept.items():
        if a % 10:
            continue
        scores = sorted((-max(-H.MOST, min(H.MOST, sum(x * y for x, y in zip(v, w, strict=False)))), i, other == label) for i, (other, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scores if x[2]][:positives]:
            found = [(n, t) for t, n, same in scores if not same and lower * -s <= -t <= -s][:negatives]
            out += [(a, p, r, n, -s, -t) for r, (n, t) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", "y", 1, 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.hard_negatives(frame, F.col("vec_id") % 10 == 0, **more).collect())


def vectors(seed, n, dims, step=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, rng.randrange(3), [round((c + rng.gauss(0, 0.4)) / step) * step / 4 for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "dims", "step"), [(1, 120, 8, 0.01), (2, 200, 2, 1.0), (3, 90, 16, 0.001)])
def test_brute_force(spark, seed, n, dims, step):
    """A step of 1 in two dimensions makes many ties and repeated vectors."""
    rows = vectors(seed, n, dims, step)
    assert len(want := brute(rows)) > 50 and mined(spark, rows) == want


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 600)
    rows = vectors(4, 300, 4, 0.05)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=9, lower=Fraction(1, 2)) == brute(rows, 2, 9, Fraction(1, 2))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 1, [0.9]), (3, 2, [0.9, 0.9, 0.9]), (4, 2, []), (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [None, 1.0]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (None, 2, [1.0, 1.0]),
        (3, 2, [0.9, 0.9, 0.9]), (11, 2, [1.0, 1.0]), (11, 3, [0.95, 0.95]), (10, 4, [-1.0, -1.0]), (12, 4, [1.0, 1.0]), (20, 5, [0.0, 0.0]), (21, 5, [0.0, 0.0]), (22, 6, [0.0]), (30, 2, [1.0, 1.0]),
    ]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, []) == [] and mined(spark, rows[4:6]) == []


def test_components_beyond_doubles_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, [rng.uniform(1e15, 1.1e15), rng.uniform(0, 1)]) for i in range(40)]
    assert mined(spark, rows) == brute(rows) != []
    assert all(r[4] == H.MOST for r in mined(spark, rows))
    rows = [(i, i % 2, [rng.uniform(3e5, 4e5) + rng.random(), rng.uniform(0, 1)]) for i in range(40)]
    assert mined(spark, rows) == brute(rows) != []
