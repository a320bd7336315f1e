"""Stars of the n-gram join, bitmaps of marks, and repeated ids."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sitescribe.llm import common as C
from sitescribe.llm import ngram_jaccard as J

DOCS = "doc_id long, text string"


def test_a_chain_costs_what_its_links_cost(spark, monkeypatch):
    """Each text is near the next only: all of them are one component, but no set goes to more than its few stars."""
    monkeypatch.setattr(J, "BLOCK_BYTES", 4000)
    rng, sent = random.Random(4), []
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(36):
        texts.append(" ".join(words))
        words = [*words[8:], *(f"w{rng.randrange(10**6)}" for _ in range(8))]
    compared = J.compared
    monkeypatch.setattr(J, "compared", lambda texts, units, *rest: sent.append(units.count()) or compared(texts, units, *rest))
    found = J.ngram_jaccard_components(spark.createDataFrame(list(enumerate(texts)), DOCS), 5, Fraction(4, 5)).collect()
    assert {r.component_id for r in found} == {0}
    assert len(texts) < sum(sent) <= 7 * len(texts)  # 45, 124 and 209 units of 12, 24 and 36 texts


@pytest.mark.parametrize("block", [2000, 200_000])
def test_large_groups_and_outliers(spark, monkeypatch, block):
    """A group of near copies, larger than a block, and texts that only some of it are near to."""
    monkeypatch.setattr(J, "BLOCK_BYTES", block)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(80):
        words = list(base)
        words[rng.randrange(120)] = f"x{rng.randrange(999)}"
        texts.append(" ".join(words))
    for k in (4, 8, 12, 16, 20, 24):
        texts.append(" ".join([*base[k:], *(f"y{k}{i}" for i in range(k))]))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    found = J.ngram_jaccard_components(spark.createDataFrame(list(enumerate(texts)), DOCS), 5, Fraction(4, 5)).collect()
    assert [r.component_id for r in sorted(found, key=lambda r: r.doc_id)] == root
    assert sum(r.is_first for r in found) == len(set(root)) > 1


def test_two_texts_under_one_id(spark):
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, other), (2, other + " more"), (3, one + " more"), (3, one + " more")]
    found = J.ngram_jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1), (3, 1)}
    groups = {}
    for r in found:
        groups.setdefault(r.is_first, []).append(r.doc_id)
    assert sorted(groups[True]) == [1, 1] and sorted(groups[False]) == [2, 3, 3]  # each text of id 1 is the first of its own group


def test_bitmap_marks_every_partner(spark):
    marked = spark.range(0, 5000, 7).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("l"))
    rows = spark.range(20_000).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    found = C.maybe_in(rows, ["a", "b"], marked, ["k", "l"]).where("_maybe").select("a").collect()
    assert {r.a for r in found} >= set(range(0, 5000, 7)) and len(found) < 1200
    assert C.maybe_in(rows, ["a"], marked.limit(0), ["k"]).where("_maybe").count() == 0


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        sparkContext = Context

    with pytest.raises(RuntimeError):
        C.shared_dir(Session)
