"""N-gram Jaccard join, components and embedding near-dedup against brute force."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from sitescribe.llm import embedding_dedup as E
from sitescribe.llm import ngram_jaccard as J
from sitescribe.llm.common import WordHashes, shingle_set
from sitescribe.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, component long, keys string"


def rows(texts, first=0):
    return [(first + i, t, "en", "src0", len(t or ""), 7, 7, "x") for i, t in enumerate(texts)]


def smallest(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def corpus(seed, n=90):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.6:
            words = rng.choice(out).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 5, 9])):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.3:
                words += [word() for _ in range(rng.randint(1, 6))]
            out.append(" ".join(words))
        else:
            out.append(" ".join(word() for _ in range(rng.choice([1, 2, 4, 9, 12, 20, 60, 200, 700]))))
    return out


@pytest.mark.parametrize(("width", "similarity"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_postings_meet(width, similarity):
    p, q = similarity.numerator, similarity.denominator
    memo, rng = WordHashes(), random.Random(5)
    for trial in range(300):
        base = [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(rng.choice([8, 12, 25, 60, 150, 400]))]
        other = list(base)
        for _ in range(rng.randrange(1, 2 + len(base) // 12)):
            other[rng.randrange(len(other))] = f"z{rng.randrange(99)}"
        other += ["new"] * rng.randrange(3)
        a, b = (shingle_set(" ".join(x), width, memo) for x in (base, other))
        common = len(np.intersect1d(a, b))
        if q * common >= p * (len(a) + len(b) - common) and len(a) + len(b) != 2 * common:
            assert set(J.postings(a, p, q).tolist()) & set(J.postings(b, p, q).tolist()), trial


@pytest.mark.parametrize(("width", "similarity"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_components_equal_brute_force(spark, width, similarity, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_BYTES", 20_000)  # several blocks in a family
    texts = corpus(1) + corpus(2)
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= similarity]
    found = J.ngram_jaccard_components(spark.createDataFrame(rows(texts), DOCS), width, similarity).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, smallest(len(sets), links), strict=True))}
    assert len(set(smallest(len(sets), links))) < len(texts)


def test_jaccard_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", " \t\n", "One two", "one  TWO", "one", long, long + " end", long]
    made = [*rows(texts), (3, "One two", None, None, None, None, None, None), (None, "one", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    found = J.ngram_jaccard_components(spark.createDataFrame(made, DOCS), 3, Fraction(9, 10)).collect()
    assert len(found) == len(made)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in found}
    assert by[0, 0] == 0 and by[1, 0] == 1 and by[2, 0] == 2
    assert by[3, 1] == 3 and by[4, 1] == 3 and by[5, 1] == 5 and by[None, 1] == 5 and by[None, 0] is None
    assert by[6, 29998] == by[7, 29999] == by[8, 29998] == 6
    assert J.ngram_jaccard_components(spark.createDataFrame([], DOCS)).collect() == []


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300), (None, 5), (400, 7)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = smallest(401, [e for e in edges if None not in e])
    assert found == {n: want[n] for n in {x for a, b in edges if a is not None and a != b for x in (a, b)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute(vectors, threshold):
    links = []
    for i, (_, a, x) in enumerate(vectors):
        for j, (_, b, y) in enumerate(vectors[:i]):
            if x is not None and x == y and a and b and len(a) == len(b):
                u, v = np.array(a, float), np.array(b, float)
                if np.isfinite(u).all() and np.isfinite(v).all() and u @ u > 0 and v @ v > 0 and u @ v / math.sqrt((u @ u) * (v @ v)) >= threshold:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    vectors = [(i, [float(x) for x in np.float32(base[i % 12] + 0.09 * rng.standard_normal(16))], int(i % 3)) for i in range(150)]
    vectors += [(200 + i, vectors[0][1], 0) for i in range(5)]
    vectors += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [1.0, None], 1), (304, vectors[1][1], None), (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [float("inf")] * 16, 1)]
    usable = [(v, [x for x in e] if e and None not in e else None, label) for v, e, label in vectors]
    links = brute(usable, 0.93)
    root = smallest(len(vectors), links)
    n = [0] * len(vectors)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    frame = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<float>, label int, node int, links string")
    found = {r.vec_id: r for r in E.embedding_duplicates(frame).collect()}
    got = sum(r.n_links for r in found.values())
    assert got <= sum(n) and got >= 0.9 * sum(n)
    exact = [v for i, v in enumerate(vectors) if found[v[0]].n_links == n[i]]
    assert len(exact) >= 0.9 * len(vectors)
    for v in range(300, 306):
        assert found[v].n_links == 0 and found[v].kept and found[v].component_id == v
    assert found[306].n_links == 1 and found[307].component_id == 306 and not found[307].kept
    assert sum(found[v[0]].component_id == vectors[root[i]][0] for i, v in enumerate(vectors)) >= 0.9 * len(vectors)
    assert E.embedding_duplicates(frame.limit(0)).collect() == []


def test_recall_on_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    made = [(r.vec_id, list(r.embedding), r.label) for r in frame.collect()]
    x = np.array([v[1] for v in made], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([v[2] for v in made])
    want = int(((x @ x.T >= 0.93) & (labels[:, None] == labels[None, :])).sum() - len(made))
    got = sum(r.n_links for r in E.embedding_duplicates(frame).collect())
    assert 0.9 * want <= got <= want


def test_thousands_of_pairs_near_the_threshold(spark):
    """Pairs at cosines of 0.93 to 0.96 among vectors of a few labels, found to 0.99 and more by the whole operator."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one = unit(rng.standard_normal((2000, 32)))
    away = rng.standard_normal((2000, 32))
    away = unit(away - (away * one).sum(axis=1, keepdims=True) * one)
    c = rng.uniform(0.931, 0.96, (2000, 1))
    both = np.vstack([one, c * one + np.sqrt(1 - c * c) * away])
    labels = np.tile(rng.integers(0, 4, 2000), 2)
    rows = [(int(i), both[i].tolist(), int(labels[i])) for i in range(len(both))]
    got = {r.vec_id: r for r in E.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    near = (both @ both.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    want, links = near.sum(axis=1), np.array([got[i].n_links for i in range(len(both))])
    assert near.sum() >= 4000 and (links <= want).all() and links.sum() >= 0.99 * want.sum()
    root = smallest(len(both), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    assert sum(got[i].component_id == root[i] for i in range(len(both))) >= 0.99 * len(both)


def test_several_vectors_of_one_id_and_rows_without_an_id(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(5, a, 1), (5, b, 1), (7, a, 1), (9, b, 1), (9, b, 1), (None, a, 1), (None, None, 1), (3, a, 2)]
    got = E.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in got.collect() if r.vec_id) == [(3, 0, 3), (5, 1, 5), (7, 1, 5), (9, 1, 5)]
    assert sorted((r.n_links, r.component_id, r.kept) for r in got.collect() if r.vec_id is None) == [(0, None, True), (0, None, True)]
