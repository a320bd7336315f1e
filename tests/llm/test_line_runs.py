"""Repeated runs of lines go whole."""

import random

import pytest

from sitescribe.llm import line_dedup as L

COLUMNS = "doc_id long, text string, n_chars long, _removed int"


def brute(docs):
    """Lines that go, by document: passages and those of two neighbouring lines that occurred before."""
    first, out = {}, {}
    for doc_id, text in docs:
        lines, gone = (text or "").split("\n"), set()
        alone = [len(x.split()) > 50 for x in lines]
        for at, line in enumerate(lines):
            if alone[at] and first.setdefault(line, (doc_id, at)) != (doc_id, at):
                gone.add(at)
        for at in range(len(lines) - 1):
            pair = tuple(lines[at : at + 2])
            if all(alone[at : at + 2]):
                continue
            if any(x.strip() for x in pair) and (place := first.setdefault(pair, (doc_id, at))) != (doc_id, at):
                gone |= {at + 1} if place == (doc_id, at - 1) else {at, at + 1}
        out[doc_id] = sorted(gone)
    return out


@pytest.mark.parametrize("bits", [128, 3])
def test_runs_equal_brute_force_and_go_whole(spark, bits):
    rng = random.Random(12)
    passages = [[f"passage {p} line {i}" for i in range(rng.randint(2, 12))] for p in range(6)]
    docs = [None, "", "one line", "\n\n\n\n\n", "x\nx\nx\nx\nx", *("\n".join(p) for p in passages)]
    planted = {}
    for i in range(60):
        own = [f"own {i} {k}" for k in range(rng.randint(0, 9))]
        at, passage = rng.randrange(len(own) + 1), rng.choice(passages)
        planted[len(docs)] = own
        docs.append("\n".join(own[:at] + passage + own[at:]))
    docs.append(docs[-1])
    rows = [(i, t, len(t or ""), 1) for i, t in enumerate(docs)]
    out = {r.doc_id: r for r in L.runs_deduped(spark.createDataFrame(rows, COLUMNS).repartition(3), bits).collect()}
    want = brute(enumerate(docs))
    for i, r in out.items():
        assert r._removed == want[i]
        kept = [x for at, x in enumerate((docs[i] or "").split("\n")) if at not in want[i]]
        assert (r.text or "") == "\n".join(kept) and r.n_chars == len(r.text or "")
    assert all(out[i].text == docs[i] for i in (*range(4), *range(5, 11))) and out[4].text == "x\nx"  # first occurrences stay whole
    assert all((out[i].text.split("\n") if out[i].text else []) == own for i, own in planted.items())  # runs go to their edges
    assert out[len(docs) - 1].text == "" and len(out) == len(docs)


def test_long_lines_go_alone(spark):
    passage, short = " ".join(f"w{i}" for i in range(51)), " ".join(f"w{i}" for i in range(50))
    docs = [f"a\n{passage}\nb", f"c\n{passage}\nd", f"e\n{short}\nf", f"g\n{short}\nh", passage, f"{passage}\n{passage}"]
    rows = [(i, t, len(t), 1) for i, t in enumerate(docs)]
    out = {r.doc_id: r.text for r in L.runs_deduped(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()}
    assert [out[i] for i in range(6)] == [docs[0], "c\nd", docs[2], docs[3], "", ""]
    assert {i: r for i, r in enumerate(docs) if out[i] != r}.keys() == {i for i, gone in brute(enumerate(docs)).items() if gone}
