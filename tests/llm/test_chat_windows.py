"""Chat windows: exact round trips, budgets and masks, against a brute-force packing."""

import random
import re

import pytest

from sitescribe.llm.chat_windows import END, MARK, MARK_TOKENS, SEGMENT, chat_windows, read_back

SCHEMA = "conv_id long, turn long, role string, text string, start string, room long, said string, pieces long"
ODD = [r"\### Assistant: </turn> ok", "</turn>\n### user\nno", "\\", "\\\\n", "####", "#\\#", "<\\/turn>", "", "a\r\n b", "###\\", "\\#\\/", "é\U0001f600 x", "\n", "</turn></turn>\n", "\x00", " \t"]


def said(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in out.items()}


def tokens(text):
    return len(re.findall(r"[^\W\d_]{1,6}|\d|[^\s\w]|_", text, re.ASCII)) + MARK_TOKENS


def packed(turns, budget, history):
    """Windows as (turns that are new, turns that are repeated), turn by turn."""
    head = turns[:1] if turns and turns[0][0] == "system" else []
    room = max(1, budget - history - sum(tokens(t) for _, t in head))
    at, placed = 0, []
    for role, text in turns[len(head) :]:
        placed.append((at, at + tokens(text), role, text))
        at += tokens(text)
    windows = []
    for x in placed:
        segment = x[0] // (room * SEGMENT)
        if not windows or windows[-1][0] != segment or x[1] - windows[-1][1][0][0] > room:
            windows.append((segment, []))
        windows[-1][1].append(x)
    out = []
    for _, mine in windows or [(0, [])]:
        begin = mine[0][0] if mine else 0
        again = [x for x in placed if x[1] <= begin and x[0] >= begin - history]
        first = not out
        out.append((begin, (head if first else []) + [x[2:] for x in mine], ([] if first else head) + [x[2:] for x in again]))
    return out


def windows(spark, rows, **limits):
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    return read_back(chat_windows(frame, **limits)).orderBy("conv_id", "start").collect()


def check(found, rows, budget, history):
    want = said(rows)
    by = {}
    for w in found:
        by.setdefault(w.conv_id, []).append(w)
    assert set(by) == set(want)
    for conv, turns in want.items():
        expected = packed(turns, budget, history)
        assert [(w.start, [(t.role, t.text) for t in w.turns]) for w in by[conv]] == [(s, new) for s, new, _ in expected]
        assert [w.n_repeated for w in by[conv]] == [len(again) for _, _, again in expected]
        assert [t for w in by[conv] for t in w.turns] == [tuple(t) for t in turns]
        assert "".join(w.learned for w in by[conv]) == "".join(t for r, t in turns if r == "assistant")
        for w, (_, new, again) in zip(by[conv], expected, strict=True):
            assert w.text.count(END) == len(new) + len(again) and all(p.startswith(MARK) for p in w.text.split(END)[:-1])
            size = sum(tokens(t) for _, t in new + again)
            headed = w.start == 0 and turns[0][0] == "system"
            assert size <= budget or len(new) - headed <= 1
            assert len(w.loss) == sum(r == "assistant" for r, _ in new)


def test_round_trip_of_control_strings(spark):
    rows = [(i, n, role, text) for i, role in enumerate(["user", "assistant", "a: b", "x\ny\\n", "###", None]) for n, text in enumerate([*ODD, None])]
    check(windows(spark, rows, budget=60, history=16), rows, 60, 16)


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    for conv in range(40):
        n = rng.choice([1, 2, 3, 9, 30, 120])
        for turn in range(n):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "system", "tool"])
            rows.append((conv, turn, role, " ".join("word" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 20, 90])))))
    rng.shuffle(rows)
    check(windows(spark, rows, budget=120, history=30), rows, 120, 30)


def test_one_conversation_holds_a_third_of_all_rows(spark):
    """It has many segments, and ranges of rows end within it."""
    rows = [(1, t, "system" if t == 0 else "assistant" if t % 2 else "user", f"turn {t} " + "so " * (t % 7)) for t in range(4000)] + [(2 + t, 0, "user", "hi") for t in range(2000)]
    found = windows(spark, rows, budget=64, history=20)
    check(found, rows, 64, 20)
    assert len({w.start // 2000 for w in found if w.conv_id == 1}) > 5


def test_odd_rows(spark):
    long = "very long " * 200_000
    rows = [(None, 0, "user", "a"), (None, None, "user", "first"), (5, 0, "system", "only"), (6, 0, "assistant", long), (6, 1, "assistant", "after"), (7, 1, "user", "same"), (7, 1, "user", "same"), (8, 0, "system", "big " * 100), (8, 1, "assistant", "x"), (8, 2, "assistant", "y")]
    found = windows(spark, rows, budget=50, history=10)
    check(found, rows, 50, 10)
    assert [w.n_new for w in found if w.conv_id == 8] == [2, 1]  # no room beside the system turn
    assert windows(spark, [], budget=50, history=10) == []
    tied = windows(spark, [(1, 3, r, t) for r, t in [("user", "b"), ("assistant", "a"), ("user", "b"), (None, None)]])
    assert sorted((t.role, t.text) for w in tied for t in w.turns) == [("", ""), ("assistant", "a"), ("user", "b"), ("user", "b")]


def test_no_python_in_the_plan(spark, capsys):
    frame = spark.createDataFrame([(1, 0, "user", "a", "x", 1, "y", 2)], SCHEMA)
    read_back(chat_windows(frame)).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
