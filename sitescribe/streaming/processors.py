"""Event folds as state processors: events wait until the watermark has passed them, then they count in order, once.

So late and repeated events give what the batch twins in ``operators`` give, and what was said once is
never taken back.  Keys that come in groups, such as a user's sessions, share what a group holds: its waiting
events, one timer, and each key's fold of a few numbers.  A group that is called costs the same few calls of the state store
whatever its number of keys, and one or two more for each key whose fold changes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Rows of a group as JSON, as one value of the state costs about as much as one row.
PACKED = "rows string"
ROW = "key string, event string, at timestamp, n long"


def use_rocksdb(spark: SparkSession) -> None:
    """State processors need a store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Deals a key's events to ``step`` in order of time and id; ``step(fold, at, kind)`` gives the next fold and rows (event, at, n).

    Folds that wait for time stay in one value, which is read whenever the group's timer is due; the others are looked up
    by their key, when it has events.
    """

    FOLD, START = "a long, b long, c long", (0, 0, 0)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKED)
        self.open = handle.getValueState("open", PACKED)
        self.folds = handle.getMapState("folds", "key string", self.FOLD)
        self.due = handle.getValueState("due", "at long")

    def step(self, fold: tuple, at: int, kind: str) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def passed(self, fold: tuple, now: int) -> tuple[tuple, list[tuple]]:
        """What the passing of time does, once all events up to ``now`` have counted."""
        return fold, []

    def next_due(self, fold: tuple) -> int | None:
        return None

    def _wait(self, times: list[int]) -> None:
        """One timer, for the earliest of the times."""
        set_, first = self.due.get()[0] if self.due.exists() else None, min(times, default=None)
        if first is None or set_ is not None and set_ <= first:
            return
        if set_ is not None:
            self.handle.deleteTimer(set_ // 1000 + 1)
        self.handle.registerTimer(first // 1000 + 1)  # by then the watermark is beyond it
        self.due.update((first,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        columns = ("key", "us", "event_id", "kind")
        new = [(k, int(at), int(i), kind) for frame in rows for k, at, i, kind in zip(*(frame[c] for c in columns), strict=True) if at >= mark]
        if new:
            self.waiting.appendValue((json.dumps(new),))
            self._wait([at for _, at, _, _ in new])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(w) for packed in self.waiting.get() for w in json.loads(packed[0])] if self.waiting.exists() else []
        ready, rest = sorted({w for w in waiting if w[1] < mark}), [w for w in waiting if w[1] >= mark]
        opened = {k: tuple(fold) for k, fold in json.loads(self.open.get()[0])} if self.open.exists() else {}
        events, stored, out = {k: list(of) for k, of in groupby(ready, lambda w: w[0])}, self.folds.exists(), []
        still = {}
        for k in opened.keys() | events.keys():
            before = opened.get(k)
            if before is None and stored and (found := self.folds.getValue((k,))) is not None:
                before = tuple(found)
            fold, seen = before or self.START, set()
            for _, at, event_id, kind in events.get(k, ()):
                if event_id not in seen:
                    seen.add(event_id)
                    fold, rows = self.step(fold, at, kind)
                    out += [(k, *row) for row in rows]
            fold, rows = self.passed(fold, mark)
            out += [(k, *row) for row in rows]
            if self.next_due(fold) is not None:
                still[k] = fold
            elif fold != before or k in opened:
                self.folds.updateValue((k,), fold)
        self.open.update((json.dumps(list(still.items())),)) if still else self.open.clear()
        self.waiting.put([(json.dumps(rest),)]) if rest else self.waiting.clear()
        self.due.clear()
        self._wait([at for _, at, _, _ in rest] + [self.next_due(fold) for fold in still.values()])
        texts = lambda values: pd.Series(values, dtype=object)
        found = {"key": texts([x[0] for x in out]), "event": texts([x[1] for x in out]), "at": pd.to_datetime([x[2] for x in out], unit="us"), "n": pd.Series([x[3] for x in out], dtype="int64")}
        return iter((pd.DataFrame(found),) if out else ())

    def close(self) -> None:
        pass


class Gates(InOrder):
    """A key's first ``hit``, and its first ``taken`` after it, each once."""

    def step(self, fold: tuple, at: int, kind: str) -> tuple[tuple, list[tuple]]:
        hit, taken, _ = fold
        if kind == "hit" and not hit:
            return (1, taken, 0), [("hit", at, 1)]
        if kind == "taken" and hit and not taken:
            return (hit, 1, 0), [("taken", at, 1)]
        return fold, []


class Transitions(InOrder):
    """A row whenever a key reaches a higher stage than ever before; kinds are numbers of stages."""

    def step(self, fold: tuple, at: int, kind: str) -> tuple[tuple, list[tuple]]:
        stage = int(kind)
        return ((stage, 0, 0), [("stage", at, stage)]) if stage > fold[0] else (fold, [])


class Sessions(InOrder):
    """The end of each session with the number of its uses: a use before the end moves it on, within a limit; one after it is none."""

    START = (-1, 0, 0)

    def __init__(self, ttl: int, absolute: int) -> None:
        self.ttl, self.absolute = ttl * 1_000_000, absolute * 1_000_000

    def ends(self, fold: tuple) -> int:
        return min(fold[0] + self.absolute, fold[1] + self.ttl)

    def step(self, fold: tuple, at: int, kind: str) -> tuple[tuple, list[tuple]]:
        created, _, uses = fold
        if created < 0:
            return (at, at, 1), []
        return (((created, at, uses + 1), []) if uses > 0 and at < self.ends(fold) else self.passed(fold, at + 1))

    def passed(self, fold: tuple, now: int) -> tuple[tuple, list[tuple]]:
        """An ended session has no uses any more, so it ends once and does not revive."""
        if fold[2] > 0 and self.ends(fold) < now:
            return (fold[0], fold[1], -fold[2]), [("ended", self.ends(fold), fold[2])]
        return fold, []

    def next_due(self, fold: tuple) -> int | None:
        return self.ends(fold) if fold[2] > 0 else None


def processed(events: DataFrame, processor: StatefulProcessor, lateness: str) -> DataFrame:
    """(key, event, at, n) of a stream of ``events(key, ts, event_id, kind)``; events later than ``lateness`` are let go, as in any watermark.

    A column ``group`` names a group of keys, such as the user whose days the keys are, to share calls of the state store; without it
    each key is its own.  Events of one key must be of one group.
    """
    use_rocksdb(events.sparkSession)
    group = F.col("group" if "group" in events.columns else "key").cast("string").alias("group")
    rows = events.withWatermark("ts", lateness).select(group, F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), F.col("kind").cast("string").alias("kind"))
    return rows.groupBy("group").transformWithStateInPandas(processor, ROW, "append", "EventTime")
