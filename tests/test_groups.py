"""Keys that share a group's state: as their batch twin, with few calls of the state store."""

import datetime as dt
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_processors import SCHEMA, batches

from sitescribe.operators import activity, jobs
from sitescribe.streaming import processors, twins


class Store:
    """States of one group in memory, and the number of calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _state(self, start, **methods):
        held = {"x": start}

        def counted(f):
            def call(*args):
                self.calls += 1
                return f(held, *args)

            return call

        both = {"exists": lambda h: bool(h["x"]), "clear": lambda h: h.update(x=type(start)() if start is not None else None)}
        return SimpleNamespace(**{name: counted(f) for name, f in (both | methods).items()})

    def getValueState(self, name, schema):  # noqa: N802
        return self._state(None, get=lambda h: h["x"], update=lambda h, x: h.update(x=x))

    def getListState(self, name, schema):  # noqa: N802
        more = lambda h, xs: h.update(x=h["x"] + list(xs))
        return self._state([], get=lambda h: iter(h["x"]), put=lambda h, xs: h.update(x=list(xs)), appendList=more, appendValue=lambda h, x: more(h, [x]))

    def getMapState(self, name, key, schema):  # noqa: N802
        return self._state({}, getValue=lambda h, k: h["x"].get(k), updateValue=lambda h, k, x: h["x"].update({k: x}))

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_a_groups_keys_share_calls():
    """A hundred sessions of five uses: a few calls, and one for each session that has ended."""
    store, processor = Store(), processors.Sessions(100, 1000)
    processor.init(store)
    rows = [(f"u/{k}", (1000 * k + 50 * n) * 1_000_000, 10 * k + n, "use") for n in range(5) for k in range(100)]
    at = lambda mark: SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    list(processor.handleInputRows(("u",), iter([pd.DataFrame(rows, columns=["key", "us", "event_id", "kind"])]), at(0)))
    out = pd.concat(processor.handleExpiredTimer(("u",), at(100_000_000), None))
    assert sorted(zip(out["key"], out["at"].astype("datetime64[s]").astype("int64"), out["n"], strict=True)) == sorted((f"u/{k}", 1000 * k + 300, 5) for k in range(100))
    assert store.calls <= 100 + 20


@pytest.mark.parametrize("processor", [processors.Sessions(400, 10_000), processors.Gates()])
def test_groups_equal_their_batch_twin(spark, tmp_path, processor):
    is_gate = isinstance(processor, processors.Gates)
    events, parts = batches(5, ["hit", "taken", "other"] if is_gate else ["use"])
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in").withColumn("group", F.when(F.col("key") < "k3", "a").otherwise("b"))
        twins.run_once(processors.processed(stream, processor, "600 seconds"), f"{tmp_path}/out", "append", f"{tmp_path}/checkpoint")
    got = spark.read.schema(processors.ROW).parquet(f"{tmp_path}/out").where("key <> 'end'")
    made = spark.createDataFrame(events, SCHEMA)
    want = activity.gate_claims(made) if is_gate else jobs.sessions(made.select(F.col("key").alias("session"), F.col("ts").alias("at")), 400, 10_000)
    found = got.select("key", "event", "at") if is_gate else got.select("key", "at", "n")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []
