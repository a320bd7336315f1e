"""Streams of state processors against their batch twins, with late, early and repeated events in several batches."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from sitescribe.operators import activity, jobs
from sitescribe.streaming import processors, twins

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, event_id long, kind string"


def batches(seed, kinds, lateness=600):
    """Events in five batches of which none is later than the watermark, some twice; a last one moves the watermark on."""
    rng = random.Random(seed)
    events = [(f"k{rng.randrange(6)}", BASE + dt.timedelta(seconds=rng.randrange(20_000), microseconds=rng.randrange(1_000_000)), i, rng.choice(kinds)) for i in range(400)]
    events.sort(key=lambda e: e[1])
    out, size = [], 80
    for n in range(5):
        part = events[n * size : (n + 1) * size]
        early = [e for e in events[(n + 1) * size : (n + 2) * size] if (e[1] - part[-1][1]).total_seconds() < lateness / 2 and rng.random() < 0.3]
        again = [rng.choice(part) for _ in range(5)]
        out.append(part + early + again)
        rng.shuffle(out[-1])
    return events, [*out, [("end", BASE + dt.timedelta(days=9), 10_000, kinds[0])]]


def streamed(spark, tmp_path, parts, processor, lateness="600 seconds"):
    folder = tmp_path / uuid.uuid4().hex
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        twins.run_once(processors.processed(stream, processor, lateness), f"{folder}/out", "append", f"{folder}/checkpoint")
    return spark.read.schema(processors.ROW).parquet(f"{folder}/out").where("key <> 'end'")


@pytest.mark.parametrize("seed", [1])
def test_gates(spark, tmp_path, seed):
    events, parts = batches(seed, ["hit", "taken", "taken", "other"])
    got = streamed(spark, tmp_path, parts, processors.Gates())
    want = activity.gate_claims(spark.createDataFrame(events, SCHEMA))
    assert sorted(tuple(r) for r in got.select("key", "event", "at").collect()) == sorted(tuple(r) for r in want.collect()) != []


def test_stages(spark, tmp_path):
    events, parts = batches(3, ["1", "2", "3"])
    late = [(k, t - dt.timedelta(days=30), 9000 + i, "3") for i, (k, t, _, _) in enumerate(parts[1][:20])]  # later than the watermark: let go
    parts.insert(3, late)
    got = streamed(spark, tmp_path, parts, processors.Transitions())
    want = activity.stage_rises(spark.createDataFrame(events, SCHEMA))
    assert sorted(tuple(r) for r in got.select("key", "at", "n").collect()) == sorted(tuple(r) for r in want.collect()) != []


@pytest.mark.parametrize(("ttl", "absolute"), [(400, 10_000), (900, 3_000)])
def test_sessions_end_and_do_not_revive(spark, tmp_path, ttl, absolute):
    events, parts = batches(ttl, ["use"])
    got = streamed(spark, tmp_path, parts, processors.Sessions(ttl, absolute))
    want = jobs.sessions(spark.createDataFrame(events, SCHEMA).select(F.col("key").alias("session"), F.col("ts").alias("at")), ttl, absolute)
    assert sorted(tuple(r) for r in got.select("key", "at", "n").collect()) == sorted(tuple(r) for r in want.collect())
    assert len(want.collect()) == 6


def test_sessions(spark):
    at = lambda *minutes: [("s", BASE + dt.timedelta(minutes=m)) for m in minutes]
    run = lambda rows, **k: [(r.ends - BASE, r.uses) for r in jobs.sessions(spark.createDataFrame(rows, "session string, at timestamp"), **k).collect()]
    minutes = lambda m: dt.timedelta(minutes=m)
    assert run(at(0, 10, 45, 50), ttl=1800, absolute=86400) == [(minutes(40), 2)]  # the use after the end is none
    assert run(at(0, 20, 40, 59, 61), ttl=1800, absolute=3600) == [(minutes(60), 4)]
    assert run(at(0, 30), ttl=1800, absolute=86400) == [(minutes(30), 1)] and run(at(5, 5), ttl=60, absolute=60) == [(minutes(6), 2)]
    live = jobs.live_sessions(spark.createDataFrame(at(0, 10, 45), "session string, at timestamp"), F.lit(BASE + minutes(39)), 1800, 86400)
    assert live.count() == 1 and jobs.sessions(spark.createDataFrame([], "session string, at timestamp"), 1, 1).count() == 0
