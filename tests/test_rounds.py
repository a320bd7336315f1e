"""Addresses against the standard library, admission against a fold, quantiles against sorting."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from sitescribe.functions import addresses as A
from sitescribe.functions import predicates as P
from sitescribe.operators import activity, quantiles


def test_addresses(spark):
    rng = random.Random(3)
    hosts = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(60)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(30)]
    for n in A.SPECIAL + A.PUBLIC:
        net = ipaddress.ip_network(n)
        for x in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= x < 2 ** net.max_prefixlen:
                hosts.append(str(ipaddress.IPv4Address(x) if net.version == 4 else ipaddress.IPv6Address(x)))
    hosts += [f"::ffff:{h}" for h in ("10.0.0.1", "8.8.8.8", "192.0.0.9")] + ["1::", "::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "fe80::1"]
    want = {h: not (x.ipv4_mapped or x if x.version == 6 else x).is_global for h in hosts for x in [ipaddress.ip_address(h)]} | {h: True for h in hosts if ipaddress.ip_address(h) in ipaddress.ip_network("3fff::/20")}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", P.internal_host(F.col("h")).alias("v"))
    assert {r.h: r.v for r in got.collect()} == want


@pytest.mark.parametrize(("host", "internal"), [
    ("2130706433", True), ("0x7f000001", True), ("0177.0.0.1", True), ("127.1", True), ("134744072", False), ("[::ffff:7f00:1]", True), ("fe80::1%eth0", True), ("256.1.1.1", False), ("1.2.3.4.5", False), ("4294967296", False), ("1:2", False),
    ("1::2::3", False), ("a.internal.", True), ("", True), (None, True), ("acme.com", False), ("08.1.1.1", False), ("198.18.0.1", True), ("192.0.0.8", True), ("::ffff:10.0.0.999", False),
])
def test_notations(spark, host, internal):
    """What is no address is a name."""
    assert spark.createDataFrame([(host,)], "h string").select(P.internal_host(F.col("h"))).first()[0] is internal


@pytest.mark.parametrize("seed", range(4))
def test_admission_against_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(u, t, 1000 * u + t, rng.random() < 0.9, rng.random() < 0.1, rng.choice(["site", "page", None]), rng.randrange(12)) for u in range(12) for t in range(rng.randint(0, 25))]
    usage = [(u, rng.randint(0, 3), rng.randint(0, 6)) for u in range(10)]
    used, want = {u: (r, s) for u, r, s in usage}, {}
    for u in range(12):
        jobs, days = (max(0, limit - x) for limit, x in zip((8, 5), used.get(u, (0, 0)), strict=True))
        queued = set()
        for _, _, e, valid, refreshing, scope, series in [r for r in rows if r[0] == u]:
            site = scope == "site"
            if not valid:
                want[e] = "invalid"
            elif len(queued) >= jobs or site and len(queued) >= days:
                want[e] = "quota"
            elif refreshing or (series, site) in queued:
                want[e] = "cooldown"
            else:
                want[e] = "queued"
                queued.add((series, site))
    frame = spark.createDataFrame(rows, "user_id int, ts int, event_id int, valid boolean, refreshing boolean, scope string, series int")
    got = activity.admitted(frame, spark.createDataFrame(usage, "user_id int, running int, sites int"), 8, 5)
    assert {r.event_id: r.status for r in got.collect()} == want and len(set(want.values())) == 4


def test_quantiles(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 20)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [7.0] * 300, "c": [rng.choice([1.0, 2.0, 3.0]) for _ in range(400)], "d": [1e308, -1e308, 0.0] * 30 + [rng.random() for _ in range(60)], None: [5.0, None, float("nan")], "e": [rng.random() ** 40 for _ in range(600)]}
    rows = [(k, v) for k, values in groups.items() for v in values]
    rng.shuffle(rows)
    for q in (0.95, 0.5, 0.0, 1.0):
        got = quantiles.quantile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", q).collect()
        want = {}
        for k, values in groups.items():
            values = sorted(v for v in values if v is not None and v == v)
            want[k] = (len(values), values[max(0, -int(-len(values) * q // 1) - 1)])
        assert {r.k: (r.n, r.quantile) for r in got} == want
    assert quantiles.quantile(spark.createDataFrame([], "k string, v double"), ["k"], "v", 0.5).count() == 0
