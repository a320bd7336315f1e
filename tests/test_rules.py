"""Predicates, nested values, fixes and job states."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitescribe.functions import nested as N
from sitescribe.functions import predicates as P
from sitescribe.operators import jobs, recommend

NOW = dt.datetime(2024, 1, 1, 12)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_blocked_start_page(spark):
    reason = lambda status, title, words: one(spark, P.start_page_blocked(F.lit(status), F.lit(title), F.lit(words), ["just a moment"]))
    assert reason(403, "Home", 900) == "http 403" and reason(200, "Just a Moment...", 10) == "challenge page"
    assert reason(200, "Just a moment", 80) is None and reason(200, "Home", 3) is None


def test_internal_hosts(spark):
    hosts = ["localhost", "a.internal", "127.0.0.1", "10.2.3.4", "172.20.0.1", "192.168.1.1", "169.254.1.1", "[::1]", "8.8.8.8", "172.32.0.1", "acme.com"]
    got = [r.v for r in spark.createDataFrame(list(enumerate(hosts)), "i int, h string").select("i", P.internal_host(F.col("h")).alias("v")).orderBy("i").collect()]
    assert got == [True] * 8 + [False] * 3


def test_roles_and_times(spark):
    role = lambda owner, viewer, vis: one(spark, P.viewer_role(F.lit(owner), F.lit(viewer), F.lit(vis)))
    assert [role("a", "a", "private"), role(None, "a", "public"), role("a", None, "public"), role("a", "b", "public"), role("a", "b", "private")] == ["owner", "ownerless_public", "anonymous_public", "public_non_owner", None]
    at = F.lit(NOW)
    assert one(spark, P.claimable(F.lit(None).cast("string"), F.lit(NOW - dt.timedelta(hours=25)), at)) and not one(spark, P.claimable(F.lit("u"), F.lit(NOW - dt.timedelta(hours=25)), at))
    assert one(spark, P.cooled_down(F.lit(NOW - dt.timedelta(minutes=60)), at)) and not one(spark, P.cooled_down(F.lit(NOW - dt.timedelta(minutes=59)), at))
    assert one(spark, P.comparable(F.lit("1.4"), F.lit(None).cast("string"))) and not one(spark, P.comparable(F.lit("1.4"), F.lit("1.3")))
    assert one(spark, P.worth_writing_to(F.lit("sales@a.io"))) and not one(spark, P.worth_writing_to(F.lit("NoReply@a.io")))


def test_nested(spark):
    number = lambda text: one(spark, N.number_at(N.parsed(F.lit(text)), "$.a.b"))
    assert [number(t) for t in ('{"a":{"b":2.5}}', '{"a":{"b":"2"}}', '{"a":{"b":true}}', "null", "{bad", "[1]")] == [2.5, None, None, None, None, None]
    texts = lambda text: one(spark, N.texts(F.parse_json(F.lit(text))))
    assert [texts(t) for t in ('"a"', '["a","b"]', "3")] == [["a"], ["a", "b"], []]
    assert one(spark, F.size(N.objects(F.parse_json(F.lit('[{"a":1}, 2, "x", {}]'))))) == 2
    assert one(spark, N.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))) == {"a": 1, "b": 3}
    assert one(spark, N.length_of(F.lit(None).cast("array<int>"))) == 0 and one(spark, N.clamped(F.lit(9), 1, 5)) == 5
    assert one(spark, N.true_count([F.lit(""), F.lit(None).cast("string"), F.lit("x")])) == 1
    assert one(spark, N.has_key(F.array(F.lit("Author")), "author")) and one(spark, N.any_in(F.lit("/Contact-us"), ["contact"]))


QUESTIONS = "run int, question string, verdict string, sources array<string>"


def test_answerability(spark):
    rows = [(1, "a", "supported", ["/"]), (1, "b", "supported", []), (1, "c", "partially_supported", ["/"]), (1, "d", "unsupported", ["/"]), (1, "e", "not_applicable", [])]
    frame = spark.createDataFrame(rows, QUESTIONS)
    got = recommend.answerability(frame).first()
    assert (got.score, got.applicable, got.support) == (37.5, 4, 0.5)
    assert [(r.fix, r.target) for r in recommend.unanswered(frame).collect()] == [("answer: d", 87.5)]


def test_recommended(spark):
    factors = spark.createDataFrame([(1, "schema", 40.0, 0.5), (1, "eeat", 60.0, 0.5)], "run int, factor string, score double, weight double")
    fixes = spark.createDataFrame([(1, "x", "schema", 80.0), (1, "y", "eeat", 61.0), (1, "z", "eeat", 10.0)], "run int, fix string, factor string, target double")
    got = recommend.recommended(factors, fixes).orderBy("place").collect()
    assert [(r.fix, r.priority) for r in got] == [("x", "high"), ("y", "low")] and got[0].points > 3


def test_grounded(spark):
    pages = spark.createDataFrame([("https://a/x", "a", "/x"), ("http://a/x", "a", "/x"), ("http://b/x", "b", "/x")], "url string, host string, path string")
    cited = spark.createDataFrame([(1, 2, "a", "/x"), (1, 0, "", "/x"), (1, 5, "a", "/gone"), (1, 7, "b", "/x")], "question int, place int, host string, path string")
    assert {(r.url, r.place) for r in recommend.grounded(cited, pages).collect()} == {("http://a/x", 0), ("http://b/x", 7)}


def test_contactability(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, recommend.contactability(t, f, t, t, t, t, t, t, t, f)) == 100
    assert one(spark, recommend.contactability(f, t, t, t, t, t, t, t, t, f)) == 20
    assert one(spark, recommend.contactability(f, f, f, f, f, f, f, f, f, t)) == 0


JOBS = "job_id int, state string, created_at timestamp, started_at timestamp"


def test_job_states(spark):
    ago = lambda n: NOW - dt.timedelta(minutes=n)
    table = spark.createDataFrame([(1, "running", ago(90), ago(31)), (2, "running", ago(90), ago(5)), (3, None, ago(40), None), (4, None, ago(4), None), (5, "pending", ago(10), None), (6, "pending", ago(20), None)], JOBS)
    now = F.lit(NOW)
    state = lambda d: {r.job_id: r.state for r in d.collect()}
    again = jobs.adopted(jobs.reclaimed(table, now), now)
    assert state(again) == {1: "pending", 2: "running", 3: "pending", 4: None, 5: "pending", 6: "pending"}
    assert state(jobs.claimed(again, now, 3)) == {1: "running", 2: "running", 3: "running", 4: None, 5: "pending", 6: "pending"}
    assert state(jobs.claimed(again, now, 1)) == state(again)
    assert one(spark, jobs.progress(F.lit(7), F.lit(0))) == 100
    assert one(spark, jobs.nudge([("a", F.lit(False)), ("b", F.lit(True)), ("c", F.lit(True))])) == "b"


def test_budget(spark):
    rows = [(1, 0, "a" * 400), (1, 1, "b" * 300 + "\n\n" + "c" * 300), (1, 2, "d"), (2, 0, None), (2, 1, "x" * 4000)]
    got = {r.site: r.admitted for r in jobs.budgeted(spark.createDataFrame(rows, "site int, place int, text string"), 200, 50).collect()}
    assert got == {1: ["a" * 400, "b" * 300], 2: ["", "x" * 800]}
