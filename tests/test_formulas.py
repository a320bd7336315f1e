"""Formulas with the boundary values that they are defined by."""

import pytest
from pyspark.sql import functions as F

from sitescribe.functions import scoring as S
from sitescribe.functions import text as X
from sitescribe.functions import urls as U


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def values(spark, inputs, make):
    frame = spark.createDataFrame([(i, float(x) if isinstance(x, int) else x) for i, x in enumerate(inputs)], f"i int, x {'double' if all(x is None or isinstance(x, int | float) for x in inputs) else 'string'}")
    return [r.v for r in frame.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_weights_sum_to_one():
    assert all(sum(w.values()) == pytest.approx(1) for w in S.WEIGHTS.values())


def test_bands(spark):
    scores = [0.0, 25, 39, 40, 50, 59, 60, 62, 69, 70, 78, 85, 86, 92, 100, -5, 105, 39.5, None]
    want = ["broken"] * 3 + ["weak"] * 3 + ["developing"] * 3 + ["strong"] * 3 + ["excellent"] * 3 + ["broken", "excellent", "excellent", None]
    assert values(spark, scores, S.band) == want
    assert values(spark, [39.5, 59.5, 69.5, 85.5], lambda x: S.band(x, strict=False)) == ["broken", "weak", "developing", "strong"]


def test_ratings(spark):
    assert values(spark, [0.0, 25.4, 25.6, 65.5, 100, 130, None], lambda x: S.rating("AEO", x)) == [
        "Not extractable", "Not extractable", "Limited extractability", "Reliably extractable", "Fully extractable", "Fully extractable", None,
    ]


def test_entity_consistency(spark):
    got = [value(spark, S.entity_consistency(F.lit(n), F.lit(d))) for n in (True, False) for d in (True, False)]
    assert got == [100.0, 57.1, 42.9, 0.0]


def test_schema_bonus(spark):
    score = lambda good: value(spark, S.schema_score(F.lit(60.0), F.lit(False), F.lit(False), F.lit(4), F.lit(good)))
    assert (score(1), score(2)) == (60.0, 70.0)


def test_crawl_access(spark):
    score = lambda status, **k: value(spark, S.crawl_access(F.lit(True), {b: F.lit(status) for b in S.BOT_POINTS}, F.lit(False), F.lit(False), F.lit(False)))
    assert score("blocked") == 10.4
    assert score("allowed") == pytest.approx(round(47 * 100 / 77, 1)) and score("partially_restricted") == pytest.approx(round(27 * 100 / 77, 1))


def test_profiles(spark):
    def shape(*scores):
        return value(spark, S.profile([S.band(F.lit(float(s))) for s in scores], F.lit(sum(scores) / 3)))

    assert shape(10, 20, 30) == "high_invisibility" and shape(15, 22, 71) == "material_risk" and shape(20, 75, 75) == "critical_failure"
    assert shape(39, 90, 90) == "broken_in_strong_profile" and shape(50, 65, 80) == "broad_exposure" and shape(50, 80, 80) == "single_exposure"
    assert shape(65, 65, 80) == "partial_exposure" and shape(65, 80, 80) == "developing_with_strong" and shape(90, 90, 90) == "highly_readable" and shape(75, 90, 90) == "strong_profile"


def test_model_answers(spark):
    t, f = F.lit(True), F.lit(False)
    assert value(spark, S.homepage_comprehension(F.lit(4), F.lit("clear"), F.lit("dense"), F.lit(9), t)) == pytest.approx(96)
    assert value(spark, S.meta_optimization(F.lit("complete"), F.lit("clear"), F.lit("optimized"), t)) == 100
    assert value(spark, S.content_delta(F.lit(0), F.lit("contradictory"), F.lit("incomplete"))) == pytest.approx(9)
    sales = value(spark, S.email_validation(F.array(F.lit("sales")), F.lit("high"), t))
    generic = value(spark, S.email_validation(F.array(*[F.lit("general")] * 3), F.lit("low"), f))
    assert sales >= 85 and sales > generic
    assert value(spark, S.email_validation(F.array().cast("array<string>"), F.lit("none"), f)) == pytest.approx(1.75)


def test_emails(spark):
    good = ["hello@acme.com", "a.b@sub.acme.co.uk", "x1@acme.io", "first+tag@acme.org", "me_2@a-b.net"]
    bad = ["a@acme.com", "123456@acme.com", ".ab@acme.com", "ab.@acme.com", "a..b@acme.com", "ab@192.168.1.210.when", "ab@x.c", "ab@acme.123", "ab@foo.example.com", "nothing", "ab@acme.toolongtld"]
    assert values(spark, good, X.is_valid_email) == [True] * 5 and values(spark, bad, X.is_valid_email) == [False] * len(bad)


def test_texts(spark):
    assert values(spark, ["One. Two", "  Only one  ", "a\nb. c", "x" * 50, None, ""], lambda x: X.first_sentence(x, 10)) == ["One", "Only one", "a\nb", "x" * 9 + "…", "", ""]
    assert values(spark, ["a  b\n c", "", None, " x "], X.words) == [3, 0, 0, 1]
    assert values(spark, [1.25, -3.0, 0.0, None], X.delta_text) == ["+1.2", "-3.0", "0.0", "—"]
    assert values(spark, ["max_pages_reached", "max_pages", "", None], X.friendly_reason) == ["Max pages reached", "Max Pages", "N/A", "N/A"]
    assert values(spark, ["crawl blocked: 403", "cancelled_by_user", "boom", None], X.public_error_label)[2:] == ["Analysis failed", ""]
    assert values(spark, [5.0, 65.0], X.elapsed_text) == ["5s", "1m 5s"]
    assert values(spark, ["Ä b/C.d", None, ".Example.com.", "-.-"], X.safe_filename) == ["b-c.d", "site", "example.com", "site"]
    assert values(spark, ["éé", "abc", "aé"], lambda x: X.byte_capped(x, 2)) == ["é", "ab", "a"]
    assert values(spark, ["a|b\n c"], X.markdown_cell) == ["a\\|b c"]


def test_urls(spark):
    assert values(spark, [" WWW.Acme.com ", "www.www.a.b", None], U.normalize_domain) == ["acme.com", "www.a.b", ""]
    assert values(spark, ["HTTPS://U@Www.A.com:8/x", "nothing", None], U.domain_of) == ["u@www.a.com:8", "", ""]
    assert values(spark, ["http://a.b", "http://a.b/c//", "http://www.a.b/?z=1&a=&=#f"], U.canonical_url) == ["https://a.b/", "https://a.b/c", "https://a.b/?=&a=&z=1"]
    assert values(spark, ["HTTPS://EXAMPLE.COM/", "http://a.b/c/"], U.origin_prefix) == ["https://example.com", "http://a.b/c"]
    follow = lambda u: U.same_origin_prefix(u, F.lit("https://a.b/docs"))
    assert values(spark, ["https://a.b/docs", "https://a.b/docs/x", "https://a.b/docsx", "https://c.d/"], follow) == [True, True, False, False]
    assert values(spark, ["/api", "/apis", "/Login/x", "/static/a", "/a.PDF", "/a.pdfx", "/"], U.ignored_path) == [True, False, True, True, True, False, False]
    assert values(spark, ["a.io", "x.github.com", "github.com", "notgithub.com"], lambda d: U.ignored_domain(d, ["github.com"])) == [False, True, True, False]
    assert values(spark, ["a.io", "http://a.io", "a", "A.Com "], U.looks_like_domain) == [True, False, False, True]
