"""Operators on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitescribe.functions import html as H
from sitescribe.operators import activity, audit, compare, extract, frontier, revisions, structured
from sitescribe.sources import sinks

PAGE = """<html><head><title> My
 page</title><meta name="description" content="About us"><meta property="og:title" content="T"><link rel="canonical" href="https://example.org/index">
<script type="application/ld+json">{"@type": ["Organization", "Brand"], "name": "Acme"}</script><script type="application/ld+json">[{"@type":"FAQPage","mainEntity":[{"acceptedAnswer":{"text":"%s"}}]}, 3]</script>
<script type="application/ld+json">{broken</script><script>var e="script@acme.org"</script></head><body><nav>Menu</nav><h1>Head</h1><h3></h3>
<p>Write to hello [at] acme [dot] com or john@acme . org now. user @ company</p><img src="a.png" alt="x"><img src="data:1"><img width=1 alt=y>
<a href="/about/">About</a><a href="/about#x">Again</a><a href="/">Home</a><a href="/api/x">Api</a><a href="mailto:Contact@Acme.org?subject=1">m</a><a href="https://sub.example.org/page?x=1">s</a>
<a href="https://github.com/a">g</a><a href="javascript:void(0)">j</a></body></html>""" % " ".join(["w"] * 45)


@pytest.fixture(scope="module")
def pages(spark):
    return extract.with_features(spark.createDataFrame([(1, "https://example.org/index", PAGE), (2, "https://example.org/two", None), (3, None, "<p>x")], "page_id long, url string, html string"))


def test_features(pages):
    f = {r.page_id: r.f for r in pages.collect()}
    assert f[1].title == "My page" and f[1].canonical == "https://example.org/index" and f[1].meta == {"description": "About us", "og:title": "T"}
    assert [(h.level, h.text) for h in f[1].headings] == [(1, "Head")] and (f[1].images_total, f[1].images_with_alt) == (1, 1)
    assert "Menu" not in f[1].markdown and "# Head" in f[1].markdown and len(f[1].jsonld) == 3 and f[1].counts["p"] == 1
    assert f[2].title == "" and f[3].markdown == "x"


def test_links(pages):
    found = {(r.kind, r.target) for r in extract.classified_links(pages.where("page_id = 1"), ["github.com"]).collect()}
    assert found == {("int", "/about"), ("ext", "https://sub.example.org/page")}


def test_emails(pages):
    found = {r.email: r.found_as for r in extract.found_emails(pages).collect()}
    assert found == {"contact@acme.org": ["mailto"], "hello@acme.com": ["obfuscated"], "john@acme.org": ["obfuscated"]}


def test_structured_data(pages):
    items = extract.jsonld_items(pages)
    assert sorted(r.types for r in items.collect()) == [["FAQPage"], ["Organization", "Brand"]]
    assert [(r.n_questions, r.in_range, r.mean_words) for r in extract.faq_quality(items).collect()] == [(1, 1, 45.0)]


def test_robots(spark):
    text = "User-agent: GPTBot\nUser-agent: CCBot # two\nDisallow: /\n\nUser-agent: ClaudeBot\nDisallow: /private\nAllow: /\nUser-agent: *\nDisallow:\n"
    files = spark.createDataFrame([("a", text), ("b", "User-agent: *\r\nDisallow: /"), ("c", "")], "site string, text string")
    got = {(r.site, r.bot): r.status for r in extract.robots_status(files, ["GPTBot", "CCBot", "ClaudeBot", "PerplexityBot"]).collect()}
    assert [got["a", b] for b in ("GPTBot", "CCBot", "ClaudeBot", "PerplexityBot")] == ["blocked", "blocked", "partially_restricted", "allowed"]
    assert got["b", "GPTBot"] == "blocked" and got["c", "GPTBot"] == "allowed"


def test_sitemaps(spark):
    index = '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://a.b/1.xml </loc></sitemap></sitemapindex>'
    urls = '<urlset><url><loc>https://a.b/x</loc></url><url><loc>https://a.b/y</loc></url></urlset>'
    files = spark.createDataFrame([("i", index), ("u", urls), ("bad", "<html>no"), ("none", None)], "source string, xml string")
    assert sorted((r.source, r.kind, r["loc"]) for r in extract.sitemap_urls(files).collect()) == [("i", "sitemap", "https://a.b/1.xml"), ("u", "page", "https://a.b/x"), ("u", "page", "https://a.b/y")]


def test_llms_file(spark):
    rows = [("a", "llms", 0, "<!DOCTYPE html>"), ("a", "llms", 1, "# Hi " + "x" * 600), ("b", "llms", 0, " ")]
    got = extract.llms_file(spark.createDataFrame(rows, "site string, kind string, place int, text string")).collect()
    assert [(r.site, len(r.preview)) for r in got] == [("a", 500)]


def test_walk(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (4, 5), (9, 9)], "src long, dst long")
    got = {r.page_id: r.depth for r in frontier.walk(edges, spark.createDataFrame([(1,)], "page_id long"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def event(i, user, second, item, kind="view"):
    return i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second), user, kind, float(item), None


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_segments_flip_once(spark):
    rows = [event(i, 1, i, 7) for i in range(3)] + [event(10 + i, 2, i, i) for i in range(8)]
    events = spark.createDataFrame(rows, EVENTS)
    item = F.floor("value").cast("long")
    assert [(r.user_id, r.event_id, r.distinct_items) for r in activity.segment_flips(events, item).collect()] == [(2, 14, 5)]
    state = {r.user_id: (r.n_events, r.distinct_items, r.segment) for r in activity.state(events, item, F.lit(1)).collect()}
    assert state == {1: (3, 1, "standard"), 2: (8, 5, "agency")}


def test_trailing_counts(spark):
    events = spark.createDataFrame([event(i, 1, s, 0) for i, s in enumerate([0, 30, 60, 61, 200])], EVENTS)
    assert [r.n_recent for r in activity.trailing_counts(events, 60, 2).orderBy("event_id").collect()] == [1, 2, 3, 3, 1]


def test_upsert_adds(spark):
    a = spark.createDataFrame([(1, "d", 2)], "user_id long, day string, calls long")
    assert {(r.user_id, r.calls) for r in activity.merged_usage(a, a.union(spark.createDataFrame([(2, "d", 1)], a.schema))).collect()} == {(1, 4), (2, 1)}


def test_counterfactual_equals_recomputation(spark):
    factors = spark.createDataFrame([(1, "a", 50.0, 0.4), (1, "b", 80.0, 0.6), (1, "c", None, 0.5)], "run int, factor string, score double, weight double")
    fixes = spark.createDataFrame([(1, "f", "a", 90.0), (1, "g", "c", 40.0), (1, "h", "zzz", 90.0)], "run int, fix string, factor string, target double")
    composite = lambda pairs: round(100 * (sum(s * w for s, w in pairs) / sum(w for _, w in pairs) / 100) ** 1.15, 1)
    before = composite([(50, 0.4), (80, 0.6)])
    got = {r.fix: (r.before, r.after, r.delta) for r in compare.counterfactual(factors, fixes).collect()}
    want = {"f": composite([(90, 0.4), (80, 0.6)]), "g": composite([(50, 0.4), (80, 0.6), (40, 0.5)])}
    assert got == {k: (before, v, round(v - before, 1)) for k, v in want.items()}


def test_factor_diff(spark):
    keys = "lens string, factor string"
    weights = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "z")], keys)
    old, new = spark.createDataFrame([("A", "x", 1.0)], keys + ", score double"), spark.createDataFrame([("A", "x", 3.0), ("A", "y", 2.0)], keys + ", score double")
    diff = compare.factor_diff(weights, old, new)
    assert {(r.factor, r.before, r.after, r.delta) for r in diff.collect()} == {("x", 1.0, 3.0, 2.0), ("y", None, 2.0, None)}
    assert "| x | 1.0 | 3.0 | +2.0 |" in sinks.diff_report(diff).first().markdown


def test_revisions(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, 7, day(1), "succeeded", 10.0), (2, 7, day(2), "succeeded", 30.0), (3, 7, day(2), "succeeded", 35.0), (4, 7, day(3), "failed", 1.0), (5, 8, day(1), "pending", 2.0)]
    runs = spark.createDataFrame(rows, "run_id long, series long, created_at timestamp_ntz, status string, score double")
    assert {r.run_id for r in revisions.latest(runs).collect()} == {4, 5}
    assert {r.run_id: r.previous_id for r in revisions.with_previous(runs).collect()} == {1: None, 2: 1, 3: 1}
    assert {r.run_id: (r.run_no, r.delta) for r in revisions.history(runs).collect()} == {1: (1, None), 2: (2, 20.0), 3: (3, 5.0)}
    assert {r.run_id for r in revisions.beyond_newest(runs, 1).collect()} == {1, 2}
    marked = revisions.replaced(runs, runs.limit(0))
    assert revisions.at_most_one_latest(marked).count() == 0 and revisions.at_most_one_latest(marked.withColumn("is_latest", F.lit(True))).count() == 1


def test_audits(spark):
    pages = spark.createDataFrame([(1, "s", "/", ["A"], "x"), (2, "s", "/b", [], "x"), (3, "s", "/b", ["A", "B"], "y")], "page_id long, site string, url string, types array<string>, title string")
    got = audit.schema_coverage(pages).first()
    assert (got.n_pages, got.with_schema, got.coverage_pct, got.type_counts) == (3, 2, 66.7, {"A": 2, "B": 1})
    assert [r.page_id for r in audit.first_of_page(pages).orderBy("page_id").collect()] == [1, 2]
    organisations = spark.createDataFrame([("s", "Acme", "d"), ("s", "Acme", "e")], "site string, name string, description string")
    e = audit.entity_consistency(organisations).first()
    assert e.name_consistent and not e.description_consistent


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("https://www.a.b/", "# Hi"), ("https://a.b/c/d", "x")], "url string, markdown string")
    sinks.write_markdown(pages, str(tmp_path / "md"))
    assert {str(p.relative_to(tmp_path / "md")): p.read_text() for p in (tmp_path / "md").rglob("*.md")} == {"a.b/index.md": "# Hi", "a.b/c/d.md": "x"}
    sinks.write_csv(pages, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.write_json(pages, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    history = spark.createDataFrame([(1, 1, 50.0, None), (1, 2, 55.5, 5.5)], "series int, run_no int, score double, delta double")
    assert sinks.report(history).first().markdown.endswith("| 1 | 50.0 | — |\n| 2 | 55.5 | +5.5 |")
    xml = sinks.sitemap(spark.createDataFrame([("https://a.b/x&y", dt.datetime(2024, 1, 2))], "loc string, lastmod timestamp_ntz")).first().xml
    assert "https://a.b/x&amp;y" in xml and "2024-01-02" in xml and xml.startswith("<?xml") and xml.endswith("</urlset>")


def test_page_patterns(spark):
    page = '<html><title>A</title><script>"</p><p >"</script><!-- <p> --><p>one <b>two</b></p><h2>x</h2><ul><li>a</ul>'
    body = H.without_scripts(F.lit(page))
    got = spark.range(1).select(*[H.count_of(body, p).alias(n) for n, p in H.TAGS.items()], H.heading_depth(body).alias("depth"), H.title_of(F.lit(page)).alias("t")).first()
    assert (got.paragraphs, got.lists, got.headings_total, got.depth, got.t) == (1, 1, 1, 2, "A")


def test_organisations_at_any_depth(spark):
    raw = '{"@type":"WebPage","publisher":{"@type":"Organization","name":"A"},"x":[{"y":{"@type":["Organization","Brand"],"name":"B","description":"d"}}],"z":1}'
    items = extract.jsonld_items(spark.createDataFrame([(1, [raw]), (2, ["{bad"])], "page_id long, j array<string>").select("page_id", F.struct(F.col("j").alias("jsonld")).alias("f")))
    assert {(r.name, r.description) for r in structured.organisations(items).collect()} == {("A", None), ("B", "d")}


def test_freshness(spark):
    raw = '[{"datePublished":"2026-08-27"},{"dateModified":"2020-01-01T00:00:00Z","dateCreated":"soon"}]'
    items = extract.jsonld_items(spark.createDataFrame([(1, [raw])], "page_id long, j array<string>").select("page_id", F.struct(F.col("j").alias("jsonld")).alias("f")))
    dated = extract.dates(items).select(F.lit("s").alias("site"), F.col("at").cast("string").alias("url"), "at")
    got = audit.freshness(dated.union(dated), "2026-09-01").first()
    assert (got.pages_with_dates, got.score) == (2, 20) and got.mean_days > 365


def test_canonical_mismatches(spark):
    rows = [(1, "https://www.a.b/x/", "https://a.b/x"), (2, "https://a.b/x", "/x?y=1"), (3, "https://a.b/x", "/z"), (4, "https://a.b/x", "https://c.d/x"), (5, "https://a.b/x", None), (6, "https://a.b/", "https://a.b")]
    assert {r.page_id for r in audit.canonical_mismatches(spark.createDataFrame(rows, "page_id long, url string, canonical string")).collect()} == {3, 4}


def test_sitemap_candidates(spark):
    sites = spark.createDataFrame([("a.b", "User-agent: *\nSitemap: https://a.b/own.xml\nsitemap: https://a.b/sitemap.xml"), ("c.d", None)], "site string, robots string")
    got = extract.sitemap_candidates(sites).orderBy("site", "place").collect()
    assert [r.url for r in got][:3] == ["https://a.b/own.xml", "https://a.b/sitemap.xml", "https://a.b/sitemap_index.xml"] and len(got) == 5 + 4
