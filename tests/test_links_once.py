"""Links of pages: addresses without a tree, and every page parsed once."""

from sitescribe.operators import extract
from sitescribe.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
PAGES = [
    None, "", "<a>", "<a href=/a>x<a href='/b' href=/c>y", "<a href>z</a><A HREF=' /d '>D</A>", "<script><a href=/no></script><!-- <a href=/no> --><a href='/e?x=1&amp;y=2'>e",
    "<svg><a href=/s /></svg><textarea><a href=/t></textarea><title><a href=/u></title><template><a href=/v></template><a\nhref=/w", "<p><li><a name=x><table><a href=/x></p></a>",
]


def test_hrefs_equal_the_features(spark):
    pages = PAGES + [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert [extract.page_hrefs(p) for p in pages] == [[x["href"] for x in extract.page_features(p)[5]] for p in pages]


def test_links_of_both_ways_are_equal(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = extract.classified_links(extract.with_features(pages), ["github.com"])
    got = QUERIES["page_links"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_pages_are_parsed_once(spark):
    plan = QUERIES["page_links"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # a page's addresses, and each joined with the page's
