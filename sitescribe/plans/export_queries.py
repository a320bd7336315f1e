"""Queries over what leaves: exported fields, orders, seeds, extremes and movements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import compare, listing, recommend
from ..sources.tables import read
from .page_queries import CANONICAL_PATH, DOMAIN, IGNORED, METRICS, ORACLES, PATH, QUERIES, STRUCTURE, page_metrics, query, structure

__all__ = ["ORACLES", "QUERIES"]


@query(f"SELECT page_id, 'https://' || {DOMAIN} || '/' AS start FROM pages")
def start_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.start_url(U.domain_of(F.col("url"))).alias("start"))


@query(f"SELECT page_id, regexp_matches(url, '^(https?://)?[^/]*/?$') AS itself, regexp_matches('https://' || {DOMAIN} || '/', '^(https?://)?[^/]*/?$') AS start FROM pages")
def homepages(spark, sf_dir):
    """Whether each page is a homepage, and whether its host's start page is."""
    start = U.start_url(U.domain_of(F.col("url")))
    return read(spark, sf_dir, "pages").select("page_id", U.is_homepage(F.col("url")).alias("itself"), U.is_homepage(start).alias("start"))


@query(f"SELECT page_id FROM pages WHERE {DOMAIN} IN ('m.ththth.example.net', 'blog.tiontion.example.com') AND NOT ({IGNORED.format('(' + PATH + ')')})")
def allowed_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").where(U.allowed(F.col("url"), ["m.ththth.example.net", "blog.tiontion.example.com"])).select("page_id")


@query("SELECT url FROM (SELECT DISTINCT url FROM pages) ORDER BY length(url), url LIMIT 20")
def seed_order(spark, sf_dir):
    return listing.seeds(read(spark, sf_dir, "pages"), 20)


@query(f"""SELECT site, page_id, CAST(row_number() OVER (PARTITION BY site ORDER BY CASE WHEN path = '/' THEN 0 WHEN contains(lower(url), '/product') THEN 1 WHEN contains(lower(url), '/pricing') THEN 2
  WHEN contains(lower(url), '/about') THEN 3 WHEN contains(lower(url), '/features') THEN 4 ELSE 5 END, words DESC, page_id) AS INTEGER) AS place
  FROM ({METRICS}) JOIN (SELECT page_id, url, {CANONICAL_PATH} AS path FROM pages) USING (page_id)""")
def page_order(spark, sf_dir):
    pages = page_metrics(spark, sf_dir).join(read(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    return listing.page_order(pages)


@query(f"SELECT site, count(*) FILTER (score < 40) AS thin, round(avg(CASE WHEN score < 40 THEN 70 ELSE score END), 4) AS target FROM ({STRUCTURE}) GROUP BY site HAVING count(*) FILTER (score < 40) > 0")
def thin_page_fixes(spark, sf_dir):
    return recommend.thin_pages(structure(page_metrics(spark, sf_dir))).withColumn("target", F.round("target", 4))


@query("""SELECT doc_id, substr(lang, 1, 12) AS pillar, substr(source, 1, 12) AS priority, substr(text, 1, 200) AS title, substr(text, 1, 500) AS detail, round(n_chars / 7.0, 1) AS points FROM documents""")
def exported_fields(spark, sf_dir):
    fixes = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("pillar"), F.col("source").alias("priority"), F.col("text").alias("title"), F.col("text").alias("detail"), (F.col("n_chars") / 7.0).alias("points"))
    return listing.exported(fixes, ["doc_id"])


LINES = "SELECT l_orderkey AS run, l_linenumber AS factor, l_linestatus AS pillar, CASE WHEN l_returnflag = 'N' THEN NULL ELSE round(l_discount * 50, 1) END AS score FROM lineitem"


def lines(spark, sf_dir):
    score = F.when(F.col("l_returnflag") != "N", F.round(F.col("l_discount") * 50, 1))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("factor"), F.col("l_linestatus").alias("pillar"), score.alias("score"))


@query(f"""SELECT run, coalesce(arg_min(factor, (score, factor)) FILTER (score IS NOT NULL), -1) AS lowest, coalesce(arg_min(factor, (-score, factor)) FILTER (score IS NOT NULL), -1) AS highest,
  coalesce(string_agg(CAST(factor AS VARCHAR), ',' ORDER BY factor) FILTER (score IS NULL), '') AS missing FROM ({LINES}) GROUP BY run""")
def factor_extremes(spark, sf_dir):
    """-1 stands for no factor with a score."""
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return compare.extremes(lines(spark, sf_dir)).select("run", none("lowest"), none("highest"), F.array_join("missing", ",").alias("missing"))


@query(f"SELECT run, pillar, string_agg(CAST(factor AS VARCHAR), ',' ORDER BY score IS NULL, score DESC, factor) AS fixes FROM ({LINES}) GROUP BY ALL")
def fixes_by_pillar(spark, sf_dir):
    return compare.by_pillar(lines(spark, sf_dir).withColumnsRenamed({"factor": "fix", "score": "points"})).withColumn("fixes", F.array_join("fixes", ","))


@query("""SELECT doc_id AS question, CASE WHEN doc_id % 3 > 0 THEN 'new' WHEN quality > toxic THEN 'improved' WHEN quality < toxic THEN 'declined' ELSE 'same' END AS moved FROM labels""")
def answer_movement(spark, sf_dir):
    """Quality as the new points of each question, toxicity as the old points of one in three."""
    labels = read(spark, sf_dir, "labels")
    old = labels.where("doc_id % 3 = 0").select(F.col("doc_id").alias("question"), F.col("toxic").alias("points"))
    return compare.answer_movement(old, labels.select(F.col("doc_id").alias("question"), F.col("quality").alias("points")))


@query("SELECT event_type, format('{:,}', count(*)) AS n FROM events GROUP BY event_type")
def grouped_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", X.grouped(F.col("n")).alias("n"))
