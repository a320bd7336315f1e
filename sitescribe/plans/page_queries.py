"""Queries over crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import scoring as S
from ..functions import text as X
from ..functions import urls as U
from ..operators import audit
from ..operators.frontier import walk
from ..sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# SQL of the URL functions.
AUTHORITY = r"regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)"
DOMAIN = rf"regexp_replace(lower(trim({AUTHORITY})), '^www\.', '')"
RAW_PATH = r"regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
PATH = f"CASE WHEN {RAW_PATH} = '' THEN '/' ELSE {RAW_PATH} END"
CANONICAL_PATH = f"CASE WHEN regexp_replace({RAW_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({RAW_PATH}, '/+$', '') END"
QUERY = r"array_to_string(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '')), '&')"
IGNORED = r"regexp_matches({0}, '(?i)^/(api|auth|account|login|signup)(/|$)') OR regexp_matches({0}, '(?i)^/(static|assets|cdn)/') OR regexp_matches({0}, '(?i)\.(mp3|mp4|pdf|zip|png|jpe?g|svg|webp|ico)(\?|$)')"
# SQL of the page metrics.
STRIPPED = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[ >].*?</script>', ' ', 'g'), '(?is)<style[ >].*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
TEXT = f"regexp_replace({STRIPPED}, '(?s)<[^>]*>', ' ', 'g')"
WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> ''))"
COUNTS = ", ".join(f"CAST(len(regexp_extract_all({STRIPPED}, '(?i)({pattern})', 1)) AS INTEGER) AS {name}" for name, pattern in H.TAGS.items())
DEPTH = "greatest(" + ", ".join(f"CASE WHEN regexp_matches({STRIPPED}, '(?i)<h{n}[ >]') THEN {n} ELSE 0 END" for n in range(1, 7)) + ")"
METRICS = f"SELECT page_id, {DOMAIN} AS site, {COUNTS}, {DEPTH} AS depth, CAST({WORDS.format(TEXT)} AS INTEGER) AS words FROM pages"
STRUCTURE = f"""SELECT page_id, site, CAST(CASE WHEN h1_count = 1 THEN 15 ELSE 0 END + CASE WHEN depth >= 2 THEN 15 ELSE 0 END + CASE WHEN lists > 0 THEN 10 ELSE 0 END
  + CASE WHEN tables > 0 THEN 10 ELSE 0 END + CASE WHEN words >= 300 THEN 15 ELSE 0 END + CASE WHEN words >= 1000 THEN 10 ELSE 0 END
  + CASE WHEN paragraphs >= 5 THEN 10 ELSE 0 END + CASE WHEN headings_total >= 5 THEN 10 ELSE 0 END AS INTEGER) AS score FROM ({METRICS})"""


def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the HTML; scripts and comments are stripped once and the result shared."""
    pages = read(spark, sf_dir, "pages").select("page_id", U.domain_of(F.col("url")).alias("site"), H.without_scripts(F.col("html")).alias("_html"))
    body = F.col("_html")
    counts = [H.count_of(body, pattern).alias(name) for name, pattern in H.TAGS.items()]
    words = X.words(F.regexp_replace(body, "(?s)<[^>]*>", " ")).alias("words")
    return pages.select("page_id", "site", *counts, H.heading_depth(body).alias("depth"), words)


def structure(metrics: DataFrame) -> DataFrame:
    m = {c: F.col(c) for c in ("h1_count", "depth", "lists", "tables", "words", "paragraphs", "headings_total")}
    return metrics.select("page_id", "site", S.page_structure(m | {"images_total": F.lit(0), "images_with_alt": F.lit(0)}).alias("score"))


@query(METRICS)
def page_tag_metrics(spark, sf_dir):
    return page_metrics(spark, sf_dir)


@query(STRUCTURE)
def page_structure_score(spark, sf_dir):
    return structure(page_metrics(spark, sf_dir))


RATING = "CASE " + " ".join(f"WHEN round_even(composite, 0) <= {high} THEN '{label}'" for high, label in S.RATINGS["AEO"]) + " END"


@query(f"""
SELECT site, n_pages, mean_score, composite, {RATING} AS rating FROM (
  SELECT site, count(*) AS n_pages, round(avg(score), 4) AS mean_score, round(least(100 * pow(avg(score) / 100, 1.15), 100.0), 1) AS composite
  FROM ({STRUCTURE}) GROUP BY site)""")
def site_structure_scorecard(spark, sf_dir):
    """Each site's content structure as one calibrated score with its label."""
    mean = F.avg("score")
    sites = structure(page_metrics(spark, sf_dir)).groupBy("site").agg(F.count("*").alias("n_pages"), F.round(mean, 4).alias("mean_score"), S.calibrated(mean).alias("composite"))
    return sites.withColumn("rating", S.rating("AEO", F.col("composite"))).orderBy(F.desc("composite"), "site")


@query(f"""SELECT page_id, {DOMAIN} AS site, {CANONICAL_PATH} AS path, {QUERY} AS query,
  'https://' || {DOMAIN} || {CANONICAL_PATH} || CASE WHEN {QUERY} = '' THEN '' ELSE '?' || {QUERY} END AS canonical FROM pages""")
def url_canonical(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", U.domain_of(url).alias("site"), U.canonical_path(url).alias("path"), U.sorted_query(url).alias("query"), U.canonical_url(url).alias("canonical")
    )


@query(f"SELECT {DOMAIN} AS site, count(*) AS n_pages FROM pages GROUP BY ALL")
def site_page_counts(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(U.domain_of(F.col("url")).alias("site")).agg(F.count("*").alias("n_pages"))


@query(f"SELECT page_id, {PATH} AS path FROM pages WHERE NOT ({IGNORED.format(PATH)})")
def ignored_path_filter(spark, sf_dir):
    path = U.path_of(F.col("url"))
    return read(spark, sf_dir, "pages").where(~U.ignored_path(path)).select("page_id", path.alias("path"))


IGNORED_SITES = ["example.net", "spam-farm.example.org"]


@query("SELECT page_id, site FROM (SELECT page_id, " + DOMAIN + " AS site FROM pages) WHERE NOT (" + " OR ".join(f"site = '{d}' OR ends_with(site, '.{d}')" for d in IGNORED_SITES) + ")")
def ignored_domain_filter(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.domain_of(F.col("url")).alias("site")).where(~U.ignored_domain(F.col("site"), IGNORED_SITES))


@query(r"SELECT site, regexp_matches(lower(trim(site)), '^[a-z0-9.\-]+\.[a-z]{2,24}$') AND NOT contains(site, '://') AS is_domain FROM (SELECT DISTINCT " + DOMAIN + " AS site FROM pages)")
def url_looks_like_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(U.domain_of(F.col("url")).alias("site")).distinct().select("site", U.looks_like_domain(F.col("site")).alias("is_domain"))


@query(f"SELECT page_id, substr(md5(url), 1, 16) || '_' || substr(md5({QUERY}), 1, 12) || '.html' AS cache_key FROM pages")
def page_cache_keys(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.cache_key(F.col("url"), U.sorted_query(F.col("url"))).alias("cache_key"))


LINKS = f"""SELECT DISTINCT page_id, site, href FROM (SELECT page_id, {DOMAIN} AS site, unnest(regexp_extract_all({STRIPPED}, '(?i)<a href="([^"]*)"', 1)) AS href FROM pages)
  WHERE starts_with(href, '/') AND href <> '/' AND NOT ({IGNORED.format("href")})"""


def internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", U.domain_of(F.col("url")).alias("site"), F.explode(H.hrefs(H.without_scripts(F.col("html")))).alias("href"))
    return pages.where(F.col("href").startswith("/") & (F.col("href") != "/") & ~U.ignored_path(F.col("href"))).distinct()


@query(LINKS)
def page_internal_links(spark, sf_dir):
    return internal_links(spark, sf_dir)


@query(f"SELECT site, href, count(*) AS n_pages FROM ({LINKS}) GROUP BY ALL")
def link_in_degree(spark, sf_dir):
    return internal_links(spark, sf_dir).groupBy("site", "href").agg(F.count("*").alias("n_pages"))


# Page n links to pages 2n+1 and 2n+2: a graph that every size of the table has.
@query("""WITH RECURSIVE edges AS (
  SELECT a.page_id AS src, b.page_id AS dst FROM pages a JOIN pages b ON b.page_id IN (2 * a.page_id + 1, 2 * a.page_id + 2)
), walk(page_id, depth) AS (SELECT 0, 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = page_id WHERE depth < 4)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY page_id""")
def frontier_depth(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id")
    edges = pages.select(F.col("page_id").alias("src"), F.explode(F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2)).alias("dst"))
    edges = edges.join(pages.withColumnRenamed("page_id", "dst"), "dst", "left_semi")
    return walk(edges, pages.where("page_id = 0").select("page_id"), depth=4)


TITLES = f"SELECT page_id, {DOMAIN} AS site, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", U.domain_of(F.col("url")).alias("site"), H.title_of(F.col("html")).alias("title"))


@query(f"SELECT site, title, count(*) AS n_pages, min(page_id) AS first_page FROM ({TITLES}) WHERE title <> '' GROUP BY ALL HAVING count(*) > 1")
def duplicate_titles(spark, sf_dir):
    return audit.duplicate_values(titles(spark, sf_dir), "title")


@query(f"""SELECT site, title, n AS n_pages, n_variants FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, first) AS r, count(*) OVER (PARTITION BY site) AS n_variants
  FROM (SELECT site, title, count(*) AS n, min(page_id) AS first FROM ({TITLES}) WHERE title <> '' GROUP BY ALL)) WHERE r = 1""")
def most_common_title(spark, sf_dir):
    return audit.most_common(titles(spark, sf_dir), "title")


@query(f"""SELECT page_id, CASE WHEN length(title) > 40 THEN substr(title, 1, 40) || '…' ELSE title END AS title,
  CASE WHEN trim(regexp_replace(lower(site), '[^a-z0-9.\\-]+', '-', 'g'), '.-') = '' THEN 'site' ELSE left(trim(regexp_replace(lower(site), '[^a-z0-9.\\-]+', '-', 'g'), '.-'), 80) END AS filename FROM ({TITLES})""")
def page_labels(spark, sf_dir):
    return titles(spark, sf_dir).select("page_id", X.truncated(F.col("title"), 40).alias("title"), X.safe_filename(F.col("site")).alias("filename"))


BANDED = f"SELECT site, words FROM ({METRICS})"
BAND_OF = "CASE WHEN {0} < 200 THEN 10 WHEN {0} < 500 THEN 30 WHEN {0} < 1000 THEN 50 WHEN {0} < 2000 THEN 70 WHEN {0} < 5000 THEN 90 ELSE 100 END"


@query(f"""SELECT site, round_even(0.35 * {BAND_OF.format("avg(words)")} + 0.25 * (100.0 * count(*) FILTER (words >= 1000) / count(*)) + 0.15 * (100.0 * count(*) FILTER (words > 200) / count(*))
  + CASE WHEN bool_or(code_blocks > 0) THEN 15 ELSE 0 END + CASE WHEN bool_or(tables > 0) THEN 10 ELSE 0 END, 1) AS content_depth FROM ({METRICS}) GROUP BY site""")
def site_content_depth(spark, sf_dir):
    n = F.count("*")
    share = lambda cond: 100.0 * F.count_if(cond) / n
    score = 0.35 * S.words_band(F.avg("words")) + 0.25 * share(F.col("words") >= 1000) + 0.15 * share(F.col("words") > 200)
    score = score + F.when(F.bool_or(F.col("code_blocks") > 0), 15).otherwise(0) + F.when(F.bool_or(F.col("tables") > 0), 10).otherwise(0)
    return page_metrics(spark, sf_dir).groupBy("site").agg(F.bround(score, 1).alias("content_depth"))


# Parts of the titles of pages that stand in a crawler's way.
CHALLENGES = [
    "vercel security checkpoint", "just a moment", "attention required", "checking your browser", "verify you are human", "verifying you are human",
    "security challenge", "ddos protection", "access denied", "robot check", "request blocked", "unusual traffic", "captcha", "enable javascript and cookies",
]


@query(f"""SELECT page_id, words, words < 50 AS thin, words < 50 AND ({" OR ".join(f"contains(lower(title), '{c}')" for c in CHALLENGES)}) AS blocked
  FROM ({METRICS}) JOIN (SELECT page_id, title FROM ({TITLES})) USING (page_id)""")
def blocked_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.lower(H.title_of(F.col("html"))).alias("_title"), X.words(H.plain_text(F.col("html"))).alias("words"))
    challenged = F.exists(F.array(*map(F.lit, CHALLENGES)), lambda c: F.col("_title").contains(c))
    return pages.select("page_id", "words", (F.col("words") < 50).alias("thin"), ((F.col("words") < 50) & challenged).alias("blocked"))
