"""Walks: sitemaps of sitemaps, and budgeted crawls.  The numbers of ``pages`` make the graphs: every site has a stretch of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, frontier, sitemaps, structured
from ..sources.tables import read
from .page_queries import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

#: Pages of a made site with sitemaps, sitemaps that a walk reads, and addresses that it gives.
FILES, LIMIT, MAX_URLS = 40, 20, 12
KIDS = "[2 * k + 1, 2 * k + 2, k // 2, (3 * k) % 40, 39 - k]"


def _forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files of sitemaps that name each other in cycles, some by relative addresses, and what each site's robots file names."""
    rows = read(spark, sf_dir, "pages").select(F.concat(F.lit("m"), F.floor(F.col("page_id") / FILES)).alias("site"), (F.col("page_id") % FILES).alias("k"))
    host = F.concat(F.lit("https://"), F.col("site"), F.lit(".test"))
    entry = lambda tag, address: F.concat(F.lit(f"<{tag}><loc> "), address, F.lit(f"</loc></{tag}>\n"))
    kids = F.array(2 * F.col("k") + 1, 2 * F.col("k") + 2, F.floor(F.col("k") / 2), 3 * F.col("k") % FILES, FILES - 1 - F.col("k"))
    index = F.array_join(F.transform(kids, lambda x: entry("sitemap", F.concat(F.when(x % 2 == 0, host).otherwise(F.lit("")), F.lit("/"), x, F.lit(".xml")))), "")
    pages = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") % 7), lambda j: entry("url", F.concat(host, F.lit("/p/"), F.col("k"), F.lit("/"), j))), "")
    is_index = F.col("k") % 3 != 2
    tag = F.when(is_index, "sitemapindex").otherwise("urlset")
    xml = F.concat(F.lit('<?xml version="1.0"?>\n<'), tag, F.lit(' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'), F.when(is_index, index).otherwise(pages), F.lit("</"), tag, F.lit(">"))
    files = rows.where("k % 13 <> 12").select(F.concat(host, F.lit("/"), F.col("k"), F.lit(".xml")).alias("source"), xml.alias("xml"))
    named = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(k).alias("k")) for p, k in enumerate((0, 7, 0))])).alias("s")
    seeds = rows.where("k = 0").select("site", named).select("site", "s.place", F.concat(host, F.lit("/"), F.col("s.k"), F.lit(".xml")).alias("url"))
    return files, seeds


# One step takes one sitemap off the queue of every site.
_STEPS = f"""WITH RECURSIVE rows AS (SELECT 'm' || page_id // {FILES} AS site, page_id % {FILES} AS k FROM pages
), files AS (
  SELECT site, k, CASE WHEN k % 3 <> 2 THEN {KIDS} ELSE [] END AS kids, CASE WHEN k % 3 = 2 THEN k % 7 + 1 ELSE 0 END AS n_pages FROM rows WHERE k % 13 <> 12
), steps AS (
  SELECT site, 0 AS n, CAST(NULL AS BIGINT) AS k, [CAST(0 AS BIGINT), 7] AS queue, CAST([] AS BIGINT[]) AS seen, false AS skipped FROM rows WHERE k = 0
  UNION ALL
  SELECT s.site, s.n + 1, s.queue[1], CASE WHEN list_contains(s.seen, s.queue[1]) OR f.kids IS NULL THEN s.queue[2:] ELSE list_concat(s.queue[2:], list_filter(f.kids, lambda c: NOT list_contains(list_append(s.seen, s.queue[1]), c))[1:
    greatest(0, {LIMIT} - (len(s.seen) + 1 + len(s.queue) - 1))]) END, CASE WHEN list_contains(s.seen, s.queue[1]) THEN s.seen ELSE list_append(s.seen, s.queue[1]) END, list_contains(s.seen, s.queue[1])
  FROM steps s LEFT JOIN files f ON f.site = s.site AND f.k = s.queue[1] WHERE len(s.queue) > 0
), queue AS (
  SELECT steps.site, n, 'https://' || steps.site || '.test/' || steps.k || '.xml' AS url, skipped AS seen, NOT skipped AND n_pages IS NOT NULL AS found, steps.k,
    CASE WHEN skipped THEN 0 ELSE coalesce(n_pages, 0) END AS n_pages, CASE WHEN skipped THEN 0 ELSE coalesce(len(kids), 0) END AS n_children FROM steps LEFT JOIN files ON files.site = steps.site AND files.k = steps.k WHERE n > 0
)"""


@query(_STEPS + " SELECT site, n, url, seen, found, CAST(n_pages AS BIGINT) AS n_pages, CAST(n_children AS BIGINT) AS n_children FROM queue")
def sitemap_walk(spark, sf_dir):
    return sitemaps.sitemap_walk(*_forest(spark, sf_dir), LIMIT)


@query(_STEPS + f""", sized AS (SELECT *, coalesce(sum(n_pages) OVER (PARTITION BY site ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM queue),
  listed AS (SELECT *, unnest(range(n_pages)) AS j FROM sized)
SELECT site, CAST(before + j AS BIGINT) AS place, 'https://' || site || '.test/p/' || k || '/' || j AS url, url AS sitemap FROM listed WHERE before + j < {MAX_URLS}""")
def sitemap_pages(spark, sf_dir):
    return sitemaps.sitemap_pages(*_forest(spark, sf_dir), LIMIT, MAX_URLS)


#: Pages of a made site, pages that a crawl visits, and its depth.
SITE, BUDGET, DEPTH = 60, 20, 3
FINAL = "CASE WHEN k % 7 = 5 THEN NULL WHEN k % 11 = 8 THEN 1000 + k WHEN k % 9 = 4 THEN (k + 3) % 60 ELSE k END"


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fail, end at other pages, or elsewhere; links form cycles and repeat."""
    rows = read(spark, sf_dir, "pages").select(F.concat(F.lit("c"), F.floor(F.col("page_id") / SITE)).alias("site"), (F.col("page_id") % SITE).alias("k"))
    at = lambda k: F.concat(F.lit("https://"), F.col("site"), F.lit(".test"), F.when(k == 0, "").otherwise(F.concat(F.lit("/"), k)))
    k = F.col("k")
    end = F.when(k % 7 == 5, None).when(k % 11 == 8, F.concat(F.lit("https://elsewhere.test/"), F.col("site"), F.lit("/"), k)).when(k % 9 == 4, at((k + 3) % SITE)).otherwise(at(k))
    fetched = rows.select(at(k).alias("url"), end.alias("final"))
    targets = F.array((2 * k + 1) % SITE, (2 * k + 2) % SITE, k * k % SITE, (k + 30) % SITE, (2 * k + 1) % SITE)
    links = rows.select("site", at(k).alias("url"), F.posexplode(targets).alias("position", "_to")).select("url", "position", at(F.col("_to")).alias("target"))
    starts = rows.where("k = 0").select("site", at(F.lit(0)).alias("url"))
    seeds = starts.select("site", F.explode(F.array(F.lit(17), F.lit(9), F.lit(2))).alias("k")).select("site", at(F.col("k")).alias("url"))
    return frontier.crawl(starts, fetched, links, seeds, BUDGET, DEPTH)


_POPS = f"""WITH RECURSIVE rows AS (SELECT 'c' || page_id // {SITE} AS site, page_id % {SITE} AS k FROM pages
), ends AS (SELECT site, k, {FINAL} AS final FROM rows
), links AS (
  SELECT site, k, [(2 * k + 1) % 60, (2 * k + 2) % 60, (k * k) % 60, (k + 30) % 60] AS l FROM rows
), first AS (
  SELECT site, list_filter(list_concat(list_sort(list_filter(list_transform(list_distinct(l), lambda x: [length(CAST(x AS VARCHAR)), 0, x]), lambda x: x[3] <> 0)), [[1, 1, 2], [1, 1, 9], [2, 1, 17]]), lambda x: true) AS q FROM links WHERE k = 0
), begun AS (SELECT site, list_transform(q, lambda x: x[3]) AS a FROM first
), queued AS (SELECT site, list_filter(a, lambda x, i: list_position(a, x) = i)[1:{BUDGET - 1}] AS q FROM begun
), pops AS (
  SELECT site, 0 AS n, CAST(0 AS BIGINT) AS k, 0 AS depth, 'visited' AS outcome, CAST(0 AS BIGINT) AS final, list_transform(q, lambda x: {{'k': x, 'd': 1}}) AS queue, list_concat([0], q) AS met, 1 AS visited, false AS truncated FROM queued
  UNION ALL
  SELECT site, n + 1, k, depth, outcome, final,
    CASE WHEN expands THEN list_concat(rest, list_transform(fresh, lambda x: {{'k': x, 'd': depth + 1}})) ELSE rest END,
    CASE WHEN outcome IN ('visited', 'foreign') THEN list_concat(met, [final], CASE WHEN expands THEN fresh ELSE [] END) ELSE met END,
    visited + CASE WHEN outcome = 'visited' THEN 1 ELSE 0 END, outcome = 'visited' AND depth >= {DEPTH} AND has_links
  FROM (
    SELECT *, outcome = 'visited' AND depth < {DEPTH} AS expands, list_filter(list_filter(cand, lambda x, i: list_position(cand, x) = i), lambda x: NOT list_contains(met, x) AND x <> final)[1:greatest(0, {BUDGET} - (visited + 1) - len(rest))] AS fresh
    FROM (
      SELECT p.site, p.n, p.queue[1].k AS k, p.queue[1].d AS depth, p.queue[2:] AS rest, p.met, p.visited, e.final, coalesce(l.l, []) AS cand, l.l IS NOT NULL AS has_links,
        CASE WHEN p.visited >= {BUDGET} THEN 'left' WHEN e.final IS NULL THEN 'failed' WHEN e.final <> p.queue[1].k AND list_contains(p.met, e.final) THEN 'alias' WHEN e.final >= 1000 THEN 'foreign' ELSE 'visited' END AS outcome
      FROM pops p LEFT JOIN ends e ON e.site = p.site AND e.k = p.queue[1].k LEFT JOIN links l ON l.site = p.site AND l.k = e.final WHERE len(p.queue) > 0
    )
  )
)"""


@query(_POPS + """ SELECT site, CAST(n AS BIGINT) AS n, 'https://' || site || '.test' || CASE k WHEN 0 THEN '' ELSE '/' || k END AS url, depth, outcome,
  CASE WHEN final >= 1000 THEN 'https://elsewhere.test/' || site || '/' || (final - 1000) ELSE 'https://' || site || '.test' || CASE final WHEN 0 THEN '' ELSE '/' || final END END AS final FROM pops""")
def crawl_frontier(spark, sf_dir):
    return _crawled(spark, sf_dir).drop("truncated")


@query(_POPS + """ SELECT site, count(*) FILTER (outcome = 'visited') AS visited, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'alias') AS aliases,
  CASE WHEN arg_max(outcome, n) = 'left' THEN 'max_pages' WHEN bool_or(truncated) THEN 'max_depth' ELSE 'queue_empty' END AS stop_reason FROM pops GROUP BY site""")
def crawl_stops(spark, sf_dir):
    return frontier.crawl_summary(_crawled(spark, sf_dir), BUDGET)


# Objects by the page's number, which stands where the hash is.
OBJECTS = [
    '{"@type":"FAQPage","name":"faq #","mainEntity":[{"@type":"Question","name":"What is #?","acceptedAnswer":{"text":"It is # of all. More."}},{"name":""},{"name":"Why #?"}]}',
    '{"@type":["Organization","Brand"],"name":"site #","description":"","logo":{"url":"l#"},"sameAs":["a","b#","c","d"],"contactPoint":[{"contactType":"sales","email":"s#@x.org"},7,{"contactType":"help","email":null}],"founder":{"@type":"Organization","name":"inner #"}}',
    '{"@type":"SoftwareApplication","name":"app","softwareVersion":0,"isAccessibleForFree":true,"featureList":["f#","g"],"offers":{"price":"#","priceCurrency":"USD"},"author":{"name":"by #"},"publisher":"none"}',
    '[{"@type":"Article","datePublished":"2024-01-01"},{"@graph":[{"part":{"@type":"Organization","name":"deep #","description":"d#"}}]},{}]',
    '{broken #',
]


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.replace(F.element_at(F.array(*map(F.lit, OBJECTS)), (F.col("page_id") % len(OBJECTS)).cast("int") + 1), F.lit("#"), F.col("page_id").cast("string"))
    pages = read(spark, sf_dir, "pages").select("page_id", F.struct(F.array(raw).alias("jsonld")).alias("f"))
    return extract.jsonld_items(pages)


_QUOTED = ", ".join("'" + x + "'" for x in OBJECTS)
_RAW = f"replace([{_QUOTED}][page_id % {len(OBJECTS)} + 1], '#', CAST(page_id AS VARCHAR))"
_ITEMS = f"""blocks AS (SELECT page_id, CAST({_RAW} AS JSON) AS v FROM pages WHERE page_id % 5 <> 4
), items AS (
  SELECT page_id, unnest(range(CAST(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v) ELSE 1 END AS BIGINT))) AS place, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[' || place || ']') ELSE v END AS item FROM blocks
)"""
_TOLD = "CASE WHEN json_extract(item, '$.\"{0}\"') NOT IN ('null', 'false', '0', '\"\"', '[]', '{{}}') THEN '\"{0}\":' || CAST(json_extract(item, '$.\"{0}\"') AS VARCHAR) END"
_KEYS = ", ".join(_TOLD.format(k) for k in structured.FLAT)
_NAMES = ", ".join(f"CASE WHEN json_type(item, '$.{k}') = 'OBJECT' THEN '\"{k}\":' || CAST(json_extract(item, '$.{k}.name') AS VARCHAR) END" for k in structured.NAMED)


@query(f"""WITH {_ITEMS}
SELECT page_id, place, '{{' || concat_ws(',', {_KEYS}, {_NAMES},
  CASE WHEN json_type(item, '$.contactPoint') = 'ARRAY' THEN '"contactPoint":[{{"contactType":"sales","email":' || CAST(json_extract(item, '$.contactPoint[0].email') AS VARCHAR) || '}},{{"contactType":' || CAST(json_extract(item, '$.contactPoint[2].contactType') AS VARCHAR) || '}}]' END,
  CASE WHEN json_type(item, '$.offers.price') <> 'NULL' THEN '"offers":{{"price":' || CAST(json_extract(item, '$.offers.price') AS VARCHAR) || ',"priceCurrency":' || CAST(json_extract(item, '$.offers.priceCurrency') AS VARCHAR) || '}}' END,
  CASE WHEN json_array_length(item, '$.sameAs') > 0 THEN '"sameAs_count":' || json_array_length(item, '$.sameAs') || ',"sameAs_sample":' || CAST(to_json(json_extract_string(item, '$.sameAs[*]')[1:3]) AS VARCHAR) END,
  CASE WHEN json_array_length(item, '$.featureList') > 0 THEN '"featureList":' || CAST(json_extract(item, '$.featureList') AS VARCHAR) END,
  CASE WHEN json_array_length(item, '$.mainEntity') > 0 THEN '"mainEntity_count":3,"mainEntity_qa":[{{"question":"What is ' || page_id || '?","answer_excerpt":"It is ' || page_id || ' of all"}},{{"question":"Why ' || page_id || '?"}}]' END
) || '}}' AS summary FROM items WHERE item <> '{{}}' AND NOT json_exists(item, '$."@graph"')""")
def jsonld_summaries(spark, sf_dir):
    out = structured.summaries(_objects(spark, sf_dir))
    return out.select("page_id", F.col("place").cast("long").alias("place"), "summary")


@query(f"""WITH RECURSIVE {_ITEMS}, walk AS (
  SELECT page_id, item AS v FROM items
  UNION ALL
  SELECT page_id, unnest(CASE json_type(v) WHEN 'OBJECT' THEN json_extract(v, '$.*') WHEN 'ARRAY' THEN json_extract(v, '$[*]') ELSE [] END) AS v FROM walk WHERE json_type(v) IN ('OBJECT', 'ARRAY')
)
SELECT page_id, json_extract_string(v, '$.name') AS name, json_extract_string(v, '$.description') AS description FROM walk
WHERE json_type(v) = 'OBJECT' AND (json_extract_string(v, '$."@type"') = 'Organization' OR list_contains(json_extract_string(v, '$."@type"[*]'), 'Organization'))""")
def jsonld_organisations(spark, sf_dir):
    return structured.organisations(_objects(spark, sf_dir))
