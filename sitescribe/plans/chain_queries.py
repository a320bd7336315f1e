"""From ``pages`` to factors, composites and fixes.  Pages hold no structured data and no site files, so these are made of their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import scoring as S
from ..functions import urls as U
from ..operators import extract, site_scores
from ..sources.scratch import written
from ..sources.tables import read
from .page_queries import BAND_OF, DOMAIN, METRICS, ORACLES, QUERIES, STRIPPED, page_metrics, query
from .rule_queries import FIX_ROWS

__all__ = ["ORACLES", "QUERIES"]

AS_OF = "2024-02-01"
# Objects by the page's number: # stands for it, ~ for its last digit.
OBJECTS = [
    '{"@type":"FAQPage","mainEntity":[{"name":"q","acceptedAnswer":{"text":"' + "w " * 44 + 'w"}},{"name":"r","acceptedAnswer":{"text":"short"}}]}',
    '{"@type":"Organization","name":"Acme","description":"d"}',
    '{"@type":"WebPage","publisher":{"@type":"Organization","name":"Acme #","description":" "},"contactPoint":{"email":"a@b.org"}}',
    '{"@type":"Article","Author":{"name":"p"},"datePublished":"2024-01-01","dateModified":"2023-11-2~"}',
    '{"@type":"HowTo"}', "{broken", '[{"@type":"ContactPage"},{"@type":"Article","dateCreated":"no date"}]',
]
IMAGE, DESCRIBED = "<img[ >]", '<img[^>]* alt="[^"]+"'
# Files of a site by the number of its first page.
ROBOTS = {0: None, 1: "User-agent: *\nAllow: /", 2: "User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nDisallow: /private", 3: "User-agent: *\nDisallow: /"}
VERDICTS = ["supported", "partially_supported", "unsupported", "contradictory", "not_applicable"]


def _inputs(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    html = H.without_scripts(F.col("html"))
    shown = pages.select("page_id", "url", H.count_of(html, IMAGE).alias("images_total"), H.count_of(html, DESCRIBED).alias("images_with_alt"))
    metrics = page_metrics(spark, sf_dir).join(shown, "page_id")
    raw = F.element_at(F.array(*map(F.lit, OBJECTS)), (F.col("page_id") % len(OBJECTS)).cast("int") + 1)
    raw = F.replace(F.replace(raw, F.lit("#"), F.col("page_id").cast("string")), F.lit("~"), (F.col("page_id") % 10).cast("string"))
    items = extract.jsonld_items(pages.select("page_id", F.struct(F.array(raw).alias("jsonld")).alias("f")))
    sites = pages.groupBy(U.domain_of(F.col("url")).alias("site")).agg(F.min("page_id").alias("m"))
    robots = F.lit(None).cast("string")
    for k, text in ROBOTS.items():
        robots = F.when(F.col("m") % 4 == k, F.lit(text)).otherwise(robots)
    files = sites.select("site", robots.alias("robots"), F.when(F.col("m") % 3 == 0, "llms").alias("llms"), F.when(F.col("m") % 5 == 0, " ").when(F.col("m") % 5 == 1, "all").alias("llms_full"), (F.col("m") % 2).alias("sitemaps"))
    q = F.col("m") + F.col("q")
    asked = sites.select("site", "m", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("q"))
    asked = asked.select("m", F.col("site").alias("run"), F.concat(F.lit("q"), F.col("q")).alias("question"), F.element_at(F.array(*map(F.lit, VERDICTS)), (q % 5).cast("int") + 1).alias("verdict"), F.array_repeat(F.lit("/"), (q % 3).cast("int")).alias("sources"))
    signals = written(site_scores.site_signals(metrics, items, files, AS_OF), "signals")  # a row a site, read for factors and for fixes
    return signals, asked.where("m % 6 > 0").drop("m"), asked.where("m % 6 = 0").drop("m")


def _factors(spark, sf_dir):
    signals, answers, late = _inputs(spark, sf_dir)
    return signals, answers, late, site_scores.factor_table(signals, answers)


_IMAGES = f"SELECT page_id, url, len(regexp_extract_all({STRIPPED}, '(?i)({IMAGE})', 1)) AS images_total, len(regexp_extract_all({STRIPPED}, '(?i)({DESCRIBED})', 1)) AS images_with_alt FROM pages"
_DEEP = f"least(100.0, 0.35 * {BAND_OF.format('avg({0})')} + 0.25 * (100.0 * count(*) FILTER ({{0}} >= 1000) / count(*)) + 0.15 * (100.0 * count(*) FILTER ({{0}} > 200) / count(*)) + CASE WHEN bool_or(code_blocks > 0) THEN 15 ELSE 0 END + CASE WHEN bool_or(tables > 0) THEN 10 ELSE 0 END)"
_BOT = {"GPTBot": "CASE m % 4 WHEN 1 THEN 'allowed' WHEN 2 THEN 'blocked' WHEN 3 THEN 'blocked' END", "other": "CASE m % 4 WHEN 1 THEN 'allowed' WHEN 2 THEN 'partially_restricted' WHEN 3 THEN 'blocked' END"}
_POINTS = " + ".join(f"CASE bot_{b} WHEN 'allowed' THEN {n} WHEN 'partially_restricted' THEN {n // 2} ELSE 0 END" for b, n in S.BOT_POINTS.items())
_WEIGHT = "CASE factor " + " ".join(f"WHEN '{f}' THEN {w}" for _, f, w in site_scores.FACTORS) + " END"
_LENS = "CASE factor " + " ".join(f"WHEN '{f}' THEN '{lens}'" for lens, f, _ in site_scores.FACTORS) + " END"
_VERDICT_POINTS = "CASE verdict WHEN 'supported' THEN 100 WHEN 'partially_supported' THEN 50 WHEN 'not_applicable' THEN NULL ELSE 0 END"
_CURVE = "round(least(100 * pow(({0}) / ({1}) / 100, 1.15), 100.0), 1)"
_RATED = "CASE lens " + " ".join(f"WHEN '{lens}' THEN CASE " + " ".join(f"WHEN round_even(composite, 0) <= {high} THEN '{label}'" for high, label in S.RATINGS[lens]) + " END" for lens in S.RATINGS) + " END"
_CHAIN = f"""WITH page AS (
  SELECT m.*, i.* EXCLUDE (page_id), page_id % 7 AS o FROM ({METRICS}) m JOIN ({_IMAGES}) i USING (page_id)
), scored AS (
  SELECT *, least(100, CASE WHEN h1_count = 1 THEN 15 ELSE 0 END + CASE WHEN depth >= 2 THEN 15 ELSE 0 END + CASE WHEN lists > 0 THEN 10 ELSE 0 END + CASE WHEN tables > 0 THEN 10 ELSE 0 END + CASE WHEN words >= 300 THEN 15 ELSE 0 END
    + CASE WHEN words >= 1000 THEN 10 ELSE 0 END + CASE WHEN paragraphs >= 5 THEN 10 ELSE 0 END + CASE WHEN headings_total >= 5 THEN 10 ELSE 0 END + CASE WHEN images_total > 0 AND images_with_alt / images_total >= 0.8 THEN 10 ELSE 0 END) AS points,
    CASE WHEN o = 3 THEN date_diff('day', DATE '2024-01-01', DATE '{AS_OF}') + date_diff('day', CAST('2023-11-2' || page_id % 10 AS DATE), DATE '{AS_OF}') ELSE 0 END AS ages, greatest(words, {site_scores.EXPANDED}) AS longer FROM page
), sites AS (
  SELECT site, min(page_id) AS m, count(*) AS n_pages, round_even(100.0 * count(*) FILTER (o <> 5) / count(*), 1) AS coverage, 2 * count(*) FILTER (o = 0) AS asked, count(*) FILTER (o = 0) AS fitting, bool_or(o = 3) AS author,
    bool_or(o IN (2, 6) OR contains(lower(url), 'contact')) AS contact, bool_or(contains(lower(url), 'privacy') OR contains(lower(url), 'terms') OR contains(lower(url), 'legal')) AS legal,
    CASE WHEN bool_or(o = 3) THEN sum(ages) / (2.0 * count(*) FILTER (o = 3)) END AS freshness_days, avg(points) AS structure, 100.0 * count(*) FILTER (words > 300) / count(*) AS ratio, {_DEEP.format("words")} AS depth, {_DEEP.format("longer")} AS depth_if_longer,
    sum(images_total) AS images, sum(images_with_alt) AS described, bool_or(o = 0) AS has_faq, bool_or(o = 4) AS has_howto,
    count(DISTINCT CASE o WHEN 0 THEN 'FAQPage' WHEN 1 THEN 'Organization' WHEN 2 THEN 'WebPage' WHEN 3 THEN 'Article' WHEN 4 THEN 'HowTo' WHEN 6 THEN 'ContactPage' END) + CASE WHEN bool_or(o = 6) AND NOT bool_or(o = 3) THEN 1 ELSE 0 END AS types,
    count(DISTINCT CASE o WHEN 1 THEN 'Acme' WHEN 2 THEN 'Acme ' || page_id END) <= 1 AS name_ok, true AS description_ok, bool_or(o IN (1, 2)) AS organisation FROM scored GROUP BY site
), signals AS (
  SELECT *, m % 4 > 0 AS robots, {_BOT["GPTBot"]} AS bot_GPTBot, {_BOT["other"]} AS bot_ClaudeBot, {_BOT["other"]} AS bot_PerplexityBot, m % 3 = 0 AS llms, m % 5 = 1 AS llms_full, m % 2 = 1 AS sitemap FROM sites
), answers AS (
  SELECT site, m, q, ['{"', '".join(VERDICTS)}'][(m + q) % 5 + 1] AS verdict, (m + q) % 3 AS n_sources FROM sites, range(5) t(q)
), answerability AS (
  SELECT site, m, avg(CASE WHEN verdict = 'not_applicable' THEN NULL WHEN n_sources > 0 THEN {_VERDICT_POINTS} ELSE 0 END) AS score FROM answers GROUP BY ALL
), measured AS (
  SELECT site, m, 'schema' AS factor, least(100.0, coverage + 10 * CAST(has_faq AS INT) + 5 * CAST(has_howto AS INT) + CASE WHEN asked > 0 AND fitting >= greatest(1, asked // 2) THEN 10 ELSE 0 END) AS score FROM signals
  UNION ALL SELECT site, m, 'content_structure', structure FROM signals
  UNION ALL SELECT site, m, 'freshness', CASE WHEN freshness_days <= 30 THEN 100 WHEN freshness_days <= 90 THEN 80 WHEN freshness_days <= 180 THEN 60 WHEN freshness_days <= 365 THEN 40 WHEN freshness_days IS NOT NULL THEN 20 END FROM signals
  UNION ALL SELECT site, m, 'topical_authority', round_even(least(100.0, 0.35 * coverage + 0.25 * least(types / 10.0, 1.0) * 100 + CASE WHEN name_ok THEN 15 ELSE 0 END + 15 + 0.10 * ratio), 1) FROM signals
  UNION ALL SELECT site, m, 'eeat', 30 * CAST(organisation AS INT) + 30 * CAST(author AS INT) + 20 * CAST(contact AS INT) + 20 * CAST(legal AS INT) FROM signals
  UNION ALL SELECT site, m, 'crawl_access', round_even((8 * CAST(robots AS INT) + {_POINTS} + 15 * CAST(llms AS INT) + 8 * CAST(llms_full AS INT) + 7 * CAST(sitemap AS INT)) * 100 / 77.0, 1) FROM signals
  UNION ALL SELECT site, m, 'content_depth', round_even(depth, 1) FROM signals
  UNION ALL SELECT site, m, 'entity_consistency', round_even((CASE WHEN name_ok THEN 20 ELSE 0 END + 15) * 100 / 35.0, 1) FROM signals
  UNION ALL SELECT site, m, 'answerability', CASE WHEN m % 6 > 0 THEN score END FROM answerability
  UNION ALL SELECT site, m, unnest(['{"', '".join(S.WEIGHTS["AAX"])}']), NULL FROM signals
), factors AS (SELECT site, m, {_LENS} AS lens, factor, CAST(score AS DOUBLE) AS score, CAST({_WEIGHT} AS DOUBLE) AS weight FROM measured
), sums AS (SELECT site, lens, sum(score * weight) AS s, sum(weight) FILTER (score IS NOT NULL) AS w FROM factors GROUP BY ALL
), composites AS (SELECT site, lens, CASE WHEN w > 0 THEN {_CURVE.format("s", "w")} END AS composite FROM sums)"""


@query(_CHAIN + " SELECT site, lens, factor, round(score, 6) AS score, weight FROM factors")
def site_factors(spark, sf_dir):
    return _factors(spark, sf_dir)[3].withColumn("score", F.round("score", 6)).withColumn("weight", F.col("weight").cast("double"))


@query(_CHAIN + f" SELECT site, lens, composite, {_RATED} AS rating FROM composites")
def site_composites(spark, sf_dir):
    return site_scores.composites(_factors(spark, sf_dir)[3])


_WIDE = ", ".join(f"max(score) FILTER (factor = '{f}') AS s_{f}" for _, f, _ in site_scores.FACTORS)
_RULES = " UNION ALL ".join(f"SELECT site, '{fix}' AS fix, '{factor}' AS factor, least(100.0, CAST({target} AS DOUBLE)) AS target FROM wide WHERE {when}" for factor, fix, when, target in FIX_ROWS)


@query(_CHAIN + f""", wide AS (SELECT signals.*, s.* EXCLUDE (site), s.s_topical_authority AS topical FROM signals JOIN (SELECT site, {_WIDE} FROM factors GROUP BY site) s USING (site)
), open AS (SELECT site, q, verdict, avg({_VERDICT_POINTS}) OVER (PARTITION BY site) AS s, count({_VERDICT_POINTS}) OVER (PARTITION BY site) AS n FROM answers WHERE m % 6 > 0
), proposed AS ({_RULES} UNION ALL SELECT site, 'answer: q' || q, 'answerability', least(100.0, s + 100.0 / n) FROM open WHERE verdict IN ('unsupported', 'contradictory')
), gained AS (
  SELECT p.site, p.fix, p.factor, f.lens, round({_CURVE.format("s - coalesce(f.score * f.weight, 0) + target * f.weight", "w - CASE WHEN f.score IS NULL THEN 0 ELSE f.weight END + f.weight")} - {_CURVE.format("s", "w")}, 1) AS points
  FROM proposed p JOIN factors f ON f.site = p.site AND f.factor = p.factor JOIN sums ON sums.site = f.site AND sums.lens = f.lens
)
SELECT site, lens, factor, fix, points, CASE WHEN points >= 3 THEN 'high' WHEN points >= 1 THEN 'medium' ELSE 'low' END AS priority, CAST(row_number() OVER (PARTITION BY site ORDER BY points DESC, fix) AS INTEGER) AS place FROM gained WHERE points > 0""")
def site_fixes(spark, sf_dir):
    signals, answers, _, factors = _factors(spark, sf_dir)
    return site_scores.fixes(signals, factors, answers)


@query(_CHAIN + f""", later AS (SELECT f.site, lens, CASE WHEN factor = 'answerability' THEN a.score ELSE f.score END AS score, weight FROM factors f JOIN answerability a USING (site)
), again AS (SELECT site, lens, CASE WHEN sum(weight) FILTER (score IS NOT NULL) > 0 THEN {_CURVE.format("sum(score * weight)", "sum(weight) FILTER (score IS NOT NULL)")} END AS composite FROM later GROUP BY ALL)
SELECT site, lens, composite, {_RATED} AS rating FROM again""")
def site_rescored(spark, sf_dir):
    """Composites once the answers of the remaining sites have come in."""
    _, _, late, factors = _factors(spark, sf_dir)
    return site_scores.rescored(factors, site_scores.composites(factors), site_scores.answered(late))
