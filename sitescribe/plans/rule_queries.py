"""Queries over rules: fixes, structured payloads, job states and viewers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as N
from ..functions import predicates as P
from ..functions import urls as U
from ..operators import jobs, recommend
from ..sources.tables import read, runs
from .page_queries import CANONICAL_PATH, DOMAIN, ORACLES, QUERIES, query
from .run_queries import RUNS

__all__ = ["ORACLES", "QUERIES"]

# Signals made from a supplier's number and balance, so that each rule applies to some.
SIGNALS = {
    "coverage": "k * 7 % 101", "has_faq": "k % 2 = 0", "structure": "k * 3 % 101", "freshness_days": "k * 11 % 500", "name_ok": "k % 3 > 0", "description_ok": "k % 5 > 0",
    "organisation": "k % 2 > 0", "author": "k % 3 = 0", "contact": "k % 7 > 0", "legal": "k % 4 > 0", "robots": "k % 5 > 1", "llms": "k % 6 > 3", "llms_full": "k % 6 > 4",
    "sitemap": "k % 3 > 1", "topical": "k * 13 % 101", "depth": "k * 17 % 101", "depth_if_longer": "80.0", "images": "k % 9", "described": "k % 9 * (k % 3) / CAST(3 AS DOUBLE)",
    "s_schema": "k * 7 % 60 + 0.5", "s_content_structure": "k * 3 % 90 + 0.0", "s_entity_consistency": "20.0", "s_eeat": "k % 50 + 0.0", "s_crawl_access": "k % 40 + 0.0", "s_topical_authority": "k % 60 + 0.0",
    "bot_GPTBot": "CASE k % 3 WHEN 0 THEN 'allowed' WHEN 1 THEN 'partially_restricted' ELSE 'blocked' END",
    "bot_ClaudeBot": "CASE k % 4 WHEN 0 THEN 'allowed' WHEN 1 THEN 'partially_restricted' ELSE 'blocked' END",
    "bot_PerplexityBot": "CASE k % 5 WHEN 0 THEN 'allowed' WHEN 1 THEN 'partially_restricted' ELSE 'blocked' END",
}
SITES = "SELECT k AS site, " + ", ".join(f"{e} AS {n}" for n, e in SIGNALS.items()) + " FROM (SELECT s_suppkey AS k FROM supplier)"
FIX_ROWS = [
    ("schema", "cover more pages with structured data", "coverage < 50", "80"), ("schema", "add an FAQ block", "NOT has_faq", "s_schema + 10"),
    ("content_structure", "structure the pages", "structure < 55", "70"),
    ("content_structure", "describe the images", "images > 0 AND described / images < 0.5", "s_content_structure + 10 * (1 - described / images)"),
    ("freshness", "update old pages", "freshness_days > 90 AND freshness_days <= 365", "CASE WHEN freshness_days <= 180 THEN 80 ELSE 60 END"),
    ("entity_consistency", "use one name", "NOT name_ok", "s_entity_consistency + 57.14"), ("entity_consistency", "use one description", "NOT description_ok", "s_entity_consistency + 42.86"),
    ("eeat", "say who runs the site", "NOT organisation", "s_eeat + 30"), ("eeat", "name authors", "NOT author", "s_eeat + 30"), ("eeat", "give a contact", "NOT contact", "s_eeat + 20"),
    ("eeat", "link legal pages", "NOT legal", "s_eeat + 20"), ("crawl_access", "publish robots.txt", "NOT robots", "s_crawl_access + 800 / 77.0"),
    ("crawl_access", "publish llms.txt", "NOT llms", "s_crawl_access + 1500 / 77.0"), ("crawl_access", "publish llms-full.txt", "NOT llms_full", "s_crawl_access + 800 / 77.0"),
    ("crawl_access", "publish a sitemap", "NOT sitemap", "s_crawl_access + 700 / 77.0"),
    ("topical_authority", "cover the topic on all pages", "topical < 60 AND coverage < 100", "s_topical_authority + 0.35 * (100 - coverage)"), ("content_depth", "write longer pages", "depth < 60", "depth_if_longer"),
    *[("crawl_access", f"let {b} in", f"bot_{b} <> 'allowed'", f"s_crawl_access + CASE WHEN bot_{b} = 'blocked' THEN {n}00 ELSE {n - n // 2}00 END / 77.0") for b, n in (("GPTBot", 15), ("ClaudeBot", 12), ("PerplexityBot", 12))],
]
FIXES = " UNION ALL ".join(f"SELECT site AS run, '{fix}' AS fix, '{factor}' AS factor, round(least(100.0, CAST({target} AS DOUBLE)), 6) AS target FROM s WHERE {when}" for factor, fix, when, target in FIX_ROWS)


@query(f"WITH s AS ({SITES}) {FIXES}")
def proposed_fixes(spark, sf_dir):
    k = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    sites = k.select(F.col("k").alias("site"), *[F.expr(e).alias(n) for n, e in SIGNALS.items()])
    return recommend.proposed(sites, recommend.geo_rules()).withColumn("target", F.round("target", 6))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(json_extract_string(props, '$.k') IS NULL AS INTEGER) AS missing FROM events")
def event_props(spark, sf_dir):
    """Numbers out of JSON texts; what is no object counts as empty."""
    k = N.number_at(N.parsed(F.col("props")), "$.k")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), k.isNull().cast("int").alias("missing"))


@query(f"""SELECT run_id, status = 'succeeded' AND created_at >= TIMESTAMP '1996-01-01' AS fresh, CASE WHEN series % 5 = 0 THEN 'ownerless_public' WHEN series % 5 = 1 THEN 'owner'
  WHEN priority = '1-URGENT' THEN 'public_non_owner' END AS role FROM ({RUNS})""")
def viewer_roles(spark, sf_dir):
    """Roles towards each run of a viewer who owns one series in five; urgent runs are public."""
    rows = runs(spark, sf_dir)
    owner = F.when(F.col("series") % 5 != 0, F.col("series") % 5)
    visibility = F.when(F.col("priority") == "1-URGENT", "public").otherwise("private")
    fresh = (F.col("status") == "succeeded") & P.cooled_down(F.lit("1996-01-01").cast("timestamp_ntz"), F.col("created_at"), 0)
    return rows.select("run_id", fresh.alias("fresh"), P.viewer_role(owner, F.lit(1), visibility).alias("role"))


@query(f"""WITH j AS (SELECT run_id, status, created_at, sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) OVER (ORDER BY created_at, run_id ROWS UNBOUNDED PRECEDING) AS n FROM ({RUNS}))
SELECT run_id, CASE WHEN status = 'pending' AND n <= 7 THEN 'running' ELSE status END AS state FROM j""")
def claimed_jobs(spark, sf_dir):
    table = runs(spark, sf_dir).select(F.col("run_id").alias("job_id"), F.col("status").alias("state"), "created_at", F.lit(None).cast("timestamp").alias("started_at"))
    return jobs.claimed(table, F.lit("2002-01-01").cast("timestamp"), 7).select(F.col("job_id").alias("run_id"), "state")


@query(f"""WITH p AS (SELECT page_id, url, {DOMAIN} AS host, {CANONICAL_PATH} AS path FROM pages), a AS (SELECT page_id AS question, host, path FROM p)
SELECT question, min(p.url) AS url FROM a JOIN p USING (host, path) GROUP BY question""")
def grounded_citations(spark, sf_dir):
    """Each page cited by its own address finds the first page with that address."""
    url = F.col("url")
    pages = read(spark, sf_dir, "pages").select("page_id", "url", U.domain_of(url).alias("host"), U.canonical_path(url).alias("path"))
    answers = pages.select(F.col("page_id").alias("question"), F.lit(0).alias("place"), "host", "path")
    return recommend.grounded(answers, pages.drop("page_id")).select("question", "url")


# One step takes the next text of every conversation.
@query("""WITH RECURSIVE t AS (SELECT conv_id AS site, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)) AS text FROM conversations
), steps AS (
  SELECT site, CAST(0 AS BIGINT) AS i, 600 AS room, false AS done, 0 AS n_texts, CAST(0 AS BIGINT) AS n_chars FROM t WHERE i = 1
  UNION ALL
  SELECT site, i, CASE WHEN NOT done AND fits THEN room - need ELSE room END, done OR NOT fits, n_texts + CASE WHEN NOT done AND (fits OR room > 50) THEN 1 ELSE 0 END,
    n_chars + CASE WHEN done THEN 0 WHEN fits THEN length(text) WHEN room > 50 THEN kept ELSE 0 END
  FROM (SELECT s.site, t.i, room, done, n_texts, n_chars, text, CAST(ceil(length(text) / 4.0) AS INTEGER) AS need, need <= room AS fits, substr(text, 1, room * 4) AS c, length(c) - strpos(reverse(c), chr(10) || chr(10)) - 1 AS before,
    CASE WHEN contains(c, chr(10) || chr(10)) AND before > length(c) / 2.0 THEN before ELSE length(c) END AS kept FROM steps s JOIN t ON t.site = s.site AND t.i = s.i + 1)
) SELECT site, max_by(n_texts, i) AS n_texts, CAST(max_by(n_chars, i) AS INTEGER) AS n_chars FROM steps GROUP BY site""")
def token_budget_texts(spark, sf_dir):
    """What of each conversation, a sentence a paragraph, fits into a budget, the last text cut."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n\n"))
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("site"), F.col("turn").alias("place"), text.alias("text"))
    return jobs.budgeted(turns, 600, 50).select("site", F.size("admitted").alias("n_texts"), F.length(F.array_join("admitted", "")).alias("n_chars"))


# An address by a part's number, in the notation that its last digit says.
_V4 = "(k * 2654435761) % 4294967296"
_BITS = f"CASE k % 6 WHEN 4 THEN [167772160, 2886729728, 3232235520, 3221225472, 3325231104, 134744072, 2130706433, 1681915904][k // 6 % 8 + 1] + k % 200 ELSE {_V4} END"
_DOTTED = "(b // 16777216) || '.' || (b // 65536 % 256) || '.' || (b // 256 % 256) || '.' || (b % 256)"
_NOT_PUBLIC = " OR ".join(f"b BETWEEN {a} AND {z}" for a, z in ((0, 16777215), (167772160, 184549375), (1681915904, 1686110207), (2130706432, 2147483647), (2851995648, 2852061183), (2886729728, 2887778303), (3221225472, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055), (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (4026531840, 4294967295)))


@query(f"""WITH p AS (SELECT p_partkey AS k FROM part), v AS (SELECT k, CAST({_BITS} AS BIGINT) AS b FROM p)
SELECT k AS part, CASE k % 6 WHEN 1 THEN CAST(b AS VARCHAR) WHEN 2 THEN '0x' || lower(hex(b)) WHEN 3 THEN '[::ffff:' || {_DOTTED} || ']' WHEN 5 THEN '2001:db8::' || (k % 9000) ELSE {_DOTTED} END AS host,
  CASE WHEN k % 6 = 5 THEN true ELSE b NOT IN (3221225481, 3221225482) AND ({_NOT_PUBLIC}) END AS internal FROM v""")
def internal_addresses(spark, sf_dir):
    """Addresses in dotted, whole, hexadecimal, mapped and short notation."""
    k = F.col("p_partkey")
    few = F.array(*[F.lit(x).cast("long") for x in (167772160, 2886729728, 3232235520, 3221225472, 3325231104, 134744072, 2130706433, 1681915904)])
    bits = F.when(k % 6 == 4, F.element_at(few, (F.floor(k / 6) % 8 + 1).cast("int")) + k % 200).otherwise(k * F.lit(2654435761) % F.lit(4294967296))
    rows = read(spark, sf_dir, "part").select(k.alias("part"), bits.alias("b"))
    dotted = F.concat_ws(".", *[F.shiftright("b", n).bitwiseAND(255).cast("string") for n in (24, 16, 8, 0)])
    kind = F.col("part") % 6
    host = F.when(kind == 1, F.col("b").cast("string")).when(kind == 2, F.concat(F.lit("0x"), F.lower(F.hex("b")))).when(kind == 3, F.concat(F.lit("[::ffff:"), dotted, F.lit("]"))).when(kind == 5, F.concat(F.lit("2001:db8::"), F.col("part") % 9000)).otherwise(dotted)
    return rows.select("part", host.alias("host")).withColumn("internal", P.internal_host(F.col("host")))
