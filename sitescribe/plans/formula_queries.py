"""Queries over small formulas and summaries, with the tables' numbers as their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as N
from ..functions import predicates as P
from ..functions import text as X
from ..functions import urls as U
from ..operators import activity, audit, compare, extract, jobs, listing, recommend
from ..operators import summaries as M
from ..sources import sinks
from ..sources.tables import read, runs
from .page_queries import DOMAIN, ORACLES, QUERIES, query
from .run_queries import RUNS

__all__ = ["ORACLES", "QUERIES"]


@query("""SELECT event_id, used, used > 400 AS limited FROM (SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM events)""")
def trailing_sums(spark, sf_dir):
    return M.trailing_sum(read(spark, sf_dir, "events").withColumn("n", F.floor("value").cast("long")), 86400, "n", 400)


@query("""WITH e AS (SELECT lang AS site, doc_id AS place, unnest([source, 'x' || doc_id % 5, source]) AS item, unnest([0, 1, 2]) AS pos FROM documents)
SELECT site, string_agg(item, ',' ORDER BY first) AS items FROM (SELECT site, item, min((place, pos)) AS first FROM e GROUP BY ALL) GROUP BY site""")
def first_seen_items(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("lang").alias("site"), F.col("doc_id").alias("place"), F.array("source", F.concat(F.lit("x"), F.col("doc_id") % 5), "source").alias("items"))
    return M.first_seen(rows).withColumn("items", F.array_join("items", ","))


@query("""SELECT o_custkey AS site, min(o_orderdate) AS oldest, max(o_orderdate) AS newest, count(DISTINCT o_orderkey % 3) AS pages FROM orders GROUP BY ALL""")
def date_ranges(spark, sf_dir):
    return M.date_range(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), (F.col("o_orderkey") % 3).alias("url"), F.col("o_orderdate").alias("at")))


@query("""SELECT p_partkey AS run_id, CAST(greatest(p_size % 4, CASE WHEN p_size % 3 > 0 THEN p_size % 5 ELSE 0 END) AS INTEGER) AS pages, CAST(p_size % 2 AS INTEGER) AS emails, 0 AS internal, CAST(p_size AS INTEGER) AS external FROM part""")
def payload_counts(spark, sf_dir):
    size, of = F.col("p_size"), lambda n: F.array_repeat(F.lit("u"), n.cast("int"))
    lists = {"pages": of(size % 4), "markdowns": F.when(size % 3 > 0, of(size % 5)), "emails": of(size % 2), "internal": F.lit(None).cast("array<string>"), "external": of(size)}
    return M.structural_counts(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), *(c.alias(n) for n, c in lists.items())))


_LENSES = f"SELECT run_id, series, created_at, CASE WHEN run_id % 5 > 0 THEN round(score, 2) END AS aeo, CASE WHEN run_id % 3 = 0 THEN CAST(run_id % 90 AS DOUBLE) END AS geo, CASE WHEN run_id % 7 = 0 THEN 50.0 END AS aax FROM ({RUNS})"


@query(f"""SELECT run_id, CASE WHEN a IS NULL AND g IS NULL AND x IS NULL THEN NULL ELSE concat_ws('/', coalesce(CAST(sign(a) AS VARCHAR), '-'), coalesce(CAST(CAST(g AS INTEGER) AS VARCHAR), '-'), coalesce(CAST(CAST(x AS INTEGER) AS VARCHAR), '-')) END AS since FROM (
  SELECT run_id, round(aeo - lag(aeo) OVER w, 1) AS a, geo - lag(geo) OVER w AS g, aax - lag(aax) OVER w AS x FROM ({_LENSES}) WINDOW w AS (PARTITION BY series ORDER BY created_at, run_id))""")
def lens_deltas(spark, sf_dir):
    k = F.col("run_id")
    rows = runs(spark, sf_dir).select(k, "series", "created_at", F.when(k % 5 > 0, F.round("score", 2)).alias("aeo"), F.when(k % 3 == 0, (k % 90).cast("double")).alias("geo"), F.when(k % 7 == 0, 50.0).alias("aax"))
    text = lambda c: F.coalesce(c.cast("int").cast("string"), F.lit("-"))
    said = F.concat_ws("/", text(F.signum("since_last.aeo")), text(F.col("since_last.geo")), text(F.col("since_last.aax")))
    return M.lens_deltas(rows).select("run_id", F.when(F.col("since_last").isNotNull(), said).alias("since"))


_PRIORITY = "CASE event_type WHEN 'view' THEN 'low' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' ELSE event_type END"


@query(f"""SELECT user_id AS run, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) AS fixes FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE {_PRIORITY} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'info' THEN 3 ELSE 99 END, event_id) AS r FROM events) WHERE r <= 3 GROUP BY user_id""")
def top_fixes(spark, sf_dir):
    kind = F.col("event_type")
    priority = F.when(kind == "view", "low").when(kind == "purchase", "high").when(kind == "click", "medium").otherwise(kind)
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("place"), F.col("event_id").cast("string").alias("fix"), priority.alias("priority"))
    return M.top_fixes(rows).withColumn("fixes", F.array_join("fixes", ","))


@query("""WITH e AS (SELECT user_id AS run, CAST(floor(value) AS BIGINT) % 20 AS f, event_id % 2 AS side FROM events) SELECT run, count(*) FILTER (n = 2) AS unchanged FROM (SELECT run, f, count(DISTINCT side) AS n FROM e GROUP BY ALL) GROUP BY run""")
def unchanged_findings(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (F.floor("value") % 20).alias("finding"), (F.col("event_id") % 2).alias("side"))
    return M.unchanged_count(rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side"))


@query(f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'canon' || page_id || '.org' WHEN 1 THEN 'og.org' ELSE {DOMAIN} END AS domain FROM pages")
def canonical_domains(spark, sf_dir):
    k = F.col("page_id")
    canonical = F.when(k % 4 == 0, F.concat(F.lit("https://www.Canon"), k, F.lit(".org/x"))).when(k % 4 == 2, "/relative")
    return read(spark, sf_dir, "pages").select("page_id", M.canonical_domain(canonical, F.when(k % 4 <= 1, "http://og.org"), F.col("url")).alias("domain"))


@query("""SELECT lower(c_name) AS domain, 'mail@' || c_custkey AS email, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, '') AS title, CASE c_custkey % 2 WHEN 0 THEN 'New' ELSE 'won' END AS status, CASE WHEN c_custkey % 5 = 0 THEN 'A,beta' ELSE '' END AS tags, '2024-01-0' || (c_custkey % 9 + 1) AS updated FROM customer
WHERE c_custkey % 2 = 0 AND c_custkey % 5 = 0 AND (contains(lower(c_name), '7') OR c_custkey % 3 > 0 AND contains(lower(c_mktsegment), 'build'))""")
def prospect_contacts(spark, sf_dir):
    k, q = F.col("c_custkey"), "build"
    rows = read(spark, sf_dir, "customer").select(
        F.lower("c_name").alias("domain"), F.concat(F.lit("mail@"), k).alias("email"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("title"), F.when(k % 2 == 0, "New").otherwise("won").alias("status"),
        F.when(k % 5 == 0, "A,beta").alias("tags"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 9).cast("int")).alias("updated_at"),
    )
    found = M.prospects(rows, status="NEW", q=q, tag="Beta").unionByName(M.prospects(rows, status="new", q="7", tag="BETA")).distinct()
    return M.contact_rows(found)


@query(f"""SELECT run_id, CASE WHEN status = 'pending' AND stuck THEN CASE WHEN site AND run_id % 5 > 0 THEN 'succeeded' ELSE 'failed' END WHEN status = 'pending' THEN 'running' ELSE status END AS state, CASE WHEN status = 'pending' AND stuck THEN 'time_budget_exceeded' END AS note FROM (
  SELECT run_id, status, run_id % 2 = 0 AS site, CASE WHEN run_id % 2 = 0 THEN run_id % 1000 > 600 + 60 ELSE run_id % 1000 > 180 END AS stuck FROM ({RUNS}))""")
def finalised_jobs(spark, sf_dir):
    """Jobs that began as many seconds ago as their number's last three digits say."""
    now, k = F.lit("2024-01-01 12:00:00").cast("timestamp"), F.col("run_id")
    rows = runs(spark, sf_dir).select(
        k, F.when(F.col("status") == "pending", "running").otherwise(F.col("status")).alias("state"), F.when(k % 2 == 0, "site").otherwise("page").alias("scope"),
        (now - F.make_interval(secs=k % 1000)).alias("started_at"), F.lit(600).alias("budget"), (k % 5).alias("visited"),
    )
    return M.finalised(rows, now).select("run_id", "state", "note")


@query("""WITH s AS (SELECT p_partkey AS k, p_size AS n FROM part) SELECT k AS part, k % 3 = 2 AS is_site, CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS texts, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS objects, k % 2 = 0 AS has_author, greatest(5, least(n, 40)) AS clamped,
  1 + CAST(k % 2 = 0 AS INTEGER) AS said, CAST(CASE WHEN k % 2 = 0 THEN n % 4 ELSE 0 END AS INTEGER) AS length, CASE WHEN k % 3 = 0 THEN 'r' || k ELSE 'l' END AS merged, k % 5 = 0 AS any_in, CAST(least(100, round(100.0 * k / greatest(n, 1))) AS INTEGER) AS progress FROM s""")
def nested_values(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    params = F.when(k % 3 == 0, None).when(k % 3 == 1, " null ").otherwise('{"depth": 1}')
    v = F.parse_json(F.when(k % 4 == 0, '["a", {"b": 1}]').when(k % 4 == 1, '"one"').when(k % 4 == 2, "5").otherwise("null"))
    left, right = F.create_map(F.lit("a"), F.lit("l")), F.when(k % 3 == 0, F.create_map(F.lit("a"), F.concat(F.lit("r"), k))).otherwise(F.create_map(F.lit("b"), F.lit("x")))
    return read(spark, sf_dir, "part").select(
        k.alias("part"), M.site_scope(params).alias("is_site"), F.size(N.texts(v)).alias("texts"), F.coalesce(F.size(N.objects(v)), F.lit(0)).alias("objects"), N.has_key(F.when(k % 2 == 0, F.array(F.lit("Author"))).otherwise(F.array(F.lit("authors"))), "author").alias("has_author"),
        N.clamped(n, 5, 40).alias("clamped"), N.true_count([k, F.when(k % 2 == 0, "x"), F.lit(""), F.lit(None)]).alias("said"), N.length_of(F.when(k % 2 == 0, F.array_repeat(F.lit("u"), n % 4))).alias("length"),
        N.merged(left, right)["a"].alias("merged"), N.any_in(F.when(k % 5 == 0, "a Privacy page").otherwise("home"), ["privacy", "legal"]).alias("any_in"), jobs.progress(k, n).alias("progress"),
    )


@query(f"""SELECT run_id, run_id % 3 = 0 AND run_id % 2 > 0 AND run_id % 5 > 0 AND status = 'succeeded' AS public, run_id % 2 > 0 AND created_at <= TIMESTAMP '1995-06-01' AS claimable, created_at <= TIMESTAMP '1995-06-02' - INTERVAL 1 HOUR AS cooled,
  CASE WHEN run_id % 4 = 0 THEN 'http 403' WHEN run_id % 4 = 1 AND run_id % 60 < 50 THEN 'challenge page' END AS blocked, run_id % 3 = 0 OR run_id % 6 < 3 OR run_id % 4 = 0 AS comparable, CASE WHEN run_id % 7 = 0 THEN 'save' WHEN run_id % 2 = 0 THEN 'watch' END AS nudge,
  CASE run_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Time budget reached' WHEN 2 THEN 'Cancelled by the owner' ELSE 'Analysis failed' END AS label FROM ({RUNS})""")
def run_conditions(spark, sf_dir):
    k, at = F.col("run_id"), F.col("created_at")
    rows = runs(spark, sf_dir)
    kind = rows.schema["created_at"].dataType
    now = F.lit("1995-06-02").cast(kind)
    owner = F.when(k % 2 == 0, "u")
    versions = (F.when(k % 3 > 0, 1), F.when(k % 4 > 0, F.when(k % 6 < 3, 1).otherwise(2)))
    error = F.when(k % 4 == 1, " TIME_BUDGET_EXCEEDED").when(k % 4 == 2, "cancelled_by_user").when(k % 4 == 3, "Traceback")
    return rows.select(
        "run_id", P.public(F.when(k % 3 == 0, "public").otherwise("private"), owner, k % 5 > 0, F.col("status")).alias("public"), P.claimable(owner, at, now).alias("claimable"), P.cooled_down(at, now).alias("cooled"),
        P.start_page_blocked(F.when(k % 4 == 0, 403).otherwise(200), F.when(k % 4 == 1, "Just a moment").otherwise("Home"), k % 60, ["just a moment"]).alias("blocked"), P.comparable(*versions).alias("comparable"),
        jobs.nudge([("save", k % 7 == 0), ("watch", k % 2 == 0)]).alias("nudge"), X.public_error_label(error).alias("label"),
    )


@query(r"""SELECT doc_id, left(replace(replace(coalesce(text, ''), '|', '\|'), chr(10), ' '), 30) AS cell, replace(left(coalesce(text, ''), 40), '</', '<' || chr(8203) || '/') AS neutral, CASE WHEN doc_id % 90 < 60 THEN (doc_id % 90) || 's ago' ELSE '1m ago' END AS ago, length(left(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g'), 64)) AS kept FROM documents""")
def text_formulas(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.substring(F.regexp_replace(F.replace(F.replace(text, F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit(" ")), "$^", ""), 1, 30).alias("cell"), X.neutral_tags(F.substring(text, 1, 40)).alias("neutral"),
        X.relative_time(now - F.make_interval(secs=F.col("doc_id") % 90), now).alias("ago"), F.length(X.byte_capped(F.regexp_replace(text, "[^ -~]", ""), 64)).alias("kept"),
    )


@query("""WITH q AS (SELECT conv_id AS run, turn AS question, CASE (conv_id + turn) % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'partially_supported' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'contradictory' ELSE 'not_applicable' END AS verdict FROM conversations),
p AS (SELECT *, CASE verdict WHEN 'supported' THEN 100 WHEN 'partially_supported' THEN 50 WHEN 'not_applicable' THEN NULL ELSE 0 END AS points FROM q)
SELECT run, 'answer: q' || question AS fix, round(least(100.0, (SELECT avg(points) FROM p b WHERE b.run = p.run) + 100.0 / (SELECT count(points) FROM p b WHERE b.run = p.run)), 6) AS target FROM p WHERE verdict IN ('unsupported', 'contradictory')""")
def unanswered_questions(spark, sf_dir):
    names = F.array(*map(F.lit, ("supported", "partially_supported", "unsupported", "contradictory", "not_applicable")))
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.concat(F.lit("q"), F.col("turn")).alias("question"), F.element_at(names, ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int")).alias("verdict"))
    return recommend.unanswered(rows).select("run", "fix", F.round("target", 6).alias("target"))


@query(f"""SELECT site, 'gone' AS change, page_id FROM (SELECT {DOMAIN} AS site, page_id FROM pages) WHERE page_id % 6 = 0""")
def origin_prefixes(spark, sf_dir):
    """Pages that are not below the prefix of their own, mangled address."""
    k = F.col("page_id")
    bare = F.regexp_replace("url", "[?#].*$", "")
    other = F.when(k % 6 == 0, F.concat(U.origin_prefix(F.col("url")), F.lit("x"))).otherwise(F.concat(U.origin_prefix(F.col("url")), F.when(k % 2 == 0, "/a").otherwise("?a")))
    return read(spark, sf_dir, "pages").where(bare.isNotNull() & ~U.same_origin_prefix(other, U.origin_prefix(F.col("url")))).select(U.domain_of(F.col("url")).alias("site"), F.lit("gone").alias("change"), "page_id")


@query(f"""SELECT site, names, descriptions, n_blocks, names <= 1 AS name_consistent, descriptions <= 1 AS description_consistent FROM (
  SELECT {DOMAIN} AS site, count(DISTINCT page_id % 2) AS names, count(DISTINCT CASE WHEN page_id % 3 > 0 THEN 'd' END) AS descriptions, count(*) AS n_blocks FROM pages GROUP BY ALL)""")
def entity_audit(spark, sf_dir):
    k = F.col("page_id")
    return audit.entity_consistency(read(spark, sf_dir, "pages").select(U.domain_of(F.col("url")).alias("site"), (k % 2).cast("string").alias("name"), F.when(k % 3 > 0, "d").alias("description")))


@query(f"""WITH p AS (SELECT {DOMAIN} AS site, page_id % 3 AS k FROM pages)
SELECT site, count(*) AS n_pages, count(*) FILTER (k > 0) AS with_schema, round_even(100.0 * count(*) FILTER (k > 0) / count(*), 1) AS coverage_pct, CASE WHEN count(*) FILTER (k > 0) > 0 THEN count(*) FILTER (k > 0) END AS articles FROM p GROUP BY site""")
def schema_audit(spark, sf_dir):
    k = F.col("page_id") % 3
    types = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("Article"))).otherwise(F.array(F.lit("Article"), F.lit("FAQPage")))
    out = audit.schema_coverage(read(spark, sf_dir, "pages").select(U.domain_of(F.col("url")).alias("site"), "page_id", types.alias("types")))
    return out.withColumn("type_counts", F.try_element_at("type_counts", F.lit("Article"))).withColumnRenamed("type_counts", "articles")


@query("""SELECT lens, factor, a AS before, b AS after, round(b - a, 1) AS delta FROM (SELECT p_brand AS lens, p_partkey AS factor, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS DOUBLE) END AS a, CASE WHEN p_partkey % 4 > 0 THEN p_size * 1.5 END AS b FROM part) WHERE a IS NOT NULL OR b IS NOT NULL""")
def factor_changes(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("lens"), F.col("p_partkey").alias("factor"), F.col("p_size").cast("double").alias("size"))
    old, new = rows.where("factor % 3 > 0").withColumnRenamed("size", "score"), rows.where("factor % 4 > 0").select("lens", "factor", (F.col("size") * 1.5).alias("score"))
    return compare.factor_diff(rows.select("lens", "factor"), old, new)


@query("""SELECT s_suppkey AS site, CAST(n AS INTEGER) AS place, CASE WHEN s_suppkey % 2 = 0 AND n = 0 THEN 'https://m.org/' || s_suppkey ELSE 'https://s' || s_suppkey || '.org' || ['/sitemap.xml', '/sitemap_index.xml', '/sitemap-index.xml', '/wp-sitemap.xml'][n + 1 - CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END] END AS url
FROM supplier, range(5) t(n) WHERE n < 4 OR s_suppkey % 2 = 0""")
def sitemap_places(spark, sf_dir):
    k = F.col("s_suppkey")
    robots = F.when(k % 2 == 0, F.concat(F.lit("User-agent: *\nSITEMAP: https://m.org/"), k, F.lit("\n")))
    return extract.sitemap_candidates(read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k, F.lit(".org")).alias("site"), robots.alias("robots"), k)).join(
        read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k, F.lit(".org")).alias("site"), k.alias("_k")), "site"
    ).select(F.col("_k").alias("site"), "place", "url")


@query("""SELECT s_suppkey AS site, CASE WHEN s_suppkey % 3 = 0 THEN 'first ' || s_suppkey ELSE 'second' END AS preview FROM supplier WHERE s_suppkey % 5 > 0 OR s_suppkey % 3 = 0""")
def llms_files(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(k.alias("site"), F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    k = F.col("site")
    text = F.when(F.col("place") == 0, F.when(k % 3 == 0, F.concat(F.lit("first "), k)).otherwise("<!DOCTYPE html>")).otherwise(F.when(k % 5 > 0, "second").otherwise("  "))
    return extract.llms_file(rows.select("site", F.lit("llms").alias("kind"), "place", text.alias("text"))).select("site", "preview")


@query("""SELECT c_custkey AS id, CAST(c_custkey % 9 AS INTEGER) AS day FROM customer WHERE c_custkey % 9 < 5 OR c_custkey % 9 = 5 AND c_custkey < 400 ORDER BY c_custkey % 9 DESC, c_custkey DESC LIMIT 21""")
def prospect_page(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 9).cast("int").alias("day"))
    return listing.next_page(rows, "day", "id", (5, 400), 20)


@query("""WITH f AS (SELECT * FROM (SELECT o_custkey AS series, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) ORDER BY n DESC, last, series LIMIT 500) SELECT series, n FROM f WHERE series % 2 = 0 ORDER BY n DESC, last, series LIMIT 30""")
def most_visited(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("series")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    return listing.first_then_filtered(rows, [F.desc("n"), F.col("last"), F.col("series")], 500, F.col("series") % 2 == 0, 30).select("series", "n")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls FROM events GROUP BY ALL")
def merged_usage(spark, sf_dir):
    """Counters of half of the events, upserted into those of the other half."""
    events = read(spark, sf_dir, "events")
    counted = lambda odd: activity.daily_usage(events.where(F.col("event_id") % 2 == odd)).select("user_id", "day", "calls")
    return activity.merged_usage(counted(0), counted(1))


_TEXT = "CASE WHEN {0} IS NULL THEN '—' ELSE printf('%.1f', {0}) END"
_SIGNED = "CASE WHEN {0} IS NULL THEN '—' WHEN {0} > 0 THEN '+' || printf('%.1f', {0}) ELSE printf('%.1f', {0}) END"
_SERIES = "SELECT user_id AS series, event_id AS run_no, CASE WHEN event_id % 9 > 0 THEN CAST(event_id % 97 AS DOUBLE) + 0.25 END AS score, CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 7 - 3 AS DOUBLE) END AS delta FROM events"


def _history(spark, sf_dir):
    k = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("series"), k.alias("run_no"), F.when(k % 9 > 0, (k % 97).cast("double") + 0.25).alias("score"), F.when(k % 4 > 0, (k % 7 - 3).cast("double")).alias("delta")
    )


@query(f"""SELECT series, '| Run | Score | Change |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || run_no || ' | ' || {_TEXT.format("score")} || ' | ' || {_SIGNED.format("delta")} || ' |', chr(10) ORDER BY run_no) AS markdown FROM ({_SERIES}) GROUP BY series""")
def run_reports(spark, sf_dir):
    return sinks.report(_history(spark, sf_dir))


@query(f"""SELECT series AS lens, string_agg('| f' || run_no || '\\| | ' || {_TEXT.format("score")} || ' | ' || {_TEXT.format("delta")} || ' | ' || {_SIGNED.format("delta")} || ' |', chr(10) ORDER BY 'f' || run_no || '|') AS markdown FROM ({_SERIES}) GROUP BY series""")
def factor_reports(spark, sf_dir):
    rows = _history(spark, sf_dir).select(F.col("series").alias("lens"), F.concat(F.lit("f"), F.col("run_no"), F.lit("|")).alias("factor"), F.col("score").alias("before"), F.col("delta").alias("after"), "delta")
    return sinks.diff_report(rows)


@query("""SELECT string_agg('<loc>https://a.org/' || o_orderkey || '?a=1&amp;b</loc>' || strftime(o_orderdate, '%Y-%m-%d'), ' ' ORDER BY o_orderdate DESC, 'https://a.org/' || o_orderkey || '?a=1&b') AS entries FROM (
  SELECT * FROM orders ORDER BY o_orderdate DESC, 'https://a.org/' || o_orderkey || '?a=1&b' LIMIT 500)""")
def sitemap_files(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("https://a.org/"), F.col("o_orderkey"), F.lit("?a=1&b")).alias("loc"), F.col("o_orderdate").alias("lastmod"))
    found = F.regexp_extract_all("xml", F.lit(r"(?s)(<loc>[^<]*</loc>)\s*<lastmod>[^<]*</lastmod>"), 1)
    days = F.regexp_extract_all("xml", F.lit("<lastmod>([^<]*)</lastmod>"), 1)
    return sinks.sitemap(rows).select(F.array_join(F.zip_with(found, days, lambda a, b: F.concat(a, b)), " ").alias("entries"))


@query(f"""WITH p AS (SELECT {DOMAIN} AS site, page_id % 4 AS url, page_id FROM pages) SELECT site, url, min(page_id) AS page_id FROM p GROUP BY ALL""")
def first_of_pages(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(U.domain_of(F.col("url")).alias("site"), (F.col("page_id") % 4).alias("url"), "page_id")
    return audit.first_of_page(rows)


@query(f"""SELECT page_id FROM (SELECT page_id, {DOMAIN} AS host FROM pages) WHERE page_id % 5 = 0 OR page_id % 5 = 1 AND host <> 'other.org'""")
def canonical_mismatches(spark, sf_dir):
    """Canonical addresses: another path of the page's host, another host, the page itself in other spelling, none."""
    k, path = F.col("page_id") % 5, F.regexp_replace(U.path_of(F.col("url")), "/+$", "")
    canonical = F.when(k == 0, F.concat(path, F.lit("/other"))).when(k == 1, F.concat(F.lit("https://other.org"), path)).when(k == 2, F.concat(path, F.lit("/?x=1"))).when(k == 3, F.concat(F.lit("http://www."), U.domain_of(F.col("url")), path))
    return audit.canonical_mismatches(read(spark, sf_dir, "pages").select("page_id", "url", F.when(path != "", canonical).otherwise(F.when(k <= 1, F.lit("https://other.org/x"))).alias("canonical"))).select("page_id")


@query("""SELECT p_partkey AS part, 'https://s.org/' || CASE p_partkey % 5 WHEN 0 THEN 'a/b/x' || p_partkey WHEN 1 THEN 'x' || p_partkey WHEN 2 THEN 'a/x' || p_partkey WHEN 3 THEN 'y' || p_partkey ELSE 'a/b' END AS url FROM part""")
def absolute_links(spark, sf_dir):
    k = F.col("p_partkey")
    forms = [F.concat(F.lit("x"), k, F.lit("?q=1")), F.concat(F.lit("/x"), k, F.lit("/")), F.concat(F.lit("../x"), k, F.lit("#f")), F.concat(F.lit("HTTPS://S.ORG/y"), k), F.lit("./")]
    rows = read(spark, sf_dir, "part").select(k.alias("part"), F.lit("https://s.org/a/b/c").alias("base"), F.element_at(F.array(*forms), (k % 5 + 1).cast("int")).alias("href"))
    return rows.select("part", extract.absolute("href", "base").alias("url"))


@query("""SELECT p_partkey AS part, CASE p_partkey % 6 WHEN 4 THEN '' ELSE 'user' || p_partkey || '@acme' || p_size || CASE p_partkey % 6 WHEN 1 THEN '.co' WHEN 5 THEN '.net' ELSE '.org' END END AS emails FROM part""")
def deobfuscated_emails(spark, sf_dir):
    """Addresses spelled out in brackets, in words, with blanks, plainly, not at all, and without blanks."""
    k = F.col("p_partkey")
    forms = ["mail user# [at] acme~ (dot) org now", "user# at acme~ dot co dot uk", "user#@acme~ . org . We write", "contact us at user#@acme~.org. Thanks", "user# @ company~", "it is user#{AT}acme~[ dot ]net, dot by dot"]
    text = F.replace(F.replace(F.element_at(F.array(*map(F.lit, forms)), (k % 6 + 1).cast("int")), F.lit("#"), k.cast("string")), F.lit("~"), F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select(k.alias("part"), F.array_join(X.emails(extract.deobfuscated(text)), ",").alias("emails"))


@query("""SELECT p_partkey AS page_id, unnest(CASE p_partkey % 3 WHEN 0 THEN ['info' || p_partkey || '@aa.org'] WHEN 1 THEN ['xx' || p_partkey || '@bb.org', 'y+z@cc.org'] ELSE ['text' || p_partkey || '@dd.org', 'hid' || p_partkey || '@ee.org'] END) AS email,
  unnest(CASE p_partkey % 3 WHEN 0 THEN ['mailto,text'] WHEN 1 THEN ['mailto', 'mailto'] ELSE ['text', 'obfuscated'] END) AS found_as FROM part""")
def made_page_emails(spark, sf_dir):
    """Addresses on made pages, and the ways in which each was found."""
    k = F.col("p_partkey")
    forms = [
        '<p>write <a href="mailto:Info#@aa.org?subject=hi">to us</a> or info#@aa.org</p><script>no#@nono.org</script>', '<a href="mailto:xx#%40bb.org;y+z@cc.org">m</a><a href="MAILTO:">n</a>',
        "<div>text#@dd.org<br>hid# [at] ee [dot] org</div>",
    ]
    html = F.replace(F.element_at(F.array(*map(F.lit, forms)), (k % 3 + 1).cast("int")), F.lit("#"), k.cast("string"))
    pages = extract.with_features(read(spark, sf_dir, "part").select(k.alias("page_id"), F.lit("https://s.org").alias("url"), html.alias("html")))
    return extract.found_emails(pages).withColumn("found_as", F.array_join("found_as", ","))


@query("""SELECT p_partkey AS page_id, 'Title ' || p_partkey AS title, 'https://s.org/' || p_partkey AS canonical, 2 AS n_headings, 1 AS images_total, 1 AS images_with_alt, '# Head' || chr(10) || chr(10) || 'One **bold** [link](/x' || p_partkey || ') end.' || chr(10) || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || p_partkey || ' |' AS markdown FROM part""")
def made_page_features(spark, sf_dir):
    """Features and Markdown of made pages with noise in tags, roles, classes and ids."""
    page = """<html><head><title>Title #</title><link rel="canonical" href="https://s.org/#"></head><body><nav>menu</nav><div role="banner">top</div><h1>Head</h1><p>One <b>bold</b> <a href="/x#">link</a> end.</p>
      <ul><li>a<li>b</ul><div class="cookie-bar">c<h2>in noise</h2></div><div id="top-ads">d</div><table><tr><th>k<th>v<tr><td>1<td>#</table><img src="i" alt="x"><p class="no-md">e</p><footer>f</footer></body></html>"""
    k = F.col("p_partkey")
    pages = extract.with_features(read(spark, sf_dir, "part").select(k.alias("page_id"), F.lit("https://s.org").alias("url"), F.replace(F.lit(page), F.lit("#"), k.cast("string")).alias("html")))
    return pages.select("page_id", "f.title", "f.canonical", F.size("f.headings").alias("n_headings"), "f.images_total", "f.images_with_alt", "f.markdown")
