"""Queries over what leaves the library: records, contracts, previews, orders and small audits, made of the tables' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import urls as U
from ..operators import projections as P
from ..sources.tables import read, runs
from .page_queries import DOMAIN, ORACLES, QUERIES, query
from .run_queries import RUNS

__all__ = ["ORACLES", "QUERIES"]

_TURNS = "SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations"


@query(f"""SELECT conv_id, turn, left('{"q" * 30}' || conv_id || '-{"z" * 12}', 40) AS question_id, left(text, 300) AS question, left(role, 32) AS verdict, left(text || text, 2000) AS answer,
  CAST(least(10, turn + 5) AS INTEGER) AS n_facts, CAST(least(20, 4 * turn) AS INTEGER) AS n_sources, length(left(text, 300)) * least(10, turn + 5) AS facts_length FROM ({_TURNS})""")
def answer_records(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    q = F.struct(
        F.concat(F.lit("q" * 30), "conv_id", F.lit("-" + "z" * 12)).alias("question_id"), F.col("text").alias("question"), F.col("role").alias("verdict"), F.concat("text", "text").alias("answer"),
        F.array_repeat("text", (F.col("turn") + 5).cast("int")).alias("missing_facts"), F.array_repeat(F.lit("/p"), (4 * F.col("turn")).cast("int")).alias("source_pages"),
    )
    out = rows.withColumn("q", q).select("conv_id", "turn", P.answer_record(F.col("q")).alias("r"))
    total = F.aggregate("r.missing_facts", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return out.select("conv_id", "turn", *(f"r.{c}" for c in P.LENGTHS), F.size("r.missing_facts").alias("n_facts"), F.size("r.source_pages").alias("n_sources"), total.alias("facts_length"))


@query(f"""WITH t AS ({_TURNS}) SELECT a.conv_id AS run, CAST(a.turn AS VARCHAR) AS question_id, left(a.text, 20) AS question, coalesce(b.role, '') AS verdict_before, a.role AS verdict_after FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id - 1 AND b.turn = a.turn""")
def verdict_movement(spark, sf_dir):
    """Each conversation against the one numbered before it."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").cast("string").alias("question_id"), F.substring(F.coalesce("text", F.lit("")), 1, 20).alias("question"), F.col("role").alias("verdict"))
    return P.verdict_movement(rows.withColumn("run", F.col("run") + 1), rows)


_LENSES = "range(3) l(k)"
_COMPOSITES = f"SELECT run_id, ['AEO', 'GEO', 'AAX'][k + 1] AS lens, CASE WHEN (run_id + k) % 4 > 0 THEN round(score + k, 1) END AS composite FROM ({RUNS}), {_LENSES}"
_FACTORS = f"SELECT run_id, ['AEO', 'GEO', 'AAX'][k + 1] AS lens, 'f' || (run_id % 3 - j) AS factor, CAST(run_id % 50 + j AS DOUBLE) AS score FROM ({RUNS}), {_LENSES}, range(2) t(j) WHERE k < 2"


def _of_runs(spark, sf_dir):
    table = runs(spark, sf_dir).withColumn("url", F.concat(F.lit("https://www.s"), F.col("series") % 50, F.lit(".org/p/"), F.col("run_id") % 9))
    table = table.withColumns({"crawl_params": F.when(F.col("run_id") % 2 == 0, "{}"), "visibility": F.when(F.col("run_id") % 3 > 0, "public").otherwise("private"), "owner": F.lit("secret")})
    lenses = table.select("run_id", "score", F.posexplode(F.array(*map(F.lit, ("AEO", "GEO", "AAX")))).alias("k", "lens"))
    composite = F.when((F.col("run_id") + F.col("k")) % 4 > 0, F.round(F.col("score") + F.col("k"), 1))
    composites = lenses.select("run_id", "lens", composite.alias("composite"), F.lit("r").alias("rating"))
    factors = lenses.where("k < 2").select("run_id", "lens", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    factors = factors.select("run_id", "lens", F.concat(F.lit("f"), F.col("run_id") % 3 - F.col("j")).alias("factor"), (F.col("run_id") % 50 + F.col("j")).cast("double").alias("score"), F.lit(0.5).alias("weight"))
    return table, composites, factors


@query(f"""WITH c AS ({_COMPOSITES}), f AS ({_FACTORS})
SELECT run_id, 'https://www.s' || series % 50 || '.org/p/' || run_id % 9 AS url, CASE WHEN run_id % 2 = 0 THEN 'site' ELSE 'page' END AS scope, status, CAST(3 AS INTEGER) AS n_lenses, (SELECT composite FROM c WHERE c.run_id = r.run_id AND lens = 'GEO') AS geo,
  (SELECT min(factor) FROM f WHERE f.run_id = r.run_id AND lens = 'AEO') AS first_factor, CAST(CASE WHEN run_id % 5 = 0 THEN 2 END AS INTEGER) AS n_answers FROM ({RUNS}) r WHERE status = 'succeeded'""")
def result_contracts(spark, sf_dir):
    table, composites, factors = _of_runs(spark, sf_dir)
    answers = table.where("run_id % 5 = 0").select("run_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("record"))
    out = P.contract(table, composites, factors, answers)
    return out.select("run_id", "url", "scope", "status", F.size("scores").alias("n_lenses"), F.col("scores")["GEO"]["composite"].alias("geo"), F.col("scores")["AEO"]["factors"][0]["factor"].alias("first_factor"), F.size("answerability").alias("n_answers"))


@query(f"""WITH c AS ({_COMPOSITES}) SELECT 's' || series % 50 || '.org' AS domain, '/p/' || run_id % 9 AS path, status, CAST((SELECT count(composite) FROM c WHERE c.run_id = r.run_id) AS INTEGER) AS n_scores,
  CASE WHEN run_id % 2 = 0 THEN 2 ELSE 0 END AS finding_count, CAST(run_id % 3 AS BIGINT) AS n_pages, CAST(2 * (run_id % 3) AS BIGINT) AS n_emails FROM ({RUNS}) r WHERE status = 'succeeded' AND run_id % 3 > 0""")
def public_previews(spark, sf_dir):
    table, composites, _ = _of_runs(spark, sf_dir)
    fixes = table.where("run_id % 2 = 0").select("run_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("fix"))
    pages = table.where("run_id % 3 > 0").select("run_id", F.explode(F.sequence(F.lit(1), (F.col("run_id") % 3).cast("int"))).alias("p"), F.lit(2).alias("n_emails"))
    out = P.public_preview(table, composites, fixes, pages)
    return out.withColumn("scores", F.coalesce(F.size("scores"), F.lit(0))).withColumnRenamed("scores", "n_scores").withColumn("finding_count", F.col("finding_count").cast("int"))


_RANK = "CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 WHEN 'info' THEN 3 ELSE 1 END"
_LISTED = "SELECT user_id AS run, event_id AS place, CASE WHEN event_id % 6 > 0 THEN CAST(floor(value) AS BIGINT) % 7 END AS points, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'info' END AS priority FROM events"


@query(f"""SELECT run, place, CAST(row_number() OVER (PARTITION BY run ORDER BY points IS NULL, points DESC, {_RANK}, place) AS INTEGER) AS shown, CAST(row_number() OVER (PARTITION BY run ORDER BY {_RANK}, place) AS INTEGER) AS compared FROM ({_LISTED})""")
def fix_orders(spark, sf_dir):
    k = F.col("event_id") % 5
    priority = F.when(k == 0, "high").when(k == 1, "medium").when(k == 2, "low").when(k == 3, "info")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("place"), F.when(F.col("event_id") % 6 > 0, F.floor("value") % 7).alias("points"), priority.alias("priority"))
    shown = P.shown_fixes(rows).select("run", "place", "priority", F.col("shown").alias("_shown"))
    return P.compared_fixes(shown).select("run", "place", F.col("_shown").alias("shown"), F.col("shown").alias("compared"))


@query(f"""SELECT run, url, max(place) AS place FROM (SELECT {DOMAIN} AS run, page_id AS place, CASE WHEN page_id % 4 > 0 THEN regexp_replace(url, '[?#].*$', '') ELSE '/p' || page_id % 3 END AS url FROM pages WHERE page_id % 9 > 0) GROUP BY ALL""")
def pages_by_url(spark, sf_dir):
    rows = read(spark, sf_dir, "pages")
    site, bare, k = U.domain_of(F.col("url")), F.regexp_replace("url", "[?#].*$", ""), F.col("page_id")
    nested = F.when(k % 9 > 0, F.when(k % 4 > 0, bare).otherwise(F.concat(F.lit("/p"), k % 3)))
    return P.pages_by_url(rows.select(site.alias("run"), k.alias("place"), F.when((k % 9 > 0) & (k % 2 > 0), nested).otherwise(F.lit("")).alias("url"), nested.alias("page_url")))


_MAILS = r"SELECT lang AS site, '/' || doc_id % 7 AS url, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'), lambda x: lower(x)))) AS email FROM documents"


@query(f"SELECT DISTINCT site, email FROM ({_MAILS}) WHERE url IN ('/1', '/4')")
def contact_emails(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("site"), F.concat(F.lit("/"), F.col("doc_id") % 7).alias("url"), "text")
    contact = docs.where(F.col("url").isin("/1", "/4")).select("site", "url")
    return P.contact_emails(P.emails_of(docs), contact)


@query("""SELECT site, CASE WHEN status IN (401, 403, 429, 503) THEN 'http ' || status WHEN contains(lower(title), 'just a moment') AND most < 50 THEN 'challenge page' END AS reason FROM (
  SELECT source AS site, CASE WHEN min(doc_id) % 3 = 0 THEN 403 ELSE 200 END AS status, CASE WHEN min(doc_id) % 2 = 0 THEN 'Just a Moment...' ELSE 'Home' END AS title, max(CASE WHEN ascii(right(source, 1)) % 4 = 0 THEN doc_id % 60 ELSE doc_id % 40 END) AS most FROM documents GROUP BY source)""")
def blocked_sites(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("m"))
    words = F.when(F.ascii(F.right(F.col("source"), F.lit(1))) % 4 == 0, F.col("doc_id") % 60).otherwise(F.col("doc_id") % 40)
    rows = docs.join(first, "source").select(
        F.col("source").alias("site"), (F.col("doc_id") == F.col("m")).alias("is_start"), F.when(F.col("m") % 3 == 0, 403).otherwise(200).alias("status"), F.when(F.col("m") % 2 == 0, "Just a Moment...").otherwise("Home").alias("title"), words.alias("words")
    )
    return P.blocked_sites(rows, ["just a moment"], [401, 403, 429, 503], 50)


@query(f"""WITH p AS (SELECT {DOMAIN} AS site, page_id, CASE page_id % 5 WHEN 0 THEN ' Same ' WHEN 1 THEN 'Same' WHEN 2 THEN 'Other' WHEN 3 THEN ' ' END AS t, page_id % 4 = 1 AS bad FROM pages)
SELECT site, 'mend canonical addresses' AS fix, 'schema' AS factor, count(*) AS n FROM p WHERE bad GROUP BY site UNION ALL
SELECT site, 'tell preview titles apart', 'content_structure', count(*) FROM (SELECT site, trim(t) AS t FROM p WHERE trim(t) <> '' GROUP BY ALL HAVING count(*) > 1) GROUP BY site""")
def page_identity_fixes(spark, sf_dir):
    k = F.col("page_id") % 5
    title = F.when(k == 0, " Same ").when(k == 1, "Same").when(k == 2, "Other").when(k == 3, " ")
    return P.page_identity_fixes(read(spark, sf_dir, "pages").select(U.domain_of(F.col("url")).alias("site"), "page_id", title.alias("og_title"), (F.col("page_id") % 4 == 1).alias("mismatched")))


@query(r"""WITH s AS (SELECT s_suppkey AS site, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow:' || chr(10) || 'Sitemap: https://a.org/' || s_suppkey || '.xml' ELSE 'user-agent: gptbot' || chr(10) || 'disallow: /' || chr(10) || ' sitemap:/é.xml' END AS t FROM supplier)
SELECT site, site % 4 > 1 AS found, CAST(CASE WHEN site % 4 > 1 THEN strlen(t) ELSE 0 END AS INTEGER) AS size_bytes, CASE site % 4 WHEN 2 THEN 'allowed' WHEN 3 THEN 'blocked' END AS gptbot, CASE WHEN site % 4 > 1 THEN 'allowed' END AS claudebot,
  CASE site % 4 WHEN 2 THEN 'https://a.org/' || site || '.xml' WHEN 3 THEN '/é.xml' ELSE '' END AS sitemaps FROM s""")
def robots_infos(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 1, "").when(k % 4 == 2, F.concat(F.lit("User-agent: *\nDisallow:\nSitemap: https://a.org/"), k, F.lit(".xml"))).when(k % 4 == 3, "user-agent: gptbot\ndisallow: /\n sitemap:/é.xml")
    out = P.robots_info(read(spark, sf_dir, "supplier").select(k.alias("site"), text.alias("text")))
    return out.select("site", "found", "size_bytes", F.try_element_at("bots", F.lit("GPTBot")).alias("gptbot"), F.try_element_at("bots", F.lit("ClaudeBot")).alias("claudebot"), F.array_join("sitemaps", ",").alias("sitemaps"))


@query("""SELECT p_partkey AS part, CASE p_partkey % 3 WHEN 0 THEN 'User-agent: <a> & "b"' || p_partkey WHEN 1 THEN 'plain ' || p_partkey ELSE '<div>' || p_partkey || '</div>' END AS text FROM part""")
def unwrapped_texts(spark, sf_dir):
    k = F.col("p_partkey")
    wrapped = F.concat(F.lit("<!DOCTYPE html><html><head><meta x></head>\n<body><pre style='a'> User-agent: &lt;a&gt; &amp; &quot;b&quot;"), k, F.lit("\n</pre></body></html>"))
    text = F.when(k % 3 == 0, wrapped).when(k % 3 == 1, F.concat(F.lit("<html><body><pre>plain "), k, F.lit("</pre></body></html>\n"))).otherwise(F.concat(F.lit(" <html><div>"), k, F.lit("</div>")))
    return read(spark, sf_dir, "part").select(k.alias("part"), P.unwrapped(text).alias("text"))


@query("""SELECT DISTINCT p_size AS site, 'https://s.org/a/' || p_partkey AS url FROM part WHERE p_partkey % 6 IN (0, 1)""")
def crawl_seeds(spark, sf_dir):
    k = F.col("p_partkey")
    forms = [F.concat(F.lit("HTTPS://S.org/a/"), k, F.lit("/?x=1")), F.concat(F.lit("/a/"), k), F.concat(F.lit("https://s.org/a/"), k, F.lit("/llms-full.txt")), F.concat(F.lit("https://s.org/b/"), k), F.concat(F.lit("/a/robots.txt")), F.concat(F.lit("https://other.org/a/"), k)]
    url = F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))
    return P.seeds(read(spark, sf_dir, "part").select(F.col("p_size").alias("site"), F.lit("https://s.org/a").alias("origin"), url.alias("url")))


_WHOLE = "CASE WHEN run_id % 7 > 0 THEN score END"
_SAYS = "CASE lens " + " ".join(f"WHEN '{lens}' THEN CASE " + " ".join(f"WHEN round_even(least(greatest(s, 0), 100), 0) <= {high} THEN '{text}'" for high, text in texts) + " ELSE '' END" for lens, texts in S.IMPLICATIONS.items()) + " END"
_CLASS = "CASE " + " ".join(f"WHEN rating IN ({', '.join(repr(x) for x in labels)}) THEN '{name}'" for name, labels in S.RATING_CLASSES.items()) + " ELSE '' END"
_RATE = "CASE lens " + " ".join(f"WHEN '{lens}' THEN CASE " + " ".join(f"WHEN round_even(least(greatest(s, 0), 100), 0) <= {high} THEN '{text}'" for high, text in texts) + " END" for lens, texts in S.RATINGS.items()) + " END"


@query(f"""WITH r AS (SELECT run_id, ['AEO', 'GEO', 'AAX'][run_id % 3 + 1] AS lens, {_WHOLE} AS s FROM ({RUNS})), t AS (SELECT *, CASE WHEN s IS NOT NULL THEN {_RATE} END AS rating FROM r)
SELECT run_id, CASE WHEN s IS NULL THEN '' ELSE {_SAYS} END AS says, {_CLASS} AS class, CASE WHEN s IS NULL THEN 'var(--color-surface-2)' WHEN s >= 70 THEN 'var(--color-primary)' WHEN s >= 40 THEN 'var(--color-semantic-warning)' ELSE 'var(--color-semantic-error)' END AS bar FROM t""")
def score_statements(spark, sf_dir):
    lens = F.element_at(F.array(*map(F.lit, ("AEO", "GEO", "AAX"))), (F.col("run_id") % 3 + 1).cast("int"))
    rows = runs(spark, sf_dir).select("run_id", lens.alias("lens"), F.when(F.col("run_id") % 7 > 0, F.col("score")).alias("s"))
    rating = F.lit(None).cast("string")
    for name in S.RATINGS:
        rating = F.when(F.col("lens") == name, S.rating(name, F.col("s"))).otherwise(rating)
    return rows.select("run_id", S.implication(F.col("lens"), F.col("s")).alias("says"), S.rating_class(rating).alias("class"), S.bar_colour(F.col("s")).alias("bar"))


@query("""SELECT p_partkey AS part, CASE p_partkey % 3 WHEN 0 THEN 'Weak spot: machine context' WHEN 1 THEN 'Strong profile' ELSE 'Score pattern needs review' END AS label,
  CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Mend answer structure first.' ELSE 'GEO is what fails.' END WHEN 1 THEN 'All is well.' ELSE '' END AS diagnosis, 'good' AS aeo FROM (
  SELECT p_partkey FROM part) WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Weak spot: answer structure' ELSE 'Weak spot: machine context' END, CASE WHEN p_partkey % 2 = 0 THEN 'Mend answer structure first.' ELSE 'GEO is what fails.' END, '' FROM part WHERE p_partkey % 3 = 0""")
def interpretation_texts(spark, sf_dir):
    k = F.col("p_partkey")
    shape = F.element_at(F.array(*map(F.lit, ("single_exposure", "strong_profile", "odd"))), (k % 3 + 1).cast("int"))
    bands = F.create_map(F.lit("AEO"), F.when(k % 3 > 0, "strong").otherwise("weak"))
    rows = read(spark, sf_dir, "part").select(k.alias("part"), shape.alias("shape"), F.when(k % 2 == 0, "AEO").otherwise("GEO").alias("weakest"), bands.alias("bands"))
    out = P.interpretation_texts(
        rows, {"single_exposure": "weak spot: {lens}", "strong_profile": "strong profile"}, {"single_exposure": "Mend {lens} first.", "single_exposure/GEO": "GEO is what fails.", "strong_profile": "All is well."}, {("AEO", "strong"): "good"}, S.EXPOSURES
    )
    return out.select("part", "label", "diagnosis", F.col("meanings")["AEO"].alias("aeo"))
