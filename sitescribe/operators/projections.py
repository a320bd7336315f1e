"""What leaves the library: results cut down to what a reader may see, and lists in the order they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from .extract import BOTS, robots_status

# Order of priorities, and most characters of each part of an answer's record.
PRIORITIES = {"high": 0, "medium": 1, "low": 2, "info": 3}
LENGTHS = {"question_id": 40, "question": 300, "verdict": 32, "answer": 2000}
#: Files for crawlers, which are no pages.
DIRECTIVES = r"(?i)/(robots|llms(-full)?)\.txt$"


def priority_rank(priority: Column) -> Column:
    """High first; unknown and missing ones count as medium."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair]), priority), F.lit(1))


def answer_record(q: Column) -> Column:
    """The record of an answer with bounded parts: ten missing facts and twenty sources at most, 300 characters each."""
    short = lambda name, n: F.substring(F.coalesce(q[name].cast("string"), F.lit("")), 1, n).alias(name)
    some = lambda name, n: F.transform(F.slice(F.coalesce(q[name], F.array().cast("array<string>")), 1, n), lambda x: F.substring(x, 1, 300)).alias(name)
    return F.struct(*(short(name, n) for name, n in LENGTHS.items()), some("missing_facts", 10), some("source_pages", 20))


def verdict_movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run, question_id, question, verdict_before, verdict_after) of two runs' ``(run, question_id, question, verdict)``; a new question had no verdict."""
    old = before.groupBy("run", "question_id").agg(F.max("verdict").alias("_before"))
    rows = after.join(old, ["run", "question_id"], "left")
    return rows.select("run", "question_id", "question", F.coalesce("_before", F.lit("")).alias("verdict_before"), F.coalesce("verdict", F.lit("")).alias("verdict_after"))


def contract(runs: DataFrame, composites: DataFrame, factors: DataFrame, answers: DataFrame) -> DataFrame:
    """(run_id, url, scope, status, scores, answerability) of runs that succeeded, and nothing else of them.

    ``scores`` maps lenses to their composite, rating and factors with weights; ``composites(run_id, lens, composite, rating)``,
    ``factors(run_id, lens, factor, score, weight)`` and ``answers(run_id, record)`` are a few rows a run.
    """
    listed = factors.groupBy("run_id", "lens").agg(F.array_sort(F.collect_list(F.struct("factor", "score", "weight"))).alias("factors"))
    lenses = composites.join(listed, ["run_id", "lens"], "left").groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lens", F.struct("composite", "rating", "factors"))))).alias("scores"))
    said = answers.groupBy("run_id").agg(F.array_sort(F.collect_list("record")).alias("answerability"))
    scope = F.when(F.col("crawl_params").isNotNull(), "site").otherwise("page")
    return runs.where("status = 'succeeded'").select("run_id", "url", scope.alias("scope"), "status").join(lenses, "run_id", "left").join(said, "run_id", "left")


def public_preview(runs: DataFrame, composites: DataFrame, fixes: DataFrame, pages: DataFrame) -> DataFrame:
    """(domain, path, status, scores, finding_count, n_pages, n_emails) of public runs that succeeded: counts, and scores of lenses that have one.

    Built of named columns only, so e-mails, texts, owners and fixes cannot slip through.
    """
    scores = composites.where("composite is not null").groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lens", F.struct("composite", "rating"))))).alias("scores"))
    found = fixes.groupBy("run_id").agg(F.count("*").alias("finding_count"))
    counted = pages.groupBy("run_id").agg(F.count("*").alias("n_pages"), F.sum("n_emails").alias("n_emails"))
    out = runs.where("status = 'succeeded' and visibility = 'public'").join(scores, "run_id", "left").join(found, "run_id", "left").join(counted, "run_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(U.domain_of(F.col("url")).alias("domain"), U.path_of(F.col("url")).alias("path"), "status", "scores", number("finding_count"), number("n_pages"), number("n_emails"))


def shown_fixes(fixes: DataFrame) -> DataFrame:
    """``fixes(run, place, fix, points, priority)`` and ``shown``, the order of a report: most points first, those without last, ties by priority, then as they came."""
    order = Window.partitionBy("run").orderBy(F.col("points").isNull(), F.desc("points"), priority_rank(F.col("priority")), "place")
    return fixes.withColumn("shown", F.row_number().over(order))


def compared_fixes(fixes: DataFrame) -> DataFrame:
    """``fixes(run, place, fix, priority)`` and ``shown``, the order of a comparison: by priority, then as they came."""
    return fixes.withColumn("shown", F.row_number().over(Window.partitionBy("run").orderBy(priority_rank(F.col("priority")), "place")))


def pages_by_url(pages: DataFrame) -> DataFrame:
    """(run, url, place) of ``pages(run, place, url, page_url)``: each address once, the last page that has it; an address may stand in the nested page only."""
    url = F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(F.col("page_url"))
    named = pages.withColumn("url", url).where(F.coalesce("url", F.lit("")) != "")
    return named.groupBy("run", "url").agg(F.max("place").alias("place"))


def contact_emails(emails: DataFrame, contact_pages: DataFrame) -> DataFrame:
    """(site, email): addresses of ``emails(site, url, email)`` that stand on one of the site's ``contact_pages(site, url)``."""
    return emails.join(contact_pages.select("site", "url").distinct(), ["site", "url"]).select("site", "email").distinct()


def blocked_sites(pages: DataFrame, challenges: list[str], refused: list[int], thin: int) -> DataFrame:
    """(site, reason) of ``pages(site, is_start, status, title, words)``: why a site was not read, null where it was.

    A refusal of the start page decides.  A start page that is titled like a challenge counts only where no page of the site has
    ``thin`` words or more.
    """
    start = lambda c: F.max(F.when(F.col("is_start"), F.col(c)))
    sites = pages.groupBy("site").agg(start("status").alias("status"), start("title").alias("title"), F.coalesce(F.max("words"), F.lit(0)).alias("most"))
    challenged = F.exists(F.array(*map(F.lit, challenges)), lambda c: F.contains(F.lower("title"), c))
    reason = F.when(F.col("status").isin(refused), F.concat(F.lit("http "), F.col("status"))).when(challenged & (F.col("most") < thin), "challenge page")
    return sites.select("site", reason.alias("reason"))


def page_identity_fixes(pages: DataFrame) -> DataFrame:
    """(site, fix, factor, n) of ``pages(site, page_id, og_title, mismatched)``: unscored fixes for canonical addresses that lead elsewhere, and for groups of pages with one title for previews."""
    titled = pages.where(F.trim(F.coalesce("og_title", F.lit(""))) != "").groupBy("site", F.trim("og_title").alias("t")).agg(F.count("*").alias("n")).where("n > 1")
    groups = titled.groupBy("site").agg(F.count("*").alias("n")).select("site", F.lit("tell preview titles apart").alias("fix"), F.lit("content_structure").alias("factor"), "n")
    wrong = pages.where("mismatched").groupBy("site").agg(F.count("*").alias("n")).select("site", F.lit("mend canonical addresses").alias("fix"), F.lit("schema").alias("factor"), "n")
    return wrong.unionByName(groups)


def robots_info(files: DataFrame, bots: list[str] = BOTS) -> DataFrame:
    """(site, found, size_bytes, bots, sitemaps) of ``files(site, text)``: one row a site, without bots and sitemaps where there is no file."""
    status = robots_status(files.where("text <> ''"), bots).groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bot", "status")))).alias("bots"))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: F.lower(x).startswith("sitemap:"))
    named = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    there = F.coalesce(F.col("text") != "", F.lit(False))
    out = files.join(status, "site", "left")
    return out.select("site", there.alias("found"), F.when(there, F.octet_length("text")).otherwise(0).alias("size_bytes"), F.coalesce("bots", F.create_map().cast("map<string,string>")).alias("bots"), named.alias("sitemaps"))


# What a browser wraps plain text in, and the tags that are taken out where that does not fit.
WRAPPED = r"(?is)^\s*<!doctype\s+html[^>]*>\s*<html[^>]*>\s*<head[^>]*>.*?</head>\s*<body[^>]*>\s*<pre[^>]*>(.*)</pre>\s*</body>\s*</html>\s*$"
STRIPPED = ("<html>", "</html>", "<head>", "</head>", "<body>", "</body>", "<pre>", "</pre>")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def unwrapped(text: Column) -> Column:
    """Plain text out of the page that a browser made of it; of other text the wrapping tags go."""
    payload, bare = F.regexp_extract(text, WRAPPED, 1), text
    for tag in STRIPPED:
        bare = F.replace(bare, F.lit(tag), F.lit(""))
    for entity, sign in ENTITIES.items():
        payload = F.replace(payload, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.when(text.rlike(WRAPPED), payload).otherwise(bare), r"^\s+|\s+$", "")


def seeds(urls: DataFrame) -> DataFrame:
    """(site, url) of ``urls(site, origin, url)``: addresses below the origin that a crawl may follow; files for crawlers are none."""
    found = F.regexp_replace(F.regexp_replace(U.resolved(F.trim("url"), F.col("origin")), "[?#].*$", ""), "/$", "")
    rows = urls.withColumn("url", F.concat(F.lower(F.regexp_extract(found, "^([^/]*//[^/]*)", 1)), F.regexp_replace(found, "^[^/]*//[^/]*", "")))
    inside = U.should_follow(F.col("url"), U.origin_prefix(F.col("origin")))
    return rows.where(inside & ~F.col("url").rlike(DIRECTIVES)).select("site", "url").distinct()


def interpretation_texts(profiles: DataFrame, labels: dict[str, str], diagnoses: dict[str, str], meanings: dict[tuple[str, str], str], exposures: dict[str, str]) -> DataFrame:
    """``profiles(shape, weakest, bands)`` with ``label``, ``diagnosis`` and ``meanings``, from tables of texts.

    A diagnosis is named by its shape, or by shape and weakest lens as ``shape/LENS``, which goes first; {lens} in a text
    stands for what the weakest lens exposes.  ``bands`` maps lenses to bands; ``meanings`` has a text for each pair.
    """
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.create_map().cast("map<string,string>")
    filled = lambda t: F.replace(t, F.lit("{lens}"), F.coalesce(F.try_element_at(table(exposures), F.col("weakest")), F.lit("")))
    label = filled(F.coalesce(F.try_element_at(table(labels), F.col("shape")), F.lit("Score pattern needs review")))
    own = F.try_element_at(table(diagnoses), F.concat(F.col("shape"), F.lit("/"), F.coalesce("weakest", F.lit(""))))
    diagnosis = filled(F.coalesce(own, F.try_element_at(table(diagnoses), F.col("shape")), F.lit("")))
    means = F.transform_values("bands", lambda lens, band: F.coalesce(F.try_element_at(table({f"{a}/{b}": t for (a, b), t in meanings.items()}), F.concat(lens, F.lit("/"), band)), F.lit("")))
    first_up = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    return profiles.withColumns({"label": first_up(label), "diagnosis": diagnosis, "meanings": means})


def emails_of(pages: DataFrame) -> DataFrame:
    """(site, url, email) of ``pages(site, url, text)``."""
    return pages.select("site", "url", F.explode(X.emails(F.col("text"))).alias("email"))
