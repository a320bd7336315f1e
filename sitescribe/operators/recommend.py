"""Fixes: rules over a site's signals, each with the score that its factor would reach.

Every rule is a row of a table: factor, name, condition, target.  One projection stacks the rules that
apply to a site, one join and one aggregation (``compare.counterfactual``) evaluate them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import BOT_POINTS, CONTACT_TYPES, COVERAGE, looked_up
from .compare import counterfactual, ranked_fixes

Rule = tuple[str, str, Column, Column]


def geo_rules() -> list[Rule]:
    """Signals: ``coverage, has_faq, structure, freshness_days, name_ok, description_ok, organisation,
    author, contact, legal, robots, llms, llms_full, sitemap``, a status ``bot_<name>`` for each crawler,
    ``topical, depth, depth_if_longer, images, described``, and present scores ``s_<factor>``."""
    c = F.col
    score = lambda factor: F.coalesce(c(f"s_{factor}"), F.lit(0.0))
    plus = lambda factor, points: score(factor) + F.lit(float(points))
    access = lambda points: score("crawl_access") + F.lit(points * 100 / 77)
    share = F.try_divide(c("described"), c("images"))
    rules = [
        ("schema", "cover more pages with structured data", c("coverage") < 50, F.lit(80.0)),
        ("schema", "add an FAQ block", ~c("has_faq"), plus("schema", 10)),
        ("content_structure", "structure the pages", c("structure") < 55, F.lit(70.0)),
        ("content_structure", "describe the images", share < 0.5, score("content_structure") + 10 * (1 - share)),
        ("freshness", "update old pages", (c("freshness_days") > 90) & (c("freshness_days") <= 365), F.when(c("freshness_days") <= 180, 80.0).otherwise(60.0)),
        ("entity_consistency", "use one name", ~c("name_ok"), plus("entity_consistency", 57.14)),
        ("entity_consistency", "use one description", ~c("description_ok"), plus("entity_consistency", 42.86)),
        ("eeat", "say who runs the site", ~c("organisation"), plus("eeat", 30)),
        ("eeat", "name authors", ~c("author"), plus("eeat", 30)),
        ("eeat", "give a contact", ~c("contact"), plus("eeat", 20)),
        ("eeat", "link legal pages", ~c("legal"), plus("eeat", 20)),
        ("crawl_access", "publish robots.txt", ~c("robots"), access(8)),
        ("crawl_access", "publish llms.txt", ~c("llms"), access(15)),
        ("crawl_access", "publish llms-full.txt", ~c("llms_full"), access(8)),
        ("crawl_access", "publish a sitemap", ~c("sitemap"), access(7)),
        ("topical_authority", "cover the topic on all pages", (c("topical") < 60) & (c("coverage") < 100), score("topical_authority") + 0.35 * (100 - c("coverage"))),
        ("content_depth", "write longer pages", c("depth") < 60, c("depth_if_longer")),
    ]
    for bot, full in BOT_POINTS.items():
        status = c(f"bot_{bot}")
        missing = F.when(status == "blocked", full).otherwise(full - full // 2)
        rules.append(("crawl_access", f"let {bot} in", status != "allowed", score("crawl_access") + missing * 100 / 77))
    return rules


# Points of each contact signal, the cap without an address of the site's own domain,
# and what a fix adds besides lifting its penalty.
CONTACT_SIGNALS = {"has_email": 20, "has_mailto": 10, "has_contact_page": 10, "has_social_links": 10, "has_contact_point": 15}
DOMAIN_CAP, OWN_ADDRESS_FOR_OTHERS, LISTED = 20, 15, 15


def actionable_rules() -> list[Rule]:
    """Rules for what agents make of a site; a factor without a score ``s_<factor>`` gets no fix.

    Signals: ``home_missing`` of four identity fields, ``facts`` that buyers miss, ``coverage_word``,
    ``essentials_missing`` of five, ``suggestions`` for metadata, ``click, meta_complete, meta_clear``,
    ``contacts`` (types of the valid ones), ``confidence``, the contact signals, and the points that
    penalties took: ``lost_domain, lost_obfuscated, lost_legal`` (null where none applies).
    """
    c, score = F.col, lambda factor: F.col(f"s_{factor}")
    word = lambda name, default: F.coalesce(c(name), F.lit(default))
    home, delta, meta, mail = score("homepage_comprehension"), score("content_delta"), score("meta_optimization"), score("email_validation")
    types = F.coalesce("contacts", F.array().cast("array<string>"))
    confirmed = (F.size(types) > 0) & (word("confidence", "low") != "low")
    best = F.array_max(F.transform(types, lambda t: looked_up(t, CONTACT_TYPES, 0)))
    missing_fact = 0.3 * (100 - looked_up(word("coverage_word", "incomplete"), COVERAGE, 20))
    weak_meta = ~F.coalesce("click", F.lit(False)) | (word("meta_complete", "minimal") == "minimal") | (word("meta_clear", "unclear") == "unclear")
    on = lambda factor, when: factor.isNotNull() & F.coalesce(when, F.lit(False))
    return [
        ("homepage_comprehension", "make the homepage clear", on(home, c("home_missing") > 0), home + 10 * c("home_missing")),
        ("content_delta", "state missing facts", on(delta, c("facts") > 0), delta + missing_fact),
        ("content_delta", "state missing essentials", on(delta, c("essentials_missing") > 0), delta + 8 * c("essentials_missing")),
        ("meta_optimization", "write better metadata", on(meta, (c("suggestions") > 0) | weak_meta), meta + 25),
        ("email_validation", "give valid addresses", on(mail, ~confirmed), mail + 50),
        ("email_validation", "give an address for sales", on(mail, confirmed & (best < CONTACT_TYPES["sales"])), mail + CONTACT_TYPES["sales"] - best + F.when(F.size(types) == 1, 10).otherwise(0)),
        *_contact_rules(),
    ]


def _contact_rules() -> list[Rule]:
    """A fix for each penalty, and one for all missing signals that no penalty's fix brings.  The cap
    holds until the fix for the domain lifts it; other penalties hold until theirs does."""
    lost = {name: F.col(f"lost_{name}") for name in ("domain", "obfuscated", "legal")}
    uncapped = F.coalesce("s_contactability", F.lit(0.0)) + F.coalesce(lost["domain"], F.lit(0.0))
    capped = lambda x: F.when(lost["domain"].isNotNull(), F.least(x, F.lit(float(DOMAIN_CAP)))).otherwise(x)
    have = {name: F.coalesce(name, F.lit(False)) for name in CONTACT_SIGNALS}
    covered = {"has_email": lost["domain"].isNotNull(), "has_mailto": lost["obfuscated"].isNotNull()}
    gain = sum((F.when(~have[name] & ~covered.get(name, F.lit(False)), n).otherwise(0) for name, n in CONTACT_SIGNALS.items()), F.lit(0))
    own = F.when(have["has_email"], OWN_ADDRESS_FOR_OTHERS).otherwise(CONTACT_SIGNALS["has_email"])
    return [
        ("contactability", "publish an address of the own domain", lost["domain"].isNotNull(), uncapped + own),
        ("contactability", "make an address clickable", lost["obfuscated"].isNotNull(), capped(uncapped + CONTACT_SIGNALS["has_mailto"] + lost["obfuscated"])),
        ("contactability", "publish an address outside legal pages", lost["legal"].isNotNull(), capped(uncapped + LISTED + lost["legal"])),
        ("contactability", "add contact signals", gain > 0, capped(uncapped + gain)),
    ]


def guidance(title: Column, exact: dict[str, str], prefixes: dict[str, str]) -> Column:
    """What to do about a fix: by its whole title, else by the first prefix that fits, else nothing."""
    whole = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair]) if exact else F.create_map().cast("map<string,string>")
    starts = [F.when(title.startswith(prefix), F.lit(text)) for prefix, text in prefixes.items()]
    return F.coalesce(F.try_element_at(whole, title), *starts, F.lit(""))


def proposed(sites: DataFrame, rules: list[Rule], key: str = "site") -> DataFrame:
    """(run, fix, factor, target) for each rule whose condition holds; an unknown condition doesn't."""
    stacked = F.array(*[
        F.struct(F.lit(name).alias("fix"), F.lit(factor).alias("factor"), F.least(F.lit(100.0), target.cast("double")).alias("target"), F.coalesce(when, F.lit(False)).alias("on"))
        for factor, name, when, target in rules
    ])
    each = sites.select(F.col(key).alias("run"), F.explode(F.filter(stacked, lambda r: r["on"])).alias("r"))
    return each.select("run", "r.fix", "r.factor", "r.target")


def unanswered(questions: DataFrame) -> DataFrame:
    """A fix for each unsupported or contradicted question of ``questions(run, question, verdict)``.

    Answering one adds 100 by the number of questions that apply.
    """
    applies = F.col("verdict") != "not_applicable"
    n = questions.where(applies).groupBy("run").agg(F.count("*").alias("n"), F.avg(points(F.col("verdict"))).alias("s"))
    bad = questions.where(F.col("verdict").isin("unsupported", "contradictory")).join(n, "run")
    return bad.select("run", F.concat(F.lit("answer: "), F.col("question")).alias("fix"), F.lit("answerability").alias("factor"), F.least(F.lit(100.0), F.col("s") + 100 / F.col("n")).alias("target"))


def points(verdict: Column) -> Column:
    return F.when(verdict == "supported", 100).when(verdict == "partially_supported", 50).when(verdict != "not_applicable", 0)


def answerability(questions: DataFrame) -> DataFrame:
    """Mean points of applicable questions; a supported one without a source counts 0."""
    sourced = F.when(F.size("sources") > 0, points(F.col("verdict"))).otherwise(F.when(F.col("verdict") != "not_applicable", 0))
    out = questions.groupBy("run").agg(F.avg(sourced).alias("score"), F.count(sourced).alias("applicable"), F.count_if(F.col("verdict") == "supported").alias("supported"))
    return out.withColumn("support", F.round(F.try_divide("supported", "applicable"), 2))


def recommended(factors: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes with what they would gain, best first: ``factors(run, factor, score, weight)``."""
    gains = counterfactual(factors, fixes).select("run", "fix", F.col("delta").alias("points"))
    return ranked_fixes(gains)


def grounded(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """Cited pages that were crawled: ``answers(question, place, host, path)`` to ``pages(url, host, path)``.

    By host and path, or by path alone where no host is cited; of several pages the first by URL, and
    each page once a question, in the order of citation.
    """
    by_host = pages.groupBy("host", "path").agg(F.min("url").alias("a"))
    by_path = pages.groupBy("path").agg(F.min("url").alias("b"))
    found = answers.join(by_host, ["host", "path"], "left").join(by_path, "path", "left")
    url = F.when(F.coalesce(F.col("host"), F.lit("")) == "", F.col("b")).otherwise(F.col("a"))
    found = found.select("question", "place", url.alias("url")).where("url is not null")
    return found.groupBy("question", "url").agg(F.min("place").alias("place"))


def contactability(same_domain: Column, third_party: Column, mailto: Column, contact_page: Column, prominent: Column, contact_point: Column, same_as: Column, generic: Column, phone: Column, legal_only: Column) -> Column:
    """Points for ways to reach a site; without an address of its own domain 20 at most."""
    p = lambda cond, n: F.when(cond, n).otherwise(0)
    total = F.when(same_domain, 20).when(third_party, 5).otherwise(0) + p(mailto, 10) + p(contact_page, 10) + p(prominent, 15) + p(contact_point, 15)
    total = total + p(same_as, 10) + p(generic, 10) + p(phone, 10) - p(~mailto, 10) - p(legal_only, 15)
    return F.greatest(F.lit(0), F.least(F.when(same_domain, total).otherwise(F.least(total, F.lit(20))), F.lit(100)))


# The structure score below which a page is thin, and the one that a fixed page would have.
THIN, MENDED = 40, 70


def thin_pages(pages: DataFrame) -> DataFrame:
    """For each site with thin pages the mean score if these were mended; ``pages(site, score)``."""
    mended = F.when(F.col("score") < THIN, MENDED).otherwise(F.col("score"))
    out = pages.groupBy("site").agg(F.count_if(F.col("score") < THIN).alias("thin"), F.avg(mended).alias("target"))
    return out.where("thin > 0")
