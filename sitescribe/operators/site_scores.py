"""From pages to scores and fixes: audits of each site, its factors, composites and recommendations, in one plan.

What is known of a page meets what its structured data says once; every audit of a site is an aggregate of
that table which combines before its shuffle.  Later answers change one factor of the sites that they are
for, and only those composites are worked out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from . import recommend
from . import structured as D
from .compare import counterfactual, ranked_fixes
from .extract import robots_status

#: Which lens a factor belongs to, and its weight there.
FACTORS = [(lens, factor, weight) for lens, weights in S.WEIGHTS.items() for factor, weight in weights.items()]
#: Words that a shallow page would have once it is expanded.
EXPANDED = 1000


def page_data(items: DataFrame) -> DataFrame:
    """What the objects of each page of ``items(page_id, item, types)`` say: types, authors, contacts, dates, questions; a page's objects are few."""
    item, types = F.col("item"), F.col("types")
    lower = F.transform(types, lambda t: F.lower(t))
    has = lambda key: F.coalesce(F.array_contains(F.transform(F.json_object_keys(F.to_json(item)), lambda k: F.lower(k)), key), F.lit(False))
    contact = F.arrays_overlap(lower, F.array(F.lit("contactpage"), F.lit("contactpoint"))) | has("contactpoint")
    asked = F.when(F.array_contains(types, "FAQPage"), D.members(D.part(item, "mainEntity"))).otherwise(F.array().cast("array<variant>"))
    words = F.transform(asked, lambda q: X.words(D.part(D.part(q, "acceptedAnswer"), "text", "string")))
    dates = F.array_compact(F.array(*[D.part(item, n, "string").try_cast("timestamp") for n in ("datePublished", "dateModified", "dateCreated")]))
    each = items.select("page_id", types.alias("types"), has("author").alias("author"), contact.alias("contact"), dates.alias("dates"), F.size(asked).alias("asked"), F.size(F.filter(words, lambda n: n.between(40, 60))).alias("fitting"))
    return each.groupBy("page_id").agg(
        F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"), F.bool_or("author").alias("author"), F.coalesce(F.bool_or("contact"), F.lit(False)).alias("contact"),
        F.flatten(F.collect_list("dates")).alias("dates"), F.sum("asked").alias("asked"), F.sum("fitting").alias("fitting"),
    )


def site_signals(pages: DataFrame, items: DataFrame, files: DataFrame, as_of: str) -> DataFrame:
    """One row for each site, with all that ``recommend.geo_rules`` and the factors ask for.

    ``pages(page_id, site, url)`` with the metrics of each page, ``items(page_id, item, types)`` of its
    structured data, ``files(site, robots, llms, llms_full, sitemaps)`` with texts or nulls, and the number of sitemaps named.
    """
    known = pages.join(page_data(items), "page_id", "left")
    structure = S.page_structure({c: F.col(c) for c in ("h1_count", "depth", "lists", "tables", "words", "paragraphs", "headings_total", "images_total", "images_with_alt")})
    age = lambda at: F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(at)) / 86400))
    ages = F.transform(F.coalesce("dates", F.array().cast("array<timestamp>")), age)
    known = known.withColumns({"_structure": structure, "_ages": F.aggregate(ages, F.lit(0).cast("long"), lambda total, x: total + x), "_dates": F.size(ages), "_url": F.lower(F.coalesce("url", F.lit("")))})
    n, longer = F.count("*"), F.greatest("words", F.lit(EXPANDED))
    share = lambda cond: 100.0 * F.count_if(cond) / n
    extra = F.when(F.bool_or(F.col("code_blocks") > 0), 15).otherwise(0) + F.when(F.bool_or(F.col("tables") > 0), 10).otherwise(0)
    deep = lambda words: F.least(F.lit(100.0), 0.35 * S.words_band(F.avg(words)) + 0.25 * share(words >= 1000) + 0.15 * share(words > 200) + extra)
    says = lambda *names: F.bool_or(F.exists(F.array(*map(F.lit, names)), lambda x: F.col("_url").contains(x)))
    sites = known.groupBy("site").agg(
        n.alias("n_pages"), F.bround(share(F.size("types") > 0), 1).alias("coverage"), F.sum("asked").alias("asked"), F.sum("fitting").alias("fitting"),
        F.coalesce(F.bool_or("author"), F.lit(False)).alias("author"), (F.coalesce(F.bool_or("contact"), F.lit(False)) | says("contact")).alias("contact"), says("privacy", "terms", "legal").alias("legal"),
        F.try_divide(F.sum("_ages"), F.sum("_dates")).alias("freshness_days"), F.avg("_structure").alias("structure"), share(F.col("words") > 300).alias("ratio"),
        deep(F.col("words")).alias("depth"), deep(longer).alias("depth_if_longer"), F.sum("images_total").alias("images"), F.sum("images_with_alt").alias("described"),
    )
    kinds = known.select("site", F.explode("types").alias("t")).groupBy("site").agg(
        F.count_distinct("t").alias("types"), F.bool_or(F.col("t") == "FAQPage").alias("has_faq"), F.bool_or(F.col("t") == "HowTo").alias("has_howto"),
    )
    named = D.organisations(items).join(pages.select("page_id", "site"), "page_id")
    told = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    entities = named.groupBy("site").agg(F.count_distinct(told("name")).alias("names"), F.count_distinct(told("description")).alias("descriptions"), F.count("*").alias("organisations"))
    bots = robots_status(files.where("robots is not null").select("site", F.col("robots").alias("text")), list(S.BOT_POINTS))
    bots = bots.groupBy("site").agg(*[F.max(F.when(F.col("bot") == b, F.col("status"))).alias(f"bot_{b}") for b in S.BOT_POINTS])
    out = sites.join(kinds, "site", "left").join(entities, "site", "left").join(files, "site", "left").join(bots, "site", "left")
    text = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return out.withColumns({
        "types": F.coalesce("types", F.lit(0)), "has_faq": F.coalesce("has_faq", F.lit(False)), "has_howto": F.coalesce("has_howto", F.lit(False)), "asked": F.coalesce("asked", F.lit(0)), "fitting": F.coalesce("fitting", F.lit(0)),
        "name_ok": F.coalesce(F.col("names") <= 1, F.lit(True)), "description_ok": F.coalesce(F.col("descriptions") <= 1, F.lit(True)), "organisation": F.coalesce(F.col("organisations") > 0, F.lit(False)),
        "robots": F.col("robots").isNotNull(), "llms": text("llms"), "llms_full": text("llms_full"), "sitemap": F.coalesce(F.col("sitemaps") > 0, F.lit(False)),
    }).drop("names", "descriptions", "organisations", "sitemaps")


def factor_table(signals: DataFrame, answers: DataFrame | None = None, agent: DataFrame | None = None) -> DataFrame:
    """(site, lens, factor, score, weight): each factor of every site, null where nothing could be measured.

    ``answers(run, question, verdict, sources)`` gives answerability, ``run`` being the site; ``agent(site, factor, score)`` what tests with agents gave.
    """
    c = F.col
    scores = {
        "schema": S.schema_score(c("coverage"), c("has_faq"), c("has_howto"), c("asked"), c("fitting")), "content_structure": F.least(F.lit(100.0), c("structure")),
        "freshness": F.when(c("freshness_days").isNotNull(), S.freshness_band(c("freshness_days"))),
        "topical_authority": S.topical_authority(c("coverage"), c("types"), c("name_ok"), c("description_ok"), c("ratio") / 100), "eeat": S.eeat(c("organisation"), c("author"), c("contact"), c("legal")),
        "crawl_access": S.crawl_access(c("robots"), {b: c(f"bot_{b}") for b in S.BOT_POINTS}, c("llms"), c("llms_full"), c("sitemap")),
        "content_depth": F.bround("depth", 1), "entity_consistency": S.entity_consistency(c("name_ok"), c("description_ok")),
    }
    rows = F.array(*[F.struct(F.lit(lens).alias("lens"), F.lit(f).alias("factor"), scores.get(f, F.lit(None)).cast("double").alias("score"), F.lit(w).alias("weight")) for lens, f, w in FACTORS])
    table = signals.select("site", F.explode(rows).alias("r")).select("site", "r.*")
    if answers is not None:
        table = replaced(table, answered(answers))
    return table if agent is None else replaced(table, agent)


def answered(answers: DataFrame) -> DataFrame:
    """(site, factor, score): answerability of the sites that were asked."""
    return recommend.answerability(answers).select(F.col("run").alias("site"), F.lit("answerability").alias("factor"), "score")


def replaced(factors: DataFrame, given: DataFrame) -> DataFrame:
    """``factors`` with the scores of ``given(site, factor, score)``."""
    new = given.select("site", "factor", F.col("score").alias("_new"), F.lit(True).alias("_given"))
    return factors.join(new, ["site", "factor"], "left").select("site", "lens", "factor", F.when(F.col("_given"), F.col("_new")).otherwise(F.col("score")).alias("score"), "weight")


def composites(factors: DataFrame) -> DataFrame:
    """(site, lens, composite, rating): weighted over the factors that have a score; null where none has."""
    used = F.col("score").isNotNull()
    mean = F.try_divide(F.sum(F.when(used, F.col("score") * F.col("weight"))), F.sum(F.when(used, F.col("weight"))))
    out = factors.groupBy("site", "lens").agg(S.calibrated(mean).alias("composite"))
    label = F.lit(None).cast("string")
    for lens in S.RATINGS:
        label = F.when(F.col("lens") == lens, S.rating(lens, F.col("composite"))).otherwise(label)
    return out.withColumn("rating", label)


def fixes(signals: DataFrame, factors: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(site, lens, factor, fix, points, priority, place): what each fix alone would gain its lens' composite, best first."""
    wide = signals.join(factors.groupBy("site").pivot("factor", [f for _, f, _ in FACTORS]).agg(F.first("score")).select("site", *[F.col(f).alias(f"s_{f}") for _, f, _ in FACTORS]), "site").withColumn("topical", F.col("s_topical_authority"))
    proposed = recommend.proposed(wide, recommend.geo_rules())
    if answers is not None:
        proposed = proposed.unionByName(recommend.unanswered(answers))
    lens_of = F.create_map(*[F.lit(x) for lens, f, _ in FACTORS for x in (f, lens)])
    of_lens = lambda t: t.withColumn("run", F.struct(F.col("run").alias("site"), lens_of[F.col("factor")].alias("lens")))
    table = factors.select(F.struct("site", "lens").alias("run"), "factor", "score", "weight")
    gains = counterfactual(table, of_lens(proposed)).select("run", "fix", F.col("delta").alias("points"))
    best = ranked_fixes(gains.select("run.site", "run.lens", "fix", "points").withColumn("run", F.col("site")))
    named = proposed.select(F.col("run").alias("site"), "fix", "factor").distinct()
    return best.join(named, ["site", "fix"]).select("site", "lens", "factor", "fix", "points", "priority", "place")


def rescored(factors: DataFrame, scored: DataFrame, given: DataFrame) -> DataFrame:
    """``scored`` composites after ``given(site, factor, score)`` came in: only lenses of the sites and factors given are worked out again."""
    touched = factors.join(given.select("site", "factor").distinct(), ["site", "factor"], "left_semi").select("site", "lens").distinct()
    again = composites(replaced(factors.join(touched, ["site", "lens"], "left_semi"), given))
    return scored.join(touched, ["site", "lens"], "left_anti").unionByName(again)
