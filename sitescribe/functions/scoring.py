"""Factors, composites, ratings, bands and profiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of factors by lens.
WEIGHTS = {
    "AEO": {"answerability": 0.40, "content_structure": 0.25, "schema": 0.20, "freshness": 0.15},
    "GEO": {"crawl_access": 0.30, "entity_consistency": 0.20, "content_depth": 0.20, "topical_authority": 0.15, "eeat": 0.15},
    "AAX": {"homepage_comprehension": 0.35, "content_delta": 0.25, "meta_optimization": 0.15, "contactability": 0.15, "email_validation": 0.10},
}
# Highest score of each rating but the last, by lens.
RATINGS = {
    "AAX": [(24, "Opaque"), (39, "Unclear"), (59, "Readable"), (79, "Clear"), (100, "Fluent")],
    "AEO": [(25, "Not extractable"), (45, "Limited extractability"), (65, "Partially extractable"), (85, "Reliably extractable"), (100, "Fully extractable")],
    "GEO": [(25, "Unreachable"), (45, "Fragmented"), (65, "Reachable"), (85, "Connected"), (100, "Fully connected")],
}
# Bands of composite scores.
BANDS = [(0, 39, "broken"), (40, 59, "weak"), (60, 69, "developing"), (70, 85, "strong"), (86, 100, "excellent")]
EXPONENT = 1.15


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column, places: int) -> Column:
    """A double scaled, rounded to a whole number with halves away from zero, and scaled back, as SQL's ``round`` does;
    Spark's rounds the decimals that the number is written with, so -26.049999999999997 differs."""
    return F.round(x * F.lit(10.0**places)) / F.lit(10.0**places)


def calibrated(mean: Column) -> Column:
    """The power curve of composites, capped and rounded; null stays null."""
    return F.when(mean.isNotNull(), rounded(F.least(100 * F.pow(mean / 100, F.lit(EXPONENT)), F.lit(100.0)), 1))


def rating(lens: str, score: Column) -> Column:
    whole, out = clamp(F.bround(score, 0)), F.lit(None).cast("string")
    for high, label in reversed(RATINGS[lens]):
        out = F.when(whole <= high, F.lit(label)).otherwise(out)
    return F.when(score.isNotNull(), out)


def band(score: Column, strict: bool = True) -> Column:
    """Band by whole-number ranges.  ``strict`` keeps the rule that a fraction between two ranges
    falls through to the last band; otherwise ranges are half open."""
    out = F.when(score < 0, F.lit("broken"))
    for k, (low, high, name) in enumerate(BANDS):
        below = BANDS[k + 1][0] if k + 1 < len(BANDS) else None
        out = out.when((score >= low) & (score <= high) if strict or below is None else (score >= low) & (score < below), F.lit(name))
    return F.when(score.isNotNull(), out.otherwise(F.lit("excellent")))


def profile(bands: list[Column], average: Column) -> Column:
    """The first rule that fits the numbers of bands and the average; the order matters."""
    n = {name: sum(((b == name).cast("int") for b in bands), F.lit(0)) for _, _, name in BANDS}
    low, good = n["weak"] + n["broken"], n["strong"] + n["excellent"]
    return (
        F.when((good == 0) & ((n["broken"] >= 2) | (average < 35) & (n["broken"] >= 1)), "high_invisibility")
        .when((n["broken"] == 1) & (good == 2) & (average < 65), "critical_failure")
        .when((n["broken"] == 1) & (good == 2), "broken_in_strong_profile")
        .when(low >= 2, "material_risk")
        .when((low == 1) & (n["developing"] >= 1), "broad_exposure")
        .when(low == 1, "single_exposure")
        .when(n["developing"] >= 2, "partial_exposure")
        .when((n["developing"] == 1) & (good >= 2), "developing_with_strong")
        .when(n["excellent"] == 3, "highly_readable")
        .when(good == 3, "strong_profile")
        .otherwise("needs_review")
    )


# Tone of each profile; what the weakest lens exposes and what to mend first.
TONES = {
    "high_invisibility": "critical", "critical_failure": "critical", "broken_in_strong_profile": "serious", "material_risk": "serious", "broad_exposure": "serious",
    "single_exposure": "moderate", "partial_exposure": "moderate", "developing_with_strong": "limited", "highly_readable": "positive", "strong_profile": "positive",
    "needs_review": "moderate", "incomplete": "moderate",
}
EXPOSURES = {"AEO": "answer structure", "GEO": "machine context", "AAX": "agent experience"}
FIX_FIRST = {"AEO": "Structured answers", "GEO": "Crawl access + entity consistency", "AAX": "Offer, content, and next-step signals"}


def named(key: Column, names: dict[str, str]) -> Column:
    """The name of each key, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def published_composite(composite: Column, completed: Column, factors: Column, skip_reasons: Column) -> Column:
    """A composite that may be shown: none unless the tests were completed and gave factors, and none
    where a test failed, so that a score never rests on what survived.  ``skip_reasons`` is a map."""
    failed = F.exists(F.map_values(skip_reasons), lambda r: r.startswith("Test failed"))
    return F.when(completed & (factors > 0) & ~F.coalesce(failed, F.lit(False)), composite)


def generic_label(score: Column) -> Column:
    return F.when(score >= 80, "Strong").when(score >= 60, "Moderate").when(score.isNotNull(), "Weak")


# Highest score of each statement about a lens; classes of ratings.
IMPLICATIONS = {
    "AEO": [(25, "Not extractable."), (45, "Limited extractability."), (65, "Partially extractable."), (85, "Reliably extractable."), (100, "Fully extractable.")],
    "GEO": [(25, "Unreachable."), (45, "Fragmented machine context."), (65, "Reachable but inconsistently connected."), (85, "Consistently connected."), (100, "Fully connected.")],
    "AAX": [(24, "Not usable."), (39, "Significant friction."), (59, "Partial usability."), (79, "Reliably usable."), (100, "Fully agent-ready.")],
}
RATING_CLASSES = {
    "rating-low": ("Not extractable", "Limited extractability", "Unreachable", "Opaque", "Unclear"), "rating-ok": ("Partially extractable", "Fragmented", "Reachable", "Readable"),
    "rating-good": ("Reliably extractable", "Connected", "Clear"), "rating-excellent": ("Fully extractable", "Fully connected", "Fluent"),
}
BARS = [(70, "var(--color-primary)"), (40, "var(--color-semantic-warning)")]


def implication(lens: Column, score: Column) -> Column:
    """What a score says of a lens; nothing for none."""
    whole, out = clamp(F.bround(score, 0)), F.lit("")
    for name, texts in IMPLICATIONS.items():
        for high, text in reversed(texts):
            out = F.when((lens == name) & (whole <= high) & score.isNotNull(), F.lit(text)).otherwise(out)
    return out


def rating_class(label: Column) -> Column:
    out = F.lit("")
    for name, labels in RATING_CLASSES.items():
        out = F.when(label.isin(*labels), name).otherwise(out)
    return out


def bar_colour(score: Column) -> Column:
    return F.when(score.isNull(), "var(--color-surface-2)").when(score >= BARS[0][0], BARS[0][1]).when(score >= BARS[1][0], BARS[1][1]).otherwise("var(--color-semantic-error)")


def priority(points: Column) -> Column:
    return F.when(points >= 3, "high").when(points >= 1, "medium").otherwise("low")


def freshness_band(days: Column) -> Column:
    return F.when(days <= 30, 100).when(days <= 90, 80).when(days <= 180, 60).when(days <= 365, 40).otherwise(20)


def words_band(words: Column) -> Column:
    return F.when(words < 200, 10).when(words < 500, 30).when(words < 1000, 50).when(words < 2000, 70).when(words < 5000, 90).otherwise(100)


def page_structure(m: dict[str, Column]) -> Column:
    """Points for headings, lists, tables, words, paragraphs and described images of a page."""
    point = lambda cond, n: F.when(cond, n).otherwise(0)
    described = F.try_divide(m["images_with_alt"], m["images_total"]) >= 0.8
    return F.least(
        F.lit(100),
        point(m["h1_count"] == 1, 15) + point(m["depth"] >= 2, 15) + point(m["lists"] > 0, 10) + point(m["tables"] > 0, 10) + point(m["words"] >= 300, 15)
        + point(m["words"] >= 1000, 10) + point(m["paragraphs"] >= 5, 10) + point(described, 10) + point(m["headings_total"] >= 5, 10),
    )


def schema_score(coverage: Column, has_faq: Column, has_howto: Column, questions: Column, in_range: Column) -> Column:
    bonus = F.when((questions > 0) & (in_range >= F.greatest(F.lit(1), F.floor(questions / 2))), 10).otherwise(0)
    return F.least(F.lit(100.0), coverage + 10 * has_faq.cast("int") + 5 * has_howto.cast("int") + bonus)


def entity_consistency(name: Column, description: Column) -> Column:
    return F.bround((20 * name.cast("int") + 15 * description.cast("int")) * 100 / 35, 1)


def topical_authority(coverage: Column, types: Column, name: Column, description: Column, ratio: Column) -> Column:
    raw = 0.35 * coverage + 0.25 * F.least(types / 10, F.lit(1.0)) * 100 + 15 * name.cast("int") + 15 * description.cast("int") + 0.10 * ratio * 100
    return F.bround(F.least(raw, F.lit(100.0)), 1)


def eeat(organisation: Column, author: Column, contact: Column, legal: Column) -> Column:
    return 30 * organisation.cast("int") + 30 * author.cast("int") + 20 * contact.cast("int") + 20 * legal.cast("int")


# Points of crawlers in the access score.
BOT_POINTS = {"GPTBot": 15, "ClaudeBot": 12, "PerplexityBot": 12}


def crawl_access(robots: Column, bots: dict[str, Column], llms: Column, llms_full: Column, sitemap: Column) -> Column:
    """``bots`` gives allowed, partially_restricted or blocked by crawler."""
    points = 8 * robots.cast("int") + 15 * llms.cast("int") + 8 * llms_full.cast("int") + 7 * sitemap.cast("int")
    for name, full in BOT_POINTS.items():
        points = points + F.when(bots[name] == "allowed", full).when(bots[name] == "partially_restricted", full // 2).otherwise(0)
    return F.bround(points * 100 / 77, 1)


# Points of answers by the words that a model gives.
CLARITY = {"clear": 100, "somewhat_clear": 50, "unclear": 15}
DENSITY = {"dense": 100, "adequate": 60, "sparse": 25, "bloated": 15}
COMPLETENESS = {"complete": 100, "partial": 50, "minimal": 15}
COHERENCE = {"consistent": 100, "somewhat_consistent": 50, "contradictory": 15}
COVERAGE = {"comprehensive": 100, "adequate": 50, "incomplete": 15}
MODEL_FITNESS = {"optimized": 100, "adequate": 50, "poor": 15}
CONFIDENCE = {"high": 90, "medium": 55, "low": 25, "none": 5}
CONTACT_TYPES = {"sales": 25, "support": 20, "general": 15, "legal": 5, "invalid": 0}


def looked_up(value: Column, points: dict[str, int], otherwise: int) -> Column:
    out = F.lit(otherwise)
    for name, n in points.items():
        out = F.when(value == name, n).otherwise(out)
    return out


def homepage_comprehension(filled: Column, clarity: Column, density: Column, features: Column, remember: Column) -> Column:
    """``filled`` of four fields, words for clarity and density, number of features named."""
    score = 0.4 * filled / 4 * 100 + 0.2 * looked_up(clarity, CLARITY, 20) + 0.2 * looked_up(density, DENSITY, 30)
    return F.least(F.lit(100.0), score + 0.1 * F.least(15 * features, F.lit(60)) + 10 * remember.cast("int"))


def meta_optimization(completeness: Column, clarity: Column, fitness: Column, click: Column) -> Column:
    score = 0.35 * looked_up(completeness, COMPLETENESS, 20) + 0.25 * looked_up(clarity, CLARITY, 20) + 0.25 * looked_up(fitness, MODEL_FITNESS, 20)
    return F.least(F.lit(100.0), score + 15 * click.cast("int"))


def content_delta(filled: Column, coherence: Column, completeness: Column) -> Column:
    """``filled`` of five fields."""
    score = 0.4 * filled / 5 * 100 + 0.3 * looked_up(coherence, COHERENCE, 60) + 0.3 * looked_up(completeness, COVERAGE, 20)
    return F.least(F.lit(100.0), score)


def email_validation(contact_types: Column, confidence: Column, has_best: Column) -> Column:
    """``contact_types`` is the array of the valid contacts' types; the second adds little, more nothing."""
    n = F.size(contact_types)
    presence = F.when(n == 0, 0).when(n == 1, 20).otherwise(30)
    best = F.coalesce(F.array_max(F.transform(contact_types, lambda t: looked_up(t, CONTACT_TYPES, 0))), F.lit(0))
    return F.least(F.lit(100.0), presence + best + 0.35 * looked_up(confidence, CONFIDENCE, 30) + 10 * has_best.cast("int"))
