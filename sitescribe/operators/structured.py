"""JSON-LD as variants: objects at any depth, and the summary of what a reader of the data would use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

# The keys that a summary takes over, those of which it takes the name, and of contact points.
FLAT = ("@type", "name", "description", "applicationCategory", "operatingSystem", "softwareVersion", "url", "logo", "datePublished", "dateModified", "isAccessibleForFree", "priceCurrency", "contactType", "email", "availableLanguage")
NAMED = ("author", "publisher", "provider")
CONTACT = ("contactType", "email", "telephone", "availableLanguage")
#: Levels of nesting that are gone down at once.
STRIDE = 6
#: JSON that counts as nothing.
NOTHING = ("null", "false", "0", "0.0", "-0", "-0.0", '""', "[]", "{}")


def part(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f'$["{key}"]', kind)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def told(v: Column) -> Column:
    """``v``, or null where it says nothing: null, false, zero, or empty."""
    return F.when(~F.coalesce(F.to_json(v), F.lit("null")).isin(*NOTHING), v)


def members(v: Column) -> Column:
    """The members of a list; of anything else none."""
    return F.when(is_list(v), F.variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def picked(v: Column, keys: tuple[str, ...]) -> Column:
    return F.struct(*(told(part(v, k)).alias(k) for k in keys))


def plain(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def summary(item: Column) -> Column:
    """JSON of what an object says of itself; keys that say nothing are left out."""
    nested = [F.when(is_object(part(item, k)), told(part(part(item, k), "name"))).alias(k) for k in NAMED]
    contact, offers = part(item, "contactPoint"), part(item, "offers")
    several = F.transform(F.filter(F.slice(members(contact), 1, 3), is_object), lambda p: picked(p, CONTACT[:3]))
    point = F.when(is_object(contact), F.parse_json(F.to_json(picked(contact, CONTACT)))).when(F.size(several) > 0, F.parse_json(F.to_json(several)))
    priced = is_object(offers) & part(offers, "price").isNotNull() & (F.to_json(part(offers, "price")) != "null")
    same, features, entities = members(part(item, "sameAs")), members(part(item, "featureList")), members(part(item, "mainEntity"))
    texts = lambda list_, most: F.when(F.size(list_) > 0, F.transform(F.slice(list_, 1, most), plain))
    answer = lambda e: F.substring(F.split_part(part(part(e, "acceptedAnswer"), "text", "string"), F.lit(". "), F.lit(1)), 1, 120)
    asked = F.filter(entities, lambda e: is_object(e) & told(part(e, "name")).isNotNull())
    pairs = F.transform(F.slice(asked, 1, 6), lambda e: F.struct(part(e, "name", "string").alias("question"), F.when(answer(e) != "", answer(e)).alias("answer_excerpt")))
    return F.to_json(F.struct(
        *(told(part(item, k)).alias(k) for k in FLAT), *nested, point.alias("contactPoint"), F.when(priced, picked(offers, ("price", "priceCurrency"))).alias("offers"),
        F.when(F.size(same) > 0, F.size(same)).alias("sameAs_count"), texts(same, 3).alias("sameAs_sample"), texts(features, 6).alias("featureList"),
        F.when(F.size(asked) > 0, F.size(entities)).alias("mainEntity_count"), F.when(F.size(asked) > 0, pairs).alias("mainEntity_qa"),
    ))


def summaries(items: DataFrame, most: int = 5) -> DataFrame:
    """(page_id, place, summary) of the first ``most`` objects of each page of ``items(page_id, place, item)``; those that say nothing have none."""
    return items.where(F.col("place") < most).select("page_id", "place", summary(F.col("item")).alias("summary")).where("summary <> '{}'")


def every_object(items: DataFrame) -> DataFrame:
    """(page_id, depth, item): objects at any depth of ``items(page_id, item)``; every ``STRIDE`` levels are written, the last of which leads on."""
    spark = items.sparkSession
    nested = is_object(F.col("item")) | is_list(F.col("item"))
    inside = lambda level: level.lateralJoin(spark.tvf.variant_explode(F.col("item").outer())).select("page_id", F.col("depth") + 1, F.col("value")).toDF("page_id", "depth", "item").where(nested)
    edge = written(items.select("page_id", F.lit(0).alias("depth"), "item"), "objects")
    found, depth = [edge], 0
    while not edge.isEmpty():
        steps = [edge]
        for _ in range(STRIDE):
            steps.append(inside(steps[-1]))
        depth += STRIDE
        found.append(written(reduce(DataFrame.unionByName, steps[1:]), "objects"))
        edge = found[-1].where(F.col("depth") == depth)
    return reduce(DataFrame.unionByName, found).where(is_object(F.col("item")))


def types_of(item: Column) -> Column:
    """The types of an object; a list of them counts as each of its members."""
    one = F.array_compact(F.array(F.when(F.schema_of_variant(part(item, "@type")) == "STRING", part(item, "@type", "string"))))
    return F.when(is_list(part(item, "@type")), part(item, "@type", "array<string>")).otherwise(one)


def organisations(items: DataFrame) -> DataFrame:
    """(page_id, name, description): objects of type Organization at any depth of the pages' JSON-LD."""
    found = every_object(items).where(F.array_contains(types_of(F.col("item")), "Organization"))
    return found.select("page_id", *(F.when(F.schema_of_variant(part(F.col("item"), n)) == "STRING", part(F.col("item"), n, "string")).alias(n) for n in ("name", "description")))
