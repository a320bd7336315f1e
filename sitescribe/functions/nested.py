"""JSON, arrays and maps as column expressions; parts of the wrong kind count as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A JSON object, ``{}`` for anything else; the JSON null is no object."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(F.parse_json(F.lit("{}")))


def number_at(v: Column, path: str) -> Column:
    """The number at a path; text and booleans are none."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(v, path, "double"))


def objects(v: Column) -> Column:
    """The members of a list that are objects."""
    return F.filter(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def texts(v: Column) -> Column:
    """A text as a list of one, a list as it is, anything else as none."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")).otherwise(F.array().cast("array<string>"))


def length_of(items: Column) -> Column:
    return F.coalesce(F.when(items.isNotNull(), F.size(items)), F.lit(0))


def has_key(keys: Column, name: str) -> Column:
    """Case-blind."""
    return F.exists(keys, lambda k: F.lower(k) == name.lower())


def any_in(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.lower(text).contains(p))


def merged(left: Column, right: Column) -> Column:
    """Of two maps, entries of the right one win."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def clamped(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def true_count(fields: list[Column]) -> Column:
    """Fields that say something: neither null nor empty."""
    return sum(((F.coalesce(f.cast("string"), F.lit("")) != "").cast("int") for f in fields), F.lit(0))
