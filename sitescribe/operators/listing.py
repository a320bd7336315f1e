"""Filters, pages and short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U


def next_page(rows: DataFrame, time: str, key: str, cursor: tuple, size: int) -> DataFrame:
    """Rows after a cursor, newest first, and one more that tells whether a page follows."""
    at, last = F.lit(cursor[0]).cast(rows.schema[time].dataType), F.lit(cursor[1])
    return rows.where((F.col(time) < at) | (F.col(time) == at) & (F.col(key) < last)).orderBy(F.desc(time), F.desc(key)).limit(size + 1)


def previous_page(rows: DataFrame, time: str, key: str, cursor: tuple, size: int) -> DataFrame:
    """Rows before a cursor, nearest first."""
    at, last = F.lit(cursor[0]).cast(rows.schema[time].dataType), F.lit(cursor[1])
    return rows.where((F.col(time) > at) | (F.col(time) == at) & (F.col(key) > last)).orderBy(time, key).limit(size + 1)


def page_after(rows: DataFrame, time: str, key: str, anchor, size: int) -> DataFrame:
    """The page after the row with key ``anchor``; its time is looked up."""
    found = rows.where(F.col(key) == anchor).select(F.col(time).alias("_at"), F.col(key).alias("_key")).limit(1)
    after = (F.col(time) < F.col("_at")) | (F.col(time) == F.col("_at")) & (F.col(key) < F.col("_key"))
    return rows.join(F.broadcast(found), after).drop("_at", "_key").orderBy(F.desc(time), F.desc(key)).limit(size + 1)  # one row is broadcast


def searched(rows: DataFrame, text: Column, q: str, status: Column | None = None, wanted: str = "") -> DataFrame:
    """Case-blind search for a substring, and for a status where one is wanted."""
    out = rows.where(F.lower(text).contains(q.lower())) if q else rows
    return out.where(F.lower(status) == wanted.lower()) if status is not None and wanted else out


def first_then_filtered(rows: DataFrame, order: list[Column], first: int, condition: Column, k: int) -> DataFrame:
    """Of the first rows in order, those that fit, and of these the first k."""
    return rows.orderBy(*order).limit(first).where(condition).orderBy(*order).limit(k)


# Bounds of an exported fix's fields, and paths that come first in a budget, in their order.
EXPORTED = {"pillar": 12, "priority": 12, "title": 200, "detail": 500}
FIRST_PATHS = ["/product", "/pricing", "/about", "/features"]


def exported(fixes: DataFrame, keys: list[str]) -> DataFrame:
    """The fields of fixes that may leave, each cut to its bound, points to one decimal."""
    return fixes.select(*keys, *[F.substring(c, 1, n).alias(c) for c, n in EXPORTED.items()], F.round("points", 1).alias("points"))


def seeds(pages: DataFrame, k: int) -> DataFrame:
    """The k first addresses of a crawl: short ones first."""
    return pages.select("url").distinct().orderBy(F.length("url"), "url").limit(k)


def page_order(pages: DataFrame) -> DataFrame:
    """Places of a site's pages for a budget: homepage, pages by ``FIRST_PATHS``, then the longest; ``pages(site, page_id, url, words)``."""
    rank = F.lit(len(FIRST_PATHS) + 1)
    for n, path in reversed(list(enumerate(FIRST_PATHS, 1))):
        rank = F.when(F.lower("url").contains(path), n).otherwise(rank)
    rank = F.when(U.canonical_path(F.col("url")) == "/", 0).otherwise(rank)
    order = Window.partitionBy("site").orderBy(rank, F.desc("words"), "page_id")
    return pages.select("site", "page_id", F.row_number().over(order).alias("place"))
