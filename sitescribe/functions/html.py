"""What can be told about a page by patterns alone, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = {"paragraphs": "<p[ >]", "lists": "<(?:ul|ol)[ >]", "tables": "<table[ >]", "code_blocks": "<(?:pre|code)[ >]", "h1_count": "<h1[ >]", "headings_total": "<h[1-6][ >]"}


def without_scripts(html: Column) -> Column:
    out = html
    for name in ("script", "style"):
        out = F.regexp_replace(out, f"(?is)<{name}[ >].*?</{name}>", " ")
    return F.regexp_replace(out, "(?s)<!--.*?-->", " ")


def count_of(html: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(html, F.lit(f"(?i)({pattern})"), F.lit(1)))


def plain_text(html: Column) -> Column:
    return F.regexp_replace(without_scripts(html), "(?s)<[^>]*>", " ")


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)<a href="([^"]*)"'), F.lit(1))


def heading_depth(html: Column) -> Column:
    return F.greatest(*[F.when(html.rlike(f"(?i)<h{n}[ >]"), F.lit(n)).otherwise(F.lit(0)) for n in range(1, 7)])
