"""Writers of results: JSON, CSV, Markdown, XML, and tables that are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from .markdown_sink import MarkdownPages


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_markdown(pages: DataFrame, path: str, overwrite: bool = False) -> None:
    """A file ``<path>/<host>/<page>.md`` for each of ``pages(url, markdown)``, all or none; of pages with one name the first URL counts."""
    pages.sparkSession.dataSource.register(MarkdownPages)
    rows = pages.groupBy(markdown_path(F.col("url")).alias("file")).agg(F.min_by("markdown", "url").alias("markdown"))
    rows.write.format("markdown_pages").mode("overwrite" if overwrite else "append").save(path)


def markdown_path(url: Column) -> Column:
    """host/path.md, ``index.md`` for the root."""
    path = F.regexp_replace(U.canonical_path(url), "^/", "")
    return F.concat(U.domain_of(url), F.lit("/"), F.when(path == "", "index").otherwise(path), F.lit(".md"))


def report(history: DataFrame) -> DataFrame:
    """One Markdown table a series from ``history(series, run_no, score, delta)``."""
    row = F.concat(F.lit("| "), F.col("run_no").cast("string"), F.lit(" | "), X.score_text(F.col("score")), F.lit(" | "), X.delta_text(F.col("delta")), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("run_no", row.alias("row")))), lambda x: x["row"])
    head = F.lit("| Run | Score | Change |\n| --- | --- | --- |\n")
    return history.groupBy("series").agg(F.concat(head, F.array_join(lines, "\n")).alias("markdown"))


def diff_report(factors: DataFrame) -> DataFrame:
    """A before/after table of each lens from ``factors(lens, factor, before, after, delta)``."""
    row = F.concat(F.lit("| "), X.markdown_cell(F.col("factor")), F.lit(" | "), X.score_text(F.col("before")), F.lit(" | "), X.score_text(F.col("after")), F.lit(" | "), X.delta_text(F.col("delta")), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("factor", row.alias("row")))), lambda x: x["row"])
    return factors.groupBy("lens").agg(F.array_join(lines, "\n").alias("markdown"))


def sitemap(urls: DataFrame, limit: int = 500) -> DataFrame:
    """One sitemap of the newest pages of ``urls(loc, lastmod)``, ``limit`` of them at most."""
    newest = urls.orderBy(F.desc("lastmod"), "loc").limit(limit)
    entry = F.to_xml(F.struct("loc", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod")), {"rowTag": "url"})
    entries = newest.agg(F.array_sort(F.collect_list(F.struct((-F.unix_date(F.col("lastmod").cast("date"))).alias("n"), "loc", entry.alias("xml")))).alias("x"))  # of ``limit`` rows
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n')
    return entries.select(F.concat(head, F.array_join(F.transform("x", lambda x: x["xml"]), "\n"), F.lit("\n</urlset>")).alias("xml"))


def pruned(rows: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    """What a table keeps when rows older than ``days`` are deleted; 0 keeps all."""
    return rows if days <= 0 else rows.where(F.col(time) >= as_of - F.make_interval(days=F.lit(days)))
