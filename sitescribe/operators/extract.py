"""Features of pages that need a parser.

One Arrow UDF reads each page once and returns a struct; what can be told from the struct's parts
(links, e-mails, structured data, robots files) is worked out by column functions.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import page_tree as T
from ..functions import text as X
from ..functions import urls as U
from . import structured as D

FEATURES = """title string, canonical string, meta map<string,string>, jsonld array<string>, headings array<struct<level:int,text:string>>,
  links array<struct<href:string,text:string>>, images_total int, images_with_alt int, counts map<string,int>, markdown string, visible string"""

# Tags that are counted, and first words of addresses to skip.
COUNTED = ("p", "ul", "ol", "table", "pre", "code")
SKIPPED_LINKS = ("#", "mailto:", "javascript:", "tel:", "data:")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _short(text: str, most: int = 200) -> str:
    return text[:most] + "…" if len(text) > most else text


def _pictured(e: T.Element) -> bool:
    """An image that is part of the content: no pixel, no decoration, no inline data."""
    a = e.attributes
    pixel = a.get("width") in ("0", "1") or a.get("height") in ("0", "1")
    return not pixel and a.get("role") != "presentation" and a.get("aria-hidden") != "true" and not a.get("src", "").startswith("data:")


def page_features(html: str | None, url: str | None = None) -> tuple:
    """What ``FEATURES`` names, from one parse of a page."""
    root = T.parsed(html)
    title, canonical, meta, jsonld, headings, links, visible = None, None, {}, [], [], [], []
    images = described = hidden = drawn = 0
    counts = dict.fromkeys(COUNTED, 0)
    for kind, x in T.events(root):
        if kind == "text":
            if not hidden:
                visible.append(x)
            continue
        hidden += (x.tag in T.HIDDEN) * (1 if kind == "begin" else -1)
        drawn += (x.tag == "svg") * (1 if kind == "begin" else -1)
        if x.tag in T.BLOCKS or x.tag == "br":
            visible.append(" ")
        if kind == "end":
            continue
        a = x.attributes
        if x.tag in counts:
            counts[x.tag] += 1
        if x.tag == "title" and title is None and not drawn:
            title = T.text_of(x)
        elif x.tag == "meta" and (name := a.get("name") or a.get("property")):
            meta.setdefault(name.lower(), a.get("content", "").strip())
        elif x.tag == "link" and "canonical" in a.get("rel", "").lower().split():
            canonical = canonical or a.get("href")
        elif x.tag == "img" and _pictured(x):
            images += 1
            described += bool(a.get("alt", "").strip())
        elif x.tag == "a":
            links.append({"href": a.get("href", ""), "text": T.text_of(x)})
        elif x.tag in HEADINGS and (text := T.text_of(x)):
            headings.append({"level": int(x.tag[1]), "text": _short(text)})
        elif x.tag == "script" and a.get("type", "").lower() == "application/ld+json":
            jsonld.append("".join(c for c in x.children if isinstance(c, str)))
    return title or "", canonical, meta, jsonld, headings, links, images, described, counts, T.markdown(root, url or ""), " ".join("".join(visible).split())


def _features(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = [page_features(h, u) for h, u in zip(html, url, strict=True)]
    return pd.DataFrame(rows, columns=["title", "canonical", "meta", "jsonld", "headings", "links", "images_total", "images_with_alt", "counts", "markdown", "visible"])


def with_features(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` and a struct ``f`` of features; the parser runs once a page."""
    out = pages.withColumn("f", F.pandas_udf(_features, FEATURES)("html", "url"))
    return out.withColumn("f", F.col("f").withField("markdown", X.markdown_spacing(F.col("f.markdown"))))


class _Hrefs(HTMLParser):
    """Addresses of a page's links in order, as ``page_features`` finds them, without a tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.found.append(next((value or "" for name, value in attrs if name == "href"), ""))


def page_hrefs(html: str | None) -> list[str]:
    parser = _Hrefs()
    parser.feed(html or "")
    parser.close()
    return parser.found


def with_hrefs(pages: DataFrame) -> DataFrame:
    """``pages(html)`` and a struct ``f`` of ``links.href`` only, where nothing else of a page is asked for."""
    found = F.pandas_udf(lambda pages: pages.map(lambda html: [{"href": h} for h in page_hrefs(html)]), "array<struct<href:string>>")
    return pages.withColumn("f", F.struct(found("html").alias("links")))


def content_metrics(features: Column) -> Column:
    """Words, paragraphs, lists, tables, code blocks and images of a page; without paragraphs its blocks of text count."""
    blocks = F.filter(F.split(features["markdown"], r"\n\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(#|\||```)"))
    count = lambda *tags: sum((F.coalesce(F.element_at(features["counts"], t), F.lit(0)) for t in tags), F.lit(0))
    written = features["markdown"] != ""
    return F.struct(
        X.words(F.when(written, features["markdown"]).otherwise(features["visible"])).alias("words"),
        F.when((count("p") == 0) & written, F.size(blocks)).otherwise(count("p")).alias("paragraphs"), count("ul", "ol").alias("lists"), count("table").alias("tables"),
        count("pre", "code").alias("code_blocks"), features["images_total"].alias("images_total"), features["images_with_alt"].alias("images_with_alt"),
        F.size(features["headings"]).alias("headings"), F.size(F.filter(features["headings"], lambda x: x["level"] == 1)).alias("h1_count"),
        F.coalesce(F.array_max(F.transform(features["headings"], lambda x: x["level"])), F.lit(0)).alias("depth"),
    )


def _joined(href: pd.Series, base: pd.Series) -> pd.Series:
    def join(h: str, b: str) -> str | None:
        try:
            u = urlsplit(urljoin(b, h or ""))
        except ValueError:
            return None
        return urlunsplit((u.scheme.lower(), u.netloc.lower(), u.path[:-1] if u.path.endswith("/") else u.path, "", ""))

    return pd.Series([join(h, b) for h, b in zip(href, base, strict=True)], dtype=object)


def absolute(href: str, base: str) -> Column:
    """Joined by RFC 3986, scheme and host in lower case, without query, fragment and one last slash."""
    return F.pandas_udf(_joined, "string").asNondeterministic()(href, base)  # else filters on it run it again


def classified_links(pages: DataFrame, ignored: list[str]) -> DataFrame:
    """(page_id, kind, target): internal paths and external addresses of each page, each once.

    Needs ``page_id``, ``url`` and ``f``.  The root, ignored paths and ignored domains are left out.
    """
    each = pages.select("page_id", "url", F.explode("f.links.href").alias("href"))
    skip = F.lit(False)
    for start in SKIPPED_LINKS:
        skip = skip | F.lower(F.trim(F.col("href"))).startswith(start)
    each = each.where(~skip & (F.trim(F.col("href")) != "")).withColumn("to", absolute("href", "url"))
    same = U.domain_of(F.col("to")) == U.domain_of(F.col("url"))
    path = U.canonical_path(F.col("to"))
    inside = same & (path != "/") & ~U.ignored_path(path)
    outside = ~same & ~U.ignored_domain(U.domain_of(F.col("to")), ignored) & F.col("to").startswith("http")
    kind = F.when(inside, "int").when(outside, "ext")  # one pass for both, as a union would parse the pages twice
    return each.select("page_id", kind.alias("kind"), F.when(inside, path).otherwise(F.col("to")).alias("target")).where("kind is not null").distinct()


# How the signs of an address are spelled, in brackets or as words.
SPELLED = {"at": "@", "dot": "."}
BRACKETED = re.compile(r"[(\[{]\s*(at|dot)\s*[)\]}]", re.IGNORECASE)
ADDRESS = re.compile(X.EMAIL)


def respelled(text: str) -> str:
    """``text`` with addresses put together, by one scan over its words.

    A sign in brackets counts wherever it stands, a bare word between two others: ``at`` only before a word without
    an at sign, so that prose about an address stays.  A sign that stands alone joins its neighbours; a
    dot only behind what has an at sign and is no whole address yet.
    """
    words = BRACKETED.sub(lambda m: SPELLED[m[1].lower()], text).split()
    done: list[str] = []
    at, spelled = 0, False
    while at < len(words):
        word, following = words[at], words[at + 1] if at + 1 < len(words) else ""
        sign, bare = word, SPELLED.get(word.lower())
        if bare and done and following and not spelled and (bare == "." or "@" not in following):
            sign = bare
        spelled = sign != word
        starts = following[:1].isalnum() or following[:1] == "_"
        head, _, tail = (done[-1] if done else "").rpartition("@")
        ends = bool(done) and (done[-1][-1].isalnum() or done[-1][-1] == "_")
        if sign == "@" and ends and starts or sign == "." and head and tail and starts and not ADDRESS.fullmatch(done[-1]):
            done[-1] += sign + following
            at, spelled = at + 2, False
            continue
        done.append(sign)
        at += 1
    return " ".join(done)


def deobfuscated(text: Column) -> Column:
    """``[at]``, ``(dot)`` and bare at/dot turned to their signs; spaces about them taken out of addresses."""
    return F.pandas_udf(lambda texts: texts.map(respelled, na_action="ignore"), "string")(text)


def mailto_addresses(hrefs: Column) -> Column:
    """Addresses that mailto links name, lower-cased; several are parted by commas or semicolons."""
    named = F.filter(hrefs, lambda h: F.lower(h).startswith("mailto:"))
    raw = lambda h: F.substring_index(F.substring(h, F.lit(8), F.length(h)), "?", 1)
    plain = lambda h: F.coalesce(F.try_url_decode(F.replace(raw(h), F.lit("+"), F.lit("%2B"))), raw(h))
    return F.filter(F.transform(F.flatten(F.transform(named, lambda h: F.split(plain(h), "[;,]"))), lambda a: F.lower(F.trim(a))), lambda a: a != "")


def found_emails(pages: DataFrame) -> DataFrame:
    """(page_id, email, found_as): valid addresses and the sorted ways in which each was found."""
    sets = pages.select("page_id", mailto_addresses(F.col("f.links.href")).alias("mailto"), X.emails(F.col("f.visible")).alias("text"), X.emails(deobfuscated(F.col("f.visible"))).alias("all"))
    sets = sets.withColumn("obfuscated", F.array_except("all", "text"))
    each = [sets.select("page_id", F.explode(k).alias("email"), F.lit(k).alias("k")) for k in ("mailto", "text", "obfuscated")]
    rows = each[0].unionByName(each[1]).unionByName(each[2]).where(F.col("email").rlike("^" + X.EMAIL + "$") & X.is_valid_email(F.col("email")))
    return rows.groupBy("page_id", "email").agg(F.array_sort(F.collect_set("k")).alias("found_as"))


def jsonld_items(pages: DataFrame) -> DataFrame:
    """(page_id, place, item, types): each object of the pages' JSON-LD in order; lists give their members, invalid text nothing.

    A type that is a list counts as each of its members.
    """
    blocks = pages.select("page_id", F.posexplode("f.jsonld").alias("block", "raw")).select("page_id", "block", F.try_parse_json("raw").alias("v")).where("v is not null")
    members = F.when(D.is_list(F.col("v")), F.variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    each = blocks.select("page_id", "block", F.posexplode(members).alias("at", "item")).where(D.is_object(F.col("item")))
    order = Window.partitionBy("page_id").orderBy("block", "at")
    return each.select("page_id", (F.row_number().over(order) - 1).alias("place"), "item", D.types_of(F.col("item")).alias("types"))


def dates(items: DataFrame) -> DataFrame:
    """(page_id, at): published, modified and created dates of JSON-LD objects; what is no date is left out."""
    names = ("datePublished", "dateModified", "dateCreated")
    raw = F.array(*[F.try_variant_get("item", f"$.{n}", "string") for n in names])
    return items.select("page_id", F.explode(raw).alias("raw")).select("page_id", F.col("raw").try_cast("timestamp").alias("at")).where("at is not null")


def sitemap_candidates(sites: DataFrame) -> DataFrame:
    """(site, place, url): sitemaps that ``robots`` names, in order, then the usual places."""
    lines = F.filter(F.split(F.coalesce("robots", F.lit("")), r"\r?\n"), lambda x: F.lower(F.trim(x)).startswith("sitemap:"))
    named = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    usual = F.array(*[F.concat(F.lit("https://"), F.col("site"), F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml")])
    return sites.select("site", F.posexplode(F.array_distinct(F.concat(named, usual))).alias("place", "url"))


def faq_quality(items: DataFrame) -> DataFrame:
    """(page_id, n_questions, in_range, mean_words): answers of FAQ pages, 40 to 60 words being the best."""
    faq = items.where(F.array_contains("types", "FAQPage")).select("page_id", F.explode(F.try_variant_get("item", "$.mainEntity", "array<variant>")).alias("q"))
    words = X.words(F.try_variant_get("q", "$.acceptedAnswer.text", "string"))
    return faq.groupBy("page_id").agg(F.count("*").alias("n_questions"), F.count_if(words.between(40, 60)).alias("in_range"), F.round(F.avg(words), 1).alias("mean_words"))


# Crawlers that a robots file is read for.
BOTS = ["GPTBot", "ClaudeBot", "PerplexityBot", "Google-Extended", "CCBot", "anthropic-ai", "ChatGPT-User", "OAI-SearchBot", "Bytespider", "Amazonbot", "Applebot-Extended"]


def robots_status(files: DataFrame, bots: list[str] = BOTS) -> DataFrame:
    """(site, bot, status) from ``files(site, text)``: allowed, partially_restricted or blocked.

    Neighbouring User-agent lines head a group; a blank line or another directive ends the heading.
    Lines are numbered within a file; a file is small, so its lines are one window.
    """
    lines = files.select("site", F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw"))
    lines = lines.select("site", "n", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("line"))
    key, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    ordered = Window.partitionBy("site").orderBy("n")
    lines = lines.withColumn("agent", F.when(key == "user-agent", F.lower(value))).withColumn("rule", F.when(key == "disallow", value))
    starts = F.col("agent").isNotNull() & F.lag("agent").over(ordered).isNull()
    lines = lines.withColumn("group", F.sum(starts.cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).where("group > 0")
    agents = lines.where("agent is not null").select("site", "group", "agent").distinct()
    rules = lines.groupBy("site", "group").agg(F.bool_or(F.col("rule") == "/").alias("all"), F.bool_or(F.length("rule") > 0).alias("some"))
    by_agent = agents.join(rules, ["site", "group"]).groupBy("site", "agent").agg(F.bool_or(F.coalesce("all", F.lit(False))).alias("all"), F.bool_or(F.coalesce("some", F.lit(False))).alias("some"))
    asked = files.select("site", F.explode(F.array(*map(F.lit, bots))).alias("bot")).withColumn("_a", F.lower("bot"))
    own = by_agent.select("site", F.col("agent").alias("_a"), F.struct("all", "some").alias("own"))
    star = by_agent.where("agent = '*'").select("site", F.struct("all", "some").alias("star"))
    out = asked.join(own, ["site", "_a"], "left").join(star, "site", "left")
    used = F.coalesce("own", "star")
    return out.select("site", "bot", F.when(used["all"], "blocked").when(used["some"], "partially_restricted").otherwise("allowed").alias("status"))


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(source, kind, position, loc) from ``files(source, xml)``: children of an index, or pages, in order.

    Addresses are resolved against their file's; empty ones and bad XML give none.
    """
    good = files.where(F.col("xml").rlike(r"(?s)^\s*(<\?xml.*?\?>)?\s*(<!--.*?-->\s*)*<(\w+:)?(sitemapindex|urlset)\b") & F.col("xml").rlike(r"(?s)</(\w+:)?(sitemapindex|urlset)>\s*$"))
    kind = F.when(F.col("xml").rlike(r"<(\w+:)?sitemapindex\b"), "sitemap").otherwise("page")
    named = F.filter(F.transform(F.expr("""xpath(xml, '//*[local-name()="loc"]/text()')"""), lambda x: F.trim(x)), lambda x: x != "")
    return good.select("source", kind.alias("kind"), F.posexplode(named).alias("position", "loc")).withColumn("loc", U.resolved(F.col("loc"), F.col("source")))


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(source, kind, loc) of ``sitemap_entries``."""
    return sitemap_entries(files).drop("position")


def llms_file(candidates: DataFrame) -> DataFrame:
    """The first valid file of each site and kind from ``candidates(site, kind, place, text)``; HTML is none."""
    valid = candidates.where((F.trim(F.coalesce("text", F.lit(""))) != "") & ~F.lower(F.trim(F.col("text"))).rlike(r"^(<!doctype|<html)"))
    return valid.groupBy("site", "kind").agg(F.substring(F.min_by("text", "place"), 1, 500).alias("preview"))
