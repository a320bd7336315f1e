"""URL filters: given rules first, then association rules that FP-growth mines from labels.

All of it is DataFrame functions and Spark ML's FP-growth.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bounds of the mined rules.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_PAGES = 0.001, 0.6, 5
#: Mined rules that may be broadcast; given rules that one expression may hold.
BROADCAST_RULES, MOST_GIVEN = 50_000, 1000

_URL = r"(?s)^(?:(?!://).)*://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, _URL, 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: parts of the host, words of its first part, path segments and query keys."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    words = F.filter(F.split(host_of(url), r"[.\-]"), lambda x: x != "")
    segments = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    segments = F.transform(segments, lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    keys = F.filter(F.split(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), "&"), lambda x: x != "")
    tag = lambda name, items: F.transform(items, lambda x: F.concat(F.lit(name), x))
    named = F.concat(tag("host=", labels), tag("word=", words), tag("path=", segments), tag("query=", F.transform(keys, lambda x: F.substring_index(x, "=", 1))))
    return F.array_distinct(F.coalesce(named, F.array().cast("array<string>")))


def _met(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, id, unwanted) for each basket that has all tokens of a rule, by inverted index."""
    index = rules.select("rule_id", F.size("tokens").alias("needed"), F.explode("tokens").alias("token"))
    found = baskets.select("id", "unwanted", F.explode("tokens").alias("token")).join(index, "token")
    return found.groupBy("rule_id", "id", "unwanted", "needed").count().where(F.col("count") == F.col("needed")).select("rule_id", "id", "unwanted")


def _frequent_prefixes(baskets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(key, prefix) of each frequent set of ``upper`` tokens that do not imply each other, the empty one too, and (key, own) for each basket that holds it.

    ``baskets(upper, own)`` are arrays of ``(code, above)``; ``own`` are the others that do not imply one of the set.
    """
    state = baskets.select(F.array().cast("array<long>").alias("prefix"), F.col("upper").alias("rest"), "own")
    keyed = lambda df: df.withColumn("key", F.xxhash64("prefix"))
    prefixes, rows = keyed(state.select("prefix").limit(1)), keyed(state).select("key", "own")
    while True:
        at = state.where("size(rest) > 0").select("prefix", F.posexplode("rest").alias("at", "t"), "rest", "own")
        free = lambda x: ~F.array_contains(x["above"], F.col("t.code")) & ~F.array_contains(F.col("t.above"), x["code"])
        later = F.slice("rest", F.col("at") + 2, F.size("rest"))
        grown = keyed(at.select(F.array_append("prefix", F.col("t.code")).alias("prefix"), F.filter(later, free).alias("rest"), F.filter("own", free).alias("own")))
        frequent = materialise(grown.groupBy("key").agg(F.first("prefix").alias("prefix"), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n"), "prefixes")
        if frequent.isEmpty():
            return prefixes, rows
        state = materialise(grown.join(frequent.select("key"), "key", "left_semi"), "prefixed")
        prefixes, rows = prefixes.unionByName(frequent), rows.unionByName(state.select("key", "own"))


def mine_rules(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, confidence, alike): token combinations that point at unwanted pages.

    ``labels(id, unwanted)`` belong to ``pages(page_id, url)`` by id.  A rule is met by
    ``MIN_SUPPORT`` of the labelled pages and ``MIN_PAGES`` of them that are unwanted, and by no more
    wanted ones than ``MIN_CONFIDENCE`` allows.  No labelled page gives no rule.

    Single tokens are counted outright.  FP-growth then looks for combinations of the other tokens in the
    unwanted pages' baskets; a combination with a token that is a rule by itself blocks nothing more.
    Tokens that always occur together are one item; ``alike`` has for each of ``tokens`` all that stand for
    it, and each choice of them is a rule with the same confidence.  Of tokens of which one never occurs
    without the other, no combination holds both, as it says no more than that without the other.  So the
    tokens that others imply, such as the upper parts of a path, are chosen first, as sets that do not imply
    each other, and FP-growth runs in the baskets that hold such a set, over the tokens that nothing implies.
    Every combination is counted in all its baskets, and a trap whose addresses repeat or nest
    their parts is not mined for all their subsets.  Confidences are counted over all labelled pages.
    """
    marked = labels.where("id is not null and unwanted is not null").groupBy("id").agg(F.max("unwanted").alias("unwanted"))
    baskets = pages.join(marked, pages["page_id"] == marked["id"]).select("id", "unwanted", url_tokens(F.col("url")).alias("tokens"))
    baskets = materialise(baskets.where("size(tokens) > 0"), "baskets")
    n = baskets.count()
    if not n:
        return pages.sparkSession.createDataFrame([], "tokens array<string>, confidence double, alike array<array<string>>")
    least = max(MIN_SUPPORT * n, MIN_PAGES) - 1e-9
    bad = F.count_if("unwanted").alias("bad")
    each = baskets.select("id", "unwanted", F.explode("tokens").alias("token"))
    single = materialise(each.groupBy("token").agg(F.count("*").alias("n"), bad).where(F.col("bad") >= least).withColumn("confidence", F.col("bad") / F.col("n")), "tokens")
    alone = single.where(F.col("confidence") >= MIN_CONFIDENCE).select(F.array("token").alias("tokens"), "confidence", F.array(F.array("token")).alias("alike"))

    open_tokens = single.where(F.col("confidence") < MIN_CONFIDENCE).select("token", "n")
    # Every basket's tokens that are left, as one array: pairs are made within an address, not within a group of rows.
    kept = materialise(each.join(open_tokens, "token").groupBy("id", "unwanted").agg(F.sort_array(F.collect_list(F.struct("token", "n"))).alias("tokens")), "kept")
    pairs = kept.select(F.explode("tokens").alias("a"), "tokens").select("a", F.explode("tokens").alias("b")).where("a.token <> b.token and a.n <= b.n")
    both = pairs.groupBy("a", "b").count().where(F.col("count") == F.col("a.n"))  # a never without b
    always = both.groupBy(F.col("a.token").alias("token")).agg(F.min(F.when(F.expr("a.n = b.n"), F.col("b.token"))).alias("first"), F.collect_set(F.when(F.expr("a.n < b.n"), F.xxhash64("b.token"))).alias("above"))
    named = open_tokens.select("token").join(always, "token", "left").select("token", F.least("token", "first").alias("item"), F.coalesce("above", F.array().cast("array<long>")).alias("above"))
    named = materialise(named.withColumn("code", F.xxhash64("item")), "items")
    alike = named.groupBy("code").agg(F.min("item").alias("token"), F.sort_array(F.collect_list("token")).alias("alike"))
    implied = named.select(F.explode("above").alias("code")).distinct().withColumn("upper", F.lit(True))
    items = named.where("token = item").join(implied, "code", "left").select("token", F.struct("code", "above", F.coalesce("upper", F.lit(False)).alias("upper")).alias("item"))
    there = kept.where("unwanted").select("id", F.explode("tokens.token").alias("token")).join(items, "token").groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    of = lambda upper: F.transform(F.filter("items", lambda x: x["upper"] == upper), lambda x: F.struct(x["code"].alias("code"), x["above"].alias("above")))
    prefixes, rows = _frequent_prefixes(materialise(there.select(of(True).alias("upper"), of(False).alias("own")), "unwanted"), least)
    reduced = rows.where("size(own) > 0").select(F.transform("own", lambda x: F.concat_ws(" ", F.col("key").cast("string"), x["code"].cast("string"))).alias("items"))
    reduced = materialise(reduced, "reduced")
    m = reduced.count()
    sets = prefixes.select(F.col("prefix").alias("codes"))
    if least <= m:
        parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        grown = FPGrowth(itemsCol="items", minSupport=min(1.0, least / m), minConfidence=1.0, numPartitions=parts).fit(reduced).freqItemsets
        grown = grown.select(F.substring_index(F.col("items")[0], " ", 1).cast("long").alias("key"), F.transform("items", lambda x: F.substring_index(x, " ", -1).cast("long")).alias("more"))
        sets = sets.unionByName(grown.join(prefixes, "key").select(F.concat("prefix", "more").alias("codes")))
    sets = sets.where("size(codes) > 1").select(F.xxhash64(F.array_sort("codes")).alias("rule_id"), F.explode("codes").alias("code")).join(alike, "code")
    sets = sets.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("token", "alike"))).alias("_all"))
    sets = materialise(sets.select("rule_id", F.col("_all.token").alias("tokens"), F.col("_all.alike").alias("alike")), "sets")
    counted = _met(baskets, sets).groupBy("rule_id").agg(F.count("*").alias("n"), bad).withColumn("confidence", F.col("bad") / F.col("n"))
    several = sets.join(counted.where(F.col("confidence") >= MIN_CONFIDENCE), "rule_id").select("tokens", "confidence", "alike")
    return alone.unionByName(several)


def given_rule(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the given ``(verdict, host, path)`` rules that fits, as a struct, or null."""
    if len(rules) > MOST_GIVEN:
        raise ValueError("too many given rules for one expression")
    host, path, out = host_of(url), path_of(url), F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, confidence) for every row of ``pages``.

    A given rule decides where one fits; else a mined rule whose tokens, or others alike, the URL has all
    of blocks it, and ``confidence`` is that of the most confident one; else it is allowed.  Null URLs and
    those without ``://`` have an empty host and path.  Repeated rows are judged alike, other
    columns are not read, an empty table gives no rows.

    Mined rules are an inverted index from tokens; only URLs that no given rule decides are looked
    up, each once, however often it occurs.
    """
    pages = pages.select("page_id", "url")
    ruled = given_rule(F.col("url"), rules)
    found = mine_rules(pages, labels).withColumn("rule_id", F.xxhash64("tokens")).withColumn("needed", F.size("tokens"))
    index = found.select("rule_id", "needed", "confidence", F.posexplode("alike").alias("slot", "alike"))
    index = materialise(index.select("rule_id", "needed", "confidence", "slot", F.explode("alike").alias("token")), "rules")
    if index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    open_urls = pages.where(ruled.isNull() & F.col("url").isNotNull()).select("url").distinct()
    met = open_urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token")).join(index, "token")
    full = met.groupBy("url", "rule_id", "needed", "confidence").agg(F.count_distinct("slot").alias("met")).where(F.col("met") == F.col("needed"))
    blocked = full.groupBy("url").agg(F.max("confidence").alias("confidence"))
    out = pages.join(blocked, "url", "left").withColumn("given", given_rule(F.col("url"), rules))
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("given.rule").alias("rule"), verdict.alias("verdict"), "confidence")
