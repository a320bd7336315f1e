"""Queries over runs (the orders table) and over factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..operators import compare, listing, revisions
from ..sources.tables import read, runs
from .page_queries import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

RUNS = """SELECT o_orderkey AS run_id, o_custkey AS series, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  o_totalprice / 5000 AS score, o_orderpriority AS priority FROM orders"""
NEWEST = "row_number() OVER (PARTITION BY series ORDER BY created_at DESC, run_id DESC)"
OLDEST = "PARTITION BY series ORDER BY created_at, run_id"
DONE = f"SELECT * FROM ({RUNS}) WHERE status = 'succeeded'"


@query(f"SELECT run_id, series, status FROM (SELECT *, {NEWEST} AS n FROM ({RUNS})) WHERE n = 1")
def latest_revision(spark, sf_dir):
    return revisions.latest(runs(spark, sf_dir)).select("run_id", "series", "status")


@query(f"""SELECT run_id, coalesce(previous_id, -1) AS previous_id, round(score - previous_score, 1) + 0.0 AS delta FROM (
  SELECT a.run_id, a.score, p.run_id AS previous_id, p.score AS previous_score, row_number() OVER (PARTITION BY a.run_id ORDER BY p.created_at DESC, p.run_id DESC) AS n
  FROM ({DONE}) a LEFT JOIN ({DONE}) p ON a.series = p.series AND CAST(p.created_at AS DATE) < CAST(a.created_at AS DATE)) WHERE n = 1""")
def previous_revision_delta(spark, sf_dir):
    """-1 stands for no previous run."""
    return revisions.with_previous(runs(spark, sf_dir)).select("run_id", F.coalesce("previous_id", F.lit(-1)).alias("previous_id"), "delta")


@query(f"SELECT run_id, series FROM (SELECT *, {NEWEST} AS n FROM ({RUNS})) WHERE n > 6")
def beyond_kept_history(spark, sf_dir):
    return revisions.beyond_newest(runs(spark, sf_dir), 5).select("run_id", "series")


HISTORY = f"SELECT series, run_id, CAST(row_number() OVER ({OLDEST}) AS INTEGER) AS run_no, round(score - lag(score) OVER ({OLDEST}), 1) + 0.0 AS delta FROM ({DONE})"


@query(HISTORY)
def run_history(spark, sf_dir):
    return revisions.history(runs(spark, sf_dir)).select("series", "run_id", "run_no", "delta")


@query(f"SELECT series, run_id, run_no, CASE WHEN delta IS NULL THEN '—' WHEN delta > 0 THEN '+' || printf('%.1f', delta) ELSE printf('%.1f', delta) END AS delta FROM ({HISTORY})")
def run_history_report(spark, sf_dir):
    """The rows of the history's CSV, deltas signed."""
    return revisions.history(runs(spark, sf_dir)).select("series", "run_id", "run_no", X.delta_text(F.col("delta")).alias("delta"))


@query(f"SELECT series, run_id, CAST(place AS INTEGER) AS place FROM (SELECT *, {NEWEST} AS place FROM ({DONE})) WHERE place <= 3")
def newest_scores(spark, sf_dir):
    return revisions.newest(runs(spark, sf_dir), 3).select("series", "run_id", "place")


CHANGE = f"""SELECT l.series, l.run_id, l.status, round(l.score - s.score, 1) AS delta FROM (SELECT * FROM (SELECT *, {NEWEST} AS n FROM ({RUNS})) WHERE n = 1) l
  LEFT JOIN (SELECT series, score FROM (SELECT *, {NEWEST} AS n FROM ({DONE})) WHERE n = 2) s USING (series)"""


@query(CHANGE)
def latest_against_second(spark, sf_dir):
    return revisions.latest_against_second(runs(spark, sf_dir))


@query(f"""SELECT series, count(*) AS n_runs, count(*) FILTER (status = 'succeeded') AS n_succeeded, max(created_at) AS last_run, arg_max(run_id, struct_pack(created_at, run_id)) AS latest_id,
  arg_max(status, struct_pack(created_at, run_id)) AS latest_status, round(arg_max(score, struct_pack(created_at, run_id)), 2) AS latest_score FROM ({RUNS}) GROUP BY series""")
def site_cards(spark, sf_dir):
    return revisions.cards(runs(spark, sf_dir))


COUNTED = f"({CHANGE}) JOIN (SELECT series, count(*) AS n FROM ({RUNS}) GROUP BY series) USING (series)"


@query(f"""SELECT count(*) AS tracked, count(*) FILTER (delta > 0) AS improved, count(*) FILTER (delta < 0) AS declined, count(*) FILTER (n < 2) AS need_baseline,
  count(*) FILTER (status = 'pending') AS running, count(*) FILTER (status = 'failed') AS failed FROM {COUNTED}""")
def dashboard_summary(spark, sf_dir):
    return revisions.dashboard(runs(spark, sf_dir))


@query(f"""SELECT series, coalesce(delta < -5, false) AS fell, status = 'failed' AS failed, n < 2 AS few FROM {COUNTED} WHERE coalesce(delta < -5, false) OR status = 'failed' OR n < 2
  ORDER BY fell DESC, failed DESC, few DESC, series LIMIT 5""")
def attention_list(spark, sf_dir):
    return revisions.attention(runs(spark, sf_dir), 5)


@query(f"""SELECT c_nationkey AS nation, count(*) AS n_sites, round(sum(score), 2) AS total FROM (SELECT * FROM (SELECT *, {NEWEST} AS n FROM ({RUNS})) WHERE n = 1)
  JOIN customer ON c_custkey = series GROUP BY ALL""")
def latest_per_site_sum(spark, sf_dir):
    last = revisions.latest(runs(spark, sf_dir)).join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("series"))
    return last.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_sites"), F.round(F.sum("score"), 2).alias("total"))


CURSOR = ("1997-01-01", 10_000)


@query(f"""SELECT run_id, created_at FROM ({RUNS}) WHERE created_at < TIMESTAMP '{CURSOR[0]}' OR created_at = TIMESTAMP '{CURSOR[0]}' AND run_id < {CURSOR[1]}
  ORDER BY created_at DESC, run_id DESC LIMIT 13""")
def keyset_page_next(spark, sf_dir):
    return listing.next_page(runs(spark, sf_dir).select("run_id", "created_at"), "created_at", "run_id", CURSOR, 12)


@query(f"""SELECT run_id, created_at FROM ({RUNS}) WHERE created_at > TIMESTAMP '{CURSOR[0]}' OR created_at = TIMESTAMP '{CURSOR[0]}' AND run_id > {CURSOR[1]}
  ORDER BY created_at, run_id LIMIT 13""")
def keyset_page_previous(spark, sf_dir):
    return listing.previous_page(runs(spark, sf_dir).select("run_id", "created_at"), "created_at", "run_id", CURSOR, 12)


@query(f"""SELECT r.run_id, r.created_at FROM ({RUNS}) r, (SELECT created_at AS t, run_id AS k FROM ({RUNS}) WHERE run_id = 100) a
  WHERE r.created_at < t OR r.created_at = t AND r.run_id < k ORDER BY r.created_at DESC, r.run_id DESC LIMIT 25""")
def keyset_page_by_anchor(spark, sf_dir):
    return listing.page_after(runs(spark, sf_dir).select("run_id", "created_at"), "created_at", "run_id", 100, 24)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') AND lower(c_mktsegment) = 'building'")
def jobs_search(spark, sf_dir):
    return listing.searched(read(spark, sf_dir, "customer"), F.col("c_name"), "00001", F.col("c_mktsegment"), "building").select("c_custkey", "c_name")


@query(f"SELECT run_id FROM ({RUNS}) WHERE status = 'succeeded' ORDER BY created_at DESC, run_id DESC LIMIT 6")
def most_recent(spark, sf_dir):
    return runs(spark, sf_dir).where("status = 'succeeded'").orderBy(F.desc("created_at"), F.desc("run_id")).select("run_id").limit(6)


@query(f"SELECT run_id FROM ({RUNS}) WHERE status = 'pending' ORDER BY created_at, run_id LIMIT 5")
def queue_pick(spark, sf_dir):
    return runs(spark, sf_dir).where("status = 'pending'").orderBy("created_at", "run_id").select("run_id").limit(5)


@query(f"SELECT run_id, status FROM (SELECT * FROM ({RUNS}) ORDER BY created_at DESC, run_id DESC LIMIT 10) WHERE status <> 'failed' ORDER BY created_at DESC, run_id DESC LIMIT 5")
def activity_feed(spark, sf_dir):
    order = [F.desc("created_at"), F.desc("run_id")]
    return listing.first_then_filtered(runs(spark, sf_dir), order, 10, F.col("status") != "failed", 5).select("run_id", "status")


@query(f"SELECT count(DISTINCT series) AS scored FROM ({DONE})")
def scored_sites(spark, sf_dir):
    return runs(spark, sf_dir).where("status = 'succeeded'").agg(F.count_distinct("series").alias("scored"))


PAIRS = f"SELECT run_id, series, status, priority, {NEWEST} AS n FROM ({RUNS})"


@query(f"""WITH r AS ({PAIRS}), a AS (SELECT DISTINCT series AS run, priority AS finding FROM r WHERE n > 1), b AS (SELECT DISTINCT series AS run, priority AS finding FROM r WHERE n = 1)
SELECT coalesce(a.run, b.run) AS run, coalesce(a.finding, b.finding) AS finding, CASE WHEN a.run IS NULL THEN 'new' WHEN b.run IS NULL THEN 'resolved' ELSE 'unchanged' END AS change
FROM a FULL JOIN b ON a.run = b.run AND a.finding = b.finding""")
def findings_diff(spark, sf_dir):
    """Findings of all earlier runs of a series against those of its latest."""
    placed = runs(spark, sf_dir).withColumn("n", F.row_number().over(revisions.newest_first())).select(F.col("series").alias("run"), F.col("priority").alias("finding"), "n")
    return compare.findings_diff(placed.where("n > 1"), placed.where("n = 1"))


@query("""SELECT l_orderkey AS run, round(sum(least(l_quantity * 2, 100) * l_extendedprice) / sum(l_extendedprice), 4) AS mean,
  round(least(100 * pow(sum(least(l_quantity * 2, 100) * l_extendedprice) / sum(l_extendedprice) / 100, 1.15), 100.0), 1) AS composite FROM lineitem GROUP BY l_orderkey""")
def weighted_composites(spark, sf_dir):
    """Line items as factors: score from quantity, weight from price."""
    score, weight = F.least(F.col("l_quantity") * 2, F.lit(100)), F.col("l_extendedprice")
    mean = F.sum(score * weight) / F.sum(weight)
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.round(mean, 4).alias("mean"), S.calibrated(mean).alias("composite"))


@query("""WITH f AS (SELECT l_orderkey AS run, l_linenumber AS factor, least(l_quantity * 2, 100) AS score, l_tax + 0.01 AS weight FROM lineitem),
e AS (SELECT a.run, x.factor AS fix, a.score, a.weight, CASE WHEN a.factor = x.factor THEN least(100.0, x.score + 20) ELSE a.score END AS fixed FROM f a JOIN f x ON a.run = x.run),
c AS (SELECT run, fix, round(least(100 * pow(sum(score * weight) / sum(weight) / 100, 1.15), 100.0), 1) AS before, round(least(100 * pow(sum(fixed * weight) / sum(weight) / 100, 1.15), 100.0), 1) AS after FROM e GROUP BY ALL)
SELECT run, fix, before, after, round(after - before, 1) AS delta FROM c""")
def counterfactual_deltas(spark, sf_dir):
    """What each fix alone would change: for every line of every order, its score raised by 20."""
    f = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("factor"), F.least(F.col("l_quantity") * 2, F.lit(100)).alias("score"), (F.col("l_tax") + 0.01).alias("weight")
    )
    return compare.counterfactual(f, f.select("run", F.col("factor").alias("fix"), "factor", (F.col("score") + 20).alias("target")))


@query("""SELECT run, fix, points, CASE WHEN points >= 3 THEN 'high' WHEN points >= 1 THEN 'medium' ELSE 'low' END AS priority, CAST(row_number() OVER (PARTITION BY run ORDER BY points IS NULL, points DESC, fix) AS INTEGER) AS place
FROM (SELECT l_orderkey AS run, l_linenumber AS fix, CASE WHEN l_returnflag = 'N' THEN NULL ELSE round(l_discount * 50, 1) END AS points FROM lineitem) WHERE points IS NULL OR points > 0""")
def ranked_fixes(spark, sf_dir):
    points = F.when(F.col("l_returnflag") == "N", F.lit(None).cast("double")).otherwise(F.round(F.col("l_discount") * 50, 1))
    return compare.ranked_fixes(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("fix"), points.alias("points")))


BAND = "CASE WHEN {0} < 0 THEN 'broken' " + " ".join(f"WHEN {{0}} >= {low} AND {{0}} <= {high} THEN '{name}'" for low, high, name in S.BANDS) + " ELSE 'excellent' END"
RATED = {lens: "CASE " + " ".join(f"WHEN round_even(least(greatest({{0}}, 0), 100), 0) <= {high} THEN '{label}'" for high, label in S.RATINGS[lens]) + " END" for lens in S.RATINGS}


@query("SELECT run_id, " + BAND.format("score") + " AS band, " + ", ".join(f"{RATED[lens].format('score')} AS {lens.lower()}_rating" for lens in S.RATINGS) + f" FROM ({RUNS})")
def band_lookup(spark, sf_dir):
    score = F.col("score")
    return runs(spark, sf_dir).select("run_id", S.band(score).alias("band"), *[S.rating(lens, score).alias(f"{lens.lower()}_rating") for lens in S.RATINGS])


SHAPES = """CASE WHEN strong = 0 AND (broken >= 2 OR average < 35 AND broken >= 1) THEN 'high_invisibility' WHEN broken = 1 AND strong = 2 AND average < 65 THEN 'critical_failure'
  WHEN broken = 1 AND strong = 2 THEN 'broken_in_strong_profile' WHEN weak + broken >= 2 THEN 'material_risk' WHEN weak + broken = 1 AND developing >= 1 THEN 'broad_exposure'
  WHEN weak + broken = 1 THEN 'single_exposure' WHEN developing >= 2 THEN 'partial_exposure' WHEN developing = 1 AND strong >= 2 THEN 'developing_with_strong'
  WHEN excellent = 3 THEN 'highly_readable' WHEN strong = 3 THEN 'strong_profile' ELSE 'needs_review' END"""


COUNT_BANDS = ", ".join(f"(ba = '{x}')::INT + (bb = '{x}')::INT + (bc = '{x}')::INT AS {'good' if x == 'strong' else x}" for _, _, x in S.BANDS)


@query(f"""WITH s AS (SELECT p_partkey AS site, p_size * 2.0 AS a, p_partkey % 101 AS b, (p_partkey * 7) % 101 AS c FROM part),
b AS (SELECT *, {BAND.format("a")} AS ba, {BAND.format("b")} AS bb, {BAND.format("c")} AS bc, (a + b + c) / 3.0 AS average FROM s),
n AS (SELECT *, {COUNT_BANDS} FROM b), m AS (SELECT *, good + excellent AS strong FROM n)
SELECT site, {SHAPES} AS shape, CASE least(a, b, c) WHEN a THEN 'AEO' WHEN b THEN 'GEO' ELSE 'AAX' END AS weakest,
  CASE greatest(a, b, c) WHEN a THEN 'AEO' WHEN b THEN 'GEO' ELSE 'AAX' END AS strongest FROM m""")
def profile_shapes(spark, sf_dir):
    """Three lens scores a site (made from part's numbers), their profile and extremes."""
    key = F.col("p_partkey")
    sites = read(spark, sf_dir, "part").select(key.alias("site"), (F.col("p_size") * 2.0).alias("a"), (key % 101).alias("b"), (key * 7 % 101).alias("c"))
    lenses = [("a", 0, "AEO"), ("b", 1, "GEO"), ("c", 2, "AAX")]
    low = F.array_min(F.array(*[F.struct(F.col(c).cast("double").alias("s"), F.lit(k).alias("k"), F.lit(n).alias("n")) for c, k, n in lenses]))["n"]
    high = F.array_max(F.array(*[F.struct(F.col(c).cast("double").alias("s"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for c, k, n in lenses]))["n"]
    shape = S.profile([S.band(F.col(c)) for c in "abc"], (F.col("a") + F.col("b") + F.col("c")) / 3.0)
    return sites.select("site", shape.alias("shape"), low.alias("weakest"), high.alias("strongest"))


@query("""SELECT s_suppkey AS site, round_even((8 * (k % 2) + CASE k % 3 WHEN 0 THEN 15 WHEN 1 THEN 7 ELSE 0 END + CASE k % 5 WHEN 0 THEN 12 WHEN 1 THEN 6 ELSE 0 END + CASE k % 7 WHEN 0 THEN 12 WHEN 1 THEN 6 ELSE 0 END
  + 15 * (k // 2 % 2) + 8 * (k // 4 % 2) + 7 * (k // 8 % 2)) * 100.0 / 77, 1) AS crawl_access FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)""")
def crawl_access_scores(spark, sf_dir):
    """Access signals made from the supplier's number."""
    k = F.col("s_suppkey")
    status = lambda m: F.when(k % m == 0, "allowed").when(k % m == 1, "partially_restricted").otherwise("blocked")
    bit = lambda n: F.floor(k / n) % 2 == 1
    score = S.crawl_access(bit(1), {"GPTBot": status(3), "ClaudeBot": status(5), "PerplexityBot": status(7)}, bit(2), bit(4), bit(8))
    return read(spark, sf_dir, "supplier").select(k.alias("site"), score.alias("crawl_access"))
