"""Queries over scores: what agents make of sites, interpretations, factor formulas and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import compare, jobs, recommend
from ..sources.tables import read, runs
from .page_queries import ORACLES, QUERIES, query
from .run_queries import BAND, COUNT_BANDS, RUNS, SHAPES

__all__ = ["ORACLES", "QUERIES"]

# Signals made from a part's number, in SQL that both engines read.
SIGNALS = {
    "home_missing": "k % 5", "s_homepage_comprehension": "CASE WHEN k % 11 > 0 THEN k * 3 % 95 + 0.5 END", "facts": "k % 3",
    "coverage_word": "CASE k % 5 WHEN 0 THEN 'comprehensive' WHEN 1 THEN 'adequate' WHEN 2 THEN 'incomplete' WHEN 3 THEN 'odd' END", "essentials_missing": "k % 6", "s_content_delta": "k * 7 % 90 + 0.5",
    "suggestions": "CASE WHEN k % 7 = 0 THEN 2 ELSE 0 END", "click": "k % 2 = 0", "meta_complete": "CASE k % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'minimal' END", "meta_clear": "CASE WHEN k % 4 > 0 THEN 'clear' ELSE 'unclear' END",
    "s_meta_optimization": "k * 13 % 100 + 0.0", "confidence": "CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END", "s_email_validation": "k * 17 % 80 + 0.0",
    "has_email": "k % 2 > 0", "has_mailto": "k % 3 > 0", "has_contact_page": "k % 5 > 1", "has_social_links": "k % 7 > 2", "has_contact_point": "k % 11 > 4", "s_contactability": "k % 21 + 0.0",
    "lost_domain": "CASE WHEN k % 4 = 0 THEN k % 30 + 0.0 END", "lost_obfuscated": "CASE WHEN k % 6 = 0 THEN 10.0 END", "lost_legal": "CASE WHEN k % 9 = 0 THEN 15.0 END",
}
SITES = "SELECT k, " + ", ".join(f"{e} AS {n}" for n, e in SIGNALS.items()) + ", [0, 1, 2, 1][k % 4 + 1] AS n_contacts, [0, 15, 20, 25][k % 4 + 1] AS best FROM (SELECT p_partkey AS k FROM part)"
CAPPED = "CASE WHEN lost_domain IS NULL THEN {0} ELSE least(20, {0}) END"
BASE = "s_contactability + coalesce(lost_domain, 0)"
SIGNAL_GAIN = """CASE WHEN has_email OR lost_domain IS NOT NULL THEN 0 ELSE 20 END + CASE WHEN has_mailto OR lost_obfuscated IS NOT NULL THEN 0 ELSE 10 END
  + CASE WHEN has_contact_page THEN 0 ELSE 10 END + CASE WHEN has_social_links THEN 0 ELSE 10 END + CASE WHEN has_contact_point THEN 0 ELSE 15 END"""
ACTIONS = [
    ("homepage_comprehension", "make the homepage clear", "home_missing > 0 AND s_homepage_comprehension IS NOT NULL", "s_homepage_comprehension + 10 * home_missing"),
    ("content_delta", "state missing facts", "facts > 0", "s_content_delta + 0.3 * (100 - CASE coverage_word WHEN 'comprehensive' THEN 100 WHEN 'adequate' THEN 50 WHEN 'odd' THEN 20 ELSE 15 END)"),
    ("content_delta", "state missing essentials", "essentials_missing > 0", "s_content_delta + 40.0 * essentials_missing / 5"),
    ("meta_optimization", "write better metadata", "suggestions > 0 OR NOT (click AND meta_complete = 'complete' AND meta_clear = 'clear') OR meta_complete IS NULL", "s_meta_optimization + 25"),
    ("email_validation", "give valid addresses", "n_contacts = 0 OR confidence = 'low'", "s_email_validation + 50"),
    ("email_validation", "give an address for sales", "n_contacts > 0 AND confidence <> 'low' AND best < 25", "s_email_validation + 25 - best + CASE WHEN n_contacts = 1 THEN 10 ELSE 0 END"),
    ("contactability", "publish an address of the own domain", "lost_domain IS NOT NULL", f"{BASE} + CASE WHEN has_email THEN 15 ELSE 20 END"),
    ("contactability", "make an address clickable", "lost_obfuscated IS NOT NULL", CAPPED.format(f"({BASE} + 10 + lost_obfuscated)")),
    ("contactability", "publish an address outside legal pages", "lost_legal IS NOT NULL", CAPPED.format(f"({BASE} + 15 + lost_legal)")),
    ("contactability", "add contact signals", f"{SIGNAL_GAIN} > 0", CAPPED.format(f"({BASE} + {SIGNAL_GAIN})")),
]
ACTION_SQL = " UNION ALL ".join(f"SELECT k AS run, '{fix}' AS fix, '{factor}' AS factor, round(least(100.0, CAST({target} AS DOUBLE)), 6) AS target FROM s WHERE {when}" for factor, fix, when, target in ACTIONS)


@query(f"WITH s AS ({SITES}) {ACTION_SQL}")
def actionable_fixes(spark, sf_dir):
    k = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    contacts = F.expr("CASE k % 4 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('general') WHEN 2 THEN array('legal', 'support') ELSE array('sales') END")
    sites = k.select("k", *[F.expr(e).alias(n) for n, e in SIGNALS.items()], contacts.alias("contacts"))
    return recommend.proposed(sites, recommend.actionable_rules(), "k").withColumn("target", F.round("target", 6))


@query("""SELECT p_partkey AS part, CASE WHEN p_type = 'STANDARD POLISHED TIN' THEN 'whole' WHEN starts_with(p_type, 'STANDARD') THEN 'standard' WHEN starts_with(p_type, 'PROMO') THEN 'promo' ELSE '' END AS guidance FROM part""")
def fix_guidance(spark, sf_dir):
    """Guidance by whole titles and by prefixes, with types of parts as titles."""
    text = recommend.guidance(F.col("p_type"), {"STANDARD POLISHED TIN": "whole"}, {"STANDARD": "standard", "PROMO": "promo"})
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), text.alias("guidance"))


NAMED = lambda key, names: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
BAND_NAMES = ", ".join(f"upper(b{x}[1]) || b{x}[2:]" for x in "abc")


@query(f"""WITH s AS (SELECT p_partkey AS site, p_size * 2.0 AS a, p_partkey % 101 AS b, CASE WHEN p_partkey % 8 > 0 THEN (p_partkey * 7) % 101 END AS c FROM part),
b AS (SELECT *, {BAND.format("a")} AS ba, {BAND.format("b")} AS bb, {BAND.format("c")} AS bc, (a + b + c) / 3.0 AS average FROM s),
n AS (SELECT *, {COUNT_BANDS} FROM b), m AS (SELECT *, good + excellent AS strong FROM n), r AS (SELECT *, CASE WHEN c IS NULL THEN 'incomplete' ELSE {SHAPES} END AS shape,
  CASE WHEN c IS NULL THEN NULL ELSE CASE least(a, b, c) WHEN a THEN 'AEO' WHEN b THEN 'GEO' ELSE 'AAX' END END AS weakest FROM m)
SELECT site, shape, {NAMED("shape", S.TONES)} AS tone, CASE shape WHEN 'single_exposure' THEN 'Weak: ' || {NAMED("weakest", S.EXPOSURES)} WHEN 'incomplete' THEN 'A score is missing' END AS headline, weakest,
  CASE WHEN c IS NULL THEN NULL ELSE CASE greatest(a, b, c) WHEN a THEN 'AEO' WHEN b THEN 'GEO' ELSE 'AAX' END END AS strongest, {NAMED("weakest", S.FIX_FIRST)} AS fix_first,
  CASE WHEN c IS NOT NULL THEN concat_ws(',', {BAND_NAMES}) END AS bands FROM r""")
def interpretations(spark, sf_dir):
    key = F.col("p_partkey")
    lenses = {"AEO": F.col("p_size") * 2.0, "GEO": key % 101, "AAX": F.when(key % 8 > 0, key * 7 % 101)}
    sites = read(spark, sf_dir, "part").select(F.col("*"), key.alias("site"))
    return compare.interpreted(sites, "site", lenses, {"single_exposure": "Weak: {lens}", "incomplete": "A score is missing"})


@query("SELECT p_partkey AS site, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 AND p_size % 4 <> 1 THEN p_retailprice END AS composite FROM part")
def published_composites(spark, sf_dir):
    k, reason = F.col("p_partkey"), F.when(F.col("p_size") % 4 == 1, "Test failed: timeout").when(F.col("p_size") % 4 == 2, "no page")
    composite = S.published_composite(F.col("p_retailprice"), k % 3 > 0, k % 5, F.create_map(F.lit("a"), F.lit("skipped"), F.lit("b"), reason))
    return read(spark, sf_dir, "part").select(k.alias("site"), composite.alias("composite"))


WORD = lambda n, names: "CASE k % {} {} END".format(n, " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names)))
POINTS = lambda word, points, default: f"CASE {word} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in points.items()) + f" ELSE {default} END"
CLEAR, DENSE, FULL, WHOLE, FIT, SAYS, SURE = (WORD(n, list(w)) for n, w in ((4, S.CLARITY), (5, S.DENSITY), (7, S.COMPLETENESS), (6, S.COVERAGE), (11, S.MODEL_FITNESS), (9, S.COHERENCE), (13, S.CONFIDENCE)))


@query(f"""SELECT k AS site,
  round(least(100.0, 10.0 * (k % 5) + 0.2 * {POINTS(CLEAR, S.CLARITY, 20)} + 0.2 * {POINTS(DENSE, S.DENSITY, 30)} + 0.1 * least(15 * (k % 7), 60) + CASE WHEN k % 2 = 0 THEN 10 ELSE 0 END), 6) AS homepage,
  round(least(100.0, 0.35 * {POINTS(FULL, S.COMPLETENESS, 20)} + 0.25 * {POINTS(CLEAR, S.CLARITY, 20)} + 0.25 * {POINTS(FIT, S.MODEL_FITNESS, 20)} + CASE WHEN k % 3 = 0 THEN 15 ELSE 0 END), 6) AS meta,
  round(least(100.0, 8.0 * (k % 6) + 0.3 * {POINTS(SAYS, S.COHERENCE, 60)} + 0.3 * {POINTS(WHOLE, S.COVERAGE, 20)}), 6) AS content,
  round(least(100.0, [0, 20, 30, 20][k % 4 + 1] + [0, 15, 20, 25][k % 4 + 1] + 0.35 * {POINTS(SURE, S.CONFIDENCE, 30)} + CASE WHEN k % 5 > 0 THEN 10 ELSE 0 END), 6) AS email
  FROM (SELECT p_partkey AS k FROM part)""")
def agent_factor_scores(spark, sf_dir):
    """Factor scores from the words that models give, made from the part's number."""
    k, word = F.col("k"), F.expr
    contacts = word("CASE k % 4 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('general') WHEN 2 THEN array('legal', 'support') ELSE array('sales') END")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    scores = {
        "homepage": S.homepage_comprehension(k % 5, word(CLEAR), word(DENSE), k % 7, k % 2 == 0),
        "meta": S.meta_optimization(word(FULL), word(CLEAR), word(FIT), k % 3 == 0),
        "content": S.content_delta(k % 6, word(SAYS), word(WHOLE)),
        "email": S.email_validation(contacts, word(SURE), k % 5 > 0),
    }
    return rows.select(k.alias("site"), *[F.round(c.cast("double"), 6).alias(n) for n, c in scores.items()])


@query("""SELECT k AS site, round(least(100.0, k % 101 + CASE WHEN k % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN k % 9 > 0 AND k % 4 >= greatest(1, k % 9 // 2) THEN 10 ELSE 0 END), 6) AS schema,
  round_even((CASE WHEN k % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 15 ELSE 0 END) * 100 / 35.0, 1) AS entity,
  round_even(least(100.0, 0.35 * (k % 101 + 0.013) + 25 * least(k % 13 / 10.0, 1.0) + CASE WHEN k % 2 = 0 THEN 15 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 15 ELSE 0 END + 10 * (k % 5 / 4.0)), 1) AS topical,
  CAST(30 * (k % 2) + 30 * (k // 2 % 2) + 20 * (k // 4 % 2) + 20 * (k // 8 % 2) AS INTEGER) AS eeat,
  CASE WHEN d <= 30 THEN 100 WHEN d <= 90 THEN 80 WHEN d <= 180 THEN 60 WHEN d <= 365 THEN 40 ELSE 20 END AS freshness,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 101 >= 80 THEN 'Strong' WHEN k % 101 >= 60 THEN 'Moderate' ELSE 'Weak' END AS label FROM (SELECT p_partkey AS k, p_partkey * 37 % 600 AS d FROM part)""")
def factor_scores(spark, sf_dir):
    k, yes, bit = F.col("p_partkey"), lambda m: F.col("p_partkey") % m == 0, lambda n: F.floor(F.col("p_partkey") / n) % 2 == 1
    return read(spark, sf_dir, "part").select(
        k.alias("site"),
        F.round(S.schema_score(k % 101, yes(2), yes(3), k % 9, k % 4).cast("double"), 6).alias("schema"),
        S.entity_consistency(yes(2), yes(3)).cast("double").alias("entity"),
        S.topical_authority(k % 101 + 0.013, k % 13, yes(2), yes(3), k % 5 / 4).cast("double").alias("topical"),
        S.eeat(bit(1), bit(2), bit(4), bit(8)).alias("eeat"),
        S.freshness_band(k * 37 % 600).alias("freshness"),
        S.generic_label(F.when(k % 7 > 0, k % 101)).alias("label"),
    )


@query("""WITH f AS (SELECT k, k % 2 = 0 AS own, k % 3 = 0 AS other, k % 5 > 1 AS mail, k % 7 > 2 AS page, k % 11 > 4 AS seen, k % 13 > 5 AS point, k % 17 > 8 AS same, k % 4 = 1 AS generic, k % 6 > 2 AS phone, k % 19 = 0 AS legal FROM (SELECT p_partkey AS k FROM part)),
t AS (SELECT *, CASE WHEN own THEN 20 WHEN other THEN 5 ELSE 0 END + CASE WHEN mail THEN 10 ELSE -10 END + CAST(page AS INT) * 10 + CAST(seen AS INT) * 15 + CAST(point AS INT) * 15 + CAST(same AS INT) * 10 + CAST(generic AS INT) * 10 + CAST(phone AS INT) * 10 - CAST(legal AS INT) * 15 AS total FROM f)
SELECT k AS site, CAST(greatest(0, least(CASE WHEN own THEN total ELSE least(total, 20) END, 100)) AS INTEGER) AS score FROM t""")
def contactability_scores(spark, sf_dir):
    k = F.col("p_partkey")
    flags = [k % 2 == 0, k % 3 == 0, k % 5 > 1, k % 7 > 2, k % 11 > 4, k % 13 > 5, k % 17 > 8, k % 4 == 1, k % 6 > 2, k % 19 == 0]
    return read(spark, sf_dir, "part").select(k.alias("site"), recommend.contactability(*flags).cast("int").alias("score"))


@query(f"SELECT run_id, CASE WHEN status <> 'failed' THEN score END AS score FROM ({RUNS})")
def cleared_scores(spark, sf_dir):
    return jobs.cleared(runs(spark, sf_dir).withColumnRenamed("status", "state"), ["score"]).select("run_id", "score")


@query(f"""SELECT run_id, CASE WHEN status = 'failed' THEN 'failed' WHEN count(*) FILTER (status = 'succeeded') OVER (PARTITION BY series ORDER BY created_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'recheck' ELSE 'completed' END AS event
  FROM ({RUNS}) WHERE status IN ('failed', 'succeeded')""")
def outcome_events(spark, sf_dir):
    return jobs.outcomes(runs(spark, sf_dir).withColumnRenamed("status", "state"))


@query(f"""SELECT run_id, CASE WHEN status = 'running' AND created_at + INTERVAL 60 MINUTE < TIMESTAMP '1996-01-01' THEN 'pending' ELSE status END AS reclaimed,
  CASE WHEN status IS NULL AND created_at + INTERVAL 60 MINUTE < TIMESTAMP '1996-01-01' THEN 'pending' ELSE status END AS adopted FROM (SELECT * REPLACE (CASE WHEN run_id % 5 > 0 THEN status END AS status) FROM ({RUNS}))""")
def requeued_jobs(spark, sf_dir):
    """States after jobs that ran too long were reclaimed, and after stranded ones were adopted."""
    now = F.lit("1996-01-01").cast("timestamp_ntz")
    table = runs(spark, sf_dir).select(F.col("run_id").alias("job_id"), F.when(F.col("run_id") % 5 > 0, F.col("status")).alias("state"), "created_at", F.col("created_at").alias("started_at"))
    adopted = jobs.adopted(table, now, 60).select("job_id", F.col("state").alias("adopted"))
    return jobs.reclaimed(table, now, 60).select("job_id", F.col("state").alias("reclaimed")).join(adopted, "job_id").withColumnRenamed("job_id", "run_id")


# One step takes the next use of every session.
SESSION_STEPS = """WITH RECURSIVE used AS (
  SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y%m%d') AS session, ts AS t, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id) AS i FROM events WHERE {when}
), steps AS (
  SELECT session, i, t AS first, least(t + INTERVAL {ttl} SECOND, t + INTERVAL {absolute} SECOND) AS ends, CAST(1 AS BIGINT) AS uses, false AS over FROM used WHERE i = 1
  UNION ALL
  SELECT s.session, u.i, first, CASE WHEN over OR u.t >= ends THEN ends ELSE least(u.t + INTERVAL {ttl} SECOND, first + INTERVAL {absolute} SECOND) END, uses + CASE WHEN over OR u.t >= ends THEN 0 ELSE 1 END, over OR u.t >= ends
  FROM steps s JOIN used u ON u.session = s.session AND u.i = s.i + 1
)"""


@query(SESSION_STEPS.format(when="ts <= (SELECT max(ts) - INTERVAL 12 HOUR FROM events)", ttl=21600, absolute=50000) + " SELECT session, max(ends) AS ends, max(uses) AS uses FROM steps GROUP BY session HAVING max(ends) > (SELECT max(ts) - INTERVAL 12 HOUR FROM events)")
def live_sessions(spark, sf_dir):
    """A user's sessions of a day that are alive twelve hours before the last event."""
    events = read(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session"), F.col("ts").alias("at"))
    last = events.agg((F.max("at") - F.make_interval(hours=F.lit(12))).alias("now"))
    return jobs.live_sessions(events, last.scalar(), 21600, 50000)
