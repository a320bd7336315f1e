"""The queries of this subpackage's operators, each over its whole table."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import benchmark_matches
from .embedding_dedup import embedding_duplicates
from .html_text import extracted
from .line_dedup import runs_deduped
from .lm_scoring import text_scores
from .mixing import mixed
from .ngram_jaccard import ngram_jaccard_components
from .quality_knn import fit_quality, held_out, quality_scores
from .queries_11_13 import ORACLES as LATER_ORACLES
from .queries_11_13 import QUERIES as LATER_QUERIES
from .secret_scan import labelled_findings, scanned, train_forest, word_trigrams
from .url_filter import judged

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), width=3, similarity=Fraction(9, 10)).select("doc_id", "n_shingles", "component_id")


OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), flat AS (SELECT doc_id, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM sets JOIN reached USING (doc_id) GROUP BY ALL
"""


#: Given rules: verdict, host and path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are unwanted where the label with their number says low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("unwanted"))
    return judged(table(spark, sf_dir, "pages"), labels, URL_RULES).drop("url")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reached LEFT JOIN counts USING (vec_id) GROUP BY vec_id
"""


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs.select("doc_id", "text"), fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "_match.n_words", "_match.n_hit", F.size("_match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_match.items", ","), 256).alias("items_sha256"), (F.col("_match.n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(0, len(w) - least(10, len(w)) + 1), lambda i: array_to_string(w[i + 1 : i + least(10, len(w))], ' '))) AS g
  FROM items WHERE len(w) > 0
), widths AS (SELECT DISTINCT k FROM windows
), grams AS (
  SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS i, unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS g
  FROM d, widths WHERE len(w) >= k
), hits AS (SELECT doc_id, i, k, item_id FROM grams JOIN windows USING (k, g)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), found AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents that are labelled good and not toxic."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = text_scores(docs, labels.where("quality = 1 and toxic = 0").select("doc_id"))
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")))


def lm_scoring_every_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op2_lm_scoring``, with every word that two others precede predicted from these, not one in sixteen."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = text_scores(docs, labels.where("quality = 1 and toxic = 0").select("doc_id"), every=True)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")))


ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}"
OP2_SQL = rf"""
WITH targets AS (SELECT DISTINCT doc_id, true AS target FROM labels WHERE quality = 1 AND toxic = 0
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(target, false) AS target, regexp_extract_all(coalesce(text, ''), '[{ALONE}]|[^\x20\x09-\x0D{ALONE}]+') AS w
  FROM documents LEFT JOIN targets USING (doc_id)
), tokens AS (
  SELECT r, doc_id, target, unnest(w) AS w, unnest(list_concat([NULL, NULL], w)[1:len(w)]) AS u, unnest(list_concat([NULL], w)[1:len(w)]) AS v FROM docs WHERE len(w) > 0
), counts AS (SELECT w, count(*) AS b, count(*) FILTER (target) AS t FROM tokens GROUP BY w
), totals AS (SELECT sum(b) AS b, sum(t) AS t, count(*) AS n FROM counts
), hot AS (SELECT counts.* FROM counts, totals WHERE counts.b >= 1e-5 * totals.b
), rest AS (
  SELECT any_value(totals.b) + count(hot.w) + 1 AS whole_b, any_value(totals.t) + count(hot.w) + 1 AS whole_t, any_value(totals.b) - coalesce(sum(hot.b), 0) + 1 AS rare_b,
    any_value(totals.t) - coalesce(sum(hot.t), 0) + 1 AS rare_t, greatest(1, any_value(totals.n) - count(hot.w)) AS rare_n FROM totals LEFT JOIN hot ON true
), p AS (
  SELECT tokens.*, coalesce((hot.b + 1) / whole_b, rare_b / whole_b / rare_n) AS pb, coalesce((hot.t + 1) / whole_t, rare_t / whole_t / rare_n) AS pt,
    u IS NOT NULL AND substr(md5(u), 1, 1) = substr(md5(v), 2, 1) AS anchored
  FROM tokens LEFT JOIN hot ON hot.w = tokens.w, rest
), grams AS (SELECT u, v, w, count(*) AS b, count(*) FILTER (target) AS t FROM p WHERE anchored GROUP BY ALL
), histories AS (SELECT u, v, sum(b) AS b, sum(t) AS t FROM grams GROUP BY ALL
), own AS (SELECT r, u, v, w, count(*) AS n FROM p WHERE anchored GROUP BY ALL
), own_histories AS (SELECT r, u, v, sum(n) AS m FROM own GROUP BY ALL
), each AS (
  SELECT p.r, CASE WHEN anchored THEN (g.b - n + 2 * pb) / (h.b - m + 2) ELSE pb END AS qb,
    CASE WHEN anchored THEN (g.t - CASE WHEN target THEN n ELSE 0 END + 2 * pt) / (h.t - CASE WHEN target THEN m ELSE 0 END + 2) ELSE pt END AS qt
  FROM p LEFT JOIN grams g ON anchored AND p.u = g.u AND p.v = g.v AND p.w = g.w LEFT JOIN histories h ON anchored AND p.u = h.u AND p.v = h.v
    LEFT JOIN own ON anchored AND p.r = own.r AND p.u = own.u AND p.v = own.v AND p.w = own.w LEFT JOIN own_histories o ON anchored AND p.r = o.r AND p.u = o.u AND p.v = o.v
), losses AS (SELECT r, -avg(ln(qt)) AS loss_target, -avg(ln(qb)) AS loss_background FROM each GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(loss_target, 6) AS loss_target, round(loss_background, 6) AS loss_background, round(loss_target - loss_background, 6) AS score
FROM docs LEFT JOIN losses USING (r)
"""

#: The same without the choice of anchors by digests.
EVERY_HISTORY_SQL = OP2_SQL.replace("u IS NOT NULL AND substr(md5(u), 1, 1) = substr(md5(v), 2, 1) AS anchored", "u IS NOT NULL AS anchored")


#: Whole parts of the mixture by source; other sources have one part each.
MIX_WEIGHTS = {"src0": 4, "src1": 3, "src2": 2}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX_WEIGHTS, block=8)


OP3_SQL = """
WITH RECURSIVE parts AS (
  SELECT s, row_number() OVER (ORDER BY s) AS i, CASE s WHEN 'src0' THEN 4 WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END AS parts
  FROM (SELECT DISTINCT coalesce(source, '') AS s FROM documents)
), total AS (SELECT CAST(sum(parts) AS BIGINT) AS q FROM parts
), plan AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS pick, list({'i': i, 'parts': CAST(parts AS BIGINT), 'k': CAST(1 AS BIGINT)} ORDER BY i) AS st FROM parts
  UNION ALL
  SELECT slot + 1, best, list_transform(st, lambda x: {'i': x.i, 'parts': x.parts, 'k': x.k + CASE WHEN x.i = best THEN 1 ELSE 0 END})
  FROM (SELECT slot, st, list_min(list_transform(list_filter(st, lambda x: ((x.k - 1) * q) // x.parts <= slot + 1), lambda x: [(x.k * q + x.parts - 1) // x.parts, x.i]))[2] AS best
        FROM plan, total WHERE slot + 1 < q)
), turns AS (SELECT pick, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS turn FROM plan WHERE slot >= 0
), ranked AS (
  SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('mix' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents
)
SELECT doc_id, source, CAST((r // 8 // parts) * q + slot AS BIGINT) AS mix_slot, CAST(r % 8 AS INTEGER) AS mix_offset
FROM ranked JOIN parts USING (s) JOIN turns ON pick = i AND turn = (r // 8) % parts CROSS JOIN total
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionary = word_trigrams(docs)
    return scanned(docs, train_forest(spark, labelled_findings(), dictionary), dictionary)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document: lines removed, characters, and the text's digest."""
    kept = runs_deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", F.size("_removed").cast("long").alias("n_removed_lines"), F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard, "op2_lm_scoring": op2_lm_scoring, "lm_scoring_every_history": lm_scoring_every_history, "op3_mixing": op3_mixing, "op4_secrets": op4_secrets, "op5_line_dedup": op5_line_dedup, "op6_url_filter": op6_url_filter, "op7_html_text": op7_html_text, "op8_embedding_dedup": op8_embedding_dedup, "op9_quality_knn": op9_quality_knn, "op10_decontaminate": op10_decontaminate}
ORACLES = {"op2_lm_scoring": OP2_SQL, "lm_scoring_every_history": EVERY_HISTORY_SQL, "op8_embedding_dedup": OP8_SQL, "op3_mixing": OP3_SQL, "op1_ngram_jaccard": OP1_SQL, "op10_decontaminate": OP10_SQL}
QUERIES |= LATER_QUERIES
ORACLES |= LATER_ORACLES
