"""Queries over documents and their labels, and over conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..operators import compare
from ..sources.tables import read
from .page_queries import BAND_OF, ORACLES, QUERIES, WORDS, query

__all__ = ["ORACLES", "QUERIES"]

DOC_WORDS = f"SELECT doc_id, source, CAST({WORDS.format('text')} AS INTEGER) AS words FROM documents"


def doc_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source", X.words(F.col("text")).alias("words"))


@query(f"SELECT doc_id, words, CAST({BAND_OF.format('words')} AS INTEGER) AS band FROM ({DOC_WORDS})")
def doc_word_bands(spark, sf_dir):
    return doc_words(spark, sf_dir).select("doc_id", "words", S.words_band(F.col("words")).alias("band"))


@query(f"SELECT doc_id, words FROM ({DOC_WORDS}) WHERE words < 50")
def thin_docs(spark, sf_dir):
    return doc_words(spark, sf_dir).where("words < 50").select("doc_id", "words")


@query(f"""SELECT source, count(*) AS n_docs, round(avg(words), 4) AS mean_words, count(*) FILTER (words >= 50) >= 3 AS enough_content,
  bool_and(words < 50) AS thin_everywhere FROM ({DOC_WORDS}) GROUP BY source""")
def source_preconditions(spark, sf_dir):
    thick = F.col("words") >= 50
    return doc_words(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.round(F.avg("words"), 4).alias("mean_words"), (F.count_if(thick) >= 3).alias("enough_content"), F.bool_and(~thick).alias("thin_everywhere")
    )


STRIP = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
FIRST = "CASE " + " ".join(f"WHEN contains(t, {s}) THEN string_split(t, {s})[1]" for s in ("'. '", "'। '", "'。'", "'…'", "chr(10)")) + " ELSE t END"


@query(f"SELECT doc_id, CASE WHEN length(s) > 80 THEN substr(s, 1, 79) || '…' ELSE s END AS first_sentence FROM (SELECT doc_id, {FIRST} AS s FROM (SELECT doc_id, {STRIP} AS t FROM documents))")
def doc_first_sentence(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.first_sentence(F.col("text"), 80).alias("first_sentence"))


FOUND = rf"SELECT DISTINCT doc_id, lower(e) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{X.EMAIL}')) AS e FROM documents)"


def found_emails(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(X.emails(F.col("text"))).alias("email"))


@query(FOUND)
def doc_emails(spark, sf_dir):
    return found_emails(spark, sf_dir)


@query(rf"""WITH e AS (SELECT DISTINCT email, string_split(email, '@')[1] AS l, regexp_replace(email, '^[^@]*@', '') AS d FROM ({FOUND})),
p AS (SELECT *, string_split(d, '.') AS parts FROM e)
SELECT email, length(l) >= 2 AND NOT regexp_matches(l, '^[.\-]|[.\-]$|\.\.|^[0-9]+$') AND NOT regexp_matches(d, '^[.\-]|[.\-]$|\.\.') AND length(parts[-1]) BETWEEN 2 AND 8
  AND length(parts[-2]) >= 2 AND NOT regexp_matches(parts[-1], '^[0-9]+$') AND NOT regexp_matches(d, '(^|\.)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(\.|$)')
  AND NOT (d = 'example.com' OR ends_with(d, '.example.com')) AS is_valid FROM p""")
def email_validity(spark, sf_dir):
    return found_emails(spark, sf_dir).select("email").distinct().select("email", X.is_valid_email(F.col("email")).alias("is_valid"))


@query(f"SELECT email, count(*) AS n_docs, min(doc_id) AS first_doc FROM ({FOUND}) GROUP BY email")
def email_sources(spark, sf_dir):
    """The inverted index from addresses to documents."""
    return found_emails(spark, sf_dir).groupBy("email").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(rf"SELECT doc_id, md5(regexp_replace(text, '{X.EMAIL}', '[email]', 'g')) AS digest FROM documents WHERE regexp_matches(text, '{X.EMAIL}')")
def redacted_docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.col("text").rlike(X.EMAIL)).select("doc_id", F.md5(X.redact_emails(F.col("text"))).alias("digest"))


@query("""SELECT doc_id, quality IS NULL AS unlabelled, round(least(100 * pow((coalesce(0.6 * 100 * quality, 0) + coalesce(0.4 * 100 * (1 - toxic), 0) + 0.2 * least(n_chars / 50.0, 100.0))
  / (CASE WHEN quality IS NULL THEN 0 ELSE 0.6 END + CASE WHEN toxic IS NULL THEN 0 ELSE 0.4 END + 0.2) / 100, 1.15), 100.0), 1) AS composite
  FROM documents LEFT JOIN labels USING (doc_id)""")
def score_left_join_renormalised(spark, sf_dir):
    """A factor without a score is left out and the weights of the others count for it."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    factors = [(100 * F.col("quality"), 0.6), (100 * (1 - F.col("toxic")), 0.4), (F.least(F.col("n_chars") / 50.0, F.lit(100.0)), 0.2)]
    total = sum((F.coalesce(w * s, F.lit(0.0)) for s, w in factors[1:]), F.coalesce(factors[0][1] * factors[0][0], F.lit(0.0)))
    weight = sum((F.when(s.isNull(), 0.0).otherwise(w) for s, w in factors[1:]), F.when(factors[0][0].isNull(), 0.0).otherwise(factors[0][1]))
    return rows.select("doc_id", F.col("quality").isNull().alias("unlabelled"), S.calibrated(total / weight).alias("composite"))


@query("""SELECT source, count(*) AS n_docs, count(quality) AS applicable, round(avg(CASE WHEN quality = 1 THEN 100 WHEN quality = 0 THEN 0 END), 1) AS support,
  CASE WHEN count(quality) = 0 THEN 'skipped' ELSE 'completed' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def answer_fold(spark, sf_dir):
    """Share of supported answers among those that apply, as the answerability factor folds them."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    points = F.when(F.col("quality") == 1, 100).when(F.col("quality") == 0, 0)
    return rows.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count("quality").alias("applicable"), F.round(F.avg(points), 1).alias("support"),
        F.when(F.count("quality") == 0, "skipped").otherwise("completed").alias("status"),
    )


@query("""SELECT n.conv_id, n.turn, n.text = p.text AS unchanged, length(n.text) - length(p.text) AS growth FROM conversations n JOIN conversations p ON n.conv_id = p.conv_id AND p.turn = n.turn - 1""")
def turn_changes(spark, sf_dir):
    """Each turn against the one before it."""
    rows = read(spark, sf_dir, "conversations")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_before"))
    return rows.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", (F.col("text") == F.col("_before")).alias("unchanged"), (F.length("text") - F.length("_before")).cast("long").alias("growth")
    )


@query("""WITH a AS (SELECT DISTINCT text FROM conversations WHERE turn % 2 = 0), b AS (SELECT DISTINCT text FROM conversations WHERE turn % 2 = 1)
SELECT text, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT text, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def text_list_diff(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("text", "turn")
    return compare.list_diff(rows.where("turn % 2 = 0").select("text"), rows.where("turn % 2 = 1").select("text"), "text")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def cascade_delete(spark, sf_dir):
    """What is left of rows that belong to others when these are deleted."""
    gone = read(spark, sf_dir, "documents").where("source = 'src0'").select("doc_id")
    return read(spark, sf_dir, "labels").join(gone, "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def flagged_docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("""SELECT conv_id, turn, text FROM (SELECT *, sum(CAST(length(text) / 4 AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn, text) AS used FROM conversations) WHERE used <= 200""")
def token_budget(spark, sf_dir):
    """Turns that fit whole into a budget of about four characters a token, in order; halves of a token go to the even number."""
    window = Window.partitionBy("conv_id").orderBy("turn", "text")
    used = F.sum(F.rint(F.length("text") / 4).cast("long")).over(window)
    return read(spark, sf_dir, "conversations").withColumn("_used", used).where("_used <= 200").select("conv_id", "turn", "text")
