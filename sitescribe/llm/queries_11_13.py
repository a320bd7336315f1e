"""Queries 11 to 13 of this subpackage and the SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_windows import END, MARK, MARK_TOKENS, SEGMENT, TOKEN, chat_windows, read_back
from .common import table
from .hard_negatives import hard_negatives
from .spelling import spelling_variants


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""

#: Tokens of a window, and of what it repeats.
BUDGET, HISTORY = 1024, 256
ODD = r"\### Assistant: </turn> ok"


def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the windows of each conversation, and of one that says control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    read = read_back(chat_windows(rows.unionByName(odd), BUDGET, HISTORY))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    each = read.select("conv_id", "start", F.size("turns").alias("n"), said.alias("said"), "learned", F.length("text").alias("n_chars"))
    # A digest runs over a conversation from its first to its last window.
    whole = each.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("n_chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("start", "said", "learned"))).alias("w"))
    joined = lambda name: F.array_join(F.col(f"w.{name}"), "")
    digest = lambda name: F.sha2(joined(name).cast("binary"), 256)
    return whole.select(
        "conv_id", "n_turns", digest("said").alias("turns_sha256"), F.length(joined("learned")).cast("long").alias("loss_chars"), digest("learned").alias("loss_sha256"), "formatted_chars"
    )


_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '##', '#\\#'), '</turn>', '<\\/turn>')"
OP11_SQL = f"""
WITH RECURSIVE every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{ODD}' UNION ALL SELECT -7, 1, 'assistant', '{ODD}'
), turns AS (
  SELECT *, len(regexp_extract_all(text, '{TOKEN}')) + {MARK_TOKENS} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
    {len(MARK) + 1 + len(END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) AS chars FROM every
), heads AS (SELECT conv_id, tokens AS head, chars AS head_chars FROM turns WHERE i = 1 AND role = 'system'
), said AS (
  SELECT t.*, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k, greatest({BUDGET - HISTORY} - coalesce(head, 0), 1) AS room,
    CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS b, b - tokens AS a, a // (room * {SEGMENT}) AS segment
  FROM turns t LEFT JOIN heads USING (conv_id) WHERE NOT (i = 1 AND role = 'system')
), packed AS (
  SELECT conv_id, k, segment, a AS w FROM said WHERE k = 1
  UNION ALL
  SELECT s.conv_id, s.k, s.segment, CASE WHEN s.segment <> p.segment OR s.b - p.w > room THEN s.a ELSE p.w END FROM packed p JOIN said s ON s.conv_id = p.conv_id AND s.k = p.k + 1
), windows AS (SELECT DISTINCT conv_id, w FROM packed UNION SELECT conv_id, 0 FROM heads
), lengths AS (
  SELECT conv_id, sum(chars) AS n FROM said GROUP BY conv_id
  UNION ALL SELECT conv_id, head_chars FROM windows JOIN heads USING (conv_id)
  UNION ALL SELECT conv_id, sum(chars) FROM windows JOIN said USING (conv_id) WHERE b <= w AND a >= w - {HISTORY} GROUP BY conv_id
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM whole JOIN lengths USING (conv_id) GROUP BY ALL
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), one_in=97)


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The table of crc32 is built from its polynomial, bit by bit.
_STEP = "list_transform({0}, lambda c: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
_TABLE = "list_transform(range(256), lambda b: CAST(b AS BIGINT))"
for _ in range(8):
    _TABLE = _STEP.format(_TABLE)
OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_TABLE} AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents
), each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
    ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), 128 + unicode(c) % 64] END)) AS b FROM each
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS h FROM bytes, crc
), seen AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM seen WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), keys AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS k FROM places
), longer AS (SELECT DISTINCT keys.word AS a, words.word AS b FROM keys JOIN words ON keys.k = words.word
), near AS (
  SELECT x.word AS a, y.word AS b FROM keys x JOIN keys y ON x.k = y.k AND x.i = y.i AND x.word <> y.word UNION SELECT a, b FROM longer UNION SELECT b, a FROM longer
), best AS (
  SELECT a AS word, CAST(count(*) AS BIGINT) AS n_near, arg_min(b, (-words.n, b)) AS b, max(words.n) AS m FROM near JOIN words ON near.b = words.word GROUP BY a
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN b END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)
), chains(word, last, steps) AS (
  SELECT word, word, 0 FROM formed UNION ALL SELECT c.word, f.form, steps + 1 FROM chains c JOIN formed f ON c.last = f.word WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(last, steps) AS root FROM chains GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""

QUERIES = {"op11_chat_windows": op11_chat_windows, "op12_spelling_variants": op12_spelling_variants, "op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op11_chat_windows": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_hard_negatives": OP13_SQL}
