"""A training corpus from ``documents``: judge, dedup lines, dedup documents, decontaminate, mix."""

from __future__ import annotations

import functools
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescribe.llm.common import Scratch, discard, materialise, maybe_in, table, text_key
from sitescribe.llm.decontaminate import decontaminated
from sitescribe.llm.line_dedup import runs_deduped
from sitescribe.llm.mixing import mixed
from sitescribe.llm.ngram_jaccard import ngram_jaccard_components
from sitescribe.llm.quality_knn import fit_quality, quality_scores
from sitescribe.llm.queries import MIX_WEIGHTS

#: Documents below this score go.
LEAST_SCORE = 0.3


#: Columns that stages read or write; others are carried under names that nothing clashes with.
OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def stage(f):
    """A stage that returns the columns it got, whatever they are called, and what it adds."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"carried_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
        out = f(spark, docs.withColumnsRenamed(names), sf_dir)
        back = {new: old for old, new in names.items() if old not in out.columns}
        return out.drop(*(new for new in names.values() if new not in back)).withColumnsRenamed(back)

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    voters = fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, voters).where(F.col("_score") >= LEAST_SCORE).select(*docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; those of which nothing but blanks is left go."""
    kept = runs_deduped(docs)
    return kept.where((F.size("_removed") == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once; documents without
    words stay, and so does every row without an id.  Of rows with one id and text the first by their other
    columns stays.  Texts move only of documents that go or occur more than once."""
    groups = ngram_jaccard_components(docs, width=5, similarity=Fraction(4, 5))
    groups = groups.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_of")).agg(F.count("*").alias("_n"), F.bool_or(~F.col("is_first")).alias("_gone"))
    touched = materialise(groups.where("_n > 1 or _gone"), "touched")
    found = maybe_in(docs.withColumn("_key", text_key()), ["doc_id", "_key"], touched, ["_id", "_of"])
    here = found.where("_maybe")
    same = here["doc_id"].eqNullSafe(F.col("_id")) & (here["_key"] == F.col("_of"))
    kept = here.join(touched, same, "left").where(F.coalesce(~F.col("_gone"), F.lit(True)))
    # Of rows with one id and text the first by what else they hold, so that a task that runs again chooses alike.
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]))
    once = kept.where("doc_id is not null").groupBy("doc_id", "_key").agg(F.min_by(F.struct(*docs.columns), others).alias("_row")).select("_row.*")
    alone = kept.where("doc_id is null").select(*docs.columns)
    return found.where("not _maybe").select(*docs.columns).unionByName(once).unionByName(alone)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot in the mixture of sources."""
    return mixed(docs, MIX_WEIGHTS, block=8)


def stages(scratch: Scratch) -> list:
    """The stages in order; ``scratch`` cares for what they materialise."""
    return [
        ("quality classifier", scratch.stage(quality)),
        ("line dedup", scratch.stage(line_dedup)),
        ("n-gram Jaccard join", scratch.stage(near_duplicates)),
        ("benchmark decontamination", scratch.stage(decontamination)),
        ("mixing sources to target weights", scratch.stage(mixing)),
    ]


STAGES = stages(Scratch())

#: The classifier and the runs of lines are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before, each = table(spark, sf_dir, "documents"), [], stages(Scratch())
    for name, stage in each[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return each[-1][1](spark, docs, sf_dir)
