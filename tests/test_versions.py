"""Tables in versions: replays, conflicts and writes that die."""

import pytest
from pyspark.sql import functions as F

from sitescribe.sources import versions as V


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    path, one = str(tmp_path / "t"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(FileNotFoundError):
        V.read_version(spark, path)
    assert V.write_version(one, path, "first") == 1
    upper = lambda t: t.withColumn("v", F.upper("v"))
    assert V.changed_version(spark, path, "second", upper) == 2
    assert rows(V.read_version(spark, path)) == [(1, "A"), (2, "B")] and rows(V.read_version(spark, path, 1)) == [(1, "a"), (2, "b")]
    # A replayed batch changes nothing, whatever it would write now.
    assert V.changed_version(spark, path, "second", lambda t: t.limit(0)) == 2 and V.write_version(one, path, "first") == 1
    assert rows(V.read_version(spark, path)) == [(1, "A"), (2, "B")] and [c["batch"] for c in V.commits(spark, path)] == ["first", "second"]


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    V.write_version(spark.createDataFrame([(1,)], "k int"), path, "first")
    broken = lambda t: t.select(F.when(F.col("k") == 1, F.raise_error(F.lit("dies"))).cast("int").alias("k"))
    with pytest.raises(Exception, match="dies"):
        V.changed_version(spark, path, "second", broken)
    assert rows(V.read_version(spark, path)) == [(1,)] and len(V.commits(spark, path)) == 1
    assert V.changed_version(spark, path, "second", lambda t: t.union(t)) == 2


def test_of_two_writers_one_wins(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1,)], "k int")
    V.write_version(df, path, "first")

    def change(t):
        V.write_version(df.union(df), path, "other", 1)  # while this one works
        return t

    with pytest.raises(V.Conflict):
        V.changed_version(spark, path, "slow", change)
    assert V.read_version(spark, path).count() == 2
    with pytest.raises(V.Conflict):
        V._commit(spark, path, 2, "same", "data-x")
    assert V.commits(spark, path)[-1]["batch"] == "other"
