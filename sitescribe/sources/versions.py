"""Tables of Parquet in versions: a version is written whole and then committed by one small file.

``<table>/data-<id>`` holds the rows of a version, ``<table>/commits/<number>`` says which folder and which batch.
A commit's file is created only if no other has its number, so of two writers one fails; a write that
dies leaves no commit, and readers stay with the version before.  A batch that was committed before changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the version was read."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def commits(spark: SparkSession, path: str) -> list[dict]:
    """All commits in order, each with ``version``, ``batch`` and ``data``."""
    fs, where = _files(spark, f"{path}/commits")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    found = sorted(int(n) for n in names if n.isdigit())
    rows = spark.read.text([f"{path}/commits/{n:08d}" for n in found]).collect() if found else []
    return sorted((json.loads(r.value) for r in rows), key=lambda c: c["version"])


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the last one by default."""
    known = commits(spark, path)
    chosen = [c for c in known if version is None or c["version"] == version]
    if not chosen:
        raise FileNotFoundError(f"{path} has no version {'yet' if version is None else version}")
    return spark.read.parquet(f"{path}/{chosen[-1]['data']}")


def _commit(spark: SparkSession, path: str, version: int, batch: str, data: str) -> None:
    fs, where = _files(spark, f"{path}/commits/{version:08d}")
    try:
        out = fs.create(where, False)
    except Exception as e:
        raise Conflict(f"version {version} of {path} was committed by another writer") from e
    try:
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "data": data}).encode()))
    finally:
        out.close()


def write_version(df: DataFrame, path: str, batch: str, after: int | None = None) -> int:
    """Write ``df`` as the version behind ``after`` (the last one by default); the number of the version that has ``batch``."""
    spark = df.sparkSession
    known = commits(spark, path)
    if (same := next((c for c in known if c["batch"] == batch), None)) is not None:
        return same["version"]
    last = known[-1]["version"] if known else 0
    if after is not None and after != last:
        raise Conflict(f"{path} is at version {last}, not {after}")
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    _commit(spark, path, last + 1, batch, data)
    return last + 1


def changed_version(spark: SparkSession, path: str, batch: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Commit what ``change`` makes of the last version; a batch that was committed before is not applied again."""
    known = commits(spark, path)
    if (same := next((c for c in known if c["batch"] == batch), None)) is not None:
        return same["version"]
    last = known[-1]["version"] if known else 0
    return write_version(change(read_version(spark, path, last)), path, batch, last)
