"""The events' windows and folds as streams; each has a batch twin with equal results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The table's files as a stream; times become timestamps, as watermarks need them."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", f"{table}*.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, lateness: str = "1 hour", length: str = "1 hour", every: str | None = None) -> DataFrame:
    """Events of each user in each window; rows later than ``lateness`` are let go, as in any watermark."""
    window = F.window("ts", length, every) if every else F.window("ts", length)
    counted = events.withWatermark("ts", lateness).groupBy(window.alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "user_id", "n")


STATE = "n_events long, items array<long>, last_us long"
OUT = "user_id long, n_events long, distinct_items int, segment string, last_event_at timestamp"


def folded_state(events: DataFrame, threshold: int = 5) -> DataFrame:
    """Each user's state after every batch: events, distinct items (frozen at the threshold) and segment.

    The state of a user is bounded: it holds ``threshold`` items at most.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, items, last = state.get if state.exists else (0, [], 0)
        items = list(items)
        for rows in batches:
            n += len(rows)
            last = max(last, int(rows["ts"].max().value // 1000))
            for item in rows["item"].drop_duplicates():
                if len(items) < threshold and item not in items:
                    items.append(int(item))
        state.update((n, items, last))
        segment = "agency" if len(items) >= threshold else "standard"
        yield pd.DataFrame([(key[0], n, len(items), segment, pd.Timestamp(last, unit="us"))], columns=["user_id", "n_events", "distinct_items", "segment", "last_event_at"])

    rows = events.select("user_id", "ts", F.floor("value").cast("long").alias("item"))
    return rows.groupBy("user_id").applyInPandasWithState(fold, OUT, STATE, "update", "NoTimeout")


def run_once(stream: DataFrame, path: str, mode: str, checkpoint: str) -> None:
    """Everything that is there now, written to Parquet: append as files, update as one folder a batch."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    query.awaitTermination()
