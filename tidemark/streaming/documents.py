"""Structured Streaming operators of document ingestion.

State lives in Spark's state store under the query's checkpoint; sources are files, so that a run
with AvailableNow resumes where the last one ended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 10, format: str = "parquet") -> DataFrame:
    """New files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


def dedup(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten `delay` after the newest time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def better_versions(stream: DataFrame, key: str, text: str, gain: int = 50) -> DataFrame:
    """key, text, version: a row whenever a key's text is new or more than `gain` characters longer
    than the best so far."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, version = state.get if state.exists else (-1, 0)
        out = []
        for p in frames:
            for t in p[text].fillna(""):
                if best < 0 or len(t) > best + gain:
                    best, version = len(t), version + 1
                    out.append((k[0], t, version))
        state.update((best, version))
        yield pd.DataFrame(out, columns=[key, text, "version"])

    kind = dict(stream.dtypes)[key]
    schema = f"{key} {kind}, {text} string, version long"
    return stream.select(key, text).groupBy(key).applyInPandasWithState(update, schema, "best long, version long", "append", GroupStateTimeout.NoTimeout)


def retries(stream: DataFrame, key: str, failed: str, time: str, first: int = 30, most: int = 24 * 60, attempts: int = 5) -> DataFrame:
    """key, attempt, due_at after each failure: first * 2**n minutes later, at most `most`; none
    after the last attempt, and a success forgets the key."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for p in frames:
            for bad, at in p.sort_values(time)[[failed, time]].itertuples(index=False):
                if not bad:
                    n = 0
                elif n < attempts:
                    out.append((k[0], n + 1, at + pd.Timedelta(minutes=min(most, first * 2**n))))
                    n += 1
        if n:
            state.update((n,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "attempt", "due_at"])

    kind = dict(stream.dtypes)[key]
    return stream.select(key, failed, time).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, attempt int, due_at timestamp", "n int", "append", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """key, start, end, n of event-time sessions; late rows beyond `delay` are dropped on streams."""
    s = F.session_window(time, gap)
    return stream.withWatermark(time, delay).groupBy(key, s.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(stream: DataFrame, key: str, time: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """key, start, n of tumbling windows."""
    return stream.withWatermark(time, delay).groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def store(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream as Parquet, everything available now, exactly once per checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, merge, target: str, checkpoint: str):
    """For each micro-batch, merge(old or None, batch) becomes the next version of a Parquet table:
    target/v=N, N being the batch, so that a batch run again writes the same version."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{target}/v={number - 1}") if number else None
        merge(old, batch).write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
