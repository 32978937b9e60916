"""Streams over files, run until what is there is read."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import relational
from tidemark.streaming import documents as S


def test_sessions_and_dedup(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, t, "a"), (1, t + timedelta(minutes=10), "a"), (1, t + timedelta(hours=2), "b"), (2, t, "a"), (9, t + timedelta(days=2), "z")]
    d = spark.createDataFrame(rows, "k long, ts timestamp, key string")
    d.write.parquet(f"{tmp_path}/in")
    stream = S.read_files(spark, f"{tmp_path}/in", d.schema)
    S.store(S.dedup(stream, ["key"], "ts", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination(120)
    assert sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "z"]
    S.store(S.sessions(stream, "k", "ts"), f"{tmp_path}/s", f"{tmp_path}/c2").awaitTermination(120)
    got = {(r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/s").collect()}
    assert got >= {(1, 2), (1, 1), (2, 1)}


def test_better_versions_and_retries(spark, tmp_path):
    t = datetime(2024, 1, 1)
    d = spark.createDataFrame([("u", "x" * 10, True, t), ("u", "x" * 30, True, t + timedelta(minutes=1)), ("u", "x" * 200, False, t + timedelta(minutes=2)), ("u", None, True, t + timedelta(minutes=3))], "url string, body string, failed boolean, ts timestamp").coalesce(1)
    d.write.parquet(f"{tmp_path}/in")
    stream = S.read_files(spark, f"{tmp_path}/in", d.schema)
    S.store(S.better_versions(stream, "url", "body"), f"{tmp_path}/v", f"{tmp_path}/c1").awaitTermination(120)
    assert [(len(r.body), r.version) for r in spark.read.parquet(f"{tmp_path}/v").orderBy("version").collect()] == [(10, 1), (200, 2)]
    S.store(S.retries(stream, "url", "failed", "ts"), f"{tmp_path}/r", f"{tmp_path}/c2").awaitTermination(120)
    got = [(r.attempt, (r.due_at - t).total_seconds() / 60) for r in spark.read.parquet(f"{tmp_path}/r").orderBy("due_at").collect()]
    assert got == [(1, 30.0), (1, 33.0), (2, 61.0)]


def test_batches_merge_and_resume(spark, tmp_path):
    schema = "k string, v long"
    spark.createDataFrame([("a", 1), ("b", 5)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")

    def merge(old, new):
        rows = new if old is None else old.unionByName(new)
        return relational.merge_rows(rows, ["k"], [F.col("v").desc()])

    stream = S.read_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
    S.upsert_batches(stream, merge, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination(120)
    spark.createDataFrame([("a", 9), ("c", 2)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    S.upsert_batches(stream, merge, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination(120)
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t/v=1").collect()} == {("a", 9), ("b", 5), ("c", 2)}
