"""What is shown of a queue when some of it fails: pools, refill rounds, reasons, order of display."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pool(candidates: DataFrame, groups: list[tuple[Column, list[Column]]], limit: int) -> DataFrame:
    """candidates with pool_pos from 1 for the best `limit`, null for the rest. A candidate belongs to
    the first group whose condition holds and is ordered within it by the group's order (numbers,
    ascending); earlier groups go first, candidates of no group never come in.

    Only the best `limit` are ever ordered: they are taken from each task, then numbered."""
    group, keys = F.lit(None).cast("int"), []
    width = max(len(order) for _, order in groups)
    for n, (condition, _) in reversed(list(enumerate(groups))):
        group = F.when(condition, n).otherwise(group)
    ranked = candidates.withColumn("__group", group)
    for k in range(width):
        key = F.lit(None).cast("double")
        for n, (_, order) in enumerate(groups):
            if k < len(order):
                key = F.when(F.col("__group") == n, order[k].cast("double")).otherwise(key)
        ranked = ranked.withColumn(f"__k{k}", key)
        keys.append(f"__k{k}")
    first = ranked.where("__group IS NOT NULL").orderBy("__group", *keys).limit(limit)
    numbered = first.withColumn("pool_pos", F.row_number().over(Window.orderBy("__group", *keys)))
    return numbered.drop("__group", *keys)


def refill(queue: DataFrame, by: str, order: list[Column], accepted: str, shown: int, rounds: int) -> DataFrame:
    """queue with pos, round and position. The first `shown` rows of each queue are tried; as many as
    failed (accepted is not true) are tried next, and so on for `rounds` rounds. round is the one a
    row was tried in (null: never), position its place among the accepted ones.

    A queue is read no further than shown * rounds rows, which the tasks cut off before anything is
    shuffled. How far a round reaches is known from the running count of accepted rows, so rounds are
    columns and not a loop over rows."""
    w = Window.partitionBy(by).orderBy(*order)
    near = queue.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= shown * rounds)
    near = near.withColumn("__ok", F.coalesce(F.col(accepted), F.lit(False)).cast("int"))
    near = near.withColumn("__c", F.sum("__ok").over(Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(by)
    near = near.withColumn("__reach", F.lit(shown).cast("long")).withColumn("round", F.when(F.col("pos") <= shown, 1))
    for k in range(2, rounds + 1):
        have = F.max(F.when(F.col("pos") <= F.col("__reach"), F.col("__c"))).over(whole)
        near = near.withColumn("__next", F.col("__reach") + shown - have)
        near = near.withColumn("round", F.coalesce("round", F.when(F.col("pos") <= F.col("__next"), k))).withColumn("__reach", F.col("__next"))
    place = F.when(F.col("round").isNotNull() & (F.col("__ok") == 1), F.col("__c"))
    return near.withColumn("position", place).drop("__ok", "__c", "__reach", "__next")


def display_order(rows: DataFrame, by: str, position: str, score: str) -> DataFrame:
    """rows that have a position, with display: their place by score, highest first (none counts as 0),
    equal ones by position."""
    w = Window.partitionBy(by).orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), position)
    return rows.where(F.col(position).isNotNull()).withColumn("display", F.row_number().over(w))


def excluded_rows(groups: Mapping[str, DataFrame], key: str, title: Column, text: Column, score: Column) -> DataFrame:
    """key, reason, title, text, score of what was left out, a reason for each group of rows: titles of
    at most 200 characters, texts of 500, scores between 0 and 1 with four digits."""
    out = None
    for reason, rows in groups.items():
        part = rows.select(key, F.lit(reason).alias("reason"), F.left(title, F.lit(200)).alias("title"), F.left(text, F.lit(500)).alias("text"), F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
