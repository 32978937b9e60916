"""Reports on groups of rows, and small reductions that many of them share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import running


def first_rows(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows of a group in each task before the shuffle."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("in_order", F.row_number().over(w)).where(F.col("in_order") <= n).drop("in_order")


def preferred_first(rows: DataFrame, group: str, preferred: Column) -> DataFrame:
    """Rows that are preferred, and all rows of groups without one. Groups are counted apart and
    joined back, so a large one isn't gathered."""
    have = rows.groupBy(F.col(group).alias("of_group")).agg(F.coalesce(F.bool_or(preferred), F.lit(False)).alias("some"))
    return rows.join(have, F.col(group).eqNullSafe(F.col("of_group"))).where(preferred | ~F.col("some")).select(*rows.columns)


def length_profile(rows: DataFrame, group: str, n: str) -> DataFrame:
    """docs, shortest, upper median and longest of each group. The median is found by running
    counts over ranges of lengths, so no group is gathered."""
    counts = rows.groupBy(group, n).agg(F.count("*").alias("many"))
    whole = counts.groupBy(F.col(group).alias("of_group")).agg(F.sum("many").alias("docs"), F.min(n).alias("shortest"), F.max(n).alias("longest"))
    ranked = running(counts, [F.col(n)], {"upto": F.col("many")}, [group]).join(whole, F.col(group).eqNullSafe(F.col("of_group")))
    middle = F.floor(F.col("docs") / 2) + 1
    mid = ranked.where((F.col("upto") >= middle) & (F.col("upto") - F.col("many") < middle))
    return mid.select(group, "docs", "shortest", F.col(n).alias("median"), "longest")


def completeness(rows: DataFrame, group: str, tests: dict[str, Column], shares: Sequence[str] = ()) -> DataFrame:
    """cards, and for each test how many rows pass; for those of shares the rounded share as well."""
    out = rows.groupBy(group).agg(F.count("*").alias("cards"), *[F.count_if(c).alias(n) for n, c in tests.items()])
    return out.select("*", *[F.round(F.col(n) / F.col("cards"), 3).alias(f"{n}_share") for n in shares])


def compare_runs(before: DataFrame, after: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, both counters (0 where a run lacks the key) and state: added, removed or both."""
    state = F.when(F.col(a).isNull(), "added").when(F.col(b).isNull(), "removed").otherwise("both")
    return before.join(after, key, "full").select(key, F.coalesce(a, F.lit(0)).alias(a), F.coalesce(b, F.lit(0)).alias(b), state.alias("state"))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their position in an order over all of them, counted by ranges."""
    return running(rows, order, {name: F.lit(1).cast("long")})


def hit_rates(rows: DataFrame, group: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """n, hits_NN at each threshold, mean."""
    hits = [F.count_if(F.col(value) >= t).alias(f"hits_{round(t * 100)}") for t in thresholds]
    return rows.groupBy(group).agg(F.count("*").alias("n"), *hits, F.avg(value).alias("mean"))


def coerced(rows: DataFrame, fields: dict[str, tuple[str, float, float]], required: Sequence[str]) -> DataFrame:
    """rows with fields cast to a type and held within their range; rows that lack a required one go."""
    out = rows
    for name, (kind, low, high) in fields.items():
        value = F.col(name).try_cast("double").try_cast(kind)
        out = out.withColumn(name, F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high))))
    return out.dropna(subset=list(required))


def composition(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """composition: 'N kind' of a group's kinds, most frequent first."""
    counts = rows.where(F.col(kind).isNotNull()).groupBy(group, kind).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(kind).alias("k"))))
    return counts.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(" ", (-x["o"]).cast("string"), x["k"])), ", ").alias("composition"))
