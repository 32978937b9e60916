"""Running sums over whole tables without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.store import cut


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """rows with, for each name of sums, the sum of its column over the rows up to this one in
    `order` (within `by`). Rows are dealt into ranges of the order, summed inside each, and the sums
    of the ranges before are added; only one row for each range and group is ordered as a whole.
    Rows that tie in `order` follow each other as they come."""
    by = by or []
    placed = cut(rows.repartitionByRange(*by, *order).withColumn("in_range", F.spark_partition_id()))
    totals = placed.groupBy(*[F.col(b).alias(f"of_{b}") for b in by], F.col("in_range").alias("of_range")).agg(*[F.sum(c).alias(f"all_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*[f"of_{b}" for b in by]).orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[f"of_{b}" for b in by], "of_range", *[F.coalesce(F.sum(f"all_{n}").over(before), F.lit(0)).alias(f"all_{n}") for n in sums])
    same = F.col("in_range") == F.col("of_range")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"of_{b}"))
    inside = Window.partitionBy(*by, "in_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = placed.select("*", *[F.sum(c).over(inside).alias(f"in_{n}") for n, c in sums.items()])
    return within.join(offsets, same).select(*[F.col(c) for c in rows.columns], *[(F.col(f"in_{n}") + F.col(f"all_{n}")).alias(n) for n in sums])


def quantiles(rows: DataFrame, value: Column, wanted: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """`by` and, for each name of wanted, that quantile of the values that aren't null (between two of
    them by distance), null for a group without any. Values are ranked by ranges, so that no group
    and no table of distinct values has to fit one task."""
    by = by or []
    v = rows.select(*by, value.cast("double").alias("__v"))
    known = v.where(F.col("__v").isNotNull())
    placed = running(known, [F.col("__v")], {"__rank": F.lit(1)}, by)
    n = v.groupBy(*[F.col(b).alias(f"__of_{b}") for b in by]).agg(F.count("__v").alias("__n"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__of_{b}"))
    near = placed.join(F.broadcast(n), same) if not by else placed.join(n, same)
    marks = []
    for name, q in wanted.items():
        at = F.lit(q) * (F.col("__n") - 1)
        low = F.max(F.when(F.col("__rank") == F.floor(at) + 1, F.col("__v")))
        high = F.max(F.when(F.col("__rank") == F.ceil(at) + 1, F.col("__v")))
        share = F.max(at - F.floor(at))
        marks.append((low + (high - low) * share).alias(name))
    found = near.groupBy(*by).agg(*marks)
    if not by:
        return found
    named = n.drop("__n").toDF(*by)
    renamed = found.toDF(*[f"__of_{b}" for b in by], *wanted)
    return named.join(renamed, same, "left").select(*by, *wanted)
