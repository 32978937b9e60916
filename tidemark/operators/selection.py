"""Selections, groupings and labels of candidates and their evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def evidence(rows: DataFrame, group: str, key: str, similarity: str, trusted: Column, limit: int) -> DataFrame:
    """group, key, pos: the `limit` most similar documents of each group; where none of them is
    trusted but one is in the group, the best trusted one takes the last place.

    No group is sorted whole: tasks keep their best `limit`, the best trusted one is an aggregate."""
    rows = rows.withColumn("__t", F.coalesce(trusted, F.lit(False)))
    w = Window.partitionBy(group).orderBy(F.col(similarity).desc(), key)
    top = rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)
    order = F.struct(F.col(similarity).isNull().alias("none"), (-F.col(similarity)).alias("s"), F.col(key).alias("k"))
    best = rows.where("__t").groupBy(F.col(group).alias("__g")).agg(F.min(order)["k"].alias("__k"))
    seen = top.where("__t").select(F.col(group).alias("__s")).distinct()
    best = best.join(seen, F.col("__g").eqNullSafe(F.col("__s")), "left_anti")
    kept = top.join(best, F.col(group).eqNullSafe(F.col("__g")), "left").where((F.col("pos") < limit) | F.col("__k").isNull())
    return kept.select(group, key, "pos").unionByName(best.select(F.col("__g").alias(group), F.col("__k").alias(key), F.lit(limit).alias("pos")))


def singletons(rows: DataFrame, key: str, relevance: str, limit: int, max_candidates: int) -> DataFrame:
    """At most min(limit, max_candidates / 4) documents by relevance, ties by key."""
    return rows.orderBy(F.col(relevance).desc(), key).limit(min(max(limit, 0), max_candidates // 4))


def top_share(rows: DataFrame, group: str, score: str, key: str, share: float) -> DataFrame:
    """rows with preferred: the ceil(n * share) best of each group, ties by key. Ranks are running
    counts over ranges of the order, so that no group has to fit one task."""
    placed = ranges.running(rows, [F.col(score).desc(), F.col(key)], {"__rank": F.lit(1)}, [group])
    quota = rows.groupBy(F.col(group).alias("__g")).agg(F.ceil(F.count("*") * share - 1e-9).alias("__quota"))
    out = placed.join(quota, F.col(group).eqNullSafe(F.col("__g")))
    return out.withColumn("preferred", F.col("__rank") <= F.col("__quota")).drop("__rank", "__g", "__quota")


def top_contributions(contributions: Column, names: Sequence[str], count: int) -> Column:
    """Names and values of the largest contributions by size, ties by name."""
    pairs = F.zip_with(F.array(*map(F.lit, names)), contributions, lambda n, c: F.struct((-F.abs(c)).alias("o"), n.alias("name"), c.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, count), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))


def representative(rows: DataFrame, group: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row for each group: the largest by order (max of a struct, so it combines map-side)."""
    return rows.groupBy(group).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__r")).select(group, "__r.*")


def stable_ids(rows: DataFrame, group: str, member: str) -> DataFrame:
    """group, id: a name made of the sorted members, the same whenever the members are."""
    members = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.col(member).cast("string"))).alias("m"))
    return members.select(group, F.substring(F.sha2(F.array_join("m", "|"), 256), 1, 32).alias("id"))


def history(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """rows with version (1 the oldest) and current: an append-only log read as an upsert with
    history."""
    w = Window.partitionBy(*keys).orderBy(at)
    return rows.withColumn("version", F.row_number().over(w)).withColumn("current", F.lead(at).over(w).isNull())


def fresh(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of a cache that are at most `days` old."""
    return rows.where(F.col(at) >= F.date_sub(now, days))


def history_windows(rows: DataFrame, at: str, days: int = 90) -> DataFrame:
    """start, stop, n: windows of `days` backwards from the last date of rows to the first, the oldest
    clamped to it, with the rows in each (behind start, up to stop; the first date counts in the
    oldest). Rows meet their window by its number, not by a range. No row for a table without dates."""
    day = rows.select(F.to_date(at).alias("day")).where("day IS NOT NULL")
    ends = day.agg(F.min("day").alias("first"), F.max("day").alias("last")).where("last IS NOT NULL")
    n = F.greatest(F.ceil(F.datediff("last", "first") / days), F.lit(1)).cast("int")
    windows = ends.select("first", "last", F.explode(F.sequence(F.lit(0), n - 1)).alias("number"))
    stop = F.date_sub("last", F.col("number") * days)
    windows = windows.select("number", F.greatest(F.date_sub(stop, days), "first").alias("start"), stop.alias("stop"))
    placed = day.crossJoin(F.broadcast(ends.withColumn("most", n - 1))).select(F.least(F.floor(F.datediff("last", "day") / days), "most").cast("int").alias("of"))
    counted = placed.groupBy("of").agg(F.count("*").alias("n"))
    return windows.join(counted, F.col("number") == F.col("of"), "left").select("start", "stop", F.coalesce("n", F.lit(0)).alias("n"))


def months(rows: DataFrame, at: str) -> DataFrame:
    """month (YYYY-MM), n: every month from the first to the last date of rows, with its rows."""
    day = rows.select(F.to_date(at).alias("day")).where("day IS NOT NULL")
    ends = day.agg(F.trunc(F.min("day"), "month").alias("first"), F.max("day").alias("last")).where("last IS NOT NULL")
    every = ends.select(F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    counted = day.groupBy(F.date_format("day", "yyyy-MM").alias("of")).agg(F.count("*").alias("n"))
    return every.join(counted, F.col("month") == F.col("of"), "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def duplicates_by_name(rows: DataFrame, name: Column, key: str) -> DataFrame:
    """name, n, keys of names that more than one row has."""
    g = rows.select(name.alias("name"), key).where("name IS NOT NULL AND name <> ''").groupBy("name").agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    return g.where("n > 1")


def label_precedence(rows: DataFrame, labels: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """rows with label and label_source: the first of the labelled tables (key, label) that has one."""
    out, values = rows, []
    for i, (name, t) in enumerate(labels):
        one = t.where(F.col("label").isNotNull()).groupBy(F.col(key).alias(f"__k{i}")).agg(F.max("label").alias(f"__l{i}"))
        out = out.join(one, F.col(key) == F.col(f"__k{i}"), "left")
        values.append((name, F.col(f"__l{i}")))
    out = out.withColumn("label", F.coalesce(*[v for _, v in values])).withColumn("label_source", F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in values]))
    return out.drop(*[f"__{c}{i}" for i in range(len(labels)) for c in "kl"])


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight: n / (classes * n of the class). Counts are one row a class and go to every task, so
    that the rows of a class don't meet in one."""
    n = rows.groupBy(F.col(label).alias("__c")).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return rows.join(F.broadcast(n), F.col(label).eqNullSafe(F.col("__c"))).join(F.broadcast(total)).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__c", "__n", "__all", "__k")


def standardised(rows: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """rows with the z-score of each column over all rows; 0 where it doesn't vary."""
    stats = rows.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = rows.join(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c + suffix, F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0))
    return out.drop(*stats.columns)


def grid(rows: DataFrame, value: str, label: str, low: float, high: float, step: float) -> DataFrame:
    """threshold, removed, lost: for each threshold of a grid, how many rows are above it and how
    many of these are labelled 1. Rows meet only the thresholds below them."""
    n = int(round((high - low) / step))
    below = F.least(F.floor((F.col(value) - low) / step + 1e-9), F.lit(n)).cast("int")
    hit = rows.where(F.col(value) >= low).groupBy(below.alias("cell")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("l"))
    cells = rows.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("cell"))
    w = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cells.join(hit, "cell", "left")
    return out.select(F.round(F.lit(low) + F.col("cell") * step, 6).alias("threshold"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("removed"), F.coalesce(F.sum("l").over(w), F.lit(0)).alias("lost"))


def precision_by_region(rows: DataFrame, in_a: Column, in_b: Column, hit: Column) -> DataFrame:
    """region (both, only_a, only_b), n, hits, precision."""
    region = F.when(in_a & in_b, "both").when(in_a, "only_a").when(in_b, "only_b")
    a = rows.withColumn("region", region).where("region IS NOT NULL").groupBy("region").agg(F.count(hit).alias("n"), F.count_if(hit).alias("hits"))
    return a.withColumn("precision", F.when(F.col("n") > 0, F.col("hits") / F.col("n")))


def first_loss(rows: DataFrame, key: str, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """key, lost_at: the first stage that a row doesn't pass, null if it passes all."""
    return rows.select(key, F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in stages]).alias("lost_at"))


def funnel(rows: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """stage, pos, kept, dropped: how many rows pass all stages up to each."""
    passed, counts = F.lit(True), []
    for _, ok in stages:
        passed = passed & F.coalesce(ok, F.lit(False))
        counts.append(F.count_if(passed))
    total = rows.agg(F.count("*").alias("__all"), *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    items = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(i + 1).alias("pos"), F.col(f"c{i}").alias("kept"), ((F.col(f"c{i - 1}") if i else F.col("__all")) - F.col(f"c{i}")).alias("dropped")) for i, (n, _) in enumerate(stages)])
    return total.select(F.explode(items).alias("x")).select("x.*")


def segments(words: Column, stop: Sequence[str]) -> Column:
    """Runs of words between stop words, in order; words hold no control characters."""
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(*stop), "\x01").otherwise(w)), " ")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda s: F.trim(s)), lambda s: s != "")


def stage_sets(rows: DataFrame, key: str, stages: Sequence[tuple[str, str, DataFrame | None]]) -> DataFrame:
    """stage, key: the objects that each stage still holds. A stage (name, "all", None), (name, "in", df)
    or (name, "out", df) keeps what the stage before it kept, of that the keys that df has or hasn't.
    Every df is reduced to its distinct keys and joined once; null keys are in no df."""
    held = rows.select(key)
    kept, sets = F.lit(True), []
    for i, (name, how, df) in enumerate(stages):
        if df is not None:
            flagged = df.select(F.col(key).alias(f"__k{i}")).where(F.col(f"__k{i}").isNotNull()).distinct()
            held = held.join(flagged, F.col(key) == F.col(f"__k{i}"), "left")
            kept = kept & (F.col(f"__k{i}").isNotNull() if how == "in" else F.col(f"__k{i}").isNull())
        sets.append(F.when(kept, F.lit(name)))
    return held.select(F.explode(F.filter(F.array(*sets), lambda s: s.isNotNull())).alias("stage"), key)
