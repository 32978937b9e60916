"""Topics dealt over folds so that labels of 1, then sizes, are even."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balanced_folds(rows: DataFrame, topic: str, label: str, folds: int, most: int = 100_000) -> DataFrame:
    """topic, pos, size, fold of each topic of rows: largest number of label 1 first, then largest
    size, then by the SHA-256 of the topic, each goes to the fold with the fewest so far (of label 1,
    then of rows, then the first fold). Null labels don't count, null topics are left out.

    Rows are only counted, one row a topic is left. The `most` largest topics go through one task in
    order. The rest, small topics of which many are alike, goes round the folds, one direction and
    back: in each of 64 parts of the topics of equal counts the folds differ by one topic at most."""
    counted = rows.where(F.col(topic).isNotNull()).groupBy(F.col(topic).cast("string").alias("topic"))
    sizes = counted.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(label).alias("size"))
    order = [F.col("pos").desc(), F.col("size").desc(), F.sha2("topic", 256)]

    def deal(parts):
        load = [[0, 0, k] for k in range(folds)]
        for p in parts:
            chosen = []
            for pos, size in zip(p["pos"].tolist(), p["size"].tolist(), strict=True):
                fold = min(load)
                fold[0] += pos
                fold[1] += size
                chosen.append(fold[2])
            yield pd.DataFrame({"topic": p["topic"], "pos": p["pos"], "size": p["size"], "fold": chosen})

    schema = "topic string, pos long, size long, fold int"
    large = sizes.orderBy(*order).limit(most)
    dealt = large.repartition(1).sortWithinPartitions(*order).mapInPandas(deal, schema)
    if sizes.limit(most + 1).count() <= most:
        return dealt
    last = large.orderBy(F.col("pos"), F.col("size"), F.sha2("topic", 256).desc()).first()
    behind = (F.col("pos") < last.pos) | ((F.col("pos") == last.pos) & ((F.col("size") < last["size"]) | ((F.col("size") == last["size"]) & (F.sha2("topic", 256) > F.sha2(F.lit(last.topic), 256)))))
    # equal (pos, size) are one class: within a class any order is as good, so classes are ranked apart
    w = Window.partitionBy("pos", "size", F.pmod(F.xxhash64("topic"), F.lit(64))).orderBy(F.sha2("topic", 256))
    turn = F.row_number().over(w) + F.pmod(F.xxhash64("pos", "size"), F.lit(folds))
    lap = F.floor(turn / folds) % 2
    fold = F.when(lap == 0, turn % folds).otherwise(folds - 1 - turn % folds)
    return dealt.unionByName(sizes.where(behind).select("topic", "pos", "size", fold.cast("int").alias("fold")))


def imbalance(dealt: DataFrame) -> DataFrame:
    """How far the fullest fold is above the mean of all, for labels of 1 and for rows."""
    by = dealt.groupBy("fold").agg(F.sum("pos").alias("pos"), F.sum("size").alias("size"))
    return by.agg((F.max("pos") / F.avg("pos") - 1).alias("pos"), (F.max("size") / F.avg("size") - 1).alias("size"))
