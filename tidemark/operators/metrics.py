"""Evaluation statistics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.operators.ranges import running


def confusion(rows: DataFrame, label: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy; null where a quotient has no denominator."""
    y, p = label.cast("boolean"), predicted.cast("boolean")
    a = rows.where(y.isNotNull() & p.isNotNull()).groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    over = lambda x, n: F.when(n > 0, x / n)
    return a.withColumn("precision", over(tp, tp + fp)).withColumn("recall", over(tp, tp + fn)).withColumn("f1", over(2 * tp, 2 * tp + fp + fn)).withColumn("accuracy", over(tp + tn, tp + fp + fn + tn))


def average_rank(value: str, partition: list[str] | None = None) -> Column:
    """Rank of a value, ties sharing their mean."""
    w = Window.partitionBy(*(partition or [])).orderBy(value)
    peers = Window.partitionBy(*(partition or []), value)
    return F.rank().over(w) + (F.count("*").over(peers) - 1) / 2.0


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """auc by the Mann-Whitney formula, ties half; null for one class.

    Ranks come from the counts of distinct scores: a partial aggregation, then running sums over
    ranges of scores, as a continuous score leaves as many rows as there were."""
    n = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    ranked = running(n, [F.col(score)], {"upto": F.col("n")}).withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0)
    s = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return s.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))).alias("auc"), F.coalesce("p", F.lit(0)).alias("positives"), F.coalesce("q", F.lit(0)).alias("negatives"))


def average_precision(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under precision and recall, one step for each distinct score; null without positives."""
    n = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    step = running(n, [F.col(score).desc()], {"cp": F.col("p"), "cn": F.col("n")})
    return step.agg((F.sum(F.col("p") * F.col("cp") / F.col("cn")) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))


def reliability(rows: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, rate of equal bins of predicted probabilities."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"))


def calibration(rows: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """n, ece, brier."""
    e = reliability(rows, label, p, bins).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    b = rows.agg(F.avg(F.pow(F.col(p) - F.col(label).cast("double"), F.lit(2.0))).alias("brier"))
    return e.join(F.broadcast(b))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa of two raters; kappa is null where chance agreement is 1."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "a").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return total.join(F.broadcast(chance)).select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def weighted_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Quadratic weighted kappa of two integer ratings; null where the ratings never vary."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.avg((x - y) * (x - y)).alias("d"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x).alias("x"), F.avg(y).alias("y"))
    chance = F.col("xx") + F.col("yy") - 2 * F.col("x") * F.col("y")
    return s.select(F.when(chance > 0, 1 - F.col("d") / chance).alias("weighted_kappa"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks; ranks of both sides are joined back by value."""

    def ranks(c: str, name: str) -> DataFrame:
        n = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(c).alias(f"__{name}")).agg(F.count("*").alias("n"))
        upto = running(n, [F.col(f"__{name}")], {"upto": F.col("n")})
        return upto.select(f"__{name}", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias(name))

    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).join(ranks(a, "ra"), F.col(a) == F.col("__ra")).join(ranks(b, "rb"), F.col(b) == F.col("__rb"))
    return both.agg(F.corr("ra", "rb").alias("spearman"), F.count("*").alias("n"))


def top_k(rows: DataFrame, group: str, score: str, label: str, key: str, k: int) -> DataFrame:
    """group, shown, hits, precision, ndcg of the k best by score, ties by key."""
    known = rows.where(F.col(label).isNotNull())

    def best(by: str) -> DataFrame:  # tasks keep their k best of a group
        w = Window.partitionBy(group).orderBy(F.col(by).desc(), key)
        return known.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)

    gain = F.sum(F.col(label) / F.log2(F.col("r") + 1.0))
    shown = best(score).groupBy(group).agg(F.count("*").alias("shown"), F.sum(label).cast("long").alias("hits"), gain.alias("dcg"))
    ideal = best(label).groupBy(F.col(group).alias("__g")).agg(gain.alias("best"))
    a = shown.join(ideal, F.col(group).eqNullSafe(F.col("__g")))
    return a.select(group, "shown", "hits", (F.col("hits") / F.col("shown")).alias("precision"), F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).alias("ndcg"))


def share_with_interval(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """group, n, hits, share and its Wilson interval."""
    a = rows.groupBy(group).agg(F.count(hit).alias("n"), F.count_if(hit).alias("hits"))
    lo, hi = N.wilson(F.col("hits"), F.col("n"))
    return a.withColumn("share", F.when(F.col("n") > 0, F.col("hits") / F.col("n"))).withColumn("low", lo).withColumn("high", hi)


def _poisson(*key: Column) -> Column:
    """A Poisson(1) number by a hash of key, from the distribution's cumulative probabilities."""
    u = F.pmod(F.xxhash64(*key), F.lit(1_000_003)) / 1_000_003.0
    bounds = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    times = F.lit(0)
    for b in bounds:
        times = times + (u >= b).cast("int")
    return times


def bootstrap_mean(rows: DataFrame, unit: str, value: str, rounds: int = 1000, seed: int = 20260915) -> DataFrame:
    """mean, low, high: percentile interval of the mean over units, which are drawn with Poisson(1)
    multiplicities by a hash of (seed, round, unit); each unit is weighed in every round by a hash,
    so no row is sent anywhere but its sums."""
    times = _poisson(F.lit(seed), F.col("round"), F.col(unit))
    drawn = rows.select(unit, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("times", times)
    means = drawn.groupBy("round").agg((F.sum(F.col("v") * F.col("times")) / F.nullif(F.sum("times"), F.lit(0))).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).join(F.broadcast(rows.agg(F.avg(value).alias("mean"))))


def paired_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """topics, mean_diff of b over a on common keys, and how many keys only one side has."""
    both = a.select(key, F.col(value).alias("va")).join(b.select(F.col(key).alias("kb"), F.col(value).alias("vb")), F.col(key) == F.col("kb"), "full")
    in_a, in_b = F.col(key).isNotNull(), F.col("kb").isNotNull()
    return both.agg(F.count_if(in_a & in_b).alias("topics"), F.avg(F.col("vb") - F.col("va")).alias("mean_diff"), F.count_if(~in_b).alias("only_in_a"), F.count_if(~in_a).alias("only_in_b"))


def paired_interval(a: DataFrame, b: DataFrame, key: str, value: str, rounds: int = 1000) -> DataFrame:
    """mean, low, high of the difference of b over a by bootstrap over common keys."""
    diff = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key).select(key, (F.col("vb") - F.col("va")).alias("diff"))
    return bootstrap_mean(diff, key, "diff", rounds)


def kappa_interval(rows: DataFrame, a: str, b: str, key: str, rounds: int = 1000, seed: int = 20260915) -> DataFrame:
    """low, high: percentile interval of the kappa of two binary ratings, pairs drawn with Poisson(1)
    multiplicities by a hash of (seed, round, key); rounds without a kappa are left out."""
    drawn = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    drawn = drawn.withColumn("n", _poisson(F.lit(seed), F.col("round"), F.col(key)))
    s = drawn.groupBy("round").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("x") == F.col("y")).cast("int")).alias("same"), F.sum(F.col("n") * F.col("x")).alias("x"), F.sum(F.col("n") * F.col("y")).alias("y")).where("n > 0")
    pa, pb, po = F.col("x") / F.col("n"), F.col("y") / F.col("n"), F.col("same") / F.col("n")
    pe = pa * pb + (1 - pa) * (1 - pb)
    return s.select(F.when(pe < 1, (po - pe) / (1 - pe)).alias("k")).agg(F.percentile("k", F.lit(0.025)).alias("low"), F.percentile("k", F.lit(0.975)).alias("high"))


def sliced(rows: DataFrame, hit: Column, dimensions: list[str]) -> DataFrame:
    """slice, value, n, accuracy for each value of each dimension, by one pass of grouping sets."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("slice"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("s")
    return rows.select(hit.cast("int").alias("hit"), pairs).groupBy("s.slice", "s.value").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))


def best_threshold(rows: DataFrame, label: str, score: str, min_precision: float) -> DataFrame:
    """threshold, precision, recall, f1: the distinct score of highest F1 with enough precision."""
    n = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    every = n.agg(F.sum("p").alias("all"))
    c = running(n, [F.col(score).desc()], {"tp": F.col("p"), "shown": F.col("n")}).join(F.broadcast(every))
    c = c.withColumn("precision", F.col("tp") / F.col("shown")).withColumn("recall", F.col("tp") / F.nullif(F.col("all"), F.lit(0))).withColumn("f1", 2 * F.col("tp") / (F.col("shown") + F.col("all")))
    kept = c.where(F.col("precision") >= min_precision)
    return kept.agg(F.max_by(F.struct(F.col(score).alias("threshold"), "precision", "recall", "f1"), F.struct("f1", F.col(score))).alias("b")).select("b.*")


def group_folds(rows: DataFrame, group: str, label: str, folds: int, seed: str) -> DataFrame:
    """group, fold: groups in order of a hash of (seed, group), dealt in turn within each label."""
    g = rows.groupBy(group).agg(F.max(label).alias("l"))
    w = Window.partitionBy("l").orderBy(F.sha2(F.concat(F.lit(seed + "|"), F.col(group).cast("string")), 256), group)
    return g.select(group, F.pmod(F.row_number().over(w) - 1, F.lit(folds)).alias("fold"))


def expert_recall(experts: DataFrame, hits: DataFrame, key: str, strong: str, since: Column, share: int = 5) -> DataFrame:
    """key, hits, strong (a hit by the rule `strong`), sources, rules, eligibility (in window, before it,
    no date) and split (holdout for each share-th key by its SHA-1) of experts (key, day) with their hits
    (key, source, rule). Hits are counted by source and rule first."""
    by = hits.groupBy(F.col(key).alias("of"), "source", "rule").agg(F.count("*").alias("n"))
    found = by.groupBy("of").agg(F.sum("n").alias("hits"), F.max(F.col("rule") == strong).alias("strong"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("rule")).alias("rules"))
    nothing = F.array().cast("array<string>")
    when = F.when(F.col("day").isNull(), "no date").when(F.col("day") >= since, "in window").otherwise("before")
    digest = F.sha1(F.col(key).cast("string"))
    # the remainder of 160 bits, 32 bits at a time
    rest = F.lit(0).cast("long")
    for i in range(5):
        rest = F.pmod(rest * F.lit((1 << 32) % share) + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long"), F.lit(share))
    joined = experts.join(found, F.col(key) == F.col("of"), "left")
    return joined.select(key, F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("strong", F.lit(False)).alias("strong"), F.coalesce("sources", nothing).alias("sources"), F.coalesce("rules", nothing).alias("rules"), when.alias("eligibility"), F.when(rest == 0, "holdout").otherwise("dev").alias("split"))


def recall_totals(found: DataFrame) -> DataFrame:
    """kind, value, found, experts: what expert_recall() gives, in all and by split, eligibility and
    source (of a source only those that it found)."""
    pairs = F.concat(F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")), F.struct(F.lit("split").alias("kind"), F.col("split").alias("value")), F.struct(F.lit("eligibility").alias("kind"), F.col("eligibility").alias("value"))), F.transform("sources", lambda s: F.struct(F.lit("source").alias("kind"), s.alias("value"))))
    return found.select((F.col("hits") > 0).alias("hit"), F.explode(pairs).alias("p")).groupBy("p.kind", "p.value").agg(F.count_if("hit").alias("found"), F.count("*").alias("experts"))
