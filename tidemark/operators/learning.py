"""Training with MLlib: calibrated linear models, baselines, folds and components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, CountVectorizerModel, HashingTF, NGram, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import phrases as P
from tidemark.functions import text as T

from .ranges import running
from .selection import class_weights


def fit_linear(rows: DataFrame, features: Sequence[str], label: str, reg: float = 0.1, mix: float = 0.5) -> PipelineModel:
    """Standardised elastic-net logistic regression with balanced class weights."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), LogisticRegression(featuresCol="__x", labelCol=label, weightCol="weight", regParam=reg, elasticNetParam=mix, maxIter=50)]
    return Pipeline(stages=stages).fit(class_weights(rows.where(F.col(label).isNotNull()), label))


def _words(text: str, dims: int, chars: int = 0) -> list[Transformer]:
    """Stages from a text to `dims` hashed counts, __f, of its words or character n-grams."""
    tok = RegexTokenizer(inputCol=text, outputCol="__t", pattern=r"[\p{L}\p{N}_-]+" if not chars else ".", gaps=False, toLowercase=True)
    grams = [NGram(n=chars, inputCol="__t", outputCol="__g")] if chars else []
    return [tok, *grams, HashingTF(inputCol="__g" if chars else "__t", outputCol="__f", numFeatures=dims)]


def _weighed(label: str, reg: float) -> list[Estimator]:
    return [IDF(inputCol="__f", outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol=label, weightCol="weight", regParam=reg, maxIter=30)]


def hashed_words(rows: DataFrame, text: str, dims: int = 4096, chars: int = 0) -> DataFrame:
    """rows with __f, hashed counts of words or character n-grams; nothing is learnt for them, so several
    models can share them."""
    return PipelineModel(_words(text, dims, chars)).transform(rows).drop("__t", "__g")


def fit_hashed(rows: DataFrame, label: str, reg: float = 0.01) -> PipelineModel:
    """TF-IDF logistic regression on the counts of hashed_words()."""
    return Pipeline(stages=_weighed(label, reg)).fit(class_weights(rows.where(F.col(label).isNotNull()), label))


def fit_text(rows: DataFrame, text: str, label: str, dims: int = 4096, chars: int = 0, reg: float = 0.01) -> PipelineModel:
    """TF-IDF logistic regression on words, or on character n-grams of `chars` letters."""
    return Pipeline(stages=[*_words(text, dims, chars), *_weighed(label, reg)]).fit(class_weights(rows.where(F.col(label).isNotNull()), label))


def predict(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep and p, the probability of label 1."""
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("p"))


def cross_validated(rows: DataFrame, key: str, features: Sequence[str], label: str, fold: str) -> DataFrame:
    """key, label, p of each row by the model fitted without its fold. One fit a fold; the list of
    folds is small by construction."""
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    out = None
    for f in folds:
        model = fit_linear(rows.where(F.col(fold) != f), features, label)
        part = predict(model, rows.where(F.col(fold) == f), [key, label])
        out = part if out is None else out.unionByName(part)
    return out


def platt(rows: DataFrame, score: str, label: str) -> tuple[float, float]:
    """Slope and offset of a logistic curve from a score to a label."""
    x = rows.where(F.col(label).isNotNull()).select(array_to_vector(F.array(F.col(score).cast("double"))).alias("x"), F.col(label).cast("double").alias("y"))
    m = LogisticRegression(featuresCol="x", labelCol="y", maxIter=50).fit(x)
    return float(m.coefficients[0]), float(m.intercept)


def principal_components(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, components: projections on the k main axes, each axis turned so that its entry of
    largest size is positive."""
    x = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("__x"))
    model = PCA(k=k, inputCol="__x", outputCol="__p").fit(x)
    axes = model.pc.toArray()
    signs = [1.0 if abs(a.max()) >= abs(a.min()) else -1.0 for a in axes.T]
    flip = F.array(*map(F.lit, signs))
    return model.transform(x).select(key, F.zip_with(vector_to_array("__p"), flip, lambda p, s: p * s).alias("components"))


def aligned_lengths(rows: DataFrame, text: str, label: str) -> DataFrame:
    """rows (label 0 or 1) whose texts of the label with the longer median are cut, at clauses, to the
    median of the other; all as they are if a label has no rows. The median is the upper of the two
    middle ones. Lengths are counted first, and the counts summed over ranges of the lengths."""
    n = F.length(T.empty_if_null(text))
    counted = rows.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("y"), n.alias("n")).agg(F.count("*").alias("c"))
    half = counted.groupBy(F.col("y").alias("of")).agg(F.floor(F.sum("c") / 2).alias("half"))
    reached = running(counted, [F.col("n")], {"upto": F.col("c")}, ["y"]).join(F.broadcast(half), F.col("y") == F.col("of"))
    medians = reached.where(F.col("upto") > F.col("half")).agg(F.min(F.when(F.col("y") == 1, F.col("n"))).alias("m1"), F.min(F.when(F.col("y") == 0, F.col("n"))).alias("m0"))
    marked = rows.select(F.struct("*").alias("row")).join(F.broadcast(medians))
    longer = F.when(F.col("m1") > F.col("m0"), F.lit(1)).otherwise(F.lit(0))
    cut = (F.col("m1") + F.col("m0")).isNotNull() & (F.col("row")[label] == longer)
    shorter = P.truncate_at_clause(F.col("row")[text], F.least("m1", "m0"))
    return marked.select(*[(F.when(cut, shorter).otherwise(F.col("row")[c]) if c == text else F.col("row")[c]).alias(c) for c in rows.columns])


def leak_check(rows: DataFrame, key: str, text: str, label: str, markers: Sequence[str], folds: int = 5, most: float = 0.6, reg: float = 0.01) -> DataFrame:
    """n, found, f1, passed: how well a model of nothing but marker words tells the labels apart out of
    its folds (by a hash of key). found counts texts that hold a marker anywhere; without one as a word,
    or with one label only, f1 is 0. passed: f1 is at most `most`. Null texts count as empty, rows
    without a label are left out."""
    words = sorted({m.lower() for m in markers})
    low = F.lower(T.empty_if_null(text))
    held = F.lit(False)
    for w in words:
        held = held | F.contains(low, F.lit(w))
    known = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), low.alias("t"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"), held.alias("held"))
    tokens = F.regexp_extract_all("t", F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))
    known = known.withColumn("words", F.filter(tokens, lambda w: w.isin(*words)))
    seen = known.agg(F.count("*").alias("n"), F.count_if("held").alias("found"), F.count_if(F.size("words") > 0).alias("worded"), F.countDistinct("y").alias("labels"))
    first = seen.first()
    if not first["worded"] or first["labels"] < 2:
        return seen.select("n", "found", F.lit(0.0).alias("f1"), F.lit(True).alias("passed"))
    counts = CountVectorizerModel.from_vocabulary(words, inputCol="words", outputCol="__c")
    stages = [counts, IDF(inputCol="__c", outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol="y", weightCol="weight", regParam=reg, maxIter=30)]
    out = None
    for f in range(folds):
        learnt = known.where(F.col("fold") != f)
        if learnt.select("y").distinct().count() < 2:
            continue
        model = Pipeline(stages=stages).fit(class_weights(learnt, "y"))
        part = model.transform(known.where(F.col("fold") == f)).select("y", F.col("prediction").cast("int").alias("p"))
        out = part if out is None else out.unionByName(part)
    both, said = F.count_if((F.col("y") == 1) & (F.col("p") == 1)), F.count_if(F.col("p") == 1) + F.count_if(F.col("y") == 1)
    f1 = (out if out is not None else known.select("y", F.lit(0).alias("p"))).agg(F.coalesce(2 * both / F.nullif(said, F.lit(0)), F.lit(0.0)).alias("f1"))
    return seen.select("n", "found").join(F.broadcast(f1)).withColumn("passed", F.col("f1") <= most)
