"""Features of a collection of documents, of texts and of an encyclopedia entry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import text as T
from tidemark.operators import ranges

#: Groups of source types (fixed values).
GROUPS = {
    "share_scientific": ("PUBLICATION", "PREPRINT"),
    "share_news_media": ("NEWS_MEDIA", "INDUSTRY_MEDIA"),
    "share_marketing": ("PRESS_RELEASE", "BLOG"),
    "share_code_vacancy": ("CODE_REPOSITORY", "VACANCY"),
}
#: Features of a collection in the order of the vector, with their ranges (fixed values).
COLLECTION = {
    "doc_count_log": (0, 8), "source_type_diversity": (0, 14), "share_scientific": (0, 1), "share_news_media": (0, 1), "share_marketing": (0, 1),
    "share_code_vacancy": (0, 1), "trusted_share": (0, 1), "growth_ratio_12m": (0, 20), "recency_median_days": (0, 3650), "first_seen_years_ago": (0, 30), "citation_median_log": (0, 12),
}


def collection_features(docs: DataFrame, group: str, now: datetime) -> DataFrame:
    """group and the eleven features of docs (type, trust 1 to 3, published_at, citations). Medians
    are taken by ranges of the values, so a group of any size will do."""
    age = N.age_days(now, F.col("published_at"))
    year, cited = N.DAYS_PER_YEAR, F.when(F.col("type").isin(*GROUPS["share_scientific"]), F.col("citations"))
    shares = [F.avg(F.col("type").isin(*types).cast("double")).alias(name) for name, types in GROUPS.items()]
    middle = [ranges.quantiles(docs.select(group, v.alias("v")), F.col("v"), {name: 0.5}, [group]).withColumnRenamed(group, f"__{name}") for name, v in (("age_median", age), ("cited_median", cited))]
    out = docs.groupBy(group).agg(
        F.log1p(F.count("*")).alias("doc_count_log"), F.count_distinct("type").cast("double").alias("source_type_diversity"), *shares,
        F.avg((F.col("trust") == 3).cast("double")).alias("trusted_share"),
        ((F.count_if(age <= year) + 1) / (F.count_if((age > year) & (age <= 2 * year)) + 1)).alias("growth_ratio_12m"),
        F.coalesce(F.max(age) / year, F.lit(0.0)).alias("first_seen_years_ago"),
    )
    for name, m in zip(("age_median", "cited_median"), middle, strict=True):
        out = out.join(m, F.col(group).eqNullSafe(F.col(f"__{name}")), "left").drop(f"__{name}")
    named = {"recency_median_days": F.coalesce("age_median", F.lit(0.0)), "citation_median_log": F.coalesce(F.log1p("cited_median"), F.lit(0.0))}
    return out.withColumns(named).select(group, *COLLECTION)


def lexical_features(docs: DataFrame, text: str, lexicons: Mapping[str, Mapping[str, Sequence[str]]], year: int) -> DataFrame:
    """docs with lex_<name>_score for each lexicon (exact, prefixes, phrases), org_mentions_count,
    recent_year_share and funding_mentions_count."""
    out = docs.withColumn("__w", T.tokens(text))
    for name, lex in lexicons.items():
        hits = T.lexicon_hits(F.col("__w"), lex.get("exact", ()), lex.get("prefixes", ()), lex.get("phrases", ()))
        out = out.withColumn(f"lex_{name}_score", T.lexicon_rate(hits, F.size("__w")))
    funding = F.regexp_count(T.empty_if_null(text), F.lit(r"(?i)[$€£]\s?\d+(?:\.\d+)?\s?(?:m|bn|k|million|billion)|series [a-e]\b|seed round"))
    out = out.withColumn("funding_mentions_count", funding).withColumn("org_mentions_count", F.size(T.organisations(text)))
    return out.withColumn("recent_year_share", T.recent_year_share(text, year)).drop("__w")


def encyclopedia_features(rows: DataFrame, hits: DataFrame, key: str, now: datetime) -> DataFrame:
    """rows with wiki_exists, wiki_pageviews_30d_log, wiki_age_years of the hit with most views
    (key, exists, pageviews, created_at); zeros without one. Unknown views (-1) are none."""
    views = F.greatest(F.col("pageviews"), F.lit(0))
    best = hits.where("exists").groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(views.alias("v"), "created_at"), F.struct(views, "created_at")).alias("h"))
    out = rows.join(best, F.col(key) == F.col("__k"), "left")
    out = out.withColumn("wiki_exists", F.col("h").isNotNull().cast("double")).withColumn("wiki_pageviews_30d_log", F.coalesce(F.log1p("h.v"), F.lit(0.0)))
    return out.withColumn("wiki_age_years", F.coalesce(N.age_days(now, F.col("h.created_at")) / N.DAYS_PER_YEAR, F.lit(0.0))).drop("__k", "h")


def assemble(ranges: Mapping[str, tuple[float, float]], whole: Sequence[str] = ()) -> Column:
    """The features as an array in order, clipped to their ranges."""
    return F.array(*[N.clip(F.col(n).cast("double"), lo, hi, n in whole).cast("double") for n, (lo, hi) in ranges.items()])


def as_rows(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """key, feature, value: the wide features as rows."""
    return rows.unpivot([key], [F.col(n).cast("double").alias(n) for n in names], "feature", "value")


def as_columns(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """The inverse of as_rows."""
    return rows.groupBy(key).pivot("feature", list(names)).agg(F.first("value"))


def score_linear(rows: DataFrame, vector: str, mean: Sequence[float], scale: Sequence[float], weights: Sequence[float], bias: float, curve: tuple[float, float]) -> DataFrame:
    """rows with score (standardised linear model through a logistic curve) and contributions
    (weight times standardised value) of each feature."""
    z = F.transform(F.arrays_zip(F.col(vector).alias("x"), F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, scale)).alias("s"), F.array(*map(F.lit, weights)).alias("w")), lambda t: t["w"] * (t["x"] - t["m"]) / t["s"])
    out = rows.withColumn("contributions", z)
    margin = F.aggregate("contributions", F.lit(0.0), lambda s, x: s + x) + bias
    return out.withColumn("score", N.sigmoid(margin * curve[0] + curve[1]))


def histogram(docs: DataFrame, group: str, value: str) -> DataFrame:
    """group and a map of how often each value occurs."""
    n = docs.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))
