"""Features of an observation (a topic, a candidate and its evidence) and of a rubric's verdict, in one
wide plan without a shuffle: evidence is at most eight entries of a row's array."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import phrases as P
from tidemark.functions import text as T

from .features import GROUPS

#: Entries of evidence that count, letters of a stem, letters of the shortest word (fixed values).
EVIDENCE, STEM, SHORTEST = 8, 5, 3
#: Lexicons whose share of texts is a feature (fixed values).
LEXICONS = ("emergence", "maturity", "hype", "funding", "bigtech")
#: The scalar features in the order of the vector (fixed values).
SCALARS = (
    "rel_query_title", "rel_query_evidence_mean", "rel_query_evidence_max", "rel_cluster_query_v1", "rel_terms_title", "rel_terms_evidence_share", "has_topic",
    "spec_title_length", "spec_title_topic_overlap", "spec_overview_share", "spec_evidence_cohesion", "spec_title_evidence_sim",
    *[f"lex_{n}_share" for n in LEXICONS[:3]], "lex_stage_max", *[f"lex_{n}_share" for n in LEXICONS[3:]],
    "has_evidence", "evidence_count", "share_scientific", "share_news_media", "share_marketing", "share_code", "trusted_share", "low_trust_share", "source_diversity", "recent_publication_share", "dated_share",
)
PROJECTED = tuple(f"emb_pc_{i}" for i in range(1, 9))


@dataclass(frozen=True)
class Projection:
    """A stored projection of unit vectors: centre, axes and the scale of each."""

    mean: Sequence[float]
    axes: Sequence[Sequence[float]]
    scale: Sequence[float]

    def of(self, vector: Column) -> list[Column]:
        moved = F.zip_with(vector, F.array(*map(F.lit, map(float, self.mean))), lambda v, m: v - m)
        return [F.greatest(F.lit(-5.0), F.least(F.lit(5.0), N.dot(moved, F.array(*map(F.lit, map(float, axis)))) / F.lit(float(s)))) for axis, s in zip(self.axes, self.scale, strict=True)]


def stems(text: Column, stop: Sequence[str] = T.STOP_WORDS) -> Column:
    """Distinct first letters of the words of three letters or more that are no stop words."""
    kept = F.filter(T.tokens(text), lambda w: (F.length(w) >= SHORTEST) & ~w.isin(*stop))
    return F.array_distinct(F.transform(kept, lambda w: F.left(w, F.lit(STEM))))


def observation_features(rows: DataFrame, key: str, lexicons: Mapping[str, str | Sequence[str]], stages: Mapping[int, Sequence[str]], year: int, projection: Projection, overview: str = P.REVIEW, stop: Sequence[str] = T.STOP_WORDS) -> DataFrame:
    """key, the 29 scalars and the 8 projections of every row of rows: title, title_vector, topic,
    topic_terms (stems), topic_vector, evidence (an array of title, type, trust (HIGH, MEDIUM, LOW), year,
    vector; the first eight count) and cluster_similarity.

    Without a topic, its vector or evidence what needs them is 0, as are nulls and numbers that aren't
    finite. lexicons has words, or a pattern (one string), by name; stages has words by number."""
    o = rows.select(
        key, F.coalesce("title", F.lit("")).alias("title"), N.unit(F.col("title_vector")).alias("tv"), "topic_terms", "cluster_similarity",
        ((F.trim(F.coalesce("topic", F.lit(""))) != "") & F.col("topic_vector").isNotNull()).alias("asked"), N.unit(F.col("topic_vector")).alias("q"),
        F.slice(F.coalesce("evidence", F.array().cast(rows.schema["evidence"].dataType)), 1, EVIDENCE).alias("ev"),
    ).withColumns({"n": F.size("ev"), "ts": stems(F.col("title"), stop), "us": F.transform("ev", lambda e: N.unit(e["vector"]))})
    asked, n = F.col("asked"), F.col("n")
    some = asked & (n > 0)

    def when(ok: Column, value: Column) -> Column:
        return F.when(ok, value).otherwise(0.0)

    def share(name: str, of) -> Column:
        return when(some, F.size(F.filter(F.col(name), of)) / n)

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)

    o = o.withColumn("sims", F.transform("us", lambda u: N.dot(u, F.col("q"))))
    terms = F.coalesce("topic_terms", F.array().cast("array<string>"))
    met = F.size(F.array_intersect("ts", terms))
    cohesion = total(F.transform("us", lambda a: total(F.transform("us", lambda b: N.dot(a, b)))))
    texts = F.concat(F.array("title"), F.transform("ev", lambda e: F.coalesce(e["title"], F.lit(""))))
    titled = F.when(n > 0, F.transform("ev", lambda e: F.coalesce(e["title"], F.lit("")))).otherwise(F.array("title"))

    def holds(words: str | Sequence[str], text: Column) -> Column:
        return F.lower(text).rlike(words) if isinstance(words, str) else F.arrays_overlap(T.tokens(text), F.array(*map(F.lit, words)))

    def texts_with(words) -> Column:
        return F.size(F.filter(texts, lambda t: holds(words, t))) / F.size(texts)

    reached = F.lit(0)
    for stage, words in stages.items():
        reached = F.greatest(reached, F.when(F.exists(texts, lambda t: holds(words, t)), stage).otherwise(0))
    dated = F.filter(F.transform("ev", lambda e: e["year"]), lambda y: y.isNotNull() & (y != 0))
    values = {
        "has_topic": asked.cast("double"), "rel_query_title": when(asked, N.dot(F.col("q"), F.col("tv"))), "rel_cluster_query_v1": when(asked, F.coalesce("cluster_similarity", F.lit(0.0))),
        "rel_query_evidence_mean": when(some, total(F.col("sims")) / n), "rel_query_evidence_max": when(some, F.array_max("sims")),
        "rel_terms_title": when(asked & (F.size(terms) > 0), met / F.size(terms)), "spec_title_topic_overlap": when(asked & (F.size(terms) > 0) & (F.size("ts") > 0), met / F.size("ts")),
        "rel_terms_evidence_share": when(some & (F.size(terms) > 0), F.size(F.filter("ev", lambda e: F.arrays_overlap(stems(F.coalesce(e["title"], F.lit("")), stop), terms))) / n),
        "spec_title_length": F.least(F.size("ts"), F.lit(12)) / 12.0, "spec_overview_share": F.size(F.filter(titled, lambda t: t.rlike(overview))) / F.size(titled),
        "spec_evidence_cohesion": when(asked & (n >= 2), (cohesion - n) / (n * (n - 1))), "spec_title_evidence_sim": when(some, total(F.transform("us", lambda u: N.dot(u, F.col("tv")))) / n),
        **{f"lex_{name}_share": texts_with(lexicons[name]) for name in LEXICONS}, "lex_stage_max": F.least(reached, F.lit(5)) / 5.0,
        "has_evidence": some.cast("double"), "evidence_count": when(some, n / EVIDENCE),
        "share_scientific": share("ev", lambda e: e["type"].isin(*GROUPS["share_scientific"])), "share_news_media": share("ev", lambda e: e["type"].isin(*GROUPS["share_news_media"])),
        "share_marketing": share("ev", lambda e: e["type"].isin(*GROUPS["share_marketing"])), "share_code": share("ev", lambda e: e["type"].isin(*GROUPS["share_code_vacancy"])),
        "trusted_share": share("ev", lambda e: e["trust"] == "HIGH"), "low_trust_share": share("ev", lambda e: e["trust"] == "LOW"),
        "source_diversity": when(some, F.least(F.size(F.array_distinct(F.transform("ev", lambda e: e["type"]))), F.lit(4)) / 4.0),
        "recent_publication_share": when(some & (F.size(dated) > 0), F.size(F.filter(dated, lambda y: y >= year - 1)) / F.size(dated)), "dated_share": when(some, F.size(dated) / n),
    }
    mean = F.transform("tv", lambda t, i: t + F.when(n > 0, total(F.transform("us", lambda u: F.get(u, i))) / n).otherwise(0.0))
    o = o.withColumn("profile", N.unit(mean))
    safe = lambda c: F.when(c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), 0.0).otherwise(c.cast("double"))
    return o.select(key, *[safe(values[name]).alias(name) for name in SCALARS], *[safe(c).alias(name) for name, c in zip(PROJECTED, projection.of(F.col("profile")), strict=True)])


#: Codes of a rubric's verdict by the feature that marks them (fixed values).
CODES = {"code_R": ("R",), "code_U": ("U",), "code_GEN": ("N-GEN",), "code_OVR": ("N-OVR",), "code_OFF": ("N-OFF",), "code_MAT": ("N-MAT",), "code_NOISE": ("N-NOI", "N-HYP", "N-FUND")}
#: Types that are no independent source, and types of the market (fixed values).
DEPENDENT = ("CODE_REPOSITORY", "PRESS_RELEASE", "CORPORATE_BLOG", "SOCIAL_MEDIA", "OTHER", "VACANCY", "ENCYCLOPEDIA")
MARKET_TYPES = ("NEWS", "INDUSTRY_MEDIA", "PRESS_RELEASE", "ANALYTICAL_REPORT")


def rubric_features(rows: DataFrame, key: str, review: str = P.REVIEW) -> DataFrame:
    """key and the eighteen features of a verdict: rows has code, confidence, stage, trend, score and
    sources (an array of type, trust, title, year). Shares are of the sources; a missing score is 0.5."""
    rows = rows.withColumn("__s", F.coalesce("sources", F.array().cast(rows.schema["sources"].dataType)))
    s = F.col("__s")
    n = F.greatest(F.size(s), F.lit(1))

    def share(of) -> Column:
        return F.size(F.filter(s, of)) / n

    years = F.filter(F.transform(s, lambda e: e["year"]), lambda y: y.isNotNull() & (y != 0))
    recent = F.when(F.size(years) > 0, F.size(F.filter(years, lambda y: y >= F.array_max(years) - 1)) / F.size(years)).otherwise(0.0)
    return rows.select(
        key, *[F.coalesce(F.col("code").isin(*codes), F.lit(False)).cast("double").alias(name) for name, codes in CODES.items()],
        *[F.col(c).cast("double").alias(name) for c, name in (("confidence", "llm_confidence"), ("stage", "stage"), ("trend", "trend"))], F.size(s).cast("double").alias("sources"),
        share(lambda e: ~e["type"].isin(*DEPENDENT) & ~((e["type"] == "PREPRINT") & (e["trust"] != "HIGH"))).alias("independent_share"), share(lambda e: e["type"].isin(*MARKET_TYPES)).alias("market_share"),
        share(lambda e: e["type"] == "PATENT").alias("patent_share"), share(lambda e: e["type"] == "CODE_REPOSITORY").alias("code_share"),
        share(lambda e: F.coalesce(e["title"], F.lit("")).rlike(review)).alias("review_share"), recent.alias("recent_share"), F.coalesce(F.col("score").cast("double"), F.lit(0.5)).alias("analyzer_score"),
    )


def candidate_probability(profile: Column, rubric: Column, code: Column, confidence: Column) -> Column:
    """The profile model's probability, else the rubric model's, else 0.7, 0.45 or 0.2 by the code and
    0.05 of the confidence; four digits."""
    base = F.when(code == "R", 0.7).when(code == "U", 0.45).otherwise(0.2) + 0.05 * F.coalesce(confidence, F.lit(0.0))
    return F.round(F.coalesce(profile, rubric, base), 4)
