"""Exclusion rules, model decisions, ranks and status reductions."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranges
from tidemark.operators.ranges import running


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the production profile (fixed values)."""

    min_query_similarity: float = 0.30
    wiki_pageviews_min: float = 20000.0
    wiki_age_min_years: float = 3.0
    mature_stage_ordinal: int = 5
    bigtech_min: float = 3.0
    share_code_vacancy_min: float = 0.4
    maturity_min: float = 0.6
    emergence_max: float = 0.2
    share_marketing_min: float = 0.6
    hype_min: float = 0.5
    trusted_share_max: float = 0.2
    require_high_trust: bool = False
    model_mature_maturity_min: float = 0.4
    model_hype_min: float = 0.3
    min_documents: int = 2

    def with_values(self, values: dict) -> Thresholds:
        """These with the known keys of a mapping replaced; unknown ones are ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in values.items() if k in known})


def exclusion(t: Thresholds = Thresholds()) -> Column:
    """struct(decision, reason, note) of the first rule that fires, null if none does.

    Reads emb_sim_query, wiki_exists, wiki_pageviews_30d_log, wiki_age_years, stage_lex_ordinal,
    bigtech_mentions_count, share_code_vacancy, lex_maturity_score, lex_emergence_score,
    lex_hype_score, share_marketing, share_scientific, trusted_share, mature_field, n_documents,
    n_low, n_high. Off-topic comes first, then maturity, which carries the evidence rule that also
    fires as its note, then evidence, marketing and hype. Without documents no evidence rule fires."""
    c = F.col

    def fires(when: Column, decision: str, reason: str) -> Column:
        return F.when(when, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason")))

    some = c("n_documents") > 0
    evidence = F.coalesce(
        fires(some & (c("n_low") == c("n_documents")), "INSUFFICIENT_EVIDENCE", "NO_TRUSTED_SOURCE"),
        fires(some & (c("n_documents") < max(1, t.min_documents)) & (c("n_high") == 0), "INSUFFICIENT_EVIDENCE", "SINGLE_SOURCE"),
        fires(F.lit(t.require_high_trust) & some & (c("n_high") == 0), "INSUFFICIENT_EVIDENCE", "NO_TRUSTED_SOURCE"),
    )
    mature = F.coalesce(
        fires((c("wiki_exists") >= 1) & (F.expm1("wiki_pageviews_30d_log") >= t.wiki_pageviews_min) & (c("wiki_age_years") >= t.wiki_age_min_years), "MATURE", "ENCYCLOPEDIA_MATURE"),
        fires((c("stage_lex_ordinal") >= t.mature_stage_ordinal) & ((c("bigtech_mentions_count") >= t.bigtech_min) | (c("share_code_vacancy") >= t.share_code_vacancy_min)), "MATURE", "MARKET_LEADERS"),
        fires((c("lex_maturity_score") >= t.maturity_min) & (c("lex_emergence_score") <= t.emergence_max), "MATURE", "MATURITY_LEXICON"),
        fires(c("mature_field"), "MATURE", "MATURE_FIELD"),
    )
    noisy = F.coalesce(
        fires((c("share_marketing") >= t.share_marketing_min) & (c("share_scientific") <= 0), "HYPE_OR_NOISE", "MARKETING_DOMINANT"),
        fires((c("lex_hype_score") >= t.hype_min) & (c("trusted_share") <= t.trusted_share_max), "HYPE_OR_NOISE", "HYPE_LEXICON"),
    )

    def noted(rule: Column, note: Column) -> Column:
        return F.when(rule.isNotNull(), F.struct(rule["decision"].alias("decision"), rule["reason"].alias("reason"), note.alias("note")))

    none = F.lit(None).cast("string")
    off = fires(c("emb_sim_query") < t.min_query_similarity, "OFF_TOPIC", "LOW_QUERY_RELEVANCE")
    return F.coalesce(noted(off, none), noted(mature, evidence["reason"]), noted(evidence, none), noted(noisy, none))


def model_decision(score: Column, threshold: float, t: Thresholds = Thresholds()) -> Column:
    return (
        F.when(score >= threshold, "WEAK_SIGNAL")
        .when((F.col("lex_maturity_score") >= t.model_mature_maturity_min) | (F.col("wiki_exists") >= 1), "MATURE")
        .when(F.col("lex_hype_score") >= t.model_hype_min, "HYPE_OR_NOISE")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )


def decide(rows: DataFrame, score: str, threshold: float = 0.5, t: Thresholds = Thresholds()) -> DataFrame:
    """rows with decision, reason and note: the rule that fires, else the model. Excluded rows keep
    their score."""
    out = rows.withColumn("__x", exclusion(t))
    return out.withColumn("decision", F.coalesce("__x.decision", model_decision(F.col(score), threshold, t))).withColumn("reason", F.coalesce("__x.reason", F.lit("MODEL"))).withColumn("note", F.col("__x.note")).drop("__x")


def rank_signals(rows: DataFrame, score: str, relevance: str, key: str, group: str | None = None) -> DataFrame:
    """rows with rank: weak signals by score, trusted share and relevance, all descending, then key;
    0 for the others."""
    weak = F.col("decision") == "WEAK_SIGNAL"
    order = [F.col(score).desc(), F.col("trusted_share").desc(), F.col(relevance).desc(), F.col(key)]
    ranked = running(rows.where(weak), order, {"rank": F.lit(1)}, [group] if group else None)
    return ranked.withColumn("rank", F.col("rank").cast("int")).unionByName(rows.where(~F.coalesce(weak, F.lit(False))).withColumn("rank", F.lit(0)))


def direction(contribution: Column, band: float = 0.05) -> Column:
    return F.when(contribution > band, "SUPPORTS_WEAK_SIGNAL").when(contribution < -band, "SUPPORTS_MATURE").otherwise("NEUTRAL")


def mad_floor(rows: DataFrame, value: str, group: str, k: float = 3.0, least: int = 5) -> DataFrame:
    """group, n, median, mad, floor: median - k * 1.4826 * MAD; null where there are under `least`
    values or the MAD is 0."""
    known = rows.select(group, value)
    med = ranges.quantiles(known, F.col(value), {"median": 0.5}, [group]).select(F.col(group).alias("__g"), "median")
    off = known.join(med, F.col(group).eqNullSafe(F.col("__g"))).select(group, F.abs(F.col(value) - F.col("median")).alias("__off"))
    mad = ranges.quantiles(off, F.col("__off"), {"mad": 0.5}, [group]).select(F.col(group).alias("__m"), "mad")
    n = known.groupBy(group).agg(F.count(value).alias("n"))
    dev = n.join(med, F.col(group).eqNullSafe(F.col("__g"))).join(mad, F.col(group).eqNullSafe(F.col("__m"))).select(group, "n", "median", "mad")
    return dev.withColumn("floor", F.when((F.col("n") >= least) & (F.col("mad") > 0), F.col("median") - k * 1.4826 * F.col("mad")))


def above_floor(rows: DataFrame, value: str, group: str, k: float = 3.0) -> DataFrame:
    """rows at or above their group's MAD floor; all where it has none."""
    floors = mad_floor(rows, value, group, k).select(F.col(group).alias("__g"), "floor")
    return rows.join(floors, F.col(group).eqNullSafe(F.col("__g"))).where(F.col("floor").isNull() | (F.col(value) >= F.col("floor"))).drop("__g", "floor")


def trust_cap(trust: Column, low_quality: Column, dated: Column) -> Column:
    """Trust rank 3, 2, 1 under its ceilings: 1 for low-quality domains, 2 for undated rows."""
    return F.least(trust, F.when(low_quality, 1).otherwise(3), F.when(dated, 3).otherwise(2))


def source_type(host: Column, title: Column) -> Column:
    """Type of a source by host and title markers, in order (fixed values)."""
    return (
        F.when(host.rlike(r"(^|\.)(gov|gob|gouv)(\.|$)"), "GOVERNMENT")
        .when(F.lower(title).rlike("press release|newswire"), "PRESS_RELEASE")
        .when(host.rlike(r"(^|\.)(arxiv\.org|biorxiv\.org)$"), "PREPRINT")
        .when(host.rlike(r"(^|\.)(github\.com|gitlab\.com)$"), "CODE_REPOSITORY")
        .when(host.rlike(r"^blog\.|(^|\.)medium\.com$"), "BLOG")
        .otherwise("NEWS_MEDIA")
    )


def small_clusters(rows: DataFrame, cluster: str, least: int, keep_single: Column) -> DataFrame:
    """rows with kept: the cluster has `least` members, or is one document that may stand alone."""
    n = F.count("*").over(Window.partitionBy(cluster))
    return rows.withColumn("kept", (n >= least) | ((n == 1) & keep_single))


def collection_status(runs: DataFrame, collection: str) -> DataFrame:
    """collection, status of its adapter runs (status, documents, budget_hit): CANCELLED, then FAILED
    without documents, then PARTIAL for any failure or spent budget, else COMPLETED."""
    a = runs.groupBy(collection).agg(F.bool_or(F.col("status") == "CANCELLED").alias("c"), F.sum("documents").alias("d"), F.bool_or((F.col("status") == "FAILED") | F.col("budget_hit")).alias("p"))
    return a.select(collection, F.when(F.col("c"), "CANCELLED").when(F.coalesce(F.col("d"), F.lit(0)) == 0, "FAILED").when(F.col("p"), "PARTIAL").otherwise("COMPLETED").alias("status"))
