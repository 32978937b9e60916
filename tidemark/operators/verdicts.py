"""What verdicts of models and reviewers do to candidates, and the records that go with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Codes that the final check drops (fixed values).
FINAL_DROP = ("N-GEN", "N-MAT", "N-OVR", "N-OFF", "N-NOI", "N-HYP", "N-FUND")
#: Verdicts by which a candidate is rejected (fixed values).
REJECTED = ("MATURE", "HYPE_OR_NOISE", "OFF_TOPIC", "NOT_A_TECHNOLOGY")


def bump(counters: DataFrame, deltas: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """counters with the sums of deltas added, by keys (nulls are a key of their own); keys that only
    deltas have start at 0. Deltas are summed before they meet the counters, so a hot key is one row."""
    sums = deltas.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    both = counters.select(*keys, *names).unionByName(sums)
    return both.groupBy(*keys).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def final_check(cards: DataFrame, verdicts: DataFrame, key: str, market: str, least: float = 0.7, research_only: bool = True) -> DataFrame:
    """cards (key, market: whether a source is of the market) with outcome and why of the last check by
    verdicts (key, code, confidence): DROPPED for codes of FINAL_DROP, but a mature one with a market
    source, or of too little confidence, is KEPT with the reason; UNCHECKED without a verdict."""
    v = verdicts.select(F.col(key).alias("__k"), "code", "confidence")
    j = cards.join(v, F.col(key) == F.col("__k"), "left")
    mature = F.col("code") == "N-MAT"
    saved = F.when(mature & F.lit(research_only) & F.col(market), "market sources").when(mature & (F.col("confidence") < least), F.format_string("confidence %.2f < %.2f", F.col("confidence"), F.lit(least)))
    outcome = F.when(F.col("__k").isNull(), "UNCHECKED").when(saved.isNotNull(), "KEPT").when(F.col("code").isin(*FINAL_DROP), "DROPPED").otherwise("PASSED")
    return j.withColumn("outcome", outcome).withColumn("why", saved).drop("__k", "confidence")


def maturity_drop(cards: DataFrame, score: str, threshold: float, sources: Column, market_types: Sequence[str]) -> Column:
    """True for a card that has sources, none of the market, and a maturity score above the threshold;
    a card without a score stays."""
    types = F.array(*map(F.lit, market_types))
    return F.coalesce((F.size(sources) > 0) & ~F.arrays_overlap(sources, types) & (F.col(score) > threshold), F.lit(False))


def apply_judgement(weak: DataFrame, verdicts: DataFrame, key: str, rank: str, by_rank: bool = False) -> DataFrame:
    """weak with verdict, relevance, rejected and order columns o1, o2, o3 (null if rejected): a verdict of
    REJECTED or a relevance of 0 or less rejects; kept ones are judged first, by relevance, then rank.
    Ordering by (o1, o2, o3) is left to the caller, who knows how many are shown."""
    v = verdicts.select(F.col(key).alias("__k"), "verdict", "relevance")
    j = weak.join(v, F.col(key) == F.col("__k"), "left")
    judged = F.col("__k").isNotNull()
    out = F.coalesce(judged & (F.col("verdict").isin(*REJECTED) | (F.col("relevance") <= 0)), F.lit(False))
    order = (F.lit(0), F.lit(0), F.col(rank)) if by_rank else (F.when(judged, 0).otherwise(1), F.when(judged, -F.col("relevance")).otherwise(0), F.col(rank))
    return j.withColumn("rejected", out).withColumns({f"o{i + 1}": F.when(~F.col("rejected"), c) for i, c in enumerate(order)}).drop("__k")


def clean_terms(terms: DataFrame, group: str, term: str, place: str, forbidden: Sequence[str] = (), shortest: int = 2, longest: int = 80, most: int = 8) -> DataFrame:
    """group, term, pos: terms without repeats (the first spelling stays), forbidden ones and unfit
    lengths; those of several words first, then shorter ones, then in order; at most `most`."""
    t = terms.select(group, place, F.trim(F.regexp_replace(T.empty_if_null(term), r"(?U)\s+", " ")).alias("term")).where(F.length("term").between(shortest, longest))
    if forbidden:
        t = t.where(~F.lower("term").isin(*[f.lower() for f in forbidden]))
    first = t.groupBy(group, F.lower("term").alias("__l")).agg(F.min(F.struct(place, "term")).alias("f")).select(group, F.col(f"f.{place}").alias("p"), "f.term")
    w = Window.partitionBy(group).orderBy(~F.contains("term", F.lit(" ")), F.length("term"), "p", "term")
    return first.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select(group, "term", "pos")


def replay_key(messages: Column, schema: Column, max_tokens: Column, temperature: Column) -> Column:
    """The name of a request: SHA-256 of its canonical JSON (keys in order, no blanks). messages is an
    array of (role, content) in order; schema a JSON text with its keys in order, or null."""
    pairs = F.transform(messages, lambda m: F.array(F.coalesce(m["role"], F.lit("")), F.coalesce(m["content"], F.lit(""))))
    digest = F.when(schema.isNull(), F.lit("")).otherwise(F.sha2(schema, 256))
    body = F.struct(max_tokens.cast("long").alias("max_tokens"), pairs.alias("messages"), digest.alias("schema"), F.round(temperature.cast("double"), 6).alias("temperature"))
    return F.sha2(F.to_json(body), 256)


def completion(written: Column, wanted: Column, fallbacks: Column, collection: Column, failed: Column, deadline: Column) -> Column:
    """status and message of a finished job: COMPLETED only without fallbacks, failed sources (an array),
    a collection that isn't complete, or a deadline; else PARTIAL with every reason in this order."""
    none = F.coalesce(failed, F.array().cast("array<string>"))
    complete = (fallbacks == 0) & (collection == "COMPLETED") & (F.size(none) == 0) & ~deadline
    parts = F.array(
        F.when(written < wanted, F.concat(F.lit("found="), written.cast("string"), F.lit("<"), wanted.cast("string"))), F.when(fallbacks != 0, F.concat(F.lit("fallback_narratives="), fallbacks.cast("string"))),
        F.when(F.size(none) > 0, F.concat(F.lit("adapters_failed="), F.array_join(F.array_sort(none), ","))), F.when(collection != "COMPLETED", F.concat(F.lit("collection="), collection)), F.when(deadline, "deadline_reached"),
    )
    message = F.when(complete, F.lit("")).otherwise(F.concat(F.lit("PARTIAL:"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ";")))
    return F.struct(F.when(complete, "COMPLETED").otherwise("PARTIAL").alias("status"), message.alias("message"))


def status_explanation(marks: Mapping[str, Column], stage: Column, trend: Column, confidence: Column, reason: Column, limit: int = 500) -> Column:
    """A sentence on a rubric's marks (label to boolean), stage, trend, their sum out of 7 and confidence."""
    said = F.concat_ws(" ", *[F.concat(F.lit(f"{label} "), F.when(ok, "✓").otherwise("✗"), F.lit(";")) for label, ok in marks.items()])
    text = F.concat(F.lit("Rubric: "), said, F.format_string(" stage %d, trend %d, %d of 7; confidence ", stage, trend, stage + trend), F.round(confidence * 100).cast("int").cast("string"), F.lit("%. "), F.coalesce(reason, F.lit("")))
    return F.left(F.trim(text), F.lit(limit))


def merge_synonyms(answers: DataFrame, key: str, place: str, term: str, titles: DataFrame, title: str, shortest: int = 3) -> DataFrame:
    """key, term, place, reason of every answer: null for those that are kept, else SHORT (normalised
    below `shortest` letters), TITLE (equal to the title of its key) or REPEAT (given before). Each
    row is judged by an aggregate of its normalised term, not by its group's order in one task."""
    norm = T.normalize(F.col(term))
    a = answers.select(key, place, term, norm.alias("__n")).join(titles.select(F.col(key).alias("__k"), T.normalize(F.col(title)).alias("__t")), F.col(key) == F.col("__k"), "left")
    early = F.when(F.length("__n") < shortest, "SHORT").when(F.col("__n") == F.col("__t"), "TITLE")
    a = a.withColumn("__e", early)
    first = a.where("__e IS NULL").groupBy(F.col(key).alias("__fk"), F.col("__n").alias("__fn")).agg(F.min(place).alias("__fp"))
    j = a.join(first, F.col(key).eqNullSafe(F.col("__fk")) & (F.col("__n") == F.col("__fn")), "left")
    return j.select(key, term, place, F.coalesce("__e", F.when(F.col(place) != F.col("__fp"), "REPEAT")).alias("reason"))


def review_pairs(hits: DataFrame, run: str, expert: str, thing: str, rule: str) -> DataFrame:
    """hits but those by link, one of each pair (run, expert, thing), with pair_id: 16 digits of the
    SHA-256 of the three. Of repeated pairs that of the least rule stays."""
    name = F.substring(F.sha2(F.concat_ws("|", F.col(run).cast("string"), F.col(expert).cast("string"), F.col(thing).cast("string")), 256), 1, 16)
    others = [c for c in hits.columns if c not in (run, expert, thing)]
    one = hits.where(F.col(rule) != "link").groupBy(run, expert, thing).agg(F.min(F.struct(rule, *[c for c in others if c != rule])).alias("h"))
    return one.select(name.alias("pair_id"), run, expert, thing, *[F.col(f"h.{c}").alias(c) for c in others])


def maturity_rules(cards: DataFrame, rules: DataFrame, verdict: str, mature: str, weak: Sequence[str]) -> DataFrame:
    """year, novelty, cut, n_mature, lost, n_weak of every rule (year, novelty: an array): it calls a card
    mature that is research_only, whose task is established since a year up to the rule's, with a
    novelty of the rule's. Cards are counted by what rules look at first, so a rule meets a few counts."""
    v = F.col(verdict)
    counts = cards.groupBy(F.coalesce(F.col("research_only") & F.col("established") & (F.col("since") > 1900), F.lit(False)).alias("fits"), "since", "novelty").agg(F.count_if(v == mature).alias("m"), F.count_if(v.isin(*weak)).alias("w"))
    named = rules.select(F.col("year").alias("r_year"), F.col("novelty").alias("r_novelty"))
    met = F.col("fits") & (F.col("since") <= F.col("r_year")) & F.array_contains("r_novelty", F.col("novelty"))
    met = F.coalesce(met, F.lit(False)).cast("long")
    each = counts.crossJoin(F.broadcast(named)).groupBy("r_year", "r_novelty").agg(F.sum(F.col("m") * met).alias("cut"), F.sum("m").alias("n_mature"), F.sum(F.col("w") * met).alias("lost"), F.sum("w").alias("n_weak"))
    return each.select(F.col("r_year").alias("year"), F.col("r_novelty").alias("novelty"), "cut", "n_mature", "lost", "n_weak")


def best_maturity_rule(evaluated: DataFrame, most_lost: float = 0.1) -> DataFrame:
    """The rule that cuts most mature cards and loses at most a share of weak ones; ties by fewer lost,
    an earlier year, fewer kinds of novelty."""
    fair = evaluated.where((F.col("n_weak") == 0) | (F.col("lost") <= most_lost * F.col("n_weak")))
    return fair.orderBy(F.col("cut").desc(), "lost", "year", F.size("novelty")).limit(1)


def gate(checks: Mapping[str, Column]) -> Column:
    """decision (accept or reject) and the names of the checks that fail; a null check fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return F.struct(F.when(F.size(failed) == 0, "accept").otherwise("reject").alias("decision"), failed.alias("failed"))


def predictor_rows(own: Column, others: Column) -> Column:
    """(name, value, contribution, pos): a model's contributions by size, then other features whose names
    it doesn't have, in order. Both are arrays of (name, value, contribution)."""
    ranked = F.transform(F.array_sort(F.transform(own, lambda f: F.struct((-F.abs(f["contribution"])).alias("o"), f["name"].alias("name"), f.alias("f")))), lambda x: x["f"])
    names = F.transform(own, lambda f: f["name"])
    return F.transform(F.concat(ranked, F.filter(others, lambda f: ~F.array_contains(names, f["name"]))), lambda f, i: f.withField("pos", i + 1))
