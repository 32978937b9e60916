"""Further small cases: bytes, lexical features, contributions, selections and trained models."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, learning, matching, rules, selection
from tidemark.sources import formats


def test_bytes_are_decoded_by_mark_or_declaration(spark):
    rows = [(1, b"\xef\xbb\xbfcaf\xc3\xa9"), (2, '<?xml version="1.0" encoding="ISO-8859-1"?>caf'.encode() + b"\xe9"), (3, "café".encode()), (4, "café".encode("utf-16"))]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, content binary").select("i", formats.decode(F.col("content")).alias("t")).collect()}
    assert got[1] == "café" and got[2].endswith("café") and got[3] == "café" and got[4] == "café"


def test_lexical_features(spark):
    d = spark.createDataFrame([("novel novel novelty of the art $5 million seed round in 2024 by Acme Labs",), (None,)], "t string")
    lex = {"emergence": {"exact": ("novel",), "prefixes": ("novelt",), "phrases": ("of the",)}}
    a, b = features.lexical_features(d, "t", lex, 2024).collect()
    assert a.lex_emergence_score == pytest.approx(4 / 200 * 1000 / 20) and a.org_mentions_count == 1 and a.recent_year_share == 1.0 and a.funding_mentions_count == 2
    assert (b.lex_emergence_score, b.org_mentions_count, b.recent_year_share) == (0.0, 0, 0.0)


def test_contributions_and_directions(spark):
    r = spark.range(1).select(selection.top_contributions(F.array(F.lit(0.1), F.lit(-0.5), F.lit(0.5)), ["c", "b", "a"], 2).alias("t"), rules.direction(F.lit(-0.06)).alias("d")).first()
    assert [(x["name"], x.value) for x in r.t] == [("a", 0.5), ("b", -0.5)] and r.d == "SUPPORTS_MATURE"


def test_evidence_keeps_a_trusted_document(spark):
    rows = spark.createDataFrame([("g", 1, 0.9, False), ("g", 2, 0.8, False), ("g", 3, 0.1, True), ("h", 4, 0.5, False)], "g string, k int, s double, t boolean")
    got = {(r.g, r.k): r.pos for r in selection.evidence(rows, "g", "k", "s", F.col("t"), 2).collect()}
    assert got == {("g", 1): 1, ("g", 3): 2, ("h", 4): 1}


def test_scoring_matches_its_formula(spark):
    d = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    r = features.score_linear(d, "v", [0.0, 1.0], [1.0, 2.0], [2.0, -1.0], 0.5, (1.0, 0.0)).first()
    assert list(r.contributions) == [2.0, -0.5] and r.score == pytest.approx(1 / (1 + 2.718281828459045**-2.0))


def test_cache_and_enrichment(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, t string")
    cache = docs.select("k", F.sha2(F.when(F.col("k") == 1, F.col("t")).otherwise("x"), 256).alias("content_hash"), F.array(F.lit(1.0)).alias("vector"))
    hit, miss = matching.cache_split(docs, cache, "k", "t")
    assert [r.k for r in hit.collect()] == [1] and sorted(r.k for r in miss.collect()) == [2, 3]
    a = spark.createDataFrame([(1, "t", "s", ["x"], 0), (2, "t", "s", ["x"], 4), (3, "t", "s", ["x"], 1)], "k int, title string, summary string, tokens array<string>, attempts int")
    f = spark.createDataFrame([(1, "", "longer", ["y"], True), (2, None, None, None, False)], "k int, title string, summary string, tokens array<string>, ok boolean")
    got = {r.k: r for r in matching.enrich(a, f, "k", F.lit(datetime(2024, 1, 1))).collect()}
    assert (got[1].title, got[1].summary, got[1].tokens, got[1].attempts) == ("t", "longer", ["x", "y"], 0)
    assert got[2].attempts == 5 and got[2].retry_at is None and got[3].attempts == 1


def test_similarity_join_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    sets = {i: sorted({f"w{int(rng.paretovariate(1.2))}" for _ in range(rng.randint(1, 9))}) for i in range(60)}
    rows = spark.createDataFrame(list(sets.items()), "k int, t array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.5}
    assert {(r.a, r.b) for r in matching.jaccard_join(rows, "k", "t", 0.5).collect()} == want


def test_eligibility_is_three_valued(spark):
    d = lambda *a: date(*a)
    rows = spark.createDataFrame([("in", d(2024, 1, 5)), ("in", None), ("out", d(2020, 1, 1)), ("none", None)], "g string, day date")
    got = {r.g: r.eligible for r in matching.eligible(rows, "g", "day", F.lit(d(2024, 1, 1)), F.lit(d(2024, 2, 1))).collect()}
    assert got == {"in": True, "out": False, "none": None}


def test_models_learn_and_calibrate(spark):
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 + F.rand(3) / 2).alias("f"), F.when(F.col("id") % 2 == 1, "bad words here").otherwise("good words there").alias("t"), (F.col("id") % 3).cast("int").alias("fold"))
    p = learning.cross_validated(rows, "id", ["f"], "y", "fold")
    assert p.count() == 200 and p.where((F.col("p") > 0.5) != (F.col("y") == 1)).count() == 0
    text = learning.predict(learning.fit_text(rows, "t", "y", 256, chars=3), rows, ["y"])
    assert text.where((F.col("p") > 0.5) != (F.col("y") == 1)).count() == 0
    slope, _ = learning.platt(rows, "f", "y")
    assert slope > 0
