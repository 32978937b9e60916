"""What a review found on tables of 6 GB."""

from __future__ import annotations


def test_predictions_of_a_million_weights_shuffle_no_features(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import profiles

    n = 600_000
    weights = spark.range(n).select(F.concat(F.lit("w"), "id").alias("feature"), (F.col("id") % 7 - 3).alias("weight"))
    texts = {i: [f"w{(i * 7919 + j * 104_729) % (2 * n)}" for j in range(i % 60)] for i in range(300)} | {300: ["w5", "w12", "w4", "w11", "nothing"]}
    rows = spark.createDataFrame([*texts.items(), (301, [])], "k int, features array<string>")
    out = profiles.predict(rows, "k", weights, top=3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: (r.n_features, r.n_known, round(r.logit, 9), [c.feature for c in r.reasons]) for r in out.collect()}
    of = {i: {f: int(f[1:]) % 7 - 3 for f in x if f[1:].isdigit() and int(f[1:]) < n} for i, x in texts.items()} | {301: {}}
    want = {i: (len(texts.get(i, [])), len(w), round(sum(w.values()) * profiles.UNIT / max(len(texts.get(i, [])), 1) ** 0.5, 9), sorted(w, key=lambda f: (-abs(w[f]), f))[:3]) for i, w in of.items()}
    assert got == want and any(len(x[3]) == 3 for x in got.values())


def test_features_of_texts_agree_when_numbered(spark):
    from tidemark.operators import profiles

    texts = ["strong growth in quantum sensing. no market", "Quantum sensing; рынка нет", "", None, "not no market нет the sensing, quantum quantum", "сенсоры не для рынка, quantum sensing quantum sensing нет", "a. b", "нет"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "k int, t string")
    rows = profiles.features(docs, "k", "t")
    each = sorted({f for r in rows.select("features").distinct().collect() for f in r.features})
    weights = spark.createDataFrame([(f, i % 5 - 2) for i, f in enumerate(each) if i % 3], "feature string, weight long")
    out = [profiles.predict(rows, "k", weights), profiles.predict(docs, "k", weights, block=4, text="t"), profiles.predict(docs, "k", weights, few=1, text="t")]
    got = [sorted(map(str, df.collect())) for df in out]
    none = spark.createDataFrame([(i, "") for i in range(9)], "k int, t string")  # texts without features, alone in their batches
    assert profiles.predict(none, "k", weights, text="t").count() == 9
    assert len(each) > 10 and len(got[0]) == len(texts) * 40 and got[0] == got[1] == got[2]


def test_predictions_shuffle_no_text_for_labels(spark, monkeypatch):
    from tidemark.operators import profiles
    from tidemark.plans import scoring

    plans, log_odds = [], profiles.log_odds
    monkeypatch.setattr(profiles, "log_odds", lambda rows, label: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or log_odds(rows, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = [sorted(map(str, scoring.signal_predictions(spark, "/root/testdata/sf0.001").collect()))]
        monkeypatch.setattr(scoring, "FEW_LABELS", 0)
        out.append(sorted(map(str, scoring.signal_predictions(spark, "/root/testdata/sf0.001").collect())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out[0] == out[1] and out[0]
    assert "Exchange hashpartitioning" not in plans[0] and "Exchange hashpartitioning" in plans[1]


def test_tokens_of_alike_lines_are_shuffled_as_numbers(spark):
    import random

    from tidemark.operators import matching

    rnd = random.Random(4)
    sets = {i: sorted(set(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 9)))) for i in range(90)}
    out = matching.jaccard_join(spark.createDataFrame([*sets.items()], "k long, t array<string>"), "k", "t", 0.6)
    want = {(a, b): len({*x} & {*y}) / len({*x} | {*y}) for a, x in sets.items() for b, y in sets.items() if a < b and len({*x} & {*y}) / len({*x} | {*y}) >= 0.6}
    assert {(r.a, r.b): r.jaccard for r in out.collect()} == want
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "array_intersect" in plan and "id#" in plan


def test_copies_of_a_line_give_each_pair_once(spark, tmp_path):
    from tidemark.plans import matches

    rows = [(i, f"alpha beta gamma {'delta' if i % 5 == 0 else ''}\nbody {i}") for i in range(2300)] + [(9000, "something else"), (9001, None), (9002, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n, same = 2300, 460 * 459 // 2 + 1840 * 1839 // 2
    out = matches.title_jaccard_join(spark, str(tmp_path))
    got = {(r.jaccard): r.n for r in out.where("a < b").distinct().groupBy("jaccard").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert out.count() == sum(got.values()) == n * (n - 1) // 2
    assert got == {1.0: same, 0.75: 460 * 1840}
