"""What a review found on larger tables and odd values."""

from __future__ import annotations

import math

import duckdb


def _sql(name: str, folder: str, *tables: str):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con.execute(entry.oracle_sql()[name]).fetchall()


def test_centroids_keep_the_sign_of_zero_and_count_null_vectors(spark, tmp_path):
    from tidemark.plans import catalogue

    v = [1.0, -1e-4, 0.5] + [1.0] * 61
    spark.createDataFrame([(1, v, 7), (2, None, 7), (3, v, None)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.label: (r.n, [repr(x) for x in r.centroid]) for r in catalogue.emb_centroids(spark, str(tmp_path)).collect()}
    assert got == {label: (n, [repr(x) for x in c]) for label, n, c in _sql("emb_centroids", str(tmp_path), "embeddings")}
    assert got[7][0] == 2 and math.copysign(1, float(got[7][1][1])) == -1


def test_upsert_merge_rounds_halves_to_even(spark, tmp_path):
    from datetime import datetime

    from tidemark.plans import catalogue

    rows = [(1, 1, "F", 198500.0), (2, 2, "O", 297500.0), (3, 3, "P", 2500.0), (4, 3, "F", 1499.99), (5, 4, "O", 400.0)]
    rows = [(k, c, s, p, datetime(1994 + k % 2, 6, 1), "1-URGENT") for k, c, s, p in rows]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in catalogue.upsert_merge(spark, str(tmp_path)).collect())
    assert got == sorted(_sql("upsert_merge", str(tmp_path), "orders"))
    assert [r[1] for r in got] == [198, 298, 2, 0]


def test_translation_shuffles_no_text_and_large_glossaries_agree(spark):
    from tidemark.operators import translation

    docs = spark.createDataFrame([(1, "alpine flowers and zebra alpinist"), (2, "unknown meadow the alpine flower"), (3, "the"), (None, None)], "k long, t string")
    entries = [("alpine", "ALP", "a"), ("alpine flower", "ALP_FLOWER", "b"), ("flower", "FLOWER", None), ("flowery", "FLOWERY", "c")]
    glossary = spark.createDataFrame(entries, "entry string, value string, place string")
    out = [translation.translated(docs, "k", "t", glossary, ("and", "the"), "^[a-m]", True, few) for few in (10, 0)]
    rows = [{r.k: (r.segments, r.translated, r.missed) for r in df.collect()} for df in out]
    assert rows[0] == rows[1]
    assert rows[0][1] == (["alpine flowers", "zebra alpinist"], [["ALP_FLOWER"], ["zebra", "ALP"]], [])
    assert rows[0][2] == (["unknown meadow", "alpine flower"], [["unknown"], ["ALP_FLOWER"]], ["meadow"])
    assert rows[0][3] == (["the"], [["the"]], []) and rows[0][None] == ([], [], [])
    assert "Exchange" not in out[0]._jdf.queryExecution().executedPlan().toString()


def test_topic_stems_shuffle_no_text(spark):
    from tidemark.plans import topics

    plan = topics.topic_stems(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def _dealt_by(df, *columns: str) -> bool:
    """Whether some exchange of the plan is dealt by all these columns."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return any("Exchange hashpartitioning" in x and all(f"{c}#" in x for c in columns) for x in lines)


def test_jaccard_pairs_are_decided_where_they_meet(spark):
    import random

    from tidemark.operators import matching

    rnd = random.Random(3)
    sets = {i: set(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 12))) for i in range(120)}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "k long, t array<string>")
    for threshold in (0.25, 0.5, 0.6, 1.0):
        want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= threshold}
        out = matching.jaccard_join(rows, "k", "t", threshold)
        got = [(r.a, r.b, r.jaccard) for r in out.collect()]
        assert len(got) == len(want) and {(a, b): j for a, b, j in got} == want
    assert not _dealt_by(out, "k", "kb")


def test_best_overlap_counts_where_rows_are(spark):
    import random

    from tidemark.operators import matching

    rnd = random.Random(5)
    a, b = ({i: rnd.sample("abcdefghijklmnopq", k=rnd.randint(1, 12)) for i in range(n)} for n in (15, 150))
    left, right = (spark.createDataFrame([(i, s) for i, s in x.items()], f"{k} long, w array<string>") for x, k in ((a, "l_id"), (b, "r_id")))
    want = {}
    for i, x in a.items():
        each = [(-len({*x} & {*y}) / min(len(x), len(y)), -len({*x} & {*y}), j) for j, y in b.items() if len({*x} & {*y}) >= 3]
        best = min((e for e in each if e[0] <= -0.5), default=None)
        if best:
            want[i] = (best[2], -best[1], -best[0])
    assert 5 < len(want)
    for few in (20_000, 5):
        out = matching.best_by_overlap(left, right, "l_id", "r_id", "w", 3, 0.5, set_limit=few)
        assert {r.l_id: (r.r_id, r.shared, r.overlap) for r in out.collect()} == want
        assert not _dealt_by(out, "l", "r")


def test_key_pairs_are_not_collected(spark):
    from tidemark.operators import matching

    a = [(1, ["x", "y"]), (2, ["y", None]), (1, ["z"]), (3, []), (4, None)]
    b = [(i, ["x", "y"] if i % 3 else ["y", "y", "q"]) for i in range(40)] + [(7, ["z"]), (50, ["z", None]), (51, [None])]
    left, right = spark.createDataFrame(a, "l long, k array<string>"), spark.createDataFrame(b, "r long, k array<string>")
    want = {(i, j) for i, x in a for j, y in b if {*(x or [])} & {*y} - {None}}
    for part in (5, 8192):
        out = matching.any_key_join(left, right, "l", "r", "k", part=part)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and {*got} == want
    assert not _dealt_by(out, "l", "r")


def test_average_linkage_holds_no_pairs():
    import tracemalloc

    import numpy as np

    from tidemark.operators import vectors

    rng = np.random.default_rng(7)
    u = rng.normal(size=(2000, 8)) + 3 * rng.normal(size=(40, 8))[rng.integers(0, 40, 2000)]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    tracemalloc.start()
    vectors.average_linkage(u, 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2000 * 2000  # bytes; a matrix of distances takes eight times as many


def test_predictions_shuffle_no_features_and_many_weights_agree(spark):
    from tidemark.operators import profiles

    texts = ["strong growth in quantum sensing. no market", "Quantum sensing; рынка нет", "unknown words", "", None, "not no market нет the sensing, quantum"]
    rows = profiles.features(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t")
    weights = spark.createDataFrame([("quantu", 5000), ("sensin", -5000), ("quantu_sensin", 700), ("не_market", 9000), ("не_рынка", -1)], "feature string, weight long")
    out = [profiles.predict(rows, "k", weights, 0.5, top=2, few=few) for few in (5, 4)]
    got = [sorted(map(str, df.collect())) for df in out]
    assert got[0] == got[1] and len(got[0]) == len(texts)
    assert [c.feature for c in out[0].where("k = 0").first().reasons] == ["не_market", "quantu"]
    assert "Exchange" not in out[0]._jdf.queryExecution().executedPlan().toString()


def test_text_models_share_counts_and_classes_meet_in_no_task(spark):
    from tidemark.operators import learning, selection

    rows = spark.createDataFrame([(i, f"word{i % 7} other{i % 3}", float(i % 2)) for i in range(40)], "k int, t string, y double")
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = selection.class_weights(rows, "y")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    hashed = learning.hashed_words(rows, "t", 64)
    one = learning.predict(learning.fit_hashed(hashed, "y"), hashed, ["k"]).orderBy("k").collect()
    two = learning.predict(learning.fit_text(rows, "t", "y", 64), rows, ["k"]).orderBy("k").collect()
    assert len(one) == 40 and all(abs(a.p - b.p) < 1e-6 for a, b in zip(one, two))


def test_greedy_filter_deals_no_kept_vectors_to_kept_ones(spark, monkeypatch):
    from tidemark.operators import vectors

    monkeypatch.setattr(vectors, "_pairs_of_blocks", None)  # that deals all members to all blocks of theirs
    rows = spark.createDataFrame([(None, 1, [1.0, 0.0]), (None, 2, [0.0, 1.0]), (None, 3, [1.0, 0.1]), (None, 4, [0.1, 1.0]), (None, 5, [1.0, 0.2])], "g int, k int, v array<double>")
    got = {r.k: (r.kept, r.kept_by) for r in vectors.near_dup_filter(rows, "g", "k", "v", ["k"], 0.9, block=2).collect()}
    assert got == {1: (True, 1), 2: (True, 2), 3: (False, 1), 4: (False, 2), 5: (False, 1)}


def test_archive_merge_unites_few_and_many_versions_alike(spark):
    from tidemark.operators import relational

    rows = [("a", "t", None, None, ["x", "y", "x"]), ("a", "longer", "s", None, ["z", None]), ("b", "", None, None, None), (None, "n", None, None, ["q"]), (None, None, None, None, ["p"]), ("", "e", None, None, [])]
    rows = spark.createDataFrame(rows, "url string, title string, summary string, published_on date, tokens array<string>")
    got = [{r.url: (r.title, r.summary, r.tokens) for r in relational.merge_archive(rows, many).collect()} for many in (1, 32)]
    want = {"a": ("longer", "s", ["x", "y", "z"]), "b": ("", "", []), None: ("n", "", ["p", "q"]), "": ("e", "", [])}
    assert got == [want, want]


def _word_by_word(segments, glossary, strict):
    from tidemark.operators import translation

    singles, several = glossary
    out, missed = [], []
    for words, strange in segments:
        said, at = [], 0
        while at < len(words):
            near = several.get(tuple(translation._start(w) for w in words[at : at + 2]), ())
            fit = next((x for x in near if len(x["e"]) <= len(words) - at and all(translation._alike(w, e, strict) for w, e in zip(words[at:], x["e"]))), None)
            value = fit and fit["value"]
            if value is None:
                value = translation._closest(words[at], singles.get(translation._start(words[at]), []), strict) if strange[at] else words[at]
            (missed if value is None else said).append(words[at] if value is None else value)
            at += len(fit["e"]) if fit else 1
        out.append(said)
    return out, missed


def test_words_are_looked_up_once_for_all_texts(monkeypatch):
    import random

    import pyarrow as pa

    from tidemark.operators import translation

    rnd = random.Random(11)
    heads = ["abcd", "bcde", "mnop"]
    vocabulary = [h + e for h in heads for e in ("", "e", "ef", "efg", "xyz", "xyzzy")] + ["a", "mn", "z"]
    entries = [{"e": rnd.choices(vocabulary, k=rnd.choice((0, 1, 1, 2, 2, 3, 4))), "value": rnd.choice((None, f"V{i}", f"V{i}")), "place": rnd.choice((None, str(i)))} for i in range(60)]
    texts = [[(ws := rnd.choices(vocabulary, k=rnd.randint(0, 12)), [w < "m" for w in ws]) for _ in range(rnd.randint(0, 4))] for _ in range(400)]
    kind = pa.list_(pa.struct([("segment", pa.string()), ("words", pa.list_(pa.string())), ("strange", pa.list_(pa.bool_()))]))
    segs = pa.array([[{"segment": " ".join(w), "words": w, "strange": f} for w, f in t] for t in texts], kind)
    plain, asked = translation._closest, []
    monkeypatch.setattr(translation, "_closest", lambda w, *a: asked.append(w) or plain(w, *a))
    for some in (entries, [x for x in entries if len(x["e"]) < 2], []):
        for strict in (False, True):
            glossary = translation._indexed(some)
            asked.clear()
            walk = translation._walker(glossary, strict)
            got = [x for part in (segs.slice(0, 150), segs.slice(150, 250)) for x in zip(*(y.to_pylist() for y in walk(part)))]
            assert len(asked) == len({*asked}) <= len(vocabulary)
            assert [x[0] for x in got] == [[" ".join(w) for w, _ in t] for t in texts]
            assert [x[1:] for x in got] == [_word_by_word(t, glossary, strict) for t in texts]


def test_acceptability_splits_no_phrase(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import text as T
    from tidemark.operators import matching
    from tidemark.plans import matches

    generic, boilerplate, mature = ("the", "and", "a.c", "two words"), ("from", "two words"), ("of the", "abc")
    odd = ["the and the", "the of the", "a b of the", "of the", "abc", "abc the", "axc the", "a.c the and", "two words", "x from y", "from", "fromage x", "the  and", "the ", " the", "", "then and the", "re rise", "ising x", "abc ing", "x" * 61, None]

    def plain(p):
        ws = p.split(" ")
        aged = any(f" {m} " in f" {p} " and not {*ws} - {*m.split(" ")} - {*generic} for m in mature)
        return 3 <= len(p) <= 60 and bool({*ws} - {*generic}) and not {*ws} & {*boilerplate} and not ws[-1].endswith(("ing", "ize", "ise")) and not aged

    rows = spark.createDataFrame([(p,) for p in odd], "p string").select("p", matching.acceptable(F.col("p"), generic, boilerplate, mature).alias("ok"))
    assert {r.p: r.ok for r in rows.collect()} == {p: None if p is None else plain(p) for p in odd}
    assert all(r.ok for r in spark.createDataFrame([("the one",)], "p string").select(matching.acceptable(F.col("p"), (), (), ()).alias("ok")).collect())

    long = "u v " + "w" * 300_000  # no run of words is looked for inside a word
    texts = ["", "a", "a b", "a b c", "ä b c d", "a a a a", long, None]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.word_runs("t", 3).alias("r")).collect()
    assert {r.k: r.r for r in got} == {i: None if t is None else [" ".join(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)] for i, t in enumerate(texts)}
    plan = matches.technology_acceptability(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "zip_with" not in plan


def test_technologies_form_phrases_once_and_keys_may_repeat(spark, tmp_path):
    import random

    from tidemark.plans import catalogue

    rnd = random.Random(13)
    words = ["battery", "batteries", "batterys", "cell", "cells", "gas", "the", "der", "ties", "tie", "ty", "solid", "of", "bus", "bias"]
    title = lambda: "".join(rnd.choice(words) + rnd.choice((" ", " ", " ", ", ")) for _ in range(rnd.randint(0, 9)))
    rows = [(i, rnd.choice(("s1", "s2", None)), title()) for i in range(150)] + [(rnd.choice((None, 1, 2, 500, 501)), rnd.choice(("s1", "s2", "s3", None)), title()) for _ in range(60)]
    rows += [(600, "s1", "Solid batteries and solid battery"), (601, "s2", None), (602, "s2", "")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("technology_candidates", "technology_mining"):
        out = getattr(catalogue, name)(spark, str(tmp_path))
        got = sorted(tuple(r) for r in out.collect())
        assert got == sorted(_sql(name, str(tmp_path), "documents")) and len(got) > 10
    plan = catalogue.technology_candidates(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 3  # once for titles that have their key alone, twice for the others
    assert sum("Exchange hashpartitioning(phrase#" in x for x in plan.splitlines()) == 1
