"""Queries whose input was cut once: results that need the whole of it."""

from pyspark.sql import functions as F


def test_stem_overlap_looks_at_long_documents(spark, tmp_path):
    from tidemark.plans import matches

    spark.createDataFrame([(1, "alpha bravo charlie delta echo")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # 1 shares five of twelve stems; 2, a long one, holds four stems alone; 3 has no length
    rows = [(1, "alpha bravo charlie delta zulu yankee xray", 40), (2, "alpha bravo charlie delta\n" + "x" * 3000, 3026), (3, "alpha bravo charlie delta echo", None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    r = matches.stem_overlap_join(spark, str(tmp_path)).collect()
    assert [(x.item_id, x.doc_id, x.shared, x.overlap) for x in r] == [(1, 3, 5, 1.0)]
    docs = spark.createDataFrame(rows[:2], "doc_id long, text string, n_chars long").withColumn("w", F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " "))
    item = spark.read.parquet(f"{tmp_path}/benchmark.parquet").withColumn("w", F.split("text", " "))
    assert matches.matching.best_by_overlap(item, docs, "item_id", "doc_id", "w", 4, 0.2).first().doc_id == 2


def test_benchmark_items_are_matched_whole(spark, tmp_path):
    from tidemark.operators import matching
    from tidemark.plans import catalogue

    long = "one two three four five six seven eight"
    spark.createDataFrame([(1, long), (2, "green tea"), (3, "nowhere to be found in any of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [f"x {long} y", "one two three four five six nine ten", "Green tea", "evergreen tea", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.item_id: r.docs for r in catalogue.benchmark_contains(spark, str(tmp_path)).collect()} == {1: 1, 2: 1, 3: 0}
    docs = spark.createDataFrame([(t and t.lower(),) for t in texts], "t string")
    items = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    for limit in (0, 3):  # a shuffle join and a literal set
        assert {r.item_id: r.docs for r in matching.count_holding(docs, "t", items, "item_id", "text", 6, limit).collect()} == {1: 1, 2: 1, 3: 0}


def test_segments_of_long_and_null_word_lists(spark):
    from tidemark.operators import selection

    rows = [(1, "the red of of blue sky and".split()), (2, ["the"]), (3, []), (4, None), (5, ["a", "b"] * 20000)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, w array<string>").select("i", selection.segments(F.col("w"), ("the", "of", "and", "a")).alias("s")).collect()}
    assert got == {1: ["red", "blue sky"], 2: [], 3: [], 4: None, 5: ["b"] * 20000}


def test_vectors_and_baseline_see_everything(spark, tmp_path):
    import numpy as np

    from tidemark.operators import vectors
    from tidemark.plans import catalogue, more

    head = "word " * 50
    spark.createDataFrame([(1, head + "apple"), (2, head + "zebra")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    v = {r.doc_id: r.vector for r in catalogue.doc_hashing_embedding(spark, str(tmp_path)).collect()}
    assert v[1] != v[2]
    # one letter: the word (1) and one gram of three (0.5) in a wide vector
    w = vectors.hashing_embedding(spark.createDataFrame([("a",)], "t string"), "t", 1 << 16).first().vector
    assert sorted(abs(x) for x in w if x) == list(np.sort(np.array([0.5, 1.0]) / np.sqrt(1.25)))
    sf = "/root/testdata/sf0.001"
    labelled = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    scored = sorted(r.doc_id for r in more.train_text_baseline(spark, sf).collect())
    assert scored == sorted(r.doc_id for r in labelled.select("doc_id").collect())


def test_archive_merge_takes_all_tokens(spark, tmp_path):
    from tidemark.plans import catalogue

    import hashlib

    from tidemark.operators import relational

    rows = [(1, "t\na b c d e"), (2, "t\ne f"), (3, None), (4, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.url: (r.longest, r.tokens) for r in catalogue.archive_merge(spark, str(tmp_path)).collect()}
    assert got == {sha("t"): (11, sha("a b c d e f t")), sha(""): (0, sha("")), sha("x"): (1, sha("x"))}
    versions = [("en", "a b c d e", "s", None, list("abcde")), ("en", "e f", "", None, list("ef")), ("de", None, None, None, []), (None, "x", "", None, ["x"])]
    merged = relational.merge_archive(spark.createDataFrame(versions, "url string, title string, summary string, published_on date, tokens array<string>"))
    assert {r.url: r.tokens for r in merged.collect()} == {"en": list("abcdef"), "de": [], None: ["x"]}
