"""The pipeline against plain Python versions of its stages."""

from collections import Counter

import pytest
from test_llm_operators import brute_contamination, fill, shingles_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import pii  # noqa: E402

SF = "/root/testdata/sf0.001"


def near(texts):
    """Smallest id of each component of texts of a five-word similarity of 0.8, over all pairs."""
    sh = {i: shingles_of(t) for i, t in texts.items()}
    least = {i: i for i in texts}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 100 * len(sh[i] & sh[j]) >= 80 * len(sh[i] | sh[j]):
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_stage_keeps_one_of_each_component(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert kept == set(near(docs).values())


def test_stages_of_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(20).unionByName(docs.limit(5)).unionByName(docs.limit(3).selectExpr("doc_id", "CAST(NULL AS string) AS text", "lang", "source", "n_chars"))
    odd = odd.unionByName(docs.limit(1).selectExpr("CAST(NULL AS long) AS doc_id", "text", "CAST(NULL AS string) AS lang", "CAST(NULL AS string) AS source", "CAST(NULL AS long) AS n_chars"))
    odd = odd.selectExpr("*", "map('a', 1) AS m", "1 AS pii", "2 AS hit", "'x' AS w", "3 AS size")
    for table in (odd, odd.limit(0)):
        left = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, SF)
            assert left.columns == table.columns
        mixed = corpus_pipeline.STAGES[-1][1](spark, left, SF)
        assert (mixed.count() > 0) == (table is odd)


def test_run_equals_plain_stages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts = {i: r.text for i, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    group = near(texts)
    texts = {i: texts[i] for i in texts if group[i] == i}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute_contamination(texts.items(), bench)
    texts = {i: pii.redact(t) for i, t in texts.items() if not hit[i][1]}
    size = {i: len((t or "").split()) for i, t in texts.items()}
    by_source = Counter()
    for i, n in size.items():
        by_source[docs[i].source] += n
    want = fill(by_source)
    out = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in out}) == len(out) and {r.doc_id for r in out} <= set(texts)
    taken = Counter()
    for r in out:
        assert r.source == docs[r.doc_id].source and r.size == size[r.doc_id] and 0 < r.taken <= 3 * r.size
        assert r.source_size == by_source[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= max(12, 0.05 * t) for s, t in want.items())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_duplicates", "benchmark_decontamination", "personal_data", "source_mix"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
