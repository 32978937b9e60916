"""Every registered query of the library against its SQL, or for the greedy ones a brute force."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[1] / "tools"))
import oracle  # noqa: E402

from tidemark.plans import cards, catalogue, columns, matches, more, records, scoring, topics, verdicts  # noqa: E402, F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, con, name):
    said = oracle.compare(spark, con, name, SF)
    assert said.startswith("ok"), said


def groups(spark):
    p = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    for label, g in p.groupby("label"):
        g = g.sort_values("vec_id")
        x = np.array(g.embedding.tolist(), float)
        x -= x.mean(axis=0)
        yield label, g.vec_id.tolist(), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_greedy_near_duplicates(spark):
    got = {r.vec_id: r.kept for r in catalogue.emb_near_dup_greedy(spark, SF).collect()}
    for _, ids, u in groups(spark):
        kept = []
        for i in range(len(ids)):
            if all(u[i] @ u[j] < 0.6 for j in kept):
                kept.append(i)
        assert [i for i in ids if got[i]] == [ids[i] for i in kept]


def test_average_linkage_against_plain_merging(spark):
    got = {(r.label, r.vec_id): r.cluster for r in catalogue.emb_clusters(spark, SF).collect()}
    for label, ids, u in list(groups(spark))[:3]:
        d = np.clip(1 - u @ u.T, 0, 2)
        parts = [[i] for i in range(len(ids))]
        while len(parts) > 1:
            best = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j)
            if best[0] > 0.6:
                break
            parts[best[1]] += parts.pop(best[2])
        want = {frozenset(ids[i] for i in p) for p in parts}
        mine = {}
        for i in ids:
            mine.setdefault(got[label, i], set()).add(i)
        assert {frozenset(v) for v in mine.values()} == want


def test_absorption_leaves_no_nested_phrase(spark):
    rows = catalogue.technology_mining(spark, SF).collect()
    assert [r.pos for r in sorted(rows, key=lambda r: r.pos)] == list(range(1, len(rows) + 1))
    for a in rows:
        assert not any(a is not b and f" {a.phrase} " in f" {b.phrase} " and a.docs <= b.docs for b in rows)


def test_relevance_and_bootstrap(spark):
    assert catalogue.emb_mmr(spark, SF).groupBy("label").count().where("count <> 5").count() == 0
    r = catalogue.bootstrap_interval(spark, SF).first()
    assert r.low < r.mean < r.high


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
