"""Profile models, staged training, thresholds, packing, refills and answers against plain versions."""

import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import profiles as P
from tidemark.operators import packing, profiles, refill, sequential, thresholds
from tidemark.plans import scoring
from tidemark.sources import answers

SF = "/root/testdata/sf0.001"


def plain_stems(text):
    """Word by word, with a flag that a negator sets."""
    out = []
    for clause in re.split(r'[.,;:!?()\[\]«»"—–\n]+', (text or "").lower()):
        words, stems, negate = re.findall("[a-zа-яё]+", clause), [], False
        for i, w in enumerate(words):
            if w in P.NEGATORS or (w == P.NONE and i < len(words) - 1):
                negate = True
            elif w == P.NONE:
                stems = [s if s.startswith("не_") else "не_" + s for s in stems]
            elif len(w) >= 3 and w[:6] not in P.IDLE:
                stems.append("не_" + w[:6] if negate else w[:6])
                negate = False
        out.append(stems)
    return out


def plain_features(text):
    stems = plain_stems(text)
    return {s for c in stems for s in c} | {f"{a}_{b}" for c in stems for a, b in zip(c, c[1:])}


NEGATED = [None, "", "нет", "массового внедрения нет", "нет массового внедрения", "Не внедрено, без рынка и не для всех; рынок есть", "No mass market yet. Not at all adopted", "without the large scale use", "не нет внедрения нет", "one. two! no"]


def test_negations_reach_as_far_as_word_by_word(spark):
    docs = spark.createDataFrame(list(enumerate(NEGATED)), "doc_id int, text string")
    got = {r.doc_id: r for r in docs.select("doc_id", P.clause_stems("text").alias("s"), P.profile_features("text").alias("f")).collect()}
    for i, t in enumerate(NEGATED):
        assert [list(c) for c in got[i].s] == plain_stems(t) and set(got[i].f) == plain_features(t)
    assert all("не_массов" in plain_features(NEGATED[i]) for i in (3, 4))


def test_contributions_sum_to_the_logit(spark):
    docs = spark.createDataFrame([(1, "strong growth in quantum sensing. no market"), (2, "quantum sensing"), (3, "unknown words"), (4, None)], "doc_id int, text string")
    weights = spark.createDataFrame([("quantu", 5000), ("sensin", -2000), ("quantu_sensin", 700), ("не_market", 9000)], "feature string, weight long")
    got = {r.doc_id: r for r in profiles.predict(profiles.features(docs, "doc_id", "text"), "doc_id", weights, intercept=-0.25).collect()}
    for i, t in ((1, "strong growth in quantum sensing. no market"), (2, "quantum sensing"), (3, "unknown words"), (4, None)):
        keys = plain_features(t)
        w = {"quantu": 0.5, "sensin": -0.2, "quantu_sensin": 0.07, "не_market": 0.9}
        logit = -0.25 + sum(w.get(k, 0) for k in keys) / math.sqrt(max(1, len(keys)))
        assert got[i].logit == pytest.approx(logit) and got[i].p == pytest.approx(1 / (1 + math.exp(-logit)))
        assert sum(c.contribution for c in got[i].reasons) - 0.25 == pytest.approx(logit)
    assert [c.feature for c in got[1].reasons][0] == "не_market" and got[4].n_features == 0


def plain_fit(x, y, w, l2, precision=None, theta0=None):
    xa = np.hstack([x, np.ones((len(x), 1))])
    free = np.append(np.full(x.shape[1], l2), 0)
    t = np.zeros(xa.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-xa @ t))
        g = xa.T @ (w * (p - y)) + free * t
        h = (xa * (w * p * (1 - p))[:, None]).T @ xa + np.diag(free)
        if precision is not None:
            g, h = g + precision @ (t - theta0), h + precision
        t = t - np.linalg.solve(h, g)
    return t, h


@pytest.mark.parametrize("dense", [0, 128])
def test_staged_fits_equal_plain_newton(spark, dense):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=300) > 0.3).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)] + [(-1, x[0].tolist(), None)], "id int, x array<double>, label int")
    one, two = (sequential.balanced(rows.where(c), "label") for c in ("id < 200 AND label IS NOT NULL", "id >= 200 AND label IS NOT NULL"))
    weight = lambda part: np.where(part == 1, len(part) / (2 * part.sum()), len(part) / (2 * (len(part) - part.sum())))
    first, curved = plain_fit(x[:200], y[:200], weight(y[:200]), 1.0)
    theta = sequential.fit(one, "x", "label", dense=dense)
    assert np.abs(theta - first).max() < 1e-5
    assert np.allclose(sequential.hessian(one, "x", "label", theta), curved, atol=1e-4)
    for anchor in (sequential.l2_sp(first, 10.0), sequential.laplace(first, curved, 0.5), sequential.laplace(first, curved, 0.5, diagonal=True)):
        want, _ = plain_fit(x[200:], y[200:], weight(y[200:]), 1.0, anchor.precision, first)
        assert np.abs(sequential.fit(two, "x", "label", anchor=anchor, start=theta, dense=dense) - want).max() < 1e-5
    want, _ = plain_fit(np.vstack([x[200:], x[:200]]), np.append(y[200:], y[:200]), np.append(weight(y[200:]), 0.3 * weight(y[:200])), 1.0)
    assert np.abs(sequential.fit(sequential.with_replay(two, one, 0.3), "x", "label", dense=dense) - want).max() < 1e-5
    assert rows.limit(1).select(sequential.logit("x", first)).first()[0] == pytest.approx(np.append(x[0], 1) @ first)
    with pytest.raises(ValueError):
        sequential.fit(one.limit(0), "x", "label")


def test_sequential_query(spark):
    rows = scoring.staged_rows(spark, SF).toPandas()
    one = rows[rows["first"]]
    y = one.label.to_numpy()
    w = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
    want, _ = plain_fit(np.array(one.x.tolist()), y, w, 1.0)
    got = [r.weight for r in scoring.sequential_logistic(spark, SF).where("fit = 'first'").orderBy("feature").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-4


def test_relaxation_equals_row_by_row(spark):
    rows = [r for r in scoring._measured(spark, SF).where("quality = 1").collect()]
    got = scoring.threshold_relaxation(spark, SF).orderBy("move").collect()
    names, start, step = ("capitals", "digits", "length"), [0.01, 0.0005, 0.5], [0.005, 0.0005, 0.5]
    moves = [0, 0, 0]
    for r in got:
        level = [round(a + m * b, 9) for a, m, b in zip(start, moves, step, strict=True)]
        by = Counter(next((n for n, t in zip(names, level, strict=True) if x[n] is not None and x[n] >= t), None) for x in rows)
        by.pop(None, None)
        assert [r.by_capitals, r.by_digits, r.by_length] == [by[n] for n in names] and r.cut == sum(by.values())
        assert [r.t_capitals, r.t_digits, r.t_length] == level
        moves[max(range(3), key=lambda i: (by[names[i]], -i))] += 1
    assert len(got) > 3 and (got[-1].share <= 0.05 or len(got) == 41)


def test_thresholds_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, 1.0, 1), (5.0, None, 0), (2.0, 2.0, 0), (2.0, 0.0, None), (float("nan"), 0.0, 1)], "a double, b double, label int")
    out = {(r.t_a, r.t_b): r for r in thresholds.lattice(rows, {"a": (F.col("a"), (1.0, 3.0)), "b": (F.col("b"), (1.5, 9.0))}, "label").collect()}
    assert len(out) == 4 and out[(1.0, 1.5)].cut_neg == 2 and out[(3.0, 9.0)].cut_neg == 1 and out[(3.0, 9.0)].cut_pos == 1
    assert all(r.all_pos == 2 and r.all_neg == 2 for r in out.values())
    assert thresholds.relax(rows.limit(0), [thresholds.Rule("a", F.col("a"), 1.0, 1.0)], 0.1)[0]["share"] == 0
    assert thresholds.best(thresholds.lattice(rows, {"a": (F.col("a"), (1.0,))}, "label"), ["a"], 0.0).count() == 0


def test_many_topics_are_even(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{int(t)}", int(v)) for t, v in zip(np.minimum(rng.zipf(1.3, 20_000), 3000), rng.integers(0, 2, 20_000), strict=True)]
    docs = spark.createDataFrame([*rows, (None, 1), ("t1", None)], "topic string, y int")
    exact = packing.balanced_folds(docs, "topic", "y", 4)
    cut = packing.balanced_folds(docs, "topic", "y", 4, most=50)
    sizes = Counter(t for t, _ in rows)
    pos = Counter(t for t, v in rows if v)
    load, want = [[0, 0, k] for k in range(4)], {}
    import hashlib

    for t in sorted(sizes, key=lambda t: (-pos[t], -sizes[t], hashlib.sha256(t.encode()).hexdigest())):
        fold = min(load)
        fold[0] += pos[t]
        fold[1] += sizes[t]
        want[t] = fold[2]
    assert {r.topic: r.fold for r in exact.collect()} == want
    found = {r.topic: r.fold for r in cut.collect()}
    assert set(found) == set(want) and all(found[t] == want[t] for t in sorted(sizes, key=lambda t: (-pos[t], -sizes[t]))[:20])
    off = packing.imbalance(cut).first()
    assert off.pos < 0.35 and off.size < 0.35 and packing.imbalance(exact).first().pos < off.pos + 0.3


def plain_refill(rows, shown, rounds):
    """Batches from the front of a queue until enough are accepted."""
    tried, accepted = {}, []
    queue = list(rows)
    for k in range(1, rounds + 1):
        batch, queue = queue[: shown - len(accepted)], queue[shown - len(accepted) :]
        for key, ok in batch:
            tried[key] = k
            if ok:
                accepted.append(key)
    return tried, accepted


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_refills_equal_batches(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(q, i, float(rng.random()), bool(rng.random() < share)) for q, share in (("a", 0.5), ("b", 0.0), ("c", 1.0), ("d", 0.8)) for i in range(40)] + [("e", 0, 1.0, None), ("e", 1, 0.5, True)]
    out = refill.refill(spark.createDataFrame(rows, "q string, i int, s double, ok boolean"), "q", [F.col("s").desc(), F.col("i")], "ok", 7, rounds).collect()
    for q in "abcde":
        queue = sorted(((r[1], r[3]) for r in rows if r[0] == q), key=lambda x: (-next(r[2] for r in rows if r[0] == q and r[1] == x[0]), x[0]))
        tried, accepted = plain_refill(queue, 7, rounds)
        assert {r.i: r.round for r in out if r.q == q and r.round} == tried
        assert [r.i for r in sorted((r for r in out if r.q == q and r.position), key=lambda r: r.position)] == accepted


def test_answers_of_every_kind(spark):
    whole = {"a": [1, {"b": 'say "x" \\ {'}], "c": None}
    text = json.dumps(whole)
    rows = [text[:i] for i in range(1, len(text) + 1)] + [None, "", "no brace", "} {", "{]", text + " } tail", "```json\n" + text + "\n```", '{"a": 1} {"b": 2}']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(answers.closed("t")).collect()]
    for t, c in zip(rows[: len(text)], got, strict=False):
        try:
            json.loads(c)
        except ValueError:  # broken off inside a key or a literal
            assert re.search(r'(?:[{,]\s*"[^"]*"?|nul?|n)$', t), (t, c)
    assert json.loads(got[len(text) - 1]) == whole and json.loads(got[-2]) == whole and json.loads(got[-3]) == whole and json.loads(got[-1]) == {"a": 1}
    assert got[-4] is None  # a bracket of another kind
    odd = spark.createDataFrame([('{"k": 1, "s": "x"}',), ('{"k": "1"}',), ("[1]",), ("{",), (None,)], "t string")
    out = odd.select(answers.parsed(answers.repaired("t")).alias("p")).select("p.status", answers.problems(F.col("p.value"), {"k": "bigint", "s": "string"}).alias("w")).collect()
    assert [r.status for r in out] == ["OK", "OK", "NOT_OBJECT", "NOT_JSON", "NOT_JSON"]
    assert [list(r.w) for r in out[:3]] == [[], ["k: not bigint", "s: missing"], ["k: missing", "s: missing"]]
    safe = spark.sql("SELECT map('a', double('nan'), 'b', double('infinity'), 'c', 1.5D) AS m").select(answers.json_safe(F.col("m"))).first()[0]
    assert safe == {"a": None, "b": None, "c": 1.5}


def test_profile_features_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in scoring._features(spark, SF).collect():
        assert set(r.features) == plain_features(docs[r.doc_id])


def test_projections_of_observations(spark):
    rows = {r.source: r for r in scoring.observations(spark, SF).collect()}
    got = {r.source: r for r in scoring.observation_vectors(spark, SF).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for s, r in rows.items():
        u = unit(unit(r.title_vector) + np.mean([unit(e.vector) for e in r.evidence], axis=0))
        want = [np.clip((u[i] - 0.01) / (0.05 * (i + 1)), -5, 5) for i in range(8)]
        assert [got[s][f"emb_pc_{i + 1}"] for i in range(8)] == pytest.approx(want)
    assert len(got) == len(rows) > 10


def test_observations_without_topic_or_evidence(spark):
    from tidemark.operators import registry

    kind = "k int, title string, title_vector array<double>, topic string, topic_terms array<string>, topic_vector array<double>, evidence array<struct<title:string,type:string,trust:string,year:int,vector:array<double>>>, cluster_similarity double"
    v = [1.0] + [0.0] * 63
    rows = [(1, "early thing", v, None, None, None, [("a", "PUBLICATION", "HIGH", 2023, v)], 0.5), (2, None, v, "topic words", ["topic"], v, None, None), (3, "t", [0.0] * 64, "topic", ["topic"], v, [(None, None, None, None, [0.0] * 64)] * 12, float("nan"))]
    got = {r.k: r for r in registry.observation_features(spark.createDataFrame(rows, kind), "k", scoring.LEX, scoring.STAGED, 2023, scoring.projection()).collect()}
    assert got[1].has_topic == got[1].rel_query_title == got[1].trusted_share == 0 and got[1].lex_emergence_share == 0.5
    assert got[2].has_topic == 1 and got[2].has_evidence == 0 and got[2].rel_query_title == 1
    assert got[3].evidence_count == 1 and got[3].rel_cluster_query_v1 == 0 and got[3].spec_title_evidence_sim == 0
    assert all(np.isfinite(x) for r in got.values() for x in r[1:])


def test_request_names_equal_canonical_json(spark):
    import hashlib

    from tidemark.operators import verdicts

    rows = [(1, [("user", 'say "hi"\n'), ("assistant", None)], '{"a":1}', 256, 0.2), (2, [], None, 1, 1.0), (3, [("system", "é")], None, 64, 0.0)]
    d = spark.createDataFrame(rows, "k int, m array<struct<role:string,content:string>>, s string, n int, t double")
    for k, m, s, n, t in rows:
        payload = {"max_tokens": n, "messages": [[r or "", c or ""] for r, c in m], "schema": hashlib.sha256(s.encode()).hexdigest() if s else "", "temperature": t}
        want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        assert d.where(f"k = {k}").select(verdicts.replay_key(F.col("m"), F.col("s"), F.col("n"), F.col("t"))).first()[0] == want


def test_verdicts_of_odd_rows(spark):
    from tidemark.operators import verdicts as V

    counters = spark.createDataFrame([("a", 1), (None, 5)], "k string, n long")
    deltas = spark.createDataFrame([("a", 2), ("a", 3), ("b", None), (None, 1)], "k string, n long")
    assert {tuple(r) for r in V.bump(counters, deltas, ["k"], ["n"]).collect()} == {("a", 6), ("b", 0), (None, 6)}
    assert V.bump(counters.limit(0), deltas.limit(0), ["k"], ["n"]).count() == 0
    cards = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, market boolean")
    out = {r.k: r.outcome for r in V.final_check(cards, spark.createDataFrame([(1, "N-MAT", 0.9), (3, "N-MAT", None)], "k int, code string, confidence double"), "k", "market").collect()}
    assert out == {1: "KEPT", 2: "UNCHECKED", 3: "DROPPED"}
    terms = spark.createDataFrame([("g", 1, "Two  words"), ("g", 2, "two words"), ("g", 3, "x"), ("g", 4, "solo"), ("g", 5, "bad term"), ("g", 6, None)], "g string, p int, t string")
    assert [r.term for r in V.clean_terms(terms, "g", "t", "p", ("Bad Term",)).orderBy("pos").collect()] == ["Two words", "solo"]
    gates = spark.sql("SELECT CAST(NULL AS boolean) AS a, true AS b").select(V.gate({"a": F.col("a"), "b": F.col("b")}).alias("g")).first().g
    assert gates.decision == "reject" and list(gates.failed) == ["a"]
