"""Min-max hashing, periodic runs and whitening against brute force, with odd rows and tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import minhash, periodic, queries, whitening

SF = "/root/testdata/sf0.001"
CLASHING = "n long, digest string, root string, key string, w string, found string, runs string, kept string, x string, u string"


def clashing(df):
    for c in CLASHING.split(", "):
        df = df.withColumn(c.split()[0], F.lit(1).cast(c.split()[1]))
    return df


def shingles(text, k=4):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_components(texts, percent=80):
    """doc_id -> (size of the set, smallest doc_id reachable), over all pairs."""
    sh = {i: shingles(t) for i, t in texts}
    least = {i: i for i in sh}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sh)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sh[i] & sh[j])
            if both and 100 * both >= percent * len(sh[i] | sh[j]):
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    return {i: (len(sh[i]), find(i)) for i in ids}


def rewritten(rng, base, share):
    w = base.split()
    for _ in range(max(1, int(len(w) * share))):
        w[int(rng.integers(len(w)))] = f"new{int(rng.integers(1 << 30))}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of near copies around texts that aren't the first of their group, chains, passages
    shared by many texts, and copies on either side of the bound."""
    rng = np.random.default_rng(11)

    def prose(n):
        return " ".join(f"w{int(x)}" for x in rng.integers(0, 5000, n))

    texts = []
    for _ in range(12):
        base = prose(int(rng.integers(30, 150)))
        group = [rewritten(rng, base, s) for s in rng.uniform(0, 0.05, 12)]
        texts += [*group[:6], base, *group[6:]]
        chain = base
        for _ in range(6):
            chain = rewritten(rng, chain, 0.02)
            texts.append(chain)
    passage = prose(70)
    texts += [prose(int(rng.integers(3, 40))) + " " + passage for _ in range(60)]
    return list(enumerate(texts))


@pytest.mark.parametrize("cell, cell_shingles", [(4096, 4_000_000), (5, 4_000_000), (4096, 300), (1, 100)])
def test_links_equal_all_pairs(spark, copies, cell, cell_shingles):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, cell=cell, cell_shingles=cell_shingles).collect()}
    assert got == plain_components(copies)


def test_minhash_query_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op11_minhash(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(docs)
    assert len(rows) == len(docs) and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_minhash_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(9, None), (8, ""), (7, " \n\t"), (6, "One two"), (5, "one TWO "), (4, "one two three"), (None, "a b c d e"), (3, "A B C D E"), (None, "alone at last we are"), (2, long), (1, long + " x"), (1, long + " x"), (0, "É é")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=repr)
    want = [(9, 0, 9, True), (8, 0, 8, True), (7, 0, 7, True), (6, 1, 5, False), (5, 1, 5, True), (4, 1, 4, True), (None, 2, 3, False), (3, 2, 3, True), (None, 2, None, True), (2, 59997, 1, False), (1, 59998, 1, True), (1, 59998, 1, True), (0, 1, 0, True)]
    assert got == sorted(want, key=repr)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    left = minhash.deduplicate(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == [0, 1, 1, 3, 4, 5, 7, 8, 9]


def test_either_value_estimates_similarity():
    rng = np.random.default_rng(3)
    for n, both in ((400, 380), (400, 200), (50, 40)):
        equal = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = minhash.signature(np.sort(x[:n])), minhash.signature(np.sort(x[n - both :]))
            equal.append((a == b).reshape(2, -1).mean(axis=1))
        assert np.abs(np.mean(equal, axis=0) - both / (2 * n - both)).max() < 0.03


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q):
                inner = words[i : i + length]
                if all(any(inner[k] != inner[k + s] for k in range(length - s)) for s in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_runs_equal_all_periods(data):
    pieces = data.draw(st.lists(st.tuples(st.lists(st.sampled_from(data.draw(st.sampled_from(["ab", "abc", "abcdefgh"]))), min_size=1, max_size=9), st.integers(1, 30)), min_size=1, max_size=5))
    words = [w.encode() for piece, times in pieces for w in piece * times]
    assert periodic.runs(words) == plain_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_lyndon_arrays_equal_sorted_suffixes(s):
    nss, common = periodic.lyndon(s)
    for i in range(len(s)):
        j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
        assert nss[i] == j
        assert common[i] == next((k for k in range(len(s) - j) if s[i + k] != s[j + k]), len(s) - j)


@pytest.mark.parametrize("shape", ["aaaa", "abab", "ababc", "fibonacci", "abab c", "nested"])
def test_words_are_read_few_times(shape):
    """Reads per word in texts made to be read again and again: one more a doubling at worst
        (Fibonacci words and nested repeats)."""

    class Counting(list):
        reads = 0

        def __getitem__(self, i):
            Counting.reads += 1
            return super().__getitem__(i)

    def text(n):
        if shape == "fibonacci":
            a, b = "a", "ab"
            while len(b) < n:
                a, b = b, b + a
            return b[:n]
        if shape == "nested":
            t = "ab"
            while len(t) < n:
                t = t * 3 + "c"
            return t[:n]
        return {"aaaa": "a" * n, "abab": "ab" * (n // 2), "ababc": "ababc" * (n // 5), "abab c": "ab" * (n // 2 - 1) + "c"}[shape]

    per = []
    for n in (2000, 32000):
        Counting.reads = 0
        s = Counting(map(ord, text(n)))
        periodic.lyndon(s)
        per.append(Counting.reads / len(s))
    assert max(per) < 25 and per[1] - per[0] < 4.5


def plain_digest(doc_id, text):
    w = (text or "").split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(x for i, x in enumerate(w) if i not in drop))]
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *sha)


def test_runs_query_equals_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert got == {plain_digest(i, t) for i, t in docs if len((t or "").split()) < 2500 or zlib.crc32(str(i).encode()) % 10} | {r for r in got if len((dict(docs)[r[0]] or "").split()) >= 2500 and zlib.crc32(str(r[0]).encode()) % 10 == 0}
    assert sum(r[1] > 0 for r in got) >= 10


def test_runs_of_odd_rows(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    texts = [None, "", "\n", "one", "a b " * 40, "word " * 50_000]
    rows = [*zip(ids, texts, strict=True), (None, "x y z " * 9), (None, None), (1, "la " * 30), (1, "la " * 30)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = periodic.find_runs(periodic.planted(docs))
    assert set(docs.columns) <= set(out.columns) and out.count() == len(rows)
    got = sorted(map(tuple, periodic.digest(out).collect()), key=repr)
    want = [plain_digest(i, t) for i, t in rows if i is not None and len(t or "") < 1000]
    null = [plain_digest(1, t)[1:] for t in ("x y z " * 9, None)]
    big = [r for r in got if r[0] == ids[5]]
    assert big[0][1:6] == (1, 0, 50_000, 1, 50_000_000)
    assert got == sorted([*want, *big, *[(None, *r) for r in null]], key=repr)
    assert periodic.digest(periodic.find_runs(periodic.planted(docs.limit(0)))).count() == 0


def plain_whitening(rows, k=16):
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(axis=0)
    mean = s / n
    v = (fit - mean).T @ (fit - mean) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return {i: (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(y, s, strict=True)), (y - mean) @ q / np.sqrt(e), e / np.trace(v)) for i, y in x.items()}


def compare_whitening(got, want):
    for r in got:
        n, deviation, white, explained = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(abs(white[r.component - 1]), abs=1e-8)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
    for c in {r.component for r in got}:  # one sign for all rows
        assert len({round(r.whitened / want[r.vec_id][2][c - 1]) for r in got if r.component == c and abs(r.whitened) > 0.01}) == 1


def test_whitening_query_equals_plain_version(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op13_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows)
    compare_whitening(got, plain_whitening(rows))


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.normal(0, 3, 5)]) for i in range(40)]
    good += [(100 + i, good[0][1]) for i in range(50)]
    bad = [(50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0]), (53, [1.0, float("nan"), 0.0, 0.0, 0.0]), (54, [1.0, float("inf"), 0.0, 0.0, 0.0]), (55, [float("-inf")] * 5)]
    docs = clashing(spark.createDataFrame([*good, *bad, good[1]], "vec_id long, embedding array<float>"))
    want = plain_whitening([(i, np.array(v, np.float32)) for i, v in good])
    got = whitening.whiten(docs).collect()
    assert len(got) == 5 * 91 and {r.component for r in got} == {1, 2, 3, 4, 5}
    compare_whitening(got, want)
    flat = [(i, [float(a), 2.0 * a, 0.0]) for i, a in enumerate(rng.integers(0, 50, 30).tolist())]  # one direction of variance
    got = whitening.whiten(spark.createDataFrame([*flat, (None, flat[0][1])], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and len(got) == 31 and got[0].explained == pytest.approx(1)
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
