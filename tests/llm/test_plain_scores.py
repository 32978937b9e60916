"""Scores of toxicity and language against plain loops over words, pairs and n-grams."""

import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import langid, toxicity

SF = "/root/testdata/sf0.001"


def letter(c):
    return ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 6


def plain_words(text):
    """Words as lists of letter classes; letters that stand alone in a row are one word."""
    out, alone = [], False
    for w in (text or "").lower().split():
        x = [letter(c) for c in w if c.isalpha()]
        if not x:
            continue
        if len(x) == 1 and alone:
            out[-1] += x
        else:
            out.append(x)
        alone = len(x) == 1
    return out


def vector(x):
    v = Counter()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            for k in range(j + 1, min(len(x), i + toxicity.SPAN + 1)):
                v[x[i], x[j], x[k]] += toxicity.DECAY ** (k - i - 2)
    return v


def cosine(u, v):
    n = math.sqrt(sum(x * x for x in u.values())) * math.sqrt(sum(x * x for x in v.values()))
    return sum(u[k] * v[k] for k in u) / n if n else 0.0


def sharp(s):
    return s**toxicity.POWER if s >= toxicity.FLOOR else 0.0


@pytest.fixture(scope="module")
def model():
    words = ["idiot", "worthless", "stupid", "clown"]
    table = toxicity.table_of(words)
    value, axes = np.linalg.eigh(toxicity.sharpen(table.T @ table).astype(np.float64))
    whiten = (axes / np.sqrt(np.maximum(value, 0.05))).astype(np.float32)
    weights = np.array([0.7, -0.4, 1.1, 0.2, 0.9, -0.8], np.float32)
    return toxicity.Model(words, table, whiten, weights, (1.7, -0.3))


def plain_score(model, text):
    marks = [vector([letter(c) for c in w]) for w in model.landmarks]
    said = [vector(w) for w in plain_words(text)]
    best = [max([sharp(cosine(v, m)) for v in said], default=0.0) for m in marks]
    x = [sum(b * model.whiten[i, j] for i, b in enumerate(best)) for j in range(len(best))] + [toxicity.NEAREST * max(best)]
    margin = sum(a * b for a, b in zip(x, model.weights)) + model.weights[-1]
    return 1 / (1 + math.exp(-(model.curve[0] * margin + model.curve[1])))


ODD = [None, "", " - ! ", "a", "i d i o t", "an i-d.iot, no", "STUPID stupids stup1d", "worthxless wrthless", "ÄÖ idiöt клоун", "clown " * 50 + "x y z clowns", "a b. idiot c d", "idiot stupid", "aaaa abababab clo wn"]


def test_toxicity_scores_equal_plain_loops(spark, model):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    texts = ODD + docs
    want = [plain_score(model, t) for t in texts]
    assert model.score(texts) == pytest.approx(want, abs=1e-4)
    assert len(set(np.round(want, 3))) > 5
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(frame, model).collect()}
    assert [got[i][0] for i in range(len(texts))] == pytest.approx(want, abs=1e-4)
    assert all(p == int(s >= 0.3) for s, p in got.values())


def plain_features(text):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = letters.split()
    if not words:
        return None
    # a blank at each end, beside that of a run after the last word
    s = [ord(c) for c in " " + " ".join(words) + (" " if letters.endswith(" ") else "") + " "]
    counts = np.zeros(langid.DIMS)
    m = 0xFFFFFFFF
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            h = s[i] * 2654435761 & m
            if n > 1:
                h = (h ^ (s[i + 1] * 0x85EBCA6B & m)) * 0xC2B2AE35 & m
            if n > 2:
                h = (h ^ (s[i + 2] * 0x27D4EB2F & m)) * 0x165667B1 & m
            counts[h >> 20] += 1
    v = np.sqrt(counts)
    return v / np.linalg.norm(v)


def plain_language(model, x):
    """Votes of pairs inside the best family, equal votes by trust."""
    p = {f: 1 / (1 + math.exp(-4 * float(x @ model.family_w[:-1, i] + model.family_w[-1, i]))) for i, f in enumerate(model.families)}
    family = max(p, key=p.get)
    members, share = model.families[family], p[family] / sum(p.values())
    if len(members) == 1:
        return members[0], share
    votes, trust = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    pairs, w = model.pair_w[family]
    for k, (i, j) in enumerate(pairs):
        q = 1 / (1 + math.exp(-4 * float(x @ w[:-1, k] + w[-1, k])))
        votes[members[i if q > 0.5 else j]] += 1
        trust[members[i]] += q / (len(members) - 1)
        trust[members[j]] += (1 - q) / (len(members) - 1)
    won = max(members, key=lambda m: votes[m] + 0.5 * trust[m])
    return won, share * trust[won]


def test_languages_equal_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    rows = langid.identify(docs, model).select("text", "lang_pred", "score").limit(40).collect()
    assert len(model.families) > 1
    for r in rows:
        x = plain_features(r.text)
        if x is None:
            assert (r.lang_pred, r.score) == (langid.UNKNOWN, 0.0)
            continue
        assert langid.features(r.text) == pytest.approx(x, abs=1e-5)
        lang, score = plain_language(model, x)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3)
