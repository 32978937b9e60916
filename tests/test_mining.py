"""Technology mining, glossary phrases and selections against plain loops."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import STOP_WORDS
from tidemark.operators import mining, relational, selection, translation
from tidemark.plans import topics

SF = "/root/testdata/sf0.001"


def within(a, b):
    return f" {a} " in f" {b} "


def plain_absorb(scored, limit):
    """One phrase after the other."""
    chosen = []
    for p, docs, score in sorted(scored, key=lambda r: (-r[2], r[0])):
        if any(within(p, c[0]) and docs <= c[1] for c in chosen):
            continue
        chosen = [c for c in chosen if not (within(c[0], p) and c[1] <= docs)]
        chosen.append((p, docs, score))
        if len(chosen) >= limit:
            break
    return [c[0] for c in chosen]


@pytest.mark.parametrize("limit", [1, 3, 10, 40, 1000])
def test_absorption_equals_one_after_the_other(spark, limit):
    rng = np.random.default_rng(limit)
    phrases = {" ".join(rng.choice(list("abc"), int(rng.integers(1, 5)))) for _ in range(150)}
    scored = [(p, int(rng.integers(1, 4)), float(rng.integers(1, 30))) for p in sorted(phrases)]
    got = mining.absorb(spark.createDataFrame(scored, "phrase string, docs long, score double"), limit)
    assert [r.phrase for r in got.orderBy("pos").collect()] == plain_absorb(scored, limit)


def test_reprints_numbers_and_blocked_phrases(spark):
    rows = [
        (1, "s1", "Solid state battery for cars"), (2, "s2", "solid  STATE battery for cars"), (3, "s2", "New solid state batteries"),
        (4, "s3", "Solid state batteries at last"), (5, "s1", "Quantum sensor network"), (6, "s2", "quantum sensor networks"), (7, "s3", "Deep learning tools"), (8, "s4", "deep learning tools again"), (9, "s4", None), (10, "s5", "  "),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, title string")
    out = {r.phrase: r for r in mining.mine_technologies(docs, "doc_id", "source", F.col("title"), topics=["Quantum Sensor"], generic=["learning tools"], generic_words=("deep", "learning"), max_share=1.0).collect()}
    assert (out["solid state battery"].docs, out["solid state battery"].sources, out["solid state battery"].surface) == (3, 3, "solid state batteries")
    assert not [p for p in out if "quantum" in p or p in ("deep learning", "learning tools", "learning tool")]
    assert out["solid state battery"].score == pytest.approx(3 * 2 * math.log2(4))
    assert mining.absorb(mining.mine_technologies(docs.limit(0), "doc_id", "source", F.col("title")), 5).count() == 0


def lexeme(word, entry, strict):
    if word == entry:
        return True
    if len(word) < 5 or len(entry) < 5:
        return False
    common = next((i for i, (a, b) in enumerate(zip(word, entry)) if a != b), min(len(word), len(entry)))
    if strict and (len(entry) - common > 3 or (len(word) - common > 3 and common < 6)):
        return False
    return common >= max(4, min(len(word), len(entry)) - 2)


def plain_segments(text, stop):
    words = re.findall(r"[\w-]+", text.lower())
    out, now = [], []
    for w in words + [None]:
        if w is None or w in stop:
            if now:
                out.append(now)
            now = []
        else:
            now.append(w)
    return out or ([words] if words else [])


def plain_terms(text, entries, stop, foreign, strict, limit=6):
    """Word by word over the glossary as a list."""
    segs = plain_segments(text or "", stop)

    def parts(words):
        return [p for w in words for p in ([x for x in w.split("-") if x] if strict and "-" in w and re.search(foreign, w) else [w])]

    known = [(parts(e.lower().split()), v, p) for e, v, p in sorted(entries, key=lambda x: x[2])]
    done, missed = [], []
    for seg in segs:
        words, at, out = parts(seg), 0, []
        while at < len(words):
            long = [(len(e), v) for e, v, _ in known if len(e) > 1 and len(words) - at >= len(e) and all(lexeme(w, x, strict) for w, x in zip(words[at:], e))]
            if long:
                n, v = max(long, key=lambda x: x[0])
                out.append(v)
                at += n
                continue
            w = words[at]
            at += 1
            if not re.search(foreign, w):
                out.append(w)
                continue
            near = [(e[0], v) for e, v, _ in known if len(e) == 1 and lexeme(w, e[0], strict)]
            if near:
                prefix = lambda e: next((i for i, (a, b) in enumerate(zip(w, e)) if a != b), min(len(w), len(e)))
                out.append(max(near, key=lambda x: (prefix(x[0]), -abs(len(x[0]) - len(w))))[1])
            else:
                missed.append(w)
        done.append(out)
    lines = [" ".join(d) for d in done if d]
    own = [" ".join(s) for s in segs]

    def unique(items):
        seen = {}
        for x in items:
            x = " ".join(x.split())
            if len(x) >= 2:
                seen.setdefault(x.lower(), x)
        return list(seen.values())[:limit]

    def specific(s):
        return [x for x in s if " " in x] or s

    return unique([" ".join(own), *specific(own), text or ""]) or [text or ""], unique([" ".join(lines), *specific(lines)]) or [text or ""], list(dict.fromkeys(missed))


@pytest.mark.parametrize("strict", [False, True])
def test_glossary_phrases_equal_word_by_word(spark, strict):
    entries = [("квантовые вычисления", "quantum computing", "a"), ("квантовые", "quantum", "b"), ("вычисления", "computing", "c"), ("финансы", "finance", "d"), ("edge-вычисления", "edge computing", "e"), ("медицина", "medicine", "f"), ("медиа", "media", "g"), ("сети", "networks", "h"), ("сетевые технологии связи", "network links", "i")]
    texts = ["слабые сигналы в области квантовых вычислений", "финансовые сети и edge-вычисления для LLM", "медицинские роботы", "в на для", "", None, "сетевыми технологиями связи в медиа, квантовый финтех", "iot edge computing", "квантовых квантовых вычислений и вычислениях"]
    stop = ("в", "на", "для", "и", "слабые", "сигналы", "области")
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    out = translation.fallback_terms(docs, "k", "t", spark.createDataFrame(entries, "entry string, value string, place string"), stop, "[а-яё]", strict).collect()
    for r in out:
        own, other, missed = plain_terms(texts[r.k], entries, stop, "[а-яё]", strict)
        assert (list(r.own), list(r.foreign_terms), list(r.missed)) == (own, other, missed), texts[r.k]
    assert len(out) == len(texts)


def test_glossary_query_equals_word_by_word(spark):
    import hashlib

    entries = [tuple(r) for r in topics.glossary(spark, SF).collect()]
    heads = defaultdict(list)
    for e in entries:
        heads[e[0].split()[0][:4]].append(e)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 700}
    got = {r.doc_id: r for r in topics.fallback_terms(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and len(texts) > 20
    for i, t in texts.items():
        near = [e for h in {w[:4] for w in re.findall(r"[\w-]+", (t or "").lower())} for e in heads[h]]
        own, other, missed = plain_terms(t, near, STOP_WORDS, topics.FOREIGN, True)
        sha = [hashlib.sha256("\n".join(x).encode()).hexdigest() for x in (own, other)]
        assert [got[i].own_sha256, got[i].foreign_sha256, got[i].n_missed] == [*sha, len(missed)]


def test_anchors_need_two_phrases(spark):
    rows = spark.createDataFrame([("t", 1, "Robotic arms and robots"), ("t", 2, "robotics for arms"), ("t", 3, "arms"), ("u", 1, "robots robots"), ("t", 4, None), ("t", 5, "12345 systems")], "topic string, place int, phrase string")
    got = {(r.topic, r.stem): list(r.anchors) for r in translation.topic_anchors(rows, "topic", "place", "phrase", ("systems",)).collect()}
    assert got == {("t", "robot"): ["robotic", "robotics", "robots", "robot"]} | {("t", "arms"): ["arms"]} or set(got) == {("t", "robot"), ("t", "arms")}
    assert set(got[("t", "robot")]) >= {"robotic", "robotics", "robots", "robot"}
    words = [r.word for r in translation.topic_keywords(rows, "topic", "place", "phrase", ("systems",), 3).where("topic = 't'").orderBy("pos").collect()]
    assert words == ["robotic", "arms", "and"]


def test_selections_equal_whole_sorts(spark):
    rng = np.random.default_rng(8)
    rows = [(g, i, None if rng.random() < 0.1 else float(rng.integers(0, 12)), bool(rng.random() < t)) for g, t in (("a", 0.02), ("b", 0.5), ("c", 0.0), (None, 0.1)) for i in range(60)]
    d = spark.createDataFrame(rows, "g string, i int, s double, t boolean")
    order = lambda r: (r[2] is None, -(r[2] or 0), r[1])
    got = {(r.g, r.i): r.pos for r in selection.evidence(d, "g", "i", "s", F.col("t"), 4).collect()}
    shares = {(r.g, r.i): r.preferred for r in selection.top_share(d, "g", "s", "i", 0.3).collect()}
    for g in ("a", "b", "c", None):
        best = sorted((r for r in rows if r[0] == g), key=order)
        top = best[:4]
        trusted = [r for r in best if r[3]]
        if trusted and not any(r[3] for r in top):
            top = [*top[:3], trusted[0]]
        assert {i: p for (q, i), p in got.items() if q == g} == {r[1]: n + 1 for n, r in enumerate(top)}
        assert {i for (q, i), p in shares.items() if q == g and p} == {r[1] for r in best[:18]}
    for limit, reserve in ((10, 3), (10, 0), (5, 20), (500, 2)):
        flagged = sorted((r for r in rows if r[3]), key=order)
        first = flagged[: min(reserve, limit)]
        want = [*first, *sorted((r for r in rows if r not in first), key=order)][:limit]
        got_top = relational.top_with_reserve(d, F.col("t"), [F.col("s").desc(), F.col("i")], limit, reserve).collect()
        assert Counter((r.s, r.i, r.reserved) for r in got_top) == Counter((r[2], r[1], r in first) for r in want)
