"""Cards against a plain check of the same rules; terms, stages, experts and checks of training rows."""

import hashlib
import re
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cards as C
from tidemark.operators import cards, learning, matching, metrics, selection, translation, vectors
from tidemark.plans import cards as plans
from tidemark.plans import store
from tidemark.sources import records

SF = "/root/testdata/sf0.001"


def squeeze(t):
    return re.sub(r"\s+", " ", t or "").strip(" ")


def no_refs(t):
    return re.sub(r"\s*\[doc:\d+\]", "", t or "").strip(" ")


def plain_key(t):
    return squeeze(re.sub(r"[«»\"'“”„()\[\]]", " ", (t or "").lower()))


def plain_share(t):
    letters = [c for c in t if c.isalpha()]
    return sum(c.isascii() for c in letters) / len(letters) if letters else 1.0


def numbers(pattern, t):
    return [float(x.replace(",", ".")) for x in re.findall(pattern, t)]


def bad(t, held):
    return [v for v in numbers(r"(?<![\w.,])\d+(?:[.,]\d+)?(?!\w)", t) if v not in held and round(v, 2) not in held]


def mend(t, held):
    return " ".join(p for p in re.split(r"(?<=[.!?…])\s+", t) if p and not bad(p, held)).strip()



def in_sources(term, corpus):
    flat = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    cut = lambda s: {w[:5] for w in re.findall(r"[\w-]+", s.lower())}
    wanted = cut(term)
    return (flat(term) != "" and flat(term) in flat(corpus)) or bool(wanted and len(wanted & cut(corpus)) / len(wanted) >= 0.6)


def latin(t):
    return {p for w in re.findall(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*", t.lower()) for p in w.split("-") if len(p) >= 4}


def plain_check(card, sources, summaries, fields):
    labels = {x.strip() for x in card.chosen or [] if x}
    src = [s for s in sorted(sources, key=lambda s: s.place) if s.place <= 5 and f"d{s.place}" in labels]
    if not src:
        return "no source was chosen", None, None, None
    corpus = " ".join(f"{s.title} {s.text}" for s in src)
    held = set()
    for v in numbers(r"[0-9]+(?:[.,][0-9]+)?", corpus):
        held |= {v, round(v, 2)}
    held |= {float(s.day.year) for s in src if s.day}
    got = {f: squeeze(no_refs(card[f]))[:n] for f, n in fields.items()}
    got = {f: t if f == "title" else mend(t, held) for f, t in got.items()}
    names = []
    for n in card.companies or []:
        n = squeeze(n)
        if len(n) >= 2 and plain_key(n) and plain_key(n) in plain_key(corpus) and n not in names:
            names.append(n)
    told, kinds = {}, {}
    for s in src:
        for x in sorted((x for x in summaries if x.label.strip() == f"d{s.place}"), key=lambda x: (x.place, x.summary or "")):
            t = mend(squeeze(no_refs(x.summary))[:400], held)
            if s.place not in told and len(t) >= 10 and plain_share(t) >= 0.5:
                told[s.place], kinds[s.place] = t, "ORIGINAL" if s.own else "GENERATED"
    missing = sum(s.place not in told for s in src)
    case = next((s.place for s in src if f"d{s.place}" == card.case), None)
    terms = [t for t in re.findall(r"\(([^()]{2,80})\)", got["title"]) if plain_key(t)]

    def why():
        if bad(got["title"], held):
            return "title: number without a source"
        if not any(in_sources(t, corpus) for t in terms):
            return "title: no term of the sources"
        for f, t in got.items():
            if len(t) < (3 if f == "title" else 10):
                return f"{f}: empty"
            if plain_share(t) < (0.3 if f == "title" else 0.5):
                return f"{f}: other language"
        return f"no summary of {missing} sources" if missing else ""

    anchor = latin(got["title"])
    words = {s.place: latin(f"{s.title} {s.text[:400]}") for s in src}
    near = [s.place for s in src if s.place == case or not words[s.place] or words[s.place] & anchor]
    stay = near if anchor and near else [s.place for s in src]
    kept = "\n".join(f"{p}:{kinds[p]}:{told[p]}" for p in stay if p in told)
    return why(), got, names[:5], kept


def test_cards_against_a_plain_check(spark):
    answers, sources, summaries = (x.collect() for x in plans.card_inputs(spark, SF))
    by, told = defaultdict(list), defaultdict(list)
    for s in sources:
        by[s.card].append(s)
    for s in summaries:
        told[s.card].append(s)
    got = {r.card: r for r in plans.card_acceptance(spark, SF).collect()}
    assert set(got) == {a.card for a in answers} and len(got) > 20
    reasons = set()
    for a in answers:
        reason, texts, names, kept = plain_check(a, by[a.card], told[a.card], plans.FIELDS)
        r = got[a.card]
        assert (r.reason, r.accepted) == (reason, reason == ""), a.card
        reasons.add(reason)
        if texts:
            assert r.title == texts["title"] and r.companies == "; ".join(names)
            assert r.description_sha256 == hashlib.sha256(texts["description"].encode()).hexdigest()
        if reason == "":
            assert r.summaries_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert {"", "no source was chosen", "title: number without a source", "title: no term of the sources", "why: empty"} <= reasons


ANSWER = "card bigint, title string, description string, why string, chosen array<string>, `case` string, companies array<string>, src string"
SOURCE = "card bigint, place bigint, title string, text string, day date, own boolean"
TOLD = "card bigint, label string, place bigint, summary string"


def check(spark, answers, sources, summaries):
    rows = (spark.createDataFrame(answers, ANSWER), spark.createDataFrame(sources, SOURCE), spark.createDataFrame(summaries, TOLD))
    return cards.check_cards(*rows, "card", plans.FIELDS, plans.latin).collect()


def test_cards_of_nulls_repeats_and_clashing_names(spark):
    good = (1, "Fast engines (Solid Core)", "An engine of 42 parts. It has 43 parts. It runs.", "It runs for long.", ["d1", None, "d1"], "d1", ["Acme Labs", None, "Acme  Labs"], "clash")
    source = (1, 1, "Solid core engines", "Acme Labs made 42 parts", date(2024, 1, 1), True)
    told = [(1, "d1", 2, "The later of the summaries."), (1, " d1 ", 1, "In 77 parts. The first of the summaries.")]
    (r,) = check(spark, [good], [source, source], told)
    assert r.accepted and r.description == "An engine of 42 parts. It runs." and r.companies == ["Acme Labs"] and r.case_place == 1
    assert [(s.place, s.summary, s.kind) for s in r.summaries] == [(1, "The first of the summaries.", "ORIGINAL")]
    (r,) = check(spark, [(2, None, None, None, None, None, None, None)], [source], told)
    assert (r.accepted, r.reason, r.summaries) == (False, "no source was chosen", None)
    (r,) = check(spark, [good], [source], [])
    assert r.reason == "no summary of 1 sources"
    (r,) = check(spark, [good[:1] + ("Fast 2024 engines (Solid Core)", "Da da da да да да да да да да да",) + good[3:]], [source], told)
    assert r.reason == "description: other language"  # 2024 is the year of its source
    (r,) = check(spark, [good], [(1, 1, None, None, None, None)], told)
    assert r.reason == "title: no term of the sources"
    assert check(spark, [], [], []) == []


def test_fallback_of_cards_without_evidence_and_long_texts(spark):
    e = spark.createDataFrame([("a", 1, "T", "One. " + "x" * 500 + ". Three.", "d.org", 2, False), ("a", 2, "U", "Own one. Own two. Own three.", "e.org", None, True), ("a", 3, None, None, None, 2, None)], "k string, place int, title string, text string, domain string, trust int, own boolean")
    c = spark.createDataFrame([("a", "  Двигатель ", 0.5, [("A", 1.0, -0.2), ("B", 2.0, 0.2), ("C", 9.0, 0.1)]), ("b", None, 0.25, None)], "k string, title string, score double, features array<struct<label:string,value:double,contribution:double>>")
    got = {r.k: r for r in cards.fallback_cards(c, e, "k", plans.latin).collect()}
    assert got["a"].title == "Technology: Двигатель" and got["a"].description == "Own one. Own two. One." and got["a"].case_example == "T (d.org)"
    assert got["a"].explanation.startswith("Score of the model 0.50. Features: a = 1.00 (lowers), b = 2.00 (raises).")
    assert (got["b"].title, got["b"].description, got["b"].case_example) == ("Untitled", "", "No case: there is no evidence.") and "no features" in got["b"].explanation
    told = {r.place: (r.summary, r.kind) for r in cards.fallback_summaries(e, "k").collect()}
    assert told == {1: ("One.", "EXTRACTIVE"), 2: ("Own one. Own two.", "ORIGINAL"), 3: ("", "EXTRACTIVE")}


def test_title_terms(spark):
    rows = [("LiDAR and Solid-State Cooling for the Grid: a Survey (U-Net) in 6G",), ("owner/Fast-Repo",), ("one",), (None,), ("the of and",), ("data via Data and DATA cooling, LiDAR lidar",)]
    got = [r.t for r in spark.createDataFrame(rows, "s string").select(C.title_terms("s", generic=("survey",)).alias("t")).collect()]
    assert got[0] == ["LiDAR", "Solid-State Cooling", "U-Net", "6G", "Solid-State"]
    assert got[1:5] == [["Fast-Repo"], [], [], []]
    assert got[5] == ["data via Data", "DATA cooling", "LiDAR lidar", "DATA", "LiDAR"]


def test_stage_sets_and_recall(spark):
    a = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    two = spark.createDataFrame([(2,), (2,), (3,), (None,)], "k int")
    got = sorted((r.stage, r.k) for r in selection.stage_sets(a, "k", [("all", "all", None), ("in", "in", two), ("out", "out", a.where("k = 3"))]).collect() if r.k)
    assert got == [("all", 1), ("all", 2), ("all", 3), ("in", 2), ("in", 3), ("out", 2)]
    experts = spark.createDataFrame([(f"e{i}", None if i == 2 else date(2024, i + 1, 1)) for i in range(4)], "k string, day date")
    hits = spark.createDataFrame([("e0", "s", "url"), ("e0", "s", "text"), ("e1", "t", "text")], "k string, source string, rule string")
    found = metrics.expert_recall(experts, hits, "k", "url", F.lit("2024-02-01").cast("date"))
    for r in found.collect():
        assert r.split == ("holdout" if int(hashlib.sha1(r.k.encode()).hexdigest(), 16) % 5 == 0 else "dev")
    by = {r.k: r for r in found.collect()}
    assert (by["e0"].hits, by["e0"].strong, by["e0"].rules, by["e0"].eligibility) == (2, True, ["text", "url"], "before") and by["e2"].eligibility == "no date" and by["e3"].sources == []
    totals = {(r.kind, r.value): (r.found, r.experts) for r in metrics.recall_totals(found).collect()}
    assert totals["all", ""] == (2, 4) and totals["source", "t"] == (1, 1)


def test_leak_check_sees_markers(spark):
    rows = spark.createDataFrame([(i, f"word{i} " + ("Marker said" if i % 2 else "nothing"), i % 2) for i in range(60)] + [(99, None, None)], "k int, t string, y int")
    r = learning.leak_check(rows, "k", "t", "y", ["marker"], folds=2).first()
    assert (r.n, r.found, r.f1, r.passed) == (60, 30, 1.0, False)
    r = learning.leak_check(rows, "k", "t", "y", ["absent"], folds=2).first()
    assert (r.found, r.f1, r.passed) == (0, 0.0, True)
    assert learning.leak_check(rows.limit(0), "k", "t", "y", ["absent"]).first().n == 0


def test_aligned_lengths(spark):
    rows = [(1, "a" * 10 + ", " + "b" * 10, 1, "k"), (2, "c" * 30, 1, "k"), (3, "d" * 15, 0, "k"), (4, None, 0, "k"), (5, "e" * 15, 0, "k"), (6, "f" * 99, None, "k")]
    got = {r.k: r.t for r in learning.aligned_lengths(spark.createDataFrame(rows, "k int, t string, y int, n string"), "t", "y").collect()}
    assert got == {1: "a" * 10, 2: "c" * 15, 3: "d" * 15, 4: None, 5: "e" * 15, 6: "f" * 99}
    one = spark.createDataFrame(rows[:2], "k int, t string, y int, n string")
    assert {r.k: r.t for r in learning.aligned_lengths(one, "t", "y").collect()} == {1: rows[0][1], 2: rows[1][1]}


def test_matches_of_string_keys(spark):
    left = spark.createDataFrame([("x", ["alpha", "beta", "gamma"])], "a string, w array<string>")
    right = spark.createDataFrame([("q", ["alpha", "beta"]), ("p", ["alpha", "beta"])], "b string, w array<string>")
    assert matching.best_by_overlap(left, right, "a", "b", "w", 2, 0.5).first().b == "p"
    near = vectors.best_match(spark.createDataFrame([([1.0, 0.0],)], "v array<double>"), "v", spark.createDataFrame([("z", [1.0, 0.0]), ("y", [1.0, 0.0])], "l string, centroid array<double>"), "l").first()
    assert near.best == "y" and near.similarity == pytest.approx(1.0)


def test_checkpoints_are_removed(spark):
    store.cut(spark.range(3)).count()
    assert store.clean(spark) and not store.clean(spark)
    assert store.cut(spark.range(3)).count() == 3


def test_topic_stems_are_those_of_the_phrases(spark):
    rows = spark.createDataFrame([(1, ["The quick Engines", "a of"], ["cooling-engine engines"]), (2, [], [])], "k int, own array<string>, foreign_terms array<string>")
    got = {r.k: r.stems for r in translation.topic_stems(rows, "k", ("the",)).collect()}
    assert got == {1: ["cooli", "engin", "quick"], 2: []}


def test_negative_rows_are_judged(spark):
    rows = [(1, "One", None, "d", "Mature", ""), (2, " one ", "x", "d", "hype", "u"), (3, "Two", "x", "d", "odd", None), (4, None, "x", "d", "noise", None), (5, "Zwei", " y ", None, "noise", "u")]
    kept, refused = records.negative_rows(spark.createDataFrame(rows, "n int, title string, description string, domain string, subtype string, url string"), plans.KINDS)
    assert {r.n: r.reason for r in refused.collect()} == {2: "REPEATED_TITLE", 3: "UNKNOWN_SUBTYPE", 4: "EMPTY_TITLE"}
    got = {r.row_id: (r.description, r.kind, r.source_urls) for r in kept.collect()}
    assert got == {"neg-0001": ("", "MATURE", []), "neg-0005": ("y", "HYPE_OR_NOISE", ["u"])}


def test_encyclopedia_answers(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",), ("e",), (None,)], "k string")
    s = spark.createDataFrame([("a", 200, "u"), ("a", 404, None), ("b", 404, "u"), ("e", 503, "u"), (None, 200, "u")], "k string, status int, url string")
    v = spark.createDataFrame([("a", date(2024, 1, 31), 5), ("a", date(2023, 1, 1), 7)], "k string, day date, n int")
    r = spark.createDataFrame([("b", date(2020, 1, 1))], "k string, at date")
    got = {x.k: (x.found, x.url, x.views, x.created) for x in records.encyclopedia(t, "k", s, v, r, F.lit("2024-02-01").cast("date")).collect()}
    assert got == {"a": (True, "u", 5, None), "b": (False, None, None, None), "c": (None,) * 4, "e": (None,) * 4, None: (None,) * 4}
