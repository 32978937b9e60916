"""Operators on small cases: nulls, ties, empty groups and orders."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import features, metrics, mining, relational, rules, vectors
from tidemark.sources import formats


def one(spark, value, *exprs):
    kind = "string" if value is None or isinstance(value, str) else None
    df = spark.createDataFrame([(value,)], f"x {kind}") if kind else spark.createDataFrame([(value,)], ["x"])
    r = df.select(*exprs).first()
    return r[0] if len(exprs) == 1 else tuple(r)


X = None


@pytest.fixture(autouse=True)
def _column(spark):
    global X
    X = F.col("x")  # columns need a session


def test_text_functions(spark):
    assert one(spark, " A\tb​\n", T.clean_whitespace("x")) == "A b"
    assert one(spark, "<p>a<script>no</script> <b>b</b></p>", T.strip_html("x")) == "a b"
    assert one(spark, "ﬁne ＡＢ", T.nfkc(X)) == "fine AB" and one(spark, "a &amp; b", T.unescape(X)) == "a & b"
    assert one(spark, "One. Two two! Three?", T.first_sentences("x", 2)) == "One. Two two!"
    assert one(spark, "One. Has key here. Rest.", T.snippet("x", "KEY")) == "Has key here. Rest."
    assert one(spark, None, T.snippet("x", "k"), T.tokens("x"), T.text_quality("x")) == ("", [], "title")
    assert one(spark, "en-GB", T.language_code("x")) == "en" and one(spark, "1x", T.language_code("x")) is None
    assert one(spark, "https://doi.org/10.1/ABC", T.doi("x")) == "10.1/abc" and one(spark, "11.1/a", T.doi("x")) is None
    assert [one(spark, w, T.singular(X)) for w in ("batteries", "robots", "glass", "bus")] == ["battery", "robot", "glass", "bus"]
    assert one(spark, "Été à la plage!", T.slug("x")) == "ete-a-la-plage"
    assert one(spark, "/news/2024/new-solid-state-cells.html", T.slug_title("x")) == "new solid state cells"
    assert one(spark, "in 2024, 40 units, 2 of 3.5", F.array_sort(T.numbers("x"))) == [3.5, 40.0]
    assert one(spark, "a [doc:3] b[doc:12]", T.doc_refs("x"), T.without_doc_refs("x")) == ([3, 12], "a b")
    assert one(spark, "of the of the the", T.lexicon_hits(T.tokens("x"), exact=("the",), phrases=("of the",))) == 5
    assert one(spark, "Acme Labs met Acme Labs and Big Co", T.organisations("x")) == ["Acme Labs", "Big Co"]
    assert one(spark, "ТЕХ-1", T.look_alikes("x")) == "TEX-1"
    assert one(spark, "robot arms", T.words_within(F.lit("arms"), X), T.words_within(F.lit("arm"), X)) == (True, False)


def test_urls(spark):
    u = "HTTP://user@www.Example.com:80/A/?utm_source=x&b=2&a=1#top"
    assert one(spark, u, U.canonical("x"), U.identity("x"), U.origin_domain("x")) == ("https://example.com/A?b=2&a=1", "example.com/A?a=1&b=2", "example.com")
    assert one(spark, "ftp://x", U.canonical("x")) is None
    assert one(spark, "https://arxiv.org/abs/2401.01234v2", U.identity_key("x")) == "arxiv:2401.01234"
    assert one(spark, "https://doi.org/10.1/X", U.identity_key("x")) == "doi:10.1/x"
    assert str(one(spark, "https://a.b/2024/02/29/c", U.date_of_path("x"))) == "2024-02-29" and one(spark, "https://a.b/2023/02/30/c", U.date_of_path("x")) is None
    assert one(spark, "sub.gov.uk", U.in_domain(X, ["gov.uk"]), U.in_domain(X, ["ov.uk"])) == (True, False)


def test_numbers_and_dates(spark):
    assert one(spark, 2.5, N.clip(X, 0, 9, True), N.display_score(F.lit(0.5), F.lit(True)), N.calibration_map(F.lit(2), "1:2,2:3")) == (2.0, 0.75, 3)
    assert str(one(spark, "Mon, 05 Feb 2024 10:00:00 +0200", N.parse_timestamp(X))) == "2024-02-05 08:00:00"
    assert one(spark, "nonsense", N.parse_timestamp(X)) is None and str(one(spark, "2024-03", N.partial_date(X))) == "2024-03-01"
    assert one(spark, [0.0, 0.0], N.cosine(X, X)) == 0.0 and one(spark, [3.0, 4.0], N.unit(X)) == pytest.approx([0.6, 0.8])
    lo, hi = one(spark, 1, *N.wilson(F.lit(8), F.lit(10)))
    assert (round(lo, 4), round(hi, 4)) == (0.4902, 0.9433)


def test_upsert_prefers_long_texts_and_trusted_dates(spark):
    schema = "url_hash string, title string, body string, published_at date, published_source string, arrived timestamp"
    d = lambda i: datetime(2024, 1, i)
    old = spark.createDataFrame([("a", "old", "long body", d(5).date(), "url", d(1)), ("b", "only", None, None, None, d(1))], schema)
    new = spark.createDataFrame([("a", "new", "short", d(3).date(), "api", d(2)), ("a", "late", "also long", d(1).date(), "other", d(3))], schema)
    got = {r.url_hash: r for r in relational.upsert_documents(old, new).collect()}
    assert (got["a"].title, got["a"].body, str(got["a"].published_at), got["a"].versions) == ("old", "long body", "2024-01-03", 3)
    assert got["b"].title == "only" and got["b"].published_at is None


def test_keys_links_and_dedup(spark):
    store = spark.createDataFrame([(1, "d1", "u1"), (2, None, "u2")], "id int, doi string, url string")
    rows = spark.createDataFrame([("d1", "u2"), (None, "u2"), ("d9", "u9"), (None, None)], "doi string, url string")
    assert [r.id for r in relational.resolve_two_keys(rows, store, "doi", "url", "id").collect()].count(None) == 2
    assert relational.insert_absent(store, store.unionByName(store.withColumn("id", F.col("id") + 5)), ["id"]).count() == 4
    docs = spark.createDataFrame([(1, "h", None), (2, "h", "x"), (3, "g", "x"), (4, None, "x"), (5, None, None)], "id int, a string, b string")
    kept = relational.exact_dedup(docs, ["a", "b"], [F.col("id").asc()])
    assert sorted(r.id for r in kept.collect()) == [1, 3, 5]
    token = spark.range(1).select(relational.page_token(F.lit(7), F.lit("abc")).alias("t"))
    assert token.select(relational.read_page_token(F.col("t"))).first()[0] == ["7", "abc"]


def test_rules_in_order(spark):
    base = {"emb_sim_query": 0.9, "wiki_exists": 0.0, "wiki_pageviews_30d_log": 0.0, "wiki_age_years": 0.0, "stage_lex_ordinal": 0.0, "bigtech_mentions_count": 0.0, "share_code_vacancy": 0.0, "lex_maturity_score": 0.0, "lex_emergence_score": 0.0, "lex_hype_score": 0.0, "share_marketing": 0.0, "share_scientific": 1.0, "trusted_share": 1.0, "mature_field": False, "n_documents": 3, "n_low": 0, "n_high": 1, "score": 0.9}
    cases = [
        ({}, ("WEAK_SIGNAL", "MODEL", None)),
        ({"emb_sim_query": 0.1, "lex_maturity_score": 0.9}, ("OFF_TOPIC", "LOW_QUERY_RELEVANCE", None)),
        ({"lex_maturity_score": 0.9, "n_documents": 1, "n_high": 0}, ("MATURE", "MATURITY_LEXICON", "SINGLE_SOURCE")),
        ({"n_documents": 2, "n_low": 2, "n_high": 0}, ("INSUFFICIENT_EVIDENCE", "NO_TRUSTED_SOURCE", None)),
        ({"n_documents": 0, "n_high": 0}, ("WEAK_SIGNAL", "MODEL", None)),
        ({"share_marketing": 0.7, "share_scientific": 0.0}, ("HYPE_OR_NOISE", "MARKETING_DOMINANT", None)),
        ({"lex_hype_score": 0.6, "trusted_share": 0.1}, ("HYPE_OR_NOISE", "HYPE_LEXICON", None)),
        ({"wiki_exists": 1.0, "wiki_pageviews_30d_log": 10.4, "wiki_age_years": 4.0}, ("MATURE", "ENCYCLOPEDIA_MATURE", None)),
        ({"score": 0.1, "lex_hype_score": 0.35}, ("HYPE_OR_NOISE", "MODEL", None)),
    ]
    rows = spark.createDataFrame([{**base, **c, "i": i} for i, (c, _) in enumerate(cases)])
    got = {r.i: (r.decision, r.reason, r.note) for r in rules.decide(rows, "score").collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}
    assert rules.Thresholds().with_values({"hype_min": 0.9, "other": 1}).hype_min == 0.9


def test_floor_guards(spark):
    rows = spark.createDataFrame([("few", float(i)) for i in range(4)] + [("flat", 1.0)] * 9 + [("ok", float(i)) for i in range(9)] + [("ok", -99.0)], "g string, v double")
    floors = {r.g: r.floor for r in rules.mad_floor(rows, "v", "g").collect()}
    assert floors["few"] is None and floors["flat"] is None and floors["ok"] < 0
    assert rules.above_floor(rows, "v", "g").count() == rows.count() - 1


def test_metrics_on_one_class_and_ties(spark):
    r = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert metrics.auc(r, "y", "s").first().auc is None and metrics.kappa(r, "y", "y").first().kappa is None
    t = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert metrics.auc(t, "y", "s").first().auc == 0.5
    c = metrics.confusion(t, F.col("y") == 1, F.col("s") > 0.9).first()
    assert (c.tp, c.fn, c.precision, c.recall) == (0, 1, None, 0.0)


def test_mining_and_features(spark):
    d = spark.createDataFrame([(1, "a", "Solid state cells: new hope"), (2, "b", "Solid state cells"), (3, "b", None)], "id int, src string, title string")
    p = mining.phrase_table(d, "id", "src", F.col("title"))
    got = {r.phrase: (r.docs, r.sources) for r in mining.mine(p, "id", "src", 3, max_share=1.0).collect()}
    assert got == {"solid state": (2, 2), "state cells": (2, 2)}
    assert mining.two_period_growth(p, "phrase", F.lit(True), F.lit(False), min_base_total=5, per=F.col("id")).count() == 0
    assert {r.phrase for r in mining.keyphrases(d, "src", F.col("title")).where("pos = 1").collect()}
    docs = spark.createDataFrame([("g", "PREPRINT", 3, datetime(2024, 1, 1), 3), ("g", "BLOG", 1, None, None)], "g string, type string, trust int, published_at timestamp, citations int")
    f = features.collection_features(docs, "g", datetime(2024, 2, 1)).first()
    assert f.share_scientific == 0.5 and f.growth_ratio_12m == 2.0 and f.recency_median_days == 31.0
    wide = features.as_columns(features.as_rows(spark.createDataFrame([(1, 2.0, 3.0)], "k int, a double, b double"), "k", ["a", "b"]), "k", ["a", "b"])
    assert tuple(wide.first()) == (1, 2.0, 3.0)
    hits = spark.createDataFrame([(1, True, -1, None), (1, True, 99, datetime(2020, 2, 1))], "k int, exists boolean, pageviews int, created_at timestamp")
    w = features.encyclopedia_features(spark.createDataFrame([(1,), (2,)], "k int"), hits, "k", datetime(2024, 2, 1)).orderBy("k").collect()
    assert w[0].wiki_exists == 1.0 and round(w[0].wiki_age_years, 1) == 4.0 and w[1].wiki_exists == 0.0


def test_glue_and_components(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0], True), (1, 2, [0.0, 1.0], True), (1, 3, [1.0, 0.1], False)], "c int, k int, v array<double>, media boolean")
    assert {r.k: r.part for r in vectors.split_glue(v, "c", "k", "v", "media").collect()} == {1: 0, 2: 1, 3: 0}
    e = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert {r.component for r in vectors.components(e).collect()} == {0}
    assert vectors.centred(v, "v").agg(F.sum(F.element_at("v", 1))).first()[0] == pytest.approx(0)


def test_formats(spark):
    rss = "<?xml version='1.0'?><rss><channel><item><title><![CDATA[A &amp; <b>b</b>]]></title><link>http://x/1</link><pubDate>Mon, 05 Feb 2024 10:00:00 +0000</pubDate></item></channel></rss>"
    atom = '<feed xmlns="x"><entry><title>T</title><link href="http://x/2"/><updated>2024-02-05T10:00:00Z</updated></entry></feed>'
    f = formats.feed_entries(spark.createDataFrame([(rss,), (atom,), ("<html></html>",)], "body string"), "body").orderBy("url").collect()
    assert [(r.format, r.url, str(r.published)) for r in f] == [("rss2", "http://x/1", "2024-02-05 10:00:00"), ("atom", "http://x/2", "2024-02-05 10:00:00")]
    page = '<html><head><title>T</title><meta property="og:title" content="OG"><link rel="alternate" type="application/rss+xml" href="/feed"></head><p>' + "w " * 40 + "</p><p>short</p>"
    assert one(spark, page, formats.article(X)["title"], F.size(formats.article(X)["paragraphs"]), formats.feed_links(X, F.lit("https://s.org/a"))) == ("OG", 1, ["https://s.org/feed"])
    assert one(spark, "x", formats.inverted_text(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))))) == "a b a"
    maps = formats.sitemap_entries(spark.createDataFrame([("<urlset><url><loc>http://x</loc><lastmod>2024-01-02</lastmod></url></urlset>",)], "b string"), "b").first()
    assert (maps.loc, str(maps.lastmod), maps.is_index) == ("http://x", "2024-01-02", False)
    cdx = formats.cdx_entries(spark.createDataFrame([("k 20240102030405 http://a.b/new-solid-cells text/html 200 D",), ("k 20240102030405 http://a.b/x.png image/png 200 D",)], "l string"), "l").collect()
    assert [r.title for r in cdx] == ["new solid cells"]
    raw = spark.createDataFrame([("http://a.b/c", "T", "<p>b</p>"), ("nope", "T", ""), ("http://a.b/d", " ", "")], "url string, title string, body string")
    raw = raw.select("url", "title", "body", *[F.lit(None).cast("string").alias(c) for c in formats.DOCUMENT[3:]])
    kept, bad = formats.normalise(raw)
    assert kept.first().body == "b" and sorted(r.reason for r in bad.collect()) == ["EMPTY_TITLE", "INVALID_URL"]


def test_files(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b,\n\"c")], "id int, t string")
    formats.write_json(d, f"{tmp_path}/j")
    assert formats.read_json(spark, f"{tmp_path}/j", "id int, t string").orderBy("id").collect() == d.orderBy("id").collect()
    (tmp_path / "x.csv").write_text('id,t\n1,a\n2,"b,\n""c"\n')
    assert formats.read_text_table(spark, f"{tmp_path}/x.csv", "id int, t string").orderBy("id").collect() == d.orderBy("id").collect()
    (tmp_path / "r").mkdir()
    (tmp_path / "r/one.txt").write_text("== topic A ==\nwall: 12\nname: x: y\n== topic B ==\nwall: 3\n")
    got = [(r.topic, r.key, r.value) for r in formats.report_rows(spark, f"{tmp_path}/r").orderBy("topic", "pos").collect()]
    assert got == [("topic A", "wall", "12"), ("topic A", "name", "x: y"), ("topic B", "wall", "3")]
    formats.write_partition(d.withColumn("p", F.col("id")), f"{tmp_path}/p", "p")
    formats.write_partition(d.where("id = 1").withColumn("t", F.lit("z")).withColumn("p", F.col("id")), f"{tmp_path}/p", "p")
    assert {r.t for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {"z", 'b,\n"c'}


def test_recorded_source(spark, tmp_path):
    import json

    from tidemark.sources.recorded import RecordedSource

    p = tmp_path / "works" / "solid cells"
    p.mkdir(parents=True)
    (p / "1.json").write_text(json.dumps({"items": [{"url": "u1", "title": "t", "published": "2024-01-01"}, {"url": "u2", "published": "2010-01-01"}, {"url": "u3"}]}))
    spark.dataSource.register(RecordedSource)
    got = spark.read.format("recorded").option("path", f"file://{tmp_path}").option("since", "2020").load().orderBy("url").collect()
    assert [(r.url, r.source, r.phrase) for r in got] == [("u1", "works", "solid cells"), ("u3", "works", "solid cells")]
