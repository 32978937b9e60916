"""Registered queries of verdicts, completions, merges and rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import mining
from tidemark.operators import verdicts as V
from tidemark.session import table

from .catalogue import NORM, query

CODE = "CASE doc_id % 6 WHEN 0 THEN 'R' WHEN 1 THEN 'N-MAT' WHEN 2 THEN 'N-HYP' WHEN 3 THEN 'N-MAT' WHEN 4 THEN 'U' ELSE 'N-MAT' END"


@query("""WITH d AS (SELECT o_custkey, count(*) AS orders, sum((o_orderstatus = 'F')::INT) AS done FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY o_custkey),
c AS (SELECT c_custkey AS o_custkey, 10 AS orders, c_nationkey AS done FROM customer) SELECT o_custkey, sum(orders)::BIGINT AS orders, sum(done)::BIGINT AS done FROM (SELECT * FROM c UNION ALL SELECT * FROM d) GROUP BY o_custkey""")
def counter_bumps(spark, d):
    """Counters of customers, raised by their later orders."""
    counters = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(10).cast("long").alias("orders"), F.col("c_nationkey").cast("long").alias("done"))
    deltas = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")).select("o_custkey", F.lit(1).cast("long").alias("orders"), (F.col("o_orderstatus") == "F").cast("long").alias("done"))
    return V.bump(counters, deltas, ["o_custkey"], ["orders", "done"])


@query(f"""WITH c AS (SELECT doc_id, doc_id % 4 = 0 AS market, {CODE} AS code, doc_id % 10 / 10 AS confidence, doc_id % 5 > 0 AS checked FROM documents)
SELECT doc_id, CASE WHEN NOT checked THEN 'UNCHECKED' WHEN code = 'N-MAT' AND (market OR confidence < 0.7) THEN 'KEPT' WHEN starts_with(code, 'N-') THEN 'DROPPED' ELSE 'PASSED' END AS outcome,
 CASE WHEN checked AND code = 'N-MAT' THEN CASE WHEN market THEN 'market sources' WHEN confidence < 0.7 THEN format('confidence {{:.2f}} < 0.70', confidence::DOUBLE) END END AS why FROM c""")
def final_check(spark, d):
    """Documents as cards under a last check."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4 == 0).alias("market"))
    verdicts = table(spark, d, "documents").where("doc_id % 5 > 0").selectExpr("doc_id", f"{CODE} AS code", "doc_id % 10 / 10 AS confidence")
    return V.final_check(docs, verdicts, "doc_id", "market").select("doc_id", "outcome", "why")


@query("SELECT doc_id, doc_id % 3 > 0 AND doc_id % 4 != 1 AND coalesce(n_chars / 3000 > 0.5, false) AS dropped FROM documents")
def maturity_drop(spark, d):
    """Cards that a maturity score drops: with sources, none of the market."""
    sources = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 4 == 1, F.array(F.lit("NEWS"), F.lit("PREPRINT"))).otherwise(F.array(F.lit("PREPRINT")))
    docs = table(spark, d, "documents").withColumn("score", F.col("n_chars") / 3000)
    return docs.select("doc_id", V.maturity_drop(docs, "score", 0.5, sources, ("NEWS", "PRESS_RELEASE")).alias("dropped"))


@query("""WITH w AS (SELECT doc_id, n_chars AS rank, CASE WHEN doc_id % 3 > 0 THEN CASE doc_id % 4 WHEN 0 THEN 'MATURE' ELSE 'WEAK' END END AS verdict, CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 END AS relevance FROM documents),
k AS (SELECT *, coalesce(verdict = 'MATURE' OR relevance <= 0, false) AS rejected FROM w)
SELECT doc_id, rejected, CASE WHEN NOT rejected THEN row_number() OVER (PARTITION BY rejected ORDER BY verdict IS NULL, -coalesce(relevance, 0), rank NULLS LAST, doc_id) END AS pos FROM k QUALIFY coalesce(pos, 0) <= 50""")
def judgement(spark, d):
    """Candidates after a judge: the rejected ones, and the fifty first of the rest."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("rank"))
    verdicts = table(spark, d, "documents").where("doc_id % 3 > 0").selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN 'MATURE' ELSE 'WEAK' END AS verdict", "doc_id % 5 AS relevance")
    out = V.apply_judgement(docs, verdicts, "doc_id", "rank")
    from pyspark.sql import Window

    order = ["o1", "o2", F.col("o3").asc_nulls_last(), "doc_id"]
    first = out.where("NOT rejected").orderBy(*order).limit(50)
    first = first.select("doc_id", "rejected", F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"))
    return first.unionByName(out.where("rejected").select("doc_id", "rejected", F.lit(None).cast("long").alias("pos")))


@query("SELECT o_orderkey, c_name, o_orderstatus, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def jobs_with_queries(spark, d):
    """Customers as queries with their orders as jobs, those without one too."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "o_orderstatus", "o_totalprice")


@query(f"""WITH t AS (SELECT source, {NORM.replace("coalesce(text, '')", "split_part(coalesce(text, ''), chr(10), 1)")} AS title, doc_id FROM documents), c AS (SELECT source, title, min(doc_id) AS card FROM t GROUP BY ALL)
SELECT doc_id, card FROM t JOIN c USING (source, title) JOIN labels USING (doc_id)""")
def verdict_cards(spark, d):
    """Labels as verdicts on the first document of their source with the same normalised title."""
    from tidemark.functions import text as T

    docs = table(spark, d, "documents").select("doc_id", "source", T.normalize(mining.title_of(F.col("text"))).alias("title"))
    cards = docs.groupBy(F.col("source").alias("s"), F.col("title").alias("t")).agg(F.min("doc_id").alias("card"))
    said = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return said.join(cards, (F.col("source") == F.col("s")) & (F.col("title") == F.col("t"))).select("doc_id", "card")


@query("""WITH t AS (SELECT source, doc_id, trim(regexp_replace(split_part(coalesce(text, ''), '.', 1), '\\s+', ' ', 'g')) AS term FROM documents), k AS (SELECT * FROM t WHERE length(term) BETWEEN 2 AND 80),
f AS (SELECT source, min((doc_id, term)) AS f FROM k GROUP BY source, lower(term))
SELECT source, f[2] AS term, row_number() OVER (PARTITION BY source ORDER BY NOT contains(f[2], ' '), length(f[2]), f[1], f[2]) AS pos FROM f QUALIFY pos <= 8""")
def term_order(spark, d):
    """The first sentences of a source's documents as search terms, in order."""
    terms = table(spark, d, "documents").select("source", "doc_id", F.split_part(F.coalesce("text", F.lit("")), F.lit("."), F.lit(1)).alias("term"))
    return V.clean_terms(terms, "source", "term", "doc_id").withColumn("pos", F.col("pos").cast("long"))


@query()
def replay_keys(spark, d):
    """The name of every conversation as a request."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", V.replay_key(F.col("m"), F.when(F.col("conv_id") % 2 == 0, '{"type":"object"}'), F.lit(256), F.col("conv_id") % 3 / 10).alias("key"))


@query("""WITH j AS (SELECT o_orderkey, o_orderkey % 12 AS written, o_custkey % 3 AS fallbacks, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PARTIAL' ELSE 'FAILED' END AS collection, o_orderkey % 4 = 0 AS failed, o_orderkey % 10 = 0 AS deadline FROM orders),
m AS (SELECT *, fallbacks = 0 AND collection = 'COMPLETED' AND NOT failed AND NOT deadline AS complete FROM j)
SELECT o_orderkey, CASE WHEN complete THEN 'COMPLETED' ELSE 'PARTIAL' END AS status, CASE WHEN complete THEN '' ELSE 'PARTIAL:' || array_to_string(list_filter([CASE WHEN written < 10 THEN 'found=' || written || '<10' END, CASE WHEN fallbacks > 0 THEN 'fallback_narratives=' || fallbacks END,
 CASE WHEN failed THEN 'adapters_failed=news,rss' END, CASE WHEN collection != 'COMPLETED' THEN 'collection=' || collection END, CASE WHEN deadline THEN 'deadline_reached' END], lambda x: x IS NOT NULL), ';') END AS message FROM m""")
def job_completions(spark, d):
    """Orders as jobs: whether they are complete, and all that is missing."""
    k = F.col("o_orderkey")
    collection = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PARTIAL").otherwise("FAILED")
    failed = F.when(k % 4 == 0, F.array(F.lit("rss"), F.lit("news")))
    out = V.completion(k % 12, F.lit(10), F.col("o_custkey") % 3, collection, failed, k % 10 == 0)
    return table(spark, d, "orders").select("o_orderkey", out.alias("c")).select("o_orderkey", "c.*")


@query("""SELECT p_partkey, left('Rubric: on topic ' || CASE WHEN p_size > 10 THEN '✓' ELSE '✗' END || '; early ' || CASE WHEN p_partkey % 2 = 0 THEN '✓' ELSE '✗' END || '; stage ' || p_partkey % 4 + 1 || ', trend ' || p_size % 3 + 1 || ', ' || p_partkey % 4 + p_size % 3 + 2 || ' of 7; confidence ' || p_size * 2 || '%. ' || p_name, 500) AS said FROM part""")
def status_sentences(spark, d):
    """What a rubric said of each part."""
    marks = {"on topic": F.col("p_size") > 10, "early": F.col("p_partkey") % 2 == 0}
    return table(spark, d, "part").select("p_partkey", V.status_explanation(marks, (F.col("p_partkey") % 4 + 1).cast("int"), F.col("p_size") % 3 + 1, F.col("p_size") * 2 / 100, F.col("p_name")).alias("said"))


@query(f"""WITH a AS (SELECT source, doc_id, split_part(coalesce(text, ''), ' ', 1) AS term, trim(regexp_replace(lower(split_part(coalesce(text, ''), ' ', 1)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS n FROM documents WHERE source IS NOT NULL),
t AS (SELECT source, min_by(n, doc_id) AS t FROM a GROUP BY source), e AS (SELECT *, CASE WHEN length(n) < 3 THEN 'SHORT' WHEN n = t THEN 'TITLE' END AS early FROM a JOIN t USING (source))
SELECT source, doc_id, term, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY source, n, early IS NULL ORDER BY doc_id) > 1 THEN 'REPEAT' END) AS reason FROM e""")
def synonym_merge(spark, d):
    """First words of a source's documents as synonyms, with the reasons of those left out."""
    a = table(spark, d, "documents").where("source IS NOT NULL").select("source", "doc_id", F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1)).alias("term"))
    titles = a.groupBy("source").agg(F.min_by("term", "doc_id").alias("title"))
    return V.merge_synonyms(a, "source", "doc_id", "term", titles, "title")


@query("""SELECT substr(sha256(l_suppkey || '|' || l_partkey % 50 || '|' || l_orderkey % 20), 1, 16) AS pair_id, l_suppkey, (l_partkey % 50)::BIGINT AS expert, (l_orderkey % 20)::BIGINT AS thing, min(l_returnflag) AS rule
FROM lineitem WHERE l_returnflag != 'R' GROUP BY ALL""")
def review_sheet(spark, d):
    """Pairs that reviewers have to look at: all but those by one rule, once each."""
    rule = F.when(F.col("l_returnflag") == "R", "link").otherwise(F.col("l_returnflag")).alias("rule")
    hits = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("expert"), (F.col("l_orderkey") % 20).alias("thing"), rule)
    return V.review_pairs(hits, "l_suppkey", "expert", "thing", "rule")


RULES = "SELECT year, novelty FROM (SELECT unnest([1980, 1995, 2005, 2015]) AS year), (SELECT unnest([['A'], ['A', 'B'], ['C']]) AS novelty)"
CARDS = "SELECT p_partkey % 3 > 0 AS research_only, p_partkey % 5 > 0 AS established, 1970 + p_size AS since, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS novelty, CASE WHEN p_partkey % 4 = 0 THEN 'mature' WHEN p_partkey % 4 < 3 THEN 'weak' ELSE 'early' END AS verdict FROM part"
MATURE = f"""WITH c AS ({CARDS}), r AS ({RULES}),
e AS (SELECT r.year, r.novelty, count(*) FILTER (verdict = 'mature' AND hit) AS cut, count(*) FILTER (verdict = 'mature') AS n_mature, count(*) FILTER (verdict IN ('weak', 'early') AND hit) AS lost, count(*) FILTER (verdict IN ('weak', 'early')) AS n_weak
  FROM (SELECT *, research_only AND established AND since > 1900 AND since <= r.year AND list_contains(r.novelty, c.novelty) AS hit FROM c, r) r GROUP BY ALL)"""


def _maturity(spark, d):
    cards = table(spark, d, "part").selectExpr("p_partkey % 3 > 0 AS research_only", "p_partkey % 5 > 0 AS established", "1970 + p_size AS since", "CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS novelty", "CASE WHEN p_partkey % 4 = 0 THEN 'mature' WHEN p_partkey % 4 < 3 THEN 'weak' ELSE 'early' END AS verdict")
    rules = spark.createDataFrame([(y, n) for y in (1980, 1995, 2005, 2015) for n in (["A"], ["A", "B"], ["C"])], "year int, novelty array<string>")
    return V.maturity_rules(cards, rules, "verdict", "mature", ("weak", "early"))


@query(MATURE.replace("SELECT *, research_only", "SELECT c.verdict, r.year, r.novelty, research_only") + " SELECT year, array_to_string(novelty, ',') AS novelty, cut, n_mature, lost, n_weak FROM e")
def maturity_rules(spark, d):
    """What every rule on the age and novelty of parts cuts and loses."""
    return _maturity(spark, d).withColumn("novelty", F.array_join("novelty", ","))


@query(MATURE.replace("SELECT *, research_only", "SELECT c.verdict, r.year, r.novelty, research_only") + " SELECT year, array_to_string(novelty, ',') AS novelty, cut, lost FROM e WHERE n_weak = 0 OR lost <= 0.1 * n_weak ORDER BY cut DESC, lost, year, len(novelty) LIMIT 1")
def maturity_choice(spark, d):
    """The best of these rules."""
    return V.best_maturity_rule(_maturity(spark, d)).select("year", F.array_join("novelty", ",").alias("novelty"), "cut", "lost")


@query("""WITH s AS (SELECT source, count(*) AS n, avg(quality) AS good, max(toxic) AS worst FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, CASE WHEN n >= 40 AND coalesce(good >= 0.5, false) AND coalesce(worst = 0, false) THEN 'accept' ELSE 'reject' END AS decision,
 array_to_string(list_filter([CASE WHEN NOT n >= 40 THEN 'size' END, CASE WHEN NOT coalesce(good >= 0.5, false) THEN 'quality' END, CASE WHEN NOT coalesce(worst = 0, false) THEN 'toxicity' END], lambda x: x IS NOT NULL), ',') AS failed FROM s""")
def acceptance(spark, d):
    """Which sources pass all checks, and which they fail."""
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("good"), F.max("toxic").alias("worst"))
    g = V.gate({"size": F.col("n") >= 40, "quality": F.col("good") >= 0.5, "toxicity": F.col("worst") == 0})
    return s.select("source", g["decision"].alias("decision"), F.array_join(g["failed"], ",").alias("failed"))


@query("""SELECT p_partkey, CASE WHEN abs(p_size - 25) > abs(p_partkey % 50 - 10) OR (abs(p_size - 25) = abs(p_partkey % 50 - 10)) THEN 'a:1,b:2' ELSE 'b:1,a:2' END || ',c:3' AS predictors FROM part""")
def predictor_rows(spark, d):
    """A model's two contributions by size, then the feature that it doesn't know."""

    def f(name, value):
        return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), value.cast("double").alias("contribution"))

    own = F.array(f("a", F.col("p_size") - 25), f("b", F.col("p_partkey") % 50 - 10))
    rows = V.predictor_rows(own, F.array(f("b", F.lit(0)), f("c", F.lit(1))))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["name"], x["pos"].cast("string"))), ",").alias("predictors"))
