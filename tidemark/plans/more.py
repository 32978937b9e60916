"""More registered queries: selections, set operations, windows of time, learning."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import text as T
from tidemark.operators import learning, mining, ranges, relational, selection, vectors
from tidemark.operators.ranges import running
from tidemark.plans.store import cut
from tidemark.session import table

from .catalogue import COS, NORM, query


@query("""WITH x AS (SELECT source AS g, doc_id AS k, n_chars AS s, lang = 'de' AS t FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, k) AS r FROM x),
f AS (SELECT *, min(r) FILTER (t) OVER (PARTITION BY g) AS f FROM r), kept AS (SELECT * FROM f WHERE CASE WHEN f > 3 THEN r <= 2 OR r = f ELSE r <= 3 END)
SELECT g AS source, k AS doc_id, row_number() OVER (PARTITION BY g ORDER BY s DESC, k) AS pos FROM kept""")
def evidence_topk(spark, d):
    return selection.evidence(table(spark, d, "documents"), "source", "doc_id", "n_chars", F.col("lang") == "de", 3)


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def singleton_picker(spark, d):
    return selection.singletons(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 50, 40).select("doc_id")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= ceil(count(*) OVER (PARTITION BY source) * 0.3 - 1e-9) AS preferred FROM documents")
def top_share(spark, d):
    return selection.top_share(table(spark, d, "documents"), "source", "n_chars", "doc_id", 0.3).select("doc_id", "preferred")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def group_representative(spark, d):
    o = table(spark, d, "orders")
    return selection.representative(o, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderdate"])


@query("SELECT o_custkey, substr(sha256(string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR)), 1, 32) AS id FROM orders GROUP BY o_custkey")
def stable_ids(spark, d):
    """A name of each customer's orders: the members of one cluster are few."""
    return selection.stable_ids(table(spark, d, "orders"), "o_custkey", "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS current FROM orders")
def upsert_history(spark, d):
    return selection.history(table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_orderkey", "version", "current")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '1998-08-01' - 400")
def cache_ttl(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return selection.fresh(o, "day", F.lit(date(1998, 8, 1)), 400).select("o_orderkey")


@query("""WITH e AS (SELECT min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders), w AS (SELECT unnest(range(greatest(ceil((last - first) / 90), 1)::BIGINT)) AS i, first, last FROM e),
s AS (SELECT greatest(last - (i * 90 + 90)::INT, first) AS start, last - (i * 90)::INT AS stop, first FROM w)
SELECT start, stop, (SELECT count(*) FROM orders WHERE (o_orderdate::DATE > start OR (start = first AND o_orderdate::DATE = first)) AND o_orderdate::DATE <= stop) AS n FROM s""")
def history_windows(spark, d):
    """Windows of ninety days back from the last order, with their orders."""
    return selection.history_windows(table(spark, d, "orders"), "o_orderdate")


@query("""WITH m AS (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m FROM orders)
SELECT strftime(m, '%Y-%m') AS month, (SELECT count(*) FROM orders WHERE strftime(o_orderdate, '%Y-%m') = strftime(m, '%Y-%m')) AS n FROM m""")
def month_enumeration(spark, d):
    """Every month between the first and the last order, with its orders."""
    return selection.months(table(spark, d, "orders"), "o_orderdate")


@query("SELECT lower(c_mktsegment) || ':' || c_nationkey AS name, count(*) AS n, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM customer GROUP BY 1 HAVING n > 1")
def name_duplicates(spark, d):
    c = table(spark, d, "customer")
    return selection.duplicates_by_name(c, F.concat_ws(":", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")), "c_custkey")


@query("""SELECT doc_id, coalesce(toxic, quality, 0) AS label, CASE WHEN toxic IS NOT NULL THEN 'expert' WHEN quality IS NOT NULL THEN 'silver' ELSE 'default' END AS label_source
FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE doc_id % 2 = 0) USING (doc_id) LEFT JOIN (SELECT doc_id, quality FROM labels WHERE doc_id % 3 = 0) USING (doc_id)""")
def label_precedence(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id")
    levels = [("expert", labels.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("label"))), ("silver", labels.where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("label"))), ("default", docs.select("doc_id", F.lit(0).alias("label")))]
    return selection.label_precedence(docs, levels, "doc_id").select("doc_id", "label", "label_source")


@query("SELECT doc_id, round(count(*) OVER () / ((SELECT count(DISTINCT toxic) FROM labels) * count(*) OVER (PARTITION BY toxic)), 6) AS weight FROM labels")
def class_weights(spark, d):
    return selection.class_weights(table(spark, d, "labels"), "toxic").select("doc_id", F.round("weight", 6).alias("weight"))


@query("""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq + (l_tax - mt) / st, 6) AS hybrid FROM lineitem, s""")
def zscore_hybrid(spark, d):
    z = selection.standardised(table(spark, d, "lineitem"), ["l_quantity", "l_tax"])
    return z.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity_z") + F.col("l_tax_z"), 6).alias("hybrid"))


@query("""WITH x AS (SELECT d.doc_id, n_chars / 1000.0 AS v, toxic FROM documents d JOIN labels USING (doc_id)), g AS (SELECT i, i * 0.25 AS t FROM range(41) r(i))
SELECT round(t, 6)::DOUBLE AS threshold, count(v) FILTER (floor(v / 0.25 + 1e-9) >= i) AS removed, coalesce(sum(toxic) FILTER (floor(v / 0.25 + 1e-9) >= i), 0)::BIGINT AS lost FROM g, x GROUP BY i, t""")
def rule_grid(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("v", F.col("n_chars") / 1000.0)
    return selection.grid(x, "v", "toxic", 0.0, 10.0, 0.25)


@query("""WITH x AS (SELECT *, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS b FROM labels), r AS (SELECT *, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' WHEN b THEN 'only_b' END AS region FROM x)
SELECT region, count(quality) AS n, count(*) FILTER (quality = 1) AS hits, round(count(*) FILTER (quality = 1) / count(quality), 6) AS precision FROM r WHERE region IS NOT NULL GROUP BY region""")
def precision_by_region(spark, d):
    out = selection.precision_by_region(table(spark, d, "labels"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.col("quality") == 1)
    return out.withColumn("precision", F.round("precision", 6))


STAGES = [("collected", "text IS NOT NULL"), ("long", "n_chars >= 400"), ("english", "lang = 'en'"), ("trusted", "source <> 'src0'")]


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'collected' WHEN n_chars < 400 THEN 'long' WHEN lang <> 'en' THEN 'english' WHEN source = 'src0' THEN 'trusted' END AS lost_at FROM documents")
def first_loss(spark, d):
    return selection.first_loss(table(spark, d, "documents"), "doc_id", [(n, F.expr(e)) for n, e in STAGES])


@query("""WITH c AS (SELECT count(*) AS n0, count(*) FILTER (text IS NOT NULL) AS n1, count(*) FILTER (text IS NOT NULL AND n_chars >= 400) AS n2, count(*) FILTER (text IS NOT NULL AND n_chars >= 400 AND lang = 'en') AS n3,
 count(*) FILTER (text IS NOT NULL AND n_chars >= 400 AND lang = 'en' AND source <> 'src0') AS n4 FROM documents)
SELECT 'collected' AS stage, 1 AS pos, n1 AS kept, n0 - n1 AS dropped FROM c UNION ALL SELECT 'long', 2, n2, n1 - n2 FROM c UNION ALL SELECT 'english', 3, n3, n2 - n3 FROM c UNION ALL SELECT 'trusted', 4, n4, n3 - n4 FROM c""")
def stage_funnel(spark, d):
    return selection.funnel(table(spark, d, "documents"), [(n, F.expr(e)) for n, e in STAGES])


@query(f"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(' ' || replace({NORM}, ' ', '  ') || ' ', '( (a|an|the|and|or|of|in|on|at|to|for|with|by|from|as|is|are|was|were|be|it|its|this|that|not) )+'),
  lambda s: regexp_replace(trim(s), ' +', ' ', 'g')), lambda s: s <> '') AS segments FROM documents""")
def query_segments(spark, d):
    w = F.split(T.normalize("text"), " ")
    return table(spark, d, "documents").select("doc_id", selection.segments(w, T.STOP_WORDS).alias("segments"))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return a.union(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
def except_keys(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return a.exceptAll(table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("k")).distinct())


@query("SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return a.intersect(table(spark, d, "orders").select("o_custkey"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+')) AS w FROM documents)
SELECT doc_id, list_sort(list_intersect(w, ['the', 'of', 'les', 'der'])) AS matched, len(list_distinct(list_concat(w, ['zz', 'the']))) AS together FROM t""")
def array_set_operations(spark, d):
    docs = table(spark, d, "documents").withColumn("w", F.array_distinct(T.tokens("text")))
    probe = F.array(*map(F.lit, ("the", "of", "les", "der")))
    return docs.select("doc_id", F.array_sort(F.array_intersect("w", probe)).alias("matched"), F.size(F.array_union("w", F.array(F.lit("zz"), F.lit("the")))).cast("long").alias("together"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+')) AS w FROM documents), x AS (SELECT doc_id, unnest(list_intersect(w, ['the', 'of', 'les', 'der', 'from', 'que'])) AS word FROM t),
f AS (SELECT word, count(*) AS df FROM x GROUP BY word), s AS (SELECT doc_id, count(*) AS matched, sum(ln(((SELECT count(*) FROM documents) + 1) / (df + 0.5))) AS score FROM x JOIN f USING (word) GROUP BY doc_id)
SELECT doc_id, matched, round(score, 6) AS score FROM s WHERE matched >= 2 ORDER BY round(score, 9) DESC, doc_id LIMIT 25""")
def idf_event_ranking(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(T.tokens("text")).alias("tokens"))
    return mining.idf_ranking(docs, "doc_id", "tokens", ["the", "of", "les", "der", "from", "que"], 2, 25).withColumn("score", F.round("score", 6))


@query(f"""WITH m AS (SELECT i, avg(x) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY i), c AS (SELECT list(x ORDER BY i) AS m FROM m),
v AS (SELECT vec_id, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE - m[i]) AS e FROM embeddings, c), q AS (SELECT e FROM v WHERE vec_id = 0)
SELECT a.vec_id, round({COS}, 4) AS relevance FROM v a, q b""")
def phrase_relevance(spark, d):
    """Cosine of each centred vector to the centred vector 0, which stands for the query."""
    e = vectors.centred(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q)).select("vec_id", F.round(N.cosine(F.col("embedding"), F.col("q")), 4).alias("relevance"))


@query("SELECT floor((quantile_cont(p, 0.05) - 0.02) * 100) / 100 AS floor, count(*) AS n FROM (SELECT l_discount + l_tax AS p FROM lineitem)")
def similarity_floor(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_discount") + F.col("l_tax")).alias("p"))
    low = ranges.quantiles(p, F.col("p"), {"q": 0.05})
    return low.crossJoin(p.agg(F.count("*").alias("n"))).select((F.floor((F.col("q") - 0.02) * 100) / 100).alias("floor"), "n")


@query("SELECT l_returnflag, l_linestatus, max(CASE WHEN m = 'AIR' THEN n END) AS air FROM (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber % 2 = 0 THEN 'AIR' ELSE 'SEA' END AS m, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL")
def tally_pivot(spark, d):
    li = table(spark, d, "lineitem").withColumn("m", F.when(F.col("l_linenumber") % 2 == 0, "AIR").otherwise("SEA"))
    return li.groupBy("l_returnflag", "l_linestatus").pivot("m", ["AIR"]).count().withColumnRenamed("AIR", "air")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    from tidemark.streaming import documents

    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return documents.tumbling(e, "event_type", "ts").select("event_type", F.col("start").cast("timestamp_ntz").alias("day"), "n")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed|' || doc_id), doc_id) <= ceil(count(*) OVER (PARTITION BY lang) * 0.2 - 1e-9) AS holdout FROM documents")
def hash_holdout(spark, d):
    docs = table(spark, d, "documents").withColumn("coin", F.sha2(F.concat(F.lit("seed|"), F.col("doc_id").cast("string")), 256))
    n = docs.groupBy(F.col("lang").alias("of_lang")).count()
    ranked = running(docs.select("doc_id", "lang", "coin"), [F.col("coin"), F.col("doc_id")], {"pos": F.lit(1)}, ["lang"])
    return ranked.join(n, F.col("lang").eqNullSafe(F.col("of_lang"))).select("doc_id", (F.col("pos") <= F.ceil(F.col("count") * 0.2 - 1e-9)).alias("holdout"))


def _labelled(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    tokens = F.size(T.tokens("text"))
    return docs.select("doc_id", F.col("toxic").cast("double").alias("y"), (F.col("n_chars") / 1000.0).alias("f1"), (F.col("n_chars") / F.greatest(tokens, F.lit(1))).alias("f2"), T.term_coverage(("the", "of", "and", "for"), "text").alias("f3"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("fold"), "text")


@query()
def train_linear_cv(spark, d):
    """Out-of-fold probabilities of an elastic-net model of toxic, three folds by hash."""
    return learning.cross_validated(_labelled(spark, d), "doc_id", ["f1", "f2", "f3"], "y", "fold").select("doc_id", "y", F.round("p", 6).alias("p"))


@query()
def train_text_baseline(spark, d):
    """Out-of-fold probabilities of a TF-IDF word model, three folds by hash."""
    # texts are split and hashed once, not by each pass of each fit
    rows = cut(learning.hashed_words(_labelled(spark, d).select("doc_id", "y", T.empty_if_null("text").alias("text"), "fold"), "text", 2048).drop("text"))
    out = None
    for f in range(3):
        model = learning.fit_hashed(rows.where(F.col("fold") != f), "y")
        part = learning.predict(model, rows.where(F.col("fold") == f), ["doc_id", "y"])
        out = part if out is None else out.unionByName(part)
    return out.withColumn("p", F.round("p", 6))


@query()
def emb_components(spark, d):
    """Projections of the vectors on their four main axes."""
    return learning.principal_components(table(spark, d, "embeddings"), "vec_id", "embedding", 4).select("vec_id", F.transform("components", lambda x: F.round(x, 5)).alias("components"))


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, string_agg(role, ',' ORDER BY turn) AS flow FROM conversations GROUP BY conv_id")
def conversation_flow(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("f"))
    return c.select("conv_id", "turns", "roles", F.array_join(F.transform("f", lambda x: x["role"]), ",").alias("flow"))


@query("""WITH g AS (SELECT l_suppkey AS s, l_partkey % 10 AS p FROM lineitem) SELECT s, count(DISTINCT p) AS values, count(*) AS n, count(DISTINCT p) = 1 AS determines FROM g GROUP BY s""")
def origin_confound(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 10).alias("p"))
    return li.groupBy("s").agg(F.count_distinct("p").alias("values"), F.count("*").alias("n")).withColumn("determines", F.col("values") == 1)


@query("SELECT a.o_orderkey, a.o_orderstatus, count(*) AS same_day FROM orders a JOIN orders b ON a.o_orderdate = b.o_orderdate AND a.o_orderpriority = b.o_orderpriority GROUP BY ALL")
def identity_join(spark, d):
    o = table(spark, d, "orders")
    n = o.groupBy(F.col("o_orderdate").alias("d"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("same_day"))
    return o.join(n, (F.col("o_orderdate") == F.col("d")) & (F.col("o_orderpriority") == F.col("p"))).select("o_orderkey", "o_orderstatus", "same_day")


@query("SELECT o_orderkey, coalesce(a.k, b.k) AS k FROM orders LEFT JOIN (SELECT o_orderdate AS d, min(c_custkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 9000 GROUP BY 1) a ON a.d = o_orderdate LEFT JOIN (SELECT o_orderpriority AS p, min(o_custkey) AS k FROM orders GROUP BY 1) b ON b.p = o_orderpriority")
def doi_first_match(spark, d):
    """Two-key resolution: by date among rich customers, else by priority."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 9000")
    rich = o.join(c, o.o_custkey == c.c_custkey).select("o_orderdate", F.lit(None).cast("string").alias("o_orderpriority"), F.col("o_custkey").alias("k"))
    low = o.select(F.lit(None).cast("timestamp").alias("o_orderdate"), "o_orderpriority", F.col("o_custkey").alias("k"))
    rows = o.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderpriority")
    store = rich.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).unionByName(low)
    return relational.resolve_two_keys(rows, store, "o_orderdate", "o_orderpriority", "k").select("o_orderkey", "k")


@query("SELECT c_custkey FROM customer UNION ALL SELECT max_key + n FROM (SELECT max(c_custkey) AS max_key FROM customer), range(1, 4) r(n)")
def idempotent_insert(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    new = c.agg(F.max("c_custkey").alias("m")).select(F.explode(F.sequence(F.col("m") - 2, F.col("m") + 3)).alias("c_custkey"))
    return relational.insert_absent(c, new, ["c_custkey"])
