"""Registered queries of cards, title terms, stage sets and checks of training rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import cards as C
from tidemark.functions import numeric as N
from tidemark.functions import text as T
from tidemark.operators import cards, learning, metrics, selection
from tidemark.session import table
from tidemark.sources import records

from .catalogue import query
from .columns import STOPS, TERMS, TITLE, _docs, _title

# ---- terms of titles

STRIP = "' .,;:!?-–—''’`*'"


def _named(x):
    return rf"(regexp_matches({x}, '\p{{L}}') AND (regexp_matches({x}, '\p{{Nd}}') OR regexp_matches({x}, '(?s)^.+\p{{Lu}}')))"


def _key(x):
    return rf"""trim(regexp_replace(regexp_replace(lower({x}), '[«»"''“”„()\[\]]', ' ', 'g'), '\s+', ' ', 'g'))"""


def _is_term(x):
    words = f"regexp_split_to_array({x}, ' +')"
    latin = "list_filter(flatten(list_transform(regexp_extract_all(lower(w), '[a-z][a-z0-9]*(?:-[a-z0-9]+)*'), lambda q: string_split(q, '-'))), lambda q: length(q) >= 4)"
    return f"(len({words}) <= 8 AND length({x}) BETWEEN 2 AND 80 AND (len({words}) > 1 OR {_named(x)}) AND len(list_filter({words}, lambda w: {_named('w')} OR len({latin}) > 0 OR regexp_matches(w, '[А-Яа-яЁё]{{4,}}'))) > 0)"


def _unique(x):
    return f"list_transform(list_filter(list_transform({x}, lambda x, i: struct_pack(x := x, i := i)), lambda s: list_position(list_transform({x}, lambda y: {_key('y')}), {_key('s.x')}) = s.i), lambda s: s.x)"


@query(rf"""
WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT *, list_filter(string_split(regexp_replace(t, '[:;|?!()\[\]{{}}«»"“”„]|\s[-–—]\s|,\s|\.\s', ' ' || chr(1) || ' ', 'g'), ' '), lambda x: x <> '') AS words FROM t),
g AS (SELECT doc_id, t, list_filter(list_transform(string_split(array_to_string(list_transform(words, lambda x: CASE WHEN list_contains([{STOPS}], lower(trim(x, {STRIP}))) THEN chr(1) ELSE x END), ' '), chr(1)), lambda x: trim(x, {STRIP})), lambda x: {_is_term("x")}) AS runs,
 list_filter(list_transform(string_split(t, ' '), lambda x: trim(x, {STRIP[:-1]}()[]{{}}«»"“”„')), lambda x: NOT regexp_matches(x, '[()\[\]{{}}«»"“”„]') AND {_named("x")} AND {_is_term("x")}) AS single FROM w),
k AS (SELECT *, list_slice({_unique("runs")}, 1, 4) AS firsts FROM g), a AS (SELECT *, list_concat(firsts, list_concat(single, runs)) AS every FROM k)
SELECT doc_id, CASE WHEN regexp_matches(t, '^[\w.-]+/[\w.-]+$') THEN list_filter([trim(regexp_extract(t, '/([\w.-]+)$', 1), {STRIP})], lambda x: length(x) BETWEEN 2 AND 80) ELSE list_slice({_unique("every")}, 1, 6) END AS terms FROM a""")
def title_terms(spark, d):
    """Terms that the texts offer, word for word."""
    return _docs(spark, d).select("doc_id", C.title_terms("text").alias("terms"))


@query(f"""
SELECT doc_id, list_slice(list_transform(list_filter(list_transform(w, lambda x, i: struct_pack(x := x, i := i)), lambda s: list_position(w, s.x) = s.i), lambda s: s.x), 1, 120) AS words
FROM (SELECT doc_id, {TERMS.format(TITLE + " || ' ' || left(coalesce(text, ''), 1500)")} AS w FROM documents)""")
def token_reindex(spark, d):
    """Index words of title and the first 1500 characters of text, as the archive keeps them."""
    return _docs(spark, d).select("doc_id", T.terms(F.concat(_title(), F.lit(" "), F.left(T.empty_if_null("text"), F.lit(1500)))).alias("words"))


# ---- cards


def latin(c):
    """Cards are read in Latin script here."""
    return C.script_share(c)


def _evidence(spark, d):
    return _docs(spark, d).select("source", F.col("doc_id").alias("place"), _title().alias("title"), "text", F.concat_ws(".", "source", F.lit("example"), "lang").alias("domain"), F.pmod("doc_id", F.lit(3)).cast("int").alias("trust"), (F.col("lang") == "en").alias("own"))


FIRST_TWO = r"""(CASE WHEN len({s}) = 0 OR length({s}[1]) > {n} THEN rtrim(left({t}, {n})) WHEN len({s}) > 1 AND length({s}[1] || ' ' || {s}[2]) <= {n} THEN {s}[1] || ' ' || {s}[2] ELSE {s}[1] END)"""
SENTENCED = rf"""e AS (SELECT source, doc_id, {TITLE} AS title, coalesce(text, '') AS text, concat_ws('.', source, 'example', lang) AS domain, doc_id % 3 AS trust, coalesce(lang = 'en', false) AS own, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT *, list_filter(list_transform(regexp_extract_all(t, '[^.!?…]+[.!?…]?'), lambda x: trim(x)), lambda x: x <> '') AS s FROM e)"""


@query(rf"""
WITH {SENTENCED}, r AS (SELECT *, {FIRST_TWO.format(s="s", t="t", n=400)} AS piece, row_number() OVER (PARTITION BY source ORDER BY own DESC, trust DESC, doc_id) AS r FROM s),
p AS (SELECT source, string_agg(piece, ' ' ORDER BY r) FILTER (r <= 2 AND piece <> '') AS d, arg_max(title || ' (' || domain || ')', (trust, -doc_id)) AS c, count(*) AS n, count(*) FILTER (trust = 0) AS z FROM r GROUP BY source)
SELECT source, left(CASE WHEN source IS NULL THEN 'Untitled' WHEN len(regexp_extract_all(source, '[A-Za-z]')) < 0.5 * len(regexp_extract_all(source, '\p{{L}}')) THEN 'Technology: ' || source ELSE source END, 200) AS title, left(coalesce(d, ''), 800) AS description, left(c, 600) AS case_example,
 left(format('Score of the model {{:.2f}}. Features: {{}}. Drawn from the sources without a generative model.', (n % 100) / 100.0::DOUBLE, CASE WHEN n > z * 2 THEN format('documents = {{:.2f}} (raises), untrusted = {{:.2f}} (lowers)', n::DOUBLE, z::DOUBLE) ELSE format('untrusted = {{:.2f}} (lowers), documents = {{:.2f}} (raises)', z::DOUBLE, n::DOUBLE) END), 800) AS explanation FROM p""")
def fallback_cards(spark, d):
    """Cards of the sources, drawn from their documents."""
    e = _evidence(spark, d)
    n, z = F.col("n").cast("double"), F.col("z").cast("double")
    # contributions n and -2z: which is larger decides the order of the two features
    feature = lambda label, value, part: F.struct(F.lit(label).alias("label"), value.alias("value"), part.alias("contribution"))
    facts = e.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("trust") == 0).alias("z"))
    found = facts.select("source", F.col("source").alias("title"), (F.pmod("n", F.lit(100)) / 100.0).alias("score"), F.array(feature("Untrusted", z, -2 * z), feature("Documents", n, n), feature("Idle", F.lit(1.0), F.lit(0.0))).alias("features"))
    return cards.fallback_cards(found, e, "source", latin)


@query(rf"WITH {SENTENCED} SELECT source, doc_id AS place, CASE WHEN t = '' THEN left(title, 400) ELSE {FIRST_TWO.format(s='s', t='t', n=400)} END AS summary, CASE WHEN own THEN 'ORIGINAL' ELSE 'EXTRACTIVE' END AS kind FROM s")
def fallback_summaries(spark, d):
    """Summaries of all documents without a generative model."""
    return cards.fallback_summaries(_evidence(spark, d), "source")


FIELDS = {"title": 200, "description": 1200, "why": 800}


def card_inputs(spark, d):
    """Answers, sources and summaries of cards, each of seven documents in a row: answers choose some of
    their sources, quote words of one in the title and state the length of another."""
    docs = _docs(spark, d).withColumn("card", F.floor(F.col("doc_id") / 7)).withColumn("place", F.pmod("doc_id", F.lit(7)) + 1)
    k, t = F.col("card"), T.empty_if_null("text")
    words = F.split(T.collapse("text"), " ")
    sources = docs.select("card", "place", _title().alias("title"), F.concat_ws(" ", t, F.length(t).cast("string")).alias("text"), F.make_date(F.lit(2000) + F.pmod("doc_id", F.lit(25)).cast("int"), F.lit(1), F.lit(1)).alias("day"), (F.col("lang") == "en").alias("own"))
    second = docs.where("place = 2").select("card", words.alias("w"), F.length(t).alias("n"))
    first = docs.where("place = 1").select(k.alias("of"), t.alias("said"), words.alias("v"))
    both = second.join(first, F.col("card") == F.col("of"))
    number = F.when(k % 5 == 0, F.concat(F.lit(" 12345.5 "))).when(k % 5 == 1, F.concat(F.lit(" "), F.col("n").cast("string"), F.lit(" "))).otherwise(" H100 ")
    title = F.concat(F.array_join(F.slice("v", 1, 3), " "), F.when(k % 7 == 1, F.lit(" 777777 ")).otherwise(" "), F.lit("("), F.when(k % 6 == 0, "Zzqx Vvkj").otherwise(F.array_join(F.slice("w", 3, 2), " ")), F.lit(")"))
    chosen = F.when(k % 11 == 0, F.array(F.lit("d9"))).when(k % 2 == 0, F.array(F.lit("d2"), F.lit(" d1"), F.lit("d2"))).otherwise(F.array(F.lit("d2"), F.lit("d4"), F.lit("d7")))
    answers = both.select("card", title.alias("title"), F.concat(F.lit("It has parts. About"), number, F.lit("of them. "), F.left("said", F.lit(900)), F.lit(" [doc:1]")).alias("description"), F.when(k % 13 == 0, "").otherwise("Because of the sources it names.").alias("why"), chosen.alias("chosen"), F.lit("d2").alias("case"), F.array(F.get("w", F.lit(0)), F.lit(" Nobody  Inc "), F.get("v", F.lit(1))).alias("companies"))
    summaries = docs.where("doc_id % 17 > 0").select("card", F.concat(F.lit("d"), F.col("place").cast("string")).alias("label"), F.lit(1).alias("place"), F.left(t, F.lit(300)).alias("summary")).unionByName(docs.where("doc_id % 3 = 0").select("card", F.concat(F.lit("d"), F.col("place").cast("string")).alias("label"), F.lit(2).alias("place"), F.lit("In 99999 parts. The second one.").alias("summary")))
    return answers, sources, summaries


@query()
def card_acceptance(spark, d):
    """Answers on cards, checked against their sources."""
    out = cards.check_cards(*card_inputs(spark, d), "card", FIELDS, latin)
    told = F.array_join(F.transform("summaries", lambda s: F.concat_ws(":", s["place"].cast("string"), s["kind"], s["summary"])), "\n")
    return out.select("card", "accepted", "reason", "title", F.sha2("description", 256).alias("description_sha256"), F.array_join("companies", "; ").alias("companies"), "case_place", F.sha2(told, 256).alias("summaries_sha256"))


# ---- stages and experts


@query("""WITH o AS (SELECT d.doc_id, l.doc_id IS NULL AS relevant, e.vec_id IS NOT NULL AS clustered, b.item_id IS NOT NULL AS shown FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id) LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON e.vec_id = d.doc_id LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) b ON b.item_id = d.doc_id)
SELECT 'collected' AS stage, doc_id FROM o UNION ALL SELECT 'relevant', doc_id FROM o WHERE relevant UNION ALL SELECT 'clustered', doc_id FROM o WHERE relevant AND clustered UNION ALL SELECT 'shown', doc_id FROM o WHERE relevant AND clustered AND shown""")
def stage_sets(spark, d):
    """Documents that each stage still holds."""
    toxic = table(spark, d, "labels").where("toxic = 1")
    clustered = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    shown = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return selection.stage_sets(_docs(spark, d), "doc_id", [("collected", "all", None), ("relevant", "out", toxic), ("clustered", "in", clustered), ("shown", "in", shown)])


def _experts(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000")
    days = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("day"))
    experts = table(spark, d, "customer").join(days, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "day")
    hits = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderstatus") == "F", "url").otherwise("text").alias("rule"))
    return metrics.expert_recall(experts, hits, "c_custkey", "url", F.lit("1998-07-01").cast("timestamp"))


EXPERTS = """d AS (SELECT o_custkey, max(o_orderdate) AS day FROM orders GROUP BY 1), h AS (SELECT o_custkey, count(*) AS hits, bool_or(o_orderstatus = 'F') AS strong, list_sort(list_distinct(list(o_orderpriority))) AS sources, list_sort(list_distinct(list(CASE WHEN o_orderstatus = 'F' THEN 'url' ELSE 'text' END))) AS rules FROM orders WHERE o_totalprice > 100000 GROUP BY 1),
x AS (SELECT c_custkey, coalesce(hits, 0) AS hits, coalesce(strong, false) AS strong, coalesce(sources, []) AS sources, coalesce(rules, []) AS rules, CASE WHEN day IS NULL THEN 'no date' WHEN day >= TIMESTAMP '1998-07-01' THEN 'in window' ELSE 'before' END AS eligibility,
 CASE WHEN list_sum(list_transform(range(5), lambda i: ('0x' || substr(sha1(c_custkey::VARCHAR), (8 * i + 1)::BIGINT, 8))::BIGINT % 5)) % 5 = 0 THEN 'holdout' ELSE 'dev' END AS split
 FROM customer LEFT JOIN d ON d.o_custkey = c_custkey LEFT JOIN h ON h.o_custkey = c_custkey)"""


@query(f"WITH {EXPERTS} SELECT * FROM x")
def expert_recall(spark, d):
    """Customers as experts: which of their orders found them, by which rule, and when."""
    return _experts(spark, d)


@query(f"WITH {EXPERTS}, p AS (SELECT hits, 'all' AS kind, '' AS value FROM x UNION ALL SELECT hits, 'split', split FROM x UNION ALL SELECT hits, 'eligibility', eligibility FROM x UNION ALL SELECT hits, 'source', unnest(sources) FROM x) SELECT kind, value, count(*) FILTER (hits > 0) AS found, count(*) AS experts FROM p GROUP BY kind, value")
def expert_recall_totals(spark, d):
    return metrics.recall_totals(_experts(spark, d))


# ---- training rows


@query(r"""
WITH r AS (SELECT doc_id, toxic, coalesce(text, '') AS text FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1)),
m AS (SELECT toxic, length(text) AS n, row_number() OVER (PARTITION BY toxic ORDER BY length(text)) AS i, count(*) OVER (PARTITION BY toxic) AS c FROM r),
v AS (SELECT max(n) FILTER (toxic = 1) AS m1, max(n) FILTER (toxic = 0) AS m0 FROM m WHERE i = c // 2 + 1),
h AS (SELECT doc_id, text, m1 IS NOT NULL AND m0 IS NOT NULL AND toxic = CASE WHEN m1 > m0 THEN 1 ELSE 0 END AS cut, least(m1, m0) AS n, left(text, least(m1, m0)) AS head FROM r, v),
k AS (SELECT *, greatest(""" + ", ".join(f"CASE WHEN contains(head, '{m}') THEN length(head) - strpos(reverse(head), '{m[::-1]}') ELSE 0 END" for m in (". ", "; ", ", ")) + r""") AS mark FROM h)
SELECT doc_id, sha256(CASE WHEN NOT cut OR length(text) <= n THEN text ELSE trim(CASE WHEN mark - 1 > n * 0.5 THEN left(head, mark - 1) ELSE head END, ' ,;—-') END) AS text_sha256 FROM k""")
def aligned_lengths(spark, d):
    """Labelled documents, those of the longer class cut to the median of the other."""
    rows = _docs(spark, d).join(table(spark, d, "labels").where("toxic IN (0, 1)"), "doc_id").select("doc_id", "toxic", T.empty_if_null("text").alias("text"))
    return learning.aligned_lengths(rows, "text", "toxic").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query()
def leak_check(spark, d):
    """Whether a few words alone tell toxic documents apart."""
    rows = _docs(spark, d).select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    return learning.leak_check(rows, "doc_id", "text", "toxic", ("the", "and", "der", "que"), folds=3)


@query("""SELECT vec_id, round(1 / (1 + exp(-(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((i - 1) * 7 % 11 - 5) / 2.0)) - 0.25))), 6) AS maturity FROM embeddings""")
def maturity_scores(spark, d):
    """A logistic score of each vector under given weights."""
    v = N.doubles("embedding")
    weights = F.transform(v, lambda x, i: (F.pmod(i * 7, F.lit(11)) - 5) / 2.0)
    return table(spark, d, "embeddings").select("vec_id", F.round(N.sigmoid(N.dot(v, weights) - 0.25), 6).alias("maturity"))


KINDS = {"mature": "MATURE", "hype": "HYPE_OR_NOISE", "noise": "HYPE_OR_NOISE"}


@query(rf"""
WITH t AS (SELECT doc_id, trim({TITLE}) AS title, source, coalesce(text, '') AS text, url FROM documents LEFT JOIN pages ON page_id = doc_id),
s AS (SELECT *, trim(left(trim(regexp_replace(translate(lower(title), 'àáâäãçèéêëìíîïñòóôöõùúûüÿß', 'aaaaaceeeeiiiinooooouuuuys'), '[^a-z0-9]+', '-', 'g'), '-'), 80), '-') AS slug FROM t),
p AS (SELECT format('pos-{{:04d}}', doc_id) AS row_id, slug AS group_id, title, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace('weak signal ' || text, 'weak signal', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')), '\s*[—–-]\s*$', ''), '\s\s+', ' ', 'g'), ' ,;—-')[:4000] AS description,
 CASE WHEN source = 'src1' THEN 'one' WHEN source = 'src2' THEN 'two' ELSE 'other' END AS domain, 1 AS label, 'WEAK_SIGNAL' AS kind, CASE WHEN url IS NULL THEN [] ELSE [rtrim(regexp_extract(url, 'https?://[^\s)\]]+'), '.,;)')] END AS source_urls FROM s WHERE doc_id % 2 = 0),
c AS (SELECT *, (['Mature', 'hype', 'noise', 'other'])[doc_id // 2 % 4 + 1] AS subtype, min(doc_id) OVER (PARTITION BY lower(title)) AS first FROM s WHERE doc_id % 2 = 1),
n AS (SELECT format('neg-{{:04d}}', doc_id) AS row_id, slug AS group_id, title, trim(text) AS description, source AS domain, 0 AS label, CASE subtype WHEN 'Mature' THEN 'MATURE' ELSE 'HYPE_OR_NOISE' END AS kind, CASE WHEN url IS NULL OR url = '' THEN [] ELSE [url] END AS source_urls FROM c WHERE subtype <> 'other' AND title <> '' AND doc_id = first)
SELECT row_id, group_id, title, sha256(description) AS description_sha256, domain, label, kind, source_urls FROM (SELECT * FROM p UNION ALL SELECT * FROM n)""")
def training_rows(spark, d):
    """Rows of both labels: even documents as experts' rows, odd ones as candidates for the other label."""
    docs = _docs(spark, d).join(table(spark, d, "pages").select("page_id", "url"), F.col("page_id") == F.col("doc_id"), "left").withColumn("title", _title())
    k = F.col("doc_id")
    expert = docs.where(k % 2 == 0).select(k.alias("n"), F.col("title").alias("tech"), F.upper("source").alias("domain"), F.concat(F.lit("weak signal "), T.empty_if_null("text")).alias("why"), F.col("url").alias("sources"))
    pick = F.element_at(F.array(*map(F.lit, ("Mature", "hype", "noise", "other"))), (F.floor(k / 2) % 4 + 1).cast("int"))
    other = docs.where(k % 2 == 1).select(k.alias("n"), "title", F.col("text").alias("description"), F.col("source").alias("domain"), pick.alias("subtype"), "url")
    rows = records.positive_rows(expert, {"src1": "one", "src2": "two"}, ("weak signal",)).unionByName(records.negative_rows(other, KINDS)[0])
    return rows.select("row_id", "group_id", "title", F.sha2("description", 256).alias("description_sha256"), "domain", "label", "kind", "source_urls")


@query("""WITH v AS (SELECT user_id, sum(CASE WHEN ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-02-02' THEN 3 ELSE 0 END)::BIGINT AS n, min(ts) AS created FROM events GROUP BY user_id)
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 5 < 4 END AS found, CASE WHEN c_custkey % 5 BETWEEN 1 AND 3 THEN 'http://x.org/' || c_custkey END AS url,
 CASE WHEN c_custkey % 5 BETWEEN 1 AND 3 THEN coalesce(n, -1) END AS views, CASE WHEN c_custkey % 5 BETWEEN 1 AND 3 THEN created END AS created FROM customer LEFT JOIN v ON v.user_id = c_custkey""")
def encyclopedia_probe(spark, d):
    """Customers as titles of an encyclopedia, whose views and revisions are their events."""
    titles = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    k = F.col("user_id")
    summaries = titles.where(k % 5 > 0).select("user_id", F.when(k % 5 < 4, 200).otherwise(404).alias("status"), F.concat(F.lit("http://x.org/"), k.cast("string")).alias("url"))
    e = table(spark, d, "events")
    views = e.select("user_id", F.col("ts").cast("date").alias("day"), F.lit(3).alias("n"))
    return records.encyclopedia(titles, "user_id", summaries, views, e.select("user_id", F.col("ts").alias("at")), F.lit("2024-02-02").cast("date"))
