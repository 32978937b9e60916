"""Registered queries of the library over the driver's tables, each with its SQL for DuckDB.

Every query runs over its whole tables through an operator of the library. Where SQL can't express
one (greedy and agglomerative steps, hashing of Spark's own), `sql` is None and tests hold it
against a brute-force version."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import features, matching, metrics, mining, ranges, relational, rules, vectors
from tidemark.session import table
from tidemark.sources import formats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = datetime(2024, 2, 1)
TOPIC = ("the", "of", "and", "for")
W = r"[\p{L}\p{N}_-]+"
#: Source name, type and trust of the driver's sources: a rule in place of a registry.
TYPES = ("PUBLICATION", "PREPRINT", "NEWS_MEDIA", "BLOG", "CODE_REPOSITORY")
#: What mining leaves out of the driver's invented titles: topics, whole phrases, words that make no phrase alone.
MINED_TOPICS = ("the thing", "der die")
GENERIC_PHRASES = ("le la", "el los")
GENERIC_WORDS = ("the", "der", "die", "das", "la", "le", "el", "los", "und", "que")
SQL_TYPE = "CASE substr(source, 4)::INT % 5 WHEN 0 THEN 'PUBLICATION' WHEN 1 THEN 'PREPRINT' WHEN 2 THEN 'NEWS_MEDIA' WHEN 3 THEN 'BLOG' ELSE 'CODE_REPOSITORY' END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def typed(docs: DataFrame) -> DataFrame:
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return docs.withColumn("type", F.element_at(F.array(*map(F.lit, TYPES)), F.pmod(n, F.lit(5)) + 1)).withColumn("trust", F.lit(3) - F.pmod(n, F.lit(3)))


NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"
COVER = r"len(list_intersect(['the', 'of', 'and', 'for'], regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_-]+'))) / 4.0"


@query(rf"""
WITH d AS (SELECT doc_id, source, {COVER} AS cov, row_number() OVER (PARTITION BY sha256({NORM}) ORDER BY doc_id) AS n FROM documents),
k AS (SELECT source, count(*) AS docs, count(*) FILTER (n > 1) AS dups, count(*) FILTER (n = 1 AND cov >= 0.5) AS kept,
             count(*) FILTER (n = 1 AND cov >= 0.5 AND quality = 1) AS kept_quality FROM d LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, docs, dups, kept, kept_quality, row_number() OVER (ORDER BY kept DESC, source) AS pos FROM k QUALIFY pos <= 10""")
def doc_quality_funnel(spark, d):
    """The flagship: normalise, hash, keep the first copy, filter by coverage of a topic, count by source."""
    docs = table(spark, d, "documents")
    hashed = docs.select("doc_id", "source", T.content_hash("text").alias("h"), T.term_coverage(TOPIC, "text").alias("cov"))
    first = hashed.groupBy(F.col("h").alias("f_h")).agg(F.min("doc_id").alias("first_id"))
    marked = hashed.join(first, F.col("h") == F.col("f_h")).withColumn("dup", F.col("doc_id") != F.col("first_id"))
    rows = marked.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    kept = ~F.col("dup") & (F.col("cov") >= 0.5)
    by = rows.groupBy("source").agg(F.count("*").alias("docs"), F.count_if("dup").alias("dups"), F.count_if(kept).alias("kept"), F.count_if(kept & (F.col("quality") == 1)).alias("kept_quality"))
    from pyspark.sql import Window

    return by.withColumn("pos", F.row_number().over(Window.orderBy(F.col("kept").desc(), "source"))).where("pos <= 10")


@query(rf"SELECT doc_id, len(regexp_extract_all(lower(text), '{W}'))::BIGINT AS n_tokens FROM documents")
def doc_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens("text")).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, sha256({NORM}) AS content_hash FROM documents")
def doc_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash("text").alias("content_hash"))


@query(f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256({NORM}) ORDER BY doc_id) = 1")
def doc_exact_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.content_hash("text").alias("h"))
    return relational.exact_dedup(docs, ["h"], [F.col("doc_id").asc()]).select("doc_id")


@query(f"SELECT doc_id, round({COVER}, 6) AS coverage FROM documents")
def doc_term_coverage(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.term_coverage(TOPIC, "text"), 6).alias("coverage"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN strpos(h, ' ') > 0 AND b - 1 > 72 THEN rtrim(left(h, b - 1), ' ') ELSE rtrim(h, ' ') END AS head
FROM (SELECT *, length(h) - strpos(reverse(h), ' ') + 1 AS b FROM (SELECT doc_id, coalesce(text, '') AS text, left(coalesce(text, ''), 120) AS h FROM documents))""")
def doc_truncate_words(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_words("text", 120).alias("head"))


@query(r"""SELECT doc_id, CASE WHEN c + l < 3 THEN 'und' WHEN c >= l * 0.5 THEN 'ru' ELSE 'en' END AS script_lang
FROM (SELECT doc_id, len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)""")
def doc_language_script(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language_by_script("text").alias("script_lang"))


LEX = {"emergence": {"exact": ("thin", "onen"), "prefixes": ("proto",), "phrases": ("of the",)}}


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_-]+') AS w FROM documents),
h AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN ('thin', 'onen') OR starts_with(x, 'proto')))
  + len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS hits FROM t)
SELECT doc_id, hits::BIGINT AS hits, round(CASE WHEN hits <= 0 THEN 0 ELSE least(1, hits / greatest(n, 200) * 1000 / 20) END, 6)::DOUBLE AS rate FROM h""")
def doc_lexicon_rate(spark, d):
    docs = table(spark, d, "documents").withColumn("w", T.tokens("text"))
    hits = T.lexicon_hits(F.col("w"), **LEX["emergence"])
    return docs.select("doc_id", hits.alias("hits"), F.round(T.lexicon_rate(hits, F.size("w")), 6).alias("rate"))


@query(r"""SELECT page_id, round(CASE WHEN len(y) = 0 THEN 0 ELSE len(list_filter(y, lambda v: v >= 2023)) / len(y) END, 6)::DOUBLE AS share
FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(' ' || regexp_replace(html, '(\d+)', ' \1 ', 'g') || ' ', ' (20\d\d) ', 1), lambda v: v::INT), lambda v: v <= 2025) AS y FROM pages)""")
def page_recent_year_share(spark, d):
    return table(spark, d, "pages").select("page_id", F.round(T.recent_year_share("html", 2024), 6).alias("share"))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) >= 1500 THEN 'article' WHEN length(coalesce(text, '')) >= 200 THEN 'abstract' ELSE 'title' END AS text_quality FROM documents")
def doc_text_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", T.text_quality("text").alias("text_quality"))


@query(r"""SELECT doc_id, len(l) AS letters, round(CASE WHEN len(l) = 0 THEN 1 ELSE len(c) / len(l) END, 6)::DOUBLE AS cyrillic, len(l) >= 8 AND len(u) > len(l) * 0.8 AS all_caps
FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}') AS l, regexp_extract_all(text, '[\x{0400}-\x{04FF}]') AS c, regexp_extract_all(text, '\p{Lu}') AS u FROM documents)""")
def doc_letter_shares(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("letters"), F.round(T.cyrillic_share("text"), 6).alias("cyrillic"), T.all_caps("text").alias("all_caps"))


@query(r"""SELECT doc_id, list_slice(list_filter(w, lambda x, i: length(x) >= 2 AND NOT x IN ('a','an','the','and','or','of','in','on','at','to','for','with','by','from','as','is','are','was','were','be','it','its','this','that','not') AND list_position(w, x) = i), 1, 20) AS terms
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)""")
def doc_significant_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", T.terms("text", 20).alias("terms"))


@query(r"""SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\d+(?:\.\d+)?'), lambda x: x::DOUBLE), lambda v: v > 2 AND NOT (v BETWEEN 2000 AND 2030 AND v = floor(v))))) AS numbers FROM documents""")
def doc_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_sort(T.numbers("text")).alias("numbers"))


@query(r"""SELECT doc_id, left(array_to_string(list_slice(list_filter(list_transform(regexp_extract_all(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '[^.!?…]+[.!?…]?'), lambda s: trim(s)), lambda s: s <> ''), 1, 2), ' '), 600) AS summary FROM documents""")
def doc_first_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_sentences("text", 2).alias("summary"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS h FROM documents")
def doc_collapsed_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.collapse("text"), 256).alias("h"))


HOST = r"regexp_replace(lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"
PATH = r"rtrim(regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/')"
PARAMS = r"list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT lower(split_part(p, '=', 1)) IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','yclid','ref'))"


@query(f"SELECT page_id, {HOST} AS host FROM pages")
def page_host(spark, d):
    return table(spark, d, "pages").select("page_id", U.host("url").alias("host"))


@query(f"""SELECT page_id, 'https://' || h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical,
  sha256('https://' || h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) AS url_hash,
  h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS identity
FROM (SELECT page_id, {HOST} AS h, {PATH} AS p, {PARAMS} AS q FROM pages)""")
def page_canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical("url").alias("canonical"), U.url_hash("url").alias("url_hash"), U.identity("url").alias("identity"))


STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {STRIP.format('html')} AS body FROM pages")
def page_strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html("html").alias("body"))


@query(rf"""SELECT page_id, nullif({STRIP.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title,
  list_slice(list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda p: {STRIP.format('p')}), lambda p: length(p) >= 60), 1, 4) AS paragraphs FROM pages""")
def page_article(spark, d):
    return table(spark, d, "pages").withColumn("a", formats.article(F.col("html"))).select("page_id", "a.title", "a.paragraphs")


@query(rf"""WITH d AS (SELECT doc_id, ' ' || {NORM} || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || {NORM} || ' ' AS p FROM benchmark)
SELECT item_id, count(doc_id) AS docs FROM b LEFT JOIN d ON contains(t, p) GROUP BY item_id""")
def benchmark_contains(spark, d):
    """How many documents hold all words of each item in a row."""
    items = table(spark, d, "benchmark").select("item_id", T.normalize("text").alias("p"))
    return matching.count_holding(table(spark, d, "documents").select(T.normalize("text").alias("t")), "t", items, "item_id", "p")


@query(f"""SELECT doc_id, {SQL_TYPE} AS type, least(3 - substr(source, 4)::INT % 3, CASE WHEN coalesce(quality, 1) = 0 THEN 1 ELSE 3 END, CASE WHEN quality IS NULL THEN 2 ELSE 3 END) AS trust
FROM documents LEFT JOIN labels USING (doc_id)""")
def source_type_classify(spark, d):
    docs = typed(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select("doc_id", "type", rules.trust_cap(F.col("trust"), F.coalesce(F.col("quality"), F.lit(1)) == 0, F.col("quality").isNotNull()).alias("trust"))


@query("SELECT source, lang, count(*) AS docs, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY ALL")
def source_histogram(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@query(f"""WITH x AS (SELECT source, {SQL_TYPE} AS type, 3 - substr(source, 4)::INT % 3 AS trust, n_chars AS citations, TIMESTAMP '2024-02-01' - to_days((doc_id % 1500)::INT) AS seen FROM documents),
y AS (SELECT *, greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(seen)) / 8.64e10) AS age FROM x)
SELECT source, round(ln(1 + count(*)), 6) AS doc_count_log, count(DISTINCT type)::DOUBLE AS source_type_diversity,
 round(avg((type IN ('PUBLICATION', 'PREPRINT'))::INT), 6) AS share_scientific, round(avg((type = 'NEWS_MEDIA')::INT), 6) AS share_news_media, round(avg((type = 'BLOG')::INT), 6) AS share_marketing,
 round(avg((type = 'CODE_REPOSITORY')::INT), 6) AS share_code_vacancy, round(avg((trust = 3)::INT), 6) AS trusted_share,
 round((count(*) FILTER (age <= 365.25) + 1) / (count(*) FILTER (age > 365.25 AND age <= 730.5) + 1), 6) AS growth_ratio_12m,
 round(median(age), 6) AS recency_median_days, round(max(age) / 365.25, 6) AS first_seen_years_ago,
 round(coalesce(ln(1 + median(citations) FILTER (type IN ('PUBLICATION', 'PREPRINT'))), 0), 6) AS citation_median_log FROM y GROUP BY source""")
def collection_features(spark, d):
    docs = typed(table(spark, d, "documents")).withColumn("published_at", F.timestamp_micros(F.lit(1706745600000000) - F.pmod("doc_id", F.lit(1500)) * F.lit(86400000000))).withColumn("citations", F.col("n_chars"))
    out = features.collection_features(docs, "source", NOW)
    return out.select("source", *[F.round(F.col(c), 6).alias(c) for c in features.COLLECTION])


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents QUALIFY pos <= 7")
def source_cap(spark, d):
    return relational.first_per_group(table(spark, d, "documents").select("doc_id", "source"), "source", [F.col("doc_id").asc()], 7)


@query("""WITH e AS (SELECT event_type AS term, ts >= TIMESTAMP '2024-01-16' AS r, ts < TIMESTAMP '2024-01-16' AS b FROM events), t AS (SELECT count(*) FILTER (r) AS tr, count(*) FILTER (b) AS tb FROM e),
c AS (SELECT term, count(*) FILTER (r) AS recent, count(*) FILTER (b) AS base FROM e GROUP BY term),
g AS (SELECT term, recent, base, (recent / tr + 1.0 / (tr + tb)) / (base / tb + 1.0 / (tr + tb)) AS growth FROM c, t)
SELECT term, recent, base, round(growth, 6) AS growth, round(growth * log2(1 + recent), 6) AS score FROM g WHERE recent >= 3 AND growth >= 0.5""")
def events_two_period_growth(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("term"), "ts")
    cut = F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")
    out = mining.two_period_growth(e, "term", F.col("ts").cast("timestamp_ntz") >= cut, F.col("ts").cast("timestamp_ntz") < cut, max_share=1.0, min_growth=0.5)
    return out.select("term", "recent", "base", F.round("growth", 6).alias("growth"), F.round("score", 6).alias("score"))


@query("""WITH m AS (SELECT event_type, count(value) AS n, median(value) AS median, mad(value) AS mad FROM events GROUP BY event_type)
SELECT event_type, n, round(median, 6) AS median, round(mad, 6) AS mad, round(CASE WHEN n >= 5 AND mad > 0 THEN median - 1.0 * 1.4826 * mad END, 6) AS floor,
 (SELECT count(*) FROM events e WHERE e.event_type = m.event_type AND (n < 5 OR mad = 0 OR value >= median - 1.0 * 1.4826 * mad)) AS kept FROM m""")
def events_mad_floor(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    kept = rules.above_floor(e, "value", "event_type", 1.0).groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("kept"))
    return rules.mad_floor(e, "value", "event_type", 1.0).join(kept, F.col("event_type") == F.col("k")).select("event_type", "n", *[F.round(F.col(c), 6).alias(c) for c in ("median", "mad", "floor")], "kept")


@query("SELECT event_type, round(quantile_cont(value, 0.6), 6) AS q60, count(*) AS n FROM events GROUP BY event_type")
def events_quantile(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    n = e.groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n"))
    return ranges.quantiles(e, F.col("value"), {"q60": 0.6}, ["event_type"]).join(n, F.col("event_type").eqNullSafe(F.col("k"))).select("event_type", F.round("q60", 6).alias("q60"), "n")


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS k_sum, count(*) FILTER (json_extract_string(props, '$.k')::INT > 5) AS k_large FROM events GROUP BY event_type")
def events_json_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count_if(F.col("k") > 5).alias("k_large"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM n GROUP BY user_id""")
def events_sessions(spark, d):
    from tidemark.streaming import documents

    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return documents.sessions(e, "user_id", "ts").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


GRAMS = r"""WITH t AS (SELECT doc_id, source, list_transform(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}_\s-]+'), lambda s: regexp_extract_all(s, '[\p{L}\p{N}_]+')) AS segs FROM documents),
s AS (SELECT doc_id, source, unnest(segs) AS w FROM t), g AS (SELECT DISTINCT doc_id, source, array_to_string(w[i:i + 1], ' ') AS phrase, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM s)),
p AS (SELECT doc_id, source, phrase FROM g WHERE NOT a IN ('a','an','the','and','or','of','in','on','at','to','for','with','by','from','as','is','are','was','were','be','it','its','this','that','not') AND NOT b IN ('a','an','the','and','or','of','in','on','at','to','for','with','by','from','as','is','are','was','were','be','it','its','this','that','not'))"""


@query(GRAMS + """
SELECT phrase, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS sources, round(count(DISTINCT doc_id) * (1 + 0.5 * (count(DISTINCT source) - 1)) * log2(3), 6) AS score
FROM p GROUP BY phrase HAVING docs >= 2 AND sources >= 2 AND docs / (SELECT count(*) FROM documents) <= 0.33""")
def ngram_mining(spark, d):
    docs = table(spark, d, "documents")
    p = mining.phrase_table(docs, "doc_id", "source", mining.title_of(F.col("text")))
    return mining.mine(p, "doc_id", "source", docs.count()).select("phrase", "docs", "sources", F.round("score", 6).alias("score"))


STOPPED = "('a','an','the','and','or','of','in','on','at','to','for','with','by','from','as','is','are','was','were','be','it','its','this','that','not')"
SINGULAR_LAST = "CASE WHEN regexp_matches(spelling, '[^ ]{2}ies$') THEN regexp_replace(spelling, 'ies$', 'y') WHEN regexp_matches(spelling, '[^ ][^ ][^sui ]s$') THEN regexp_replace(spelling, 's$', '') ELSE spelling END"
MINED = rf"""WITH f AS (SELECT trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\s+', ' ', 'g')) AS folded, min((doc_id, source, split_part(text, chr(10), 1))) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING folded != ''),
o AS (SELECT t[1] AS doc_id, t[2] AS source, t[3] AS title FROM f),
s AS (SELECT doc_id, source, unnest(list_transform(regexp_split_to_array(lower(title), '[^\p{{L}}\p{{N}}_\s-]+'), lambda s: regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+'))) AS w FROM o),
g AS (SELECT DISTINCT doc_id, source, array_to_string(w[i:i + n - 1], ' ') AS spelling FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s, (SELECT unnest([2, 3, 4]) AS n)) WHERE w[i] NOT IN {STOPPED} AND w[i + n - 1] NOT IN {STOPPED}),
p AS (SELECT *, {SINGULAR_LAST} AS phrase FROM g WHERE len(list_filter(string_split(spelling, ' '), lambda x: x NOT IN {GENERIC_WORDS})) > 0),
u AS (SELECT phrase, arg_min(spelling, (-n, spelling)) AS surface FROM (SELECT phrase, spelling, count(*) AS n FROM p GROUP BY ALL) GROUP BY phrase),
k AS (SELECT phrase, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS sources FROM p GROUP BY phrase HAVING docs >= 2 AND sources >= 2 AND docs / (SELECT count(*) FROM o) <= 0.33),
c AS (SELECT phrase, surface, docs, sources, docs * (1 + 0.5 * (sources - 1)) * log2(len(string_split(phrase, ' ')) + 1) AS score FROM k JOIN u USING (phrase)
      WHERE phrase NOT IN {GENERIC_PHRASES} AND {" AND ".join(f"NOT contains(' ' || phrase || ' ', ' {t} ') AND NOT contains(' {t} ', ' ' || phrase || ' ')" for t in MINED_TOPICS)})"""


def _mined(spark, d):
    return mining.mine_technologies(table(spark, d, "documents"), "doc_id", "source", mining.title_of(F.col("text")), MINED_TOPICS, GENERIC_PHRASES, GENERIC_WORDS)


@query(MINED + " SELECT phrase, surface, docs, sources, round(score, 6) AS score FROM c")
def technology_candidates(spark, d):
    """Phrases of titles that may name a technology, reprints counted once."""
    return _mined(spark, d).withColumn("score", F.round("score", 6))


@query(MINED + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, phrase) AS rank FROM c),
a AS (SELECT x.*, (SELECT min(y.rank) FROM r y WHERE y.phrase != x.phrase AND x.docs <= y.docs AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')) AS until FROM r x),
v AS (SELECT * FROM a WHERE until IS NULL OR until > rank),
h AS (SELECT step, sum(sum(change)) OVER (ORDER BY step) AS chosen FROM (SELECT rank AS step, 1 AS change FROM v UNION ALL SELECT until, -1 FROM v WHERE until IS NOT NULL) GROUP BY step),
z AS (SELECT min(step) AS stop FROM h WHERE chosen >= 15)
SELECT phrase, surface, docs, sources, round(score, 6) AS score, row_number() OVER (ORDER BY rank) AS pos FROM v, z WHERE (stop IS NULL OR rank <= stop) AND (until IS NULL OR until > stop) QUALIFY pos <= 15""")
def technology_mining(spark, d):
    """The fifteen best phrases of titles after absorption of nested ones."""
    return mining.absorb(_mined(spark, d), 15).withColumn("score", F.round("score", 6)).withColumn("pos", F.col("pos").cast("long"))


@query(GRAMS + """, m AS (SELECT phrase, doc_id % 2 = 0 AS r, doc_id FROM p), tot AS (SELECT count(DISTINCT doc_id) FILTER (r) AS tr, count(DISTINCT doc_id) FILTER (NOT r) AS tb FROM m),
c AS (SELECT phrase, count(*) FILTER (r) AS recent, count(*) FILTER (NOT r) AS base FROM m GROUP BY phrase),
gr AS (SELECT phrase, recent, base, (recent / tr + 1.0 / (tr + tb)) / (base / tb + 1.0 / (tr + tb)) AS growth FROM c, tot WHERE recent >= 3 AND recent / tr <= 0.2)
SELECT phrase, recent, base, round(growth, 6) AS growth, round(growth * log2(1 + recent), 6) AS score FROM gr WHERE growth >= 1.5""")
def emerging_phrases(spark, d):
    """Phrases more frequent in one half of the documents (standing in for the recent period)."""
    docs = table(spark, d, "documents")
    p = mining.phrase_table(docs, "doc_id", "source", mining.title_of(F.col("text")))
    even = F.pmod("doc_id", F.lit(2)) == 0
    return mining.two_period_growth(p, "phrase", even, ~even, per=F.col("doc_id")).select("phrase", "recent", "base", F.round("growth", 6).alias("growth"), F.round("score", 6).alias("score"))


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS pos FROM documents QUALIFY pos <= 5")
def hash_sample(spark, d):
    return relational.hash_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 5, "lang")


@query("SELECT n_chars, doc_id FROM documents WHERE (n_chars, doc_id) > (500, 10) ORDER BY n_chars, doc_id LIMIT 50")
def keyset_page(spark, d):
    return relational.keyset_page(table(spark, d, "documents").select("n_chars", "doc_id"), [("n_chars", 500), ("doc_id", 10)], 50)


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS by_price, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS by_date, count(*) OVER (PARTITION BY o_custkey) AS orders FROM orders")
def rank_two_ways(spark, d):
    from pyspark.sql import Window

    o, w = table(spark, d, "orders"), Window.partitionBy("o_custkey")
    return o.select("o_orderkey", F.rank().over(w.orderBy(F.col("o_totalprice").desc())).alias("by_price"), F.rank().over(w.orderBy("o_orderdate")).alias("by_date"), F.count("*").over(w).alias("orders"))


@query("""WITH r AS (SELECT doc_id, n_chars, lang = 'de' AS f, row_number() OVER (PARTITION BY lang = 'de' ORDER BY n_chars DESC, doc_id) AS a FROM documents)
SELECT doc_id, n_chars, f AND a <= 5 AS reserved FROM r ORDER BY f AND a <= 5 DESC, n_chars DESC, doc_id LIMIT 20""")
def topk_reserved(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return relational.top_with_reserve(docs, F.col("lang") == "de", [F.col("n_chars").desc(), F.col("doc_id").asc()], 20, 5).select("doc_id", "n_chars", "reserved")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01')")
def anti_join_orphans(spark, d):
    recent = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
    c = table(spark, d, "customer").select("c_custkey")
    return relational.without_recent_link(c, recent, c["c_custkey"] == recent["o_custkey"])


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def semi_join_ids(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 49")
    return table(spark, d, "part").join(big, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_quantity > 25) AS large, bool_or(l_discount > 0.09) AS any_deep, bool_and(l_tax <= 0.08) AS all_low_tax,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL""")
def filtered_aggs(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("large"), F.bool_or(F.col("l_discount") > 0.09).alias("any_deep"), F.bool_and(F.col("l_tax") <= 0.08).alias("all_low_tax"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def string_agg_distinct(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderpriority AS title, repeat('x', (o_totalprice / 1000)::INT) AS body, o_orderdate AS seen, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS r, o_orderkey FROM orders)
SELECT k::VARCHAR AS url_hash, length(arg_max(body, (length(body), -epoch_us(seen)))) AS body_chars, max(r)::INT AS date_rank, max(seen) AS arrived, count(*) AS versions FROM o GROUP BY k""")
def upsert_merge(spark, d):
    """Orders as versions of documents: the longest body wins, dates by their origin. Halves round to even."""
    o = table(spark, d, "orders")
    source = F.when(F.col("o_orderstatus") == "F", "api").when(F.col("o_orderstatus") == "O", "url").otherwise("other")
    rows = o.select(F.col("o_custkey").cast("string").alias("url_hash"), F.col("o_orderpriority").alias("title"), F.repeat(F.lit("x"), F.rint(F.col("o_totalprice") / 1000).cast("int")).alias("body"), F.col("o_orderdate").alias("published_at"), source.alias("published_source"), F.col("o_orderdate").cast("timestamp").alias("arrived"))
    old, new = rows.where("arrived < timestamp'1995-01-01'"), rows.where("arrived >= timestamp'1995-01-01'")
    out = relational.upsert_documents(old, new)
    return out.select("url_hash", F.length("body").cast("long").alias("body_chars"), relational.date_rank(F.col("published_source")).alias("date_rank"), F.col("arrived").cast("timestamp_ntz").alias("arrived"), "versions")


@query("""WITH t AS (SELECT split_part(coalesce(text, ''), chr(10), 1) AS url, coalesce(text, '') AS text FROM documents)
SELECT sha256(url) AS url, max(length(text)) AS longest, sha256(array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+'))))), ' ')) AS tokens FROM t GROUP BY url""")
def archive_merge(spark, d):
    """Documents of one first line united, as versions of one address."""
    docs = table(spark, d, "documents").select(mining.title_of(F.col("text")).alias("url"), F.col("text").alias("title"), F.lit("").alias("summary"), F.lit(None).cast("date").alias("published_on"), T.tokens("text").alias("tokens"))
    return relational.merge_archive(docs).select(F.sha2("url", 256).alias("url"), F.length("title").cast("long").alias("longest"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+') AS w FROM documents),
c AS (SELECT doc_id, list_has_any(w, ['the', 'of'])::INT + list_has_any(w, ['que', 'les'])::INT + list_has_any(w, ['and'])::INT AS concepts FROM t)
SELECT doc_id, concepts FROM c WHERE concepts >= 2 ORDER BY concepts DESC, doc_id LIMIT 40""")
def archive_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.tokens("text").alias("tokens"), F.lit(None).cast("date").alias("published_on"), F.format_string("%012d", "doc_id").alias("url"))
    return relational.search_archive(docs, [("the", "of"), ("que", "les"), ("and",)], 2, 40).select("doc_id", "concepts")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pos FROM documents) SELECT doc_id, lang, pos FROM r WHERE pos <= 10 ORDER BY pos, lang""")
def quota_interleave(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return relational.interleave(docs, "lang", [F.col("n_chars").desc(), F.col("doc_id").asc()], 10).select("doc_id", "lang", "pos").orderBy("pos", "lang")


@query("""WITH a AS (SELECT doc_id, 'score' AS picked_by FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15),
b AS (SELECT doc_id, 'relevance' AS picked_by FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY (doc_id * 7919 % 1000) DESC, doc_id LIMIT 15) SELECT * FROM a UNION ALL SELECT * FROM b""")
def mixed_selection(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.pmod(F.col("doc_id") * 7919, F.lit(1000)).alias("rel"))
    return relational.mixed_selection(docs, "doc_id", "n_chars", "rel", 30, 0.5).select("doc_id", "picked_by")


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def emb_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(N.norm(F.col("embedding")), 4).alias("norm"))


COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"


@query(f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 4) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COS} >= 0.2""")
def emb_cosine_pairs(spark, d):
    """Pairs of a label with cosine of 0.2 or more."""
    return vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.2, "label").withColumn("similarity", F.round("similarity", 4))


CENT = """WITH x AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT label, max(n) AS n, list(x ORDER BY i) AS v FROM m GROUP BY label), u AS (SELECT label, n, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS e FROM c)"""


@query(CENT + " SELECT label, n, list_transform(e, lambda y: round(y, 4)) AS centroid FROM u")
def emb_centroids(spark, d):
    return vectors.centroids(table(spark, d, "embeddings"), "label", "embedding").withColumn("centroid", F.transform("centroid", lambda x: N.rounded(x, 4)))


@query(CENT + f""", a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, b.label AS best, {COS} AS c FROM a, u b)
SELECT vec_id, arg_max(best, c) AS best, round(max(c), 4) AS similarity FROM s GROUP BY vec_id""")
def emb_best_match(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.best_match(e, "embedding", vectors.centroids(e, "label", "embedding"), "label").select("vec_id", "best", N.rounded(F.col("similarity"), 4).alias("similarity"))


@query(f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT a.vec_id, a.label, 1 - max({COS}) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT label, round(least(greatest(quantile_cont(d, 0.6), 0.2), 0.65), 4) AS threshold FROM n GROUP BY label""")
def emb_nn_threshold(spark, d):
    return vectors.adaptive_threshold(table(spark, d, "embeddings"), "label", "vec_id", "embedding").withColumn("threshold", F.round("threshold", 4))


@query()
def emb_near_dup_greedy(spark, d):
    """Vectors kept by the greedy filter in each label, by vec_id."""
    return vectors.near_dup_filter(table(spark, d, "embeddings"), "label", "vec_id", "embedding", ["vec_id"], 0.6, centre=True)


@query()
def emb_clusters(spark, d):
    """Average-linkage clusters of each label."""
    return vectors.clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.6, centre=True)


@query()
def emb_mmr(spark, d):
    """Five vectors of each label by maximal marginal relevance to its centroid."""
    e = table(spark, d, "embeddings").withColumn("phrase", F.format_string("v%06d", "vec_id"))
    return vectors.mmr(e.join(vectors.centroids(e, "label", "embedding").select("label", "centroid"), "label"), "label", "phrase", "embedding", "centroid")


@query()
def doc_hashing_embedding(spark, d):
    """Hashed vectors of the first lines of documents."""
    docs = table(spark, d, "documents").select("doc_id", mining.title_of(F.col("text")).alias("title"))
    return vectors.hashing_embedding(docs, "title", 64).select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COS} >= 0.3),
x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS c FROM x UNION SELECT x.b, r.c FROM r JOIN x ON x.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY node""")
def graph_components(spark, d):
    """Vectors that chains of similar ones connect."""
    return vectors.components(vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3, "label").select("a", "b"))


FEATURES_SQL = f"""x AS (SELECT doc_id, coalesce(quality, 0) AS q, toxic, n_chars, {SQL_TYPE} AS type, 3 - substr(source, 4)::INT % 3 AS trust, (doc_id * 37 % 100) / 100.0 AS sim, (doc_id * 53 % 100) / 100.0 AS mat,
 (doc_id * 71 % 100) / 100.0 AS hype, (doc_id * 13 % 7)::DOUBLE AS stage, (doc_id * 17 % 6)::DOUBLE AS big, doc_id % 11 = 0 AS wiki FROM documents LEFT JOIN labels USING (doc_id)),
ev AS (SELECT *, CASE WHEN trust = 1 THEN 'NO_TRUSTED_SOURCE' WHEN trust < 3 THEN 'SINGLE_SOURCE' END AS e FROM x),
dec AS (SELECT *, CASE WHEN sim < 0.3 THEN 'LOW_QUERY_RELEVANCE' WHEN wiki AND doc_id % 2 = 0 THEN 'ENCYCLOPEDIA_MATURE' WHEN stage >= 5 AND (big >= 3 OR type = 'CODE_REPOSITORY') THEN 'MARKET_LEADERS'
 WHEN mat >= 0.6 AND hype <= 0.2 THEN 'MATURITY_LEXICON' ELSE coalesce(e, CASE WHEN type = 'BLOG' THEN 'MARKETING_DOMINANT' WHEN hype >= 0.5 AND trust < 3 THEN 'HYPE_LEXICON' ELSE 'MODEL' END) END AS reason FROM ev),
fin AS (SELECT *, CASE WHEN reason = 'LOW_QUERY_RELEVANCE' THEN 'OFF_TOPIC' WHEN reason IN ('ENCYCLOPEDIA_MATURE', 'MARKET_LEADERS', 'MATURITY_LEXICON') THEN 'MATURE' WHEN reason IN ('NO_TRUSTED_SOURCE', 'SINGLE_SOURCE') THEN 'INSUFFICIENT_EVIDENCE'
 WHEN reason IN ('MARKETING_DOMINANT', 'HYPE_LEXICON') THEN 'HYPE_OR_NOISE' WHEN sim >= 0.6 THEN 'WEAK_SIGNAL' WHEN mat >= 0.4 OR wiki THEN 'MATURE' WHEN hype >= 0.3 THEN 'HYPE_OR_NOISE' ELSE 'INSUFFICIENT_EVIDENCE' END AS decision,
 CASE WHEN reason IN ('ENCYCLOPEDIA_MATURE', 'MARKET_LEADERS', 'MATURITY_LEXICON') THEN e END AS note FROM dec)"""


def _decided(spark, d):
    docs = typed(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id", "left")

    def part(k: int, m: int = 100, over: float = 100.0):
        return F.pmod(F.col("doc_id") * k, F.lit(m)) / over

    wiki = F.pmod("doc_id", F.lit(11)) == 0
    one = {
        "emb_sim_query": part(37), "wiki_exists": wiki.cast("double"), "wiki_pageviews_30d_log": F.when(wiki & (F.pmod("doc_id", F.lit(2)) == 0), F.log1p(F.lit(30000.0))).otherwise(0.0), "wiki_age_years": F.lit(5.0),
        "stage_lex_ordinal": part(13, 7, 1.0), "bigtech_mentions_count": part(17, 6, 1.0), "share_code_vacancy": (F.col("type") == "CODE_REPOSITORY").cast("double"), "lex_maturity_score": part(53), "lex_emergence_score": part(71),
        "lex_hype_score": part(71), "share_marketing": (F.col("type") == "BLOG").cast("double"), "share_scientific": F.col("type").isin("PUBLICATION", "PREPRINT").cast("double"), "trusted_share": (F.col("trust") == 3).cast("double"),
        "mature_field": F.lit(False), "n_documents": F.lit(1), "n_low": (F.col("trust") == 1).cast("int"), "n_high": (F.col("trust") == 3).cast("int"),
    }
    return rules.decide(docs.withColumns(one), "emb_sim_query", 0.6)


@query("WITH " + FEATURES_SQL + " SELECT doc_id, decision, reason, note FROM fin")
def rule_chain(spark, d):
    """Decision, reason and note of each document under features made by rule."""
    return _decided(spark, d).select("doc_id", "decision", "reason", "note")


@query("WITH " + FEATURES_SQL + """ SELECT doc_id, CASE WHEN decision = 'WEAK_SIGNAL' THEN row_number() OVER (PARTITION BY decision = 'WEAK_SIGNAL' ORDER BY sim DESC, trust = 3 DESC, n_chars DESC, doc_id) ELSE 0 END AS rank FROM fin""")
def rank_signals(spark, d):
    return rules.rank_signals(_decided(spark, d), "emb_sim_query", "n_chars", "doc_id").select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("WITH " + FEATURES_SQL + " SELECT type, decision, reason, count(*) AS n FROM fin GROUP BY ALL")
def decision_histogram(spark, d):
    return _decided(spark, d).groupBy("type", "decision", "reason").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6)::DOUBLE AS precision, round(tp / nullif(tp + fn, 0), 6)::DOUBLE AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6)::DOUBLE AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6)::DOUBLE AS accuracy FROM t""")
def confusion(spark, d):
    out = metrics.confusion(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return out.select("tp", "fp", "fn", "tn", *[F.round(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("""WITH s AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS a, avg(toxic) AS b FROM labels) SELECT n, round(po, 6) AS agreement, round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa FROM s""")
def confusion_kappa(spark, d):
    return metrics.kappa(table(spark, d, "labels"), "quality", "toxic").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


LABELLED = "(SELECT d.doc_id, d.source, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id))"


@query(f"""WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM {LABELLED}), s AS (SELECT sum(r) FILTER (quality = 1) AS r, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM r)
SELECT round(CASE WHEN p > 0 AND q > 0 THEN (r - p * (p + 1) / 2.0) / (p * q) END, 6)::DOUBLE AS auc, p AS positives, q AS negatives FROM s""")
def auc_mannwhitney(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return metrics.auc(rows, "quality", "n_chars").withColumn("auc", F.round("auc", 6))


@query(f"""WITH n AS (SELECT n_chars, sum(quality) AS p, count(*) AS n FROM {LABELLED} GROUP BY n_chars), s AS (SELECT p, sum(p) OVER z AS cp, sum(n) OVER z AS cn FROM n WINDOW z AS (ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(p * cp / cn) / sum(p), 6)::DOUBLE AS average_precision FROM s""")
def average_precision(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return metrics.average_precision(rows, "quality", "n_chars").withColumn("average_precision", F.round("average_precision", 6))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS i FROM {LABELLED}),
a AS (SELECT source, count(*) FILTER (r <= 5) AS shown, sum(quality) FILTER (r <= 5)::BIGINT AS hits, sum(quality / log2(r + 1)) FILTER (r <= 5) AS dcg, sum(quality / log2(i + 1)) FILTER (i <= 5) AS best FROM r GROUP BY source)
SELECT source, shown, hits, round(hits / shown, 6) AS precision, round(CASE WHEN best > 0 THEN dcg / best END, 6) AS ndcg FROM a""")
def p_at_k(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    out = metrics.top_k(rows, "source", "n_chars", "quality", "doc_id", 5)
    return out.select("source", "shown", "hits", F.round("precision", 6).alias("precision"), F.round("ndcg", 6).alias("ndcg"))


@query("""WITH e AS (SELECT (value - lo) / (hi - lo) AS p, (event_type = 'click')::INT AS y FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)), b AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS m, avg(y) AS r FROM e GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(n * abs(m - r)) / sum(n), 6) AS ece, (SELECT round(avg((p - y) ** 2), 6) FROM e) AS brier FROM b""")
def calibration_ece(spark, d):
    e = table(spark, d, "events").select("value", (F.col("event_type") == "click").cast("int").alias("y"))
    e = e.join(F.broadcast(e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))).select(((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("p"), "y")
    return metrics.calibration(e, "y", "p").select("n", F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM r""")
def spearman(spark, d):
    return metrics.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("spearman", F.round("spearman", 6))


@query("""WITH s AS (SELECT avg((l_linenumber - (l_quantity::INT % 7 + 1)) ** 2) AS d, avg(l_linenumber ** 2) AS xx, avg((l_quantity::INT % 7 + 1) ** 2) AS yy, avg(l_linenumber) AS x, avg(l_quantity::INT % 7 + 1) AS y FROM lineitem)
SELECT round(1 - d / (xx + yy - 2 * x * y), 6) AS weighted_kappa FROM s""")
def weighted_kappa(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber", (F.pmod(F.col("l_quantity").cast("int"), F.lit(7)) + 1).alias("other"))
    return metrics.weighted_kappa(li, "l_linenumber", "other").withColumn("weighted_kappa", F.round("weighted_kappa", 6))


@query("""WITH a AS (SELECT source, count(toxic) AS n, count(*) FILTER (toxic = 1) AS hits FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source), b AS (SELECT *, hits / n AS p, 1.959963984540054 AS z FROM a)
SELECT source, n, hits, round(CASE WHEN n > 0 THEN p END, 6)::DOUBLE AS share, round(CASE WHEN n > 0 THEN greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)) END, 6)::DOUBLE AS low,
 round(CASE WHEN n > 0 THEN least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)) END, 6)::DOUBLE AS high FROM b""")
def share_intervals(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    out = metrics.share_with_interval(rows, "source", F.col("toxic") == 1)
    return out.select("source", "n", "hits", *[F.round(F.col(c), 6).alias(c) for c in ("share", "low", "high")])


@query()
def bootstrap_interval(spark, d):
    """Percentile interval of the mean order value, by order."""
    out = metrics.bootstrap_mean(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 200)
    return out.select(*[F.round(F.col(c), 4).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH n AS (SELECT n_chars AS s, sum(quality) AS p, count(*) AS n FROM {LABELLED} GROUP BY n_chars), c AS (SELECT s, sum(p) OVER z AS tp, sum(n) OVER z AS shown, sum(p) OVER () AS al FROM n WINDOW z AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT s AS threshold, round(tp / shown, 6)::DOUBLE AS precision, round(tp / al, 6)::DOUBLE AS recall, round(2 * tp / (shown + al), 6)::DOUBLE AS f1 FROM c WHERE tp / shown >= 0.5 ORDER BY 2 * tp / (shown + al) DESC, s DESC LIMIT 1""")
def threshold_selection(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    out = metrics.best_threshold(rows, "quality", "n_chars", 0.5)
    return out.select("threshold", *[F.round(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH g AS (SELECT source, max(lang) AS l FROM documents GROUP BY source) SELECT source, (row_number() OVER (PARTITION BY l ORDER BY sha256('s1|' || source), source) - 1) % 3 AS fold FROM g""")
def group_folds(spark, d):
    return metrics.group_folds(table(spark, d, "documents"), "source", "lang", 3, "s1").withColumn("fold", F.col("fold").cast("long"))


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) = 1")
def conversation_first_unique(spark, d):
    c = table(spark, d, "conversations").withColumn("k", F.lower("text"))
    return relational.merge_rows(c, ["conv_id", "k"], [F.col("turn").asc()]).select("conv_id", "turn")


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only_a' WHEN a.o_orderkey IS NULL THEN 'only_b' WHEN a.o_orderstatus IS DISTINCT FROM b.s THEN 'changed' ELSE 'same' END AS status
FROM (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0) b ON a.o_orderkey = b.o_orderkey""")
def replay_comparison(spark, d):
    """Two runs of a table, one of them with rows left out and values changed by rule."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    b = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")))
    return relational.compare_rows(o.where("o_orderkey % 5 <> 0"), b, "o_orderkey", ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "status")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def source_rollup(spark, d):
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'CANCELLED' WHEN coalesce(sum((o_totalprice > 100000)::INT), 0) = 0 THEN 'FAILED' WHEN bool_or(o_orderstatus = 'O') THEN 'PARTIAL' ELSE 'COMPLETED' END AS status
FROM (SELECT o_custkey AS c_custkey, * FROM orders) GROUP BY c_custkey""")
def collection_status(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "CANCELLED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("COMPLETED").alias("status"), (F.col("o_totalprice") > 100000).cast("int").alias("documents"), F.lit(False).alias("budget_hit"))
    return rules.collection_status(o, "c_custkey")


@query(
    "SELECT source, string_agg(lang || ':' || c, ',' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL) GROUP BY source"
)
def language_counts(spark, d):
    h = features.histogram(table(spark, d, "documents"), "source", "lang")
    return h.select("source", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("SELECT vec_id, feature, value FROM (SELECT vec_id, 'e' || generate_subscripts(embedding, 1) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings) WHERE value IS NOT NULL")
def feature_rows(spark, d):
    names = [f"e{i}" for i in range(1, 65)]
    e = table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return features.as_rows(e, "vec_id", names)


@query("""WITH x AS (SELECT doc_id, least(greatest(n_chars / 1000.0, 0), 8) AS a, least(greatest((doc_id % 17)::DOUBLE, 0), 14) AS b FROM documents), m AS (SELECT *, 0.8 * (a - 2.0) / 1.5 - 0.3 * (b - 7.0) / 4.0 + 0.1 AS z FROM x)
SELECT doc_id, round(1 / (1 + exp(-(1.2 * z - 0.2))), 6) AS score FROM m""")
def linear_scoring(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("a"), F.pmod("doc_id", F.lit(17)).cast("double").alias("b"))
    docs = docs.withColumn("v", features.assemble({"a": (0, 8), "b": (0, 14)}))
    return features.score_linear(docs, "v", [2.0, 7.0], [1.5, 4.0], [0.8, -0.3], 0.1, (1.2, -0.2)).select("doc_id", F.round("score", 6).alias("score"))
