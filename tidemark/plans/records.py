"""Registered queries of feeds, sitemaps, captures, bytes, tokens and small predicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import mining, relational, rules, selection
from tidemark.session import table
from tidemark.sources import formats

from .catalogue import STOPPED, query

#: The letters and single blanks of a first line, which need no escape in XML.
PLAIN = "trim(regexp_replace(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'))"


def _plain():
    return F.trim(F.regexp_replace(F.regexp_replace(mining.title_of(F.col("text")), "[^A-Za-z ]", ""), " +", " "))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'rss2' ELSE 'atom' END AS format, {PLAIN} AS title, 'http://x.org/' || doc_id AS url, TIMESTAMP '2024-01-05 06:07:08' AS published FROM documents""")
def feed_records(spark, d):
    """Every document as a feed of one entry, RSS or Atom, read back."""
    k = F.col("doc_id").cast("string")
    rss = F.concat(F.lit("<?xml version='1.0'?><rss version='2.0'><channel><title>c</title><item><title><![CDATA["), _plain(), F.lit("]]></title><link>http://x.org/"), k, F.lit("</link><pubDate>Fri, 05 Jan 2024 06:07:08 GMT</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit("<feed xmlns='a'><entry><title>"), _plain(), F.lit('</title><link rel="alternate" href="http://x.org/'), k, F.lit('"/><updated>2024-01-05T06:07:08Z</updated></entry></feed>'))
    feeds = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, rss).otherwise(atom).alias("body"))
    out = formats.feed_entries(feeds, "body")
    return out.select("doc_id", "format", "title", "url", F.col("published").cast("timestamp").cast("timestamp_ntz").alias("published"))


@query("SELECT doc_id, 'http://x.org/' || n || '/' || doc_id AS loc, CASE WHEN n = 1 THEN DATE '2024-02-03' END AS lastmod, false AS is_index FROM documents, (SELECT unnest([1, 2]) AS n)")
def sitemap_records(spark, d):
    """Every document as a sitemap of two addresses, read back."""
    k = F.col("doc_id").cast("string")
    body = F.concat(F.lit("<urlset><url><loc>http://x.org/1/"), k, F.lit("</loc><lastmod>2024-02-03T00:00:00Z</lastmod></url><url><loc> http://x.org/2/"), k, F.lit(" </loc></url></urlset>"))
    out = formats.sitemap_entries(table(spark, d, "documents").select("doc_id", body.alias("body")), "body")
    return out.select("doc_id", "loc", F.to_date("lastmod").alias("lastmod"), "is_index")


@query("SELECT page_id, 'http://x.org/a/new-solid-cells-' || page_id AS url, TIMESTAMP '2024-01-02 03:04:05' AS captured_at FROM pages WHERE page_id % 3 = 0")
def capture_lines(spark, d):
    """Every page as a line of a capture index: only successful captures of pages stay."""
    k = F.col("page_id")
    url = F.when(k % 3 == 2, F.concat(F.lit("http://x.org/a/some-good-picture-"), k.cast("string"), F.lit(".jpg"))).otherwise(F.concat(F.lit("http://x.org/a/new-solid-cells-"), k.cast("string")))
    line = F.concat(F.lit("org,x)/a 20240102030405 "), url, F.lit(" text/html "), F.when(k % 3 == 1, "404").otherwise("200"), F.lit(" ABC 123"))
    out = formats.cdx_entries(table(spark, d, "pages").select("page_id", line.alias("line")), "line")
    return out.select("page_id", "url", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"))


@query("SELECT doc_id, sha256(text) AS decoded FROM documents")
def decoded_bytes(spark, d):
    """Every text as bytes in one of three encodings, decoded by its first bytes."""
    t = F.col("text")
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))
    content = F.when(F.col("doc_id") % 3 == 0, F.encode(t, "UTF-8")).when(F.col("doc_id") % 3 == 1, F.encode(t, "UTF-16")).otherwise(marked)
    return table(spark, d, "documents").select("doc_id", F.sha2(formats.decode(content), 256).alias("decoded"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN ['http://x.org/feed/' || page_id, 'http://y.org/rss'] WHEN 1 THEN ['http://x.org/atom.xml'] ELSE []::VARCHAR[] END AS feeds FROM pages")
def feed_discovery(spark, d):
    """The feeds that pages name in their heads, relative addresses resolved."""
    k = F.col("page_id")
    two = F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/feed/'), k.cast("string"), F.lit('"><LINK rel=alternate type="application/atom+xml" title="t" href="//y.org/rss"><link rel="stylesheet" type="text/css" href="/s.css">'))
    head = F.when(k % 3 == 0, two).when(k % 3 == 1, '<link type="application/atom+xml" href="atom.xml"><link type="application/atom+xml" href="atom.xml">').otherwise("")
    html = F.concat(head, F.coalesce(F.regexp_replace("html", "(?i)<link", "<x"), F.lit("")))
    found = formats.feed_links(html, F.lit("http://x.org/start"))
    return table(spark, d, "pages").select("page_id", F.when(k % 3 == 0, F.transform(found, lambda u: F.regexp_replace(u, "^https://y", "http://y"))).otherwise(found).alias("feeds"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS rank, o_orderpriority || ':' || o_orderkey AS id FROM orders")
def page_tokens(spark, d):
    """Places in a list as opaque tokens, read back."""
    token = relational.page_token(F.col("o_custkey").cast("string"), F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")))
    parts = relational.read_page_token(token)
    return table(spark, d, "orders").select("o_orderkey", parts.alias("p")).select("o_orderkey", F.element_at("p", 1).alias("rank"), F.array_join(F.slice("p", 2, 10), ":").alias("id"))


@query("SELECT c_custkey, c_custkey % 3 < 2 AS inside FROM customer")
def domain_suffixes(spark, d):
    """Hosts in a domain or below it, not those that only end alike."""
    host = F.element_at(F.array(*map(F.lit, ("a.example.org", "example.org", "badexample.org"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", U.in_domain(host, ("example.org", "other.net")).alias("inside"))


@query("""WITH p AS (SELECT p_partkey, [('a', p_size / 100 - 0.25), ('b', (p_partkey % 7 - 3) / 20), ('c', 0.01)] AS c FROM part),
s AS (SELECT p_partkey, list_slice(list_sort(list_transform(c, lambda x: struct_pack(o := -abs(x[2]::DOUBLE), n := x[1], v := x[2]::DOUBLE))), 1, 2) AS top FROM p)
SELECT p_partkey, array_to_string(list_transform(top, lambda x: x.n || ' ' || CASE WHEN x.v > 0.05 THEN 'SUPPORTS_WEAK_SIGNAL' WHEN x.v < -0.05 THEN 'SUPPORTS_MATURE' ELSE 'NEUTRAL' END), ',') AS top FROM s""")
def contribution_directions(spark, d):
    """The two largest contributions of each part, and what they speak for."""
    c = F.array(F.col("p_size") / 100 - 0.25, (F.col("p_partkey") % 7 - 3) / 20, F.lit(0.01))
    top = selection.top_contributions(c, ("a", "b", "c"), 2)
    said = F.transform(top, lambda x: F.concat_ws(" ", x["name"], rules.direction(x["value"])))
    return table(spark, d, "part").select("p_partkey", F.array_join(said, ",").alias("top"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) >= 8 OR (count(*) OVER (PARTITION BY o_custkey) = 1 AND o_orderstatus = 'F') AS kept FROM orders")
def small_clusters(spark, d):
    """Orders of customers that have enough of them."""
    return rules.small_clusters(table(spark, d, "orders"), "o_custkey", 8, F.col("o_orderstatus") == "F").select("o_orderkey", "kept")


@query(rf"""WITH s AS (SELECT doc_id, source, unnest(list_transform(regexp_split_to_array(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^\p{{L}}\p{{N}}_\s-]+'), lambda s: regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+'))) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, source, array_to_string(w[i:i + n - 1], ' ') AS phrase, n AS words FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s, (SELECT unnest([1, 2, 3]) AS n)) WHERE w[i] NOT IN {STOPPED} AND w[i + n - 1] NOT IN {STOPPED}),
c AS (SELECT source, phrase, count(*) AS n, max(words) AS words FROM g WHERE length(phrase) >= 3 GROUP BY source, phrase)
SELECT source, phrase, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, words DESC, phrase) AS pos FROM c QUALIFY pos <= 60""")
def source_keyphrases(spark, d):
    """The sixty most frequent phrases of the titles of each source."""
    docs = table(spark, d, "documents").select("source", "text")
    return mining.keyphrases(docs, "source", mining.title_of(F.col("text"))).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT 'http://x.org/' || doc_id AS url, CASE WHEN doc_id % 10 = 3 THEN 'INVALID_URL' WHEN doc_id % 10 = 4 THEN 'EMPTY_TITLE' WHEN doc_id % 10 = 5 THEN 'ADVERTISEMENT' ELSE 'KEPT' END AS reason FROM documents""")
def normalised_documents(spark, d):
    """Documents as raw records: what is normalised, and why the rest is rejected."""
    k = F.col("doc_id") % 10
    title = F.when(k == 4, " <b> </b> ").when(k == 5, "Sponsored post").otherwise("A title")
    raw = table(spark, d, "documents").select(F.when(k == 3, F.concat(F.lit("ftp:/x.org/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("http://x.org/"), F.col("doc_id").cast("string"))).alias("url"), title.alias("title"), F.col("text").alias("body"), F.lit(None).cast("timestamp").alias("published_at"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("int").alias("citations"), F.lit(None).cast("int").alias("engagement"), "source")
    kept, rejected = formats.normalise(raw)
    out = kept.select("url", F.lit("KEPT").alias("reason")).unionByName(rejected)
    return out.withColumn("url", F.regexp_replace("url", "^ftp:/x", "http://x"))
