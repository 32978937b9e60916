"""Readers and writers of the document formats: JSON records, feeds, pages, sitemaps, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import text as T
from tidemark.functions import urls as U

#: One record of the works API, as far as it is used.
WORK = "id string, doi string, title string, publication_date string, language string, cited_by_count int, abstract_inverted_index map<string,array<int>>, primary_location struct<landing_page_url:string>"
#: The document every source is mapped to.
DOCUMENT = ("url", "title", "body", "published_at", "language", "doi", "citations", "engagement", "source")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; what doesn't fit is null."""
    return spark.read.schema(schema).json(path)


def read_text_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; quoted fields may hold line breaks."""
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def inverted_text(index: Column) -> Column:
    """Text of a map from word to positions, words in order of position, then word."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "), F.lit(""))


def _document(rows: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"published_at": "timestamp", "citations": "int", "engagement": "int"}
    return rows.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in DOCUMENT])


def works(rows: DataFrame) -> DataFrame:
    """Records of WORK as documents; those without a title are dropped."""
    url = F.coalesce("primary_location.landing_page_url", "doi", "id")
    return _document(rows.where(F.trim(T.empty_if_null("title")) != ""), url=url, title=F.col("title"), body=inverted_text(F.col("abstract_inverted_index")), published_at=N.partial_date(F.col("publication_date")), language=T.language_code("language"), doi=T.doi("doi"), citations=F.col("cited_by_count"), source=F.lit("works"))


def _tag(xml: Column, name: str) -> Column:
    inner = F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>", 1)
    return F.trim(F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))


def feed_entries(feeds: DataFrame, body: str) -> DataFrame:
    """feeds with format and one row for each entry: title, url, summary, published. RSS 2.0, RSS 1.0
    and Atom by their root tag; anything else gives no row (see is_feed)."""
    entry = F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?s)(<(?:item|entry)[\s>].*?</(?:item|entry)>)"), F.lit(1)))
    e = F.col("__e")
    href = F.regexp_extract(e, r"""<link[^>]*?href=["']([^"']+)["']""", 1)
    out = feeds.withColumn("format", is_feed(F.col(body))).where("format IS NOT NULL").withColumn("__e", entry)
    link = F.coalesce(F.nullif(_tag(e, "link"), F.lit("")), F.nullif(href, F.lit("")))
    when = F.coalesce(*[F.nullif(_tag(e, n), F.lit("")) for n in ("pubDate", "published", "updated", "date")])
    summary = F.coalesce(*[F.nullif(_tag(e, n), F.lit("")) for n in ("description", "summary", "content", "encoded")], F.lit(""))
    return out.withColumn("title", T.strip_html(_tag(e, "title"))).withColumn("url", link).withColumn("summary", T.strip_html(summary)).withColumn("published", N.parse_timestamp(when)).drop("__e")


def is_feed(body: Column) -> Column:
    """rss2, rdf, atom or null."""
    head = F.regexp_extract(body, r"(?s)^\s*(?:<\?xml.*?\?>)?\s*(?:<!--.*?-->\s*)*<(?:\w+:)?(\w+)", 1)
    return F.when(head == "rss", "rss2").when(head == "RDF", "rdf").when(head == "feed", "atom")


def feed_links(page: Column, base: Column) -> Column:
    """URLs of the feeds that a page links to, relative ones resolved against the site."""
    links = F.regexp_extract_all(page, F.lit(r"""(?is)(<link[^>]+type=["']application/(?:rss|atom)\+xml["'][^>]*>)"""), F.lit(1))
    hrefs = F.filter(F.transform(links, lambda x: F.regexp_extract(x, r"""(?i)href=["']([^"']+)["']""", 1)), lambda h: h != "")
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return F.array_distinct(F.transform(hrefs, lambda h: F.when(h.rlike("^https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).otherwise(F.concat(root, F.lit("/"), F.ltrim(h, F.lit("/"))))))


def article(page: Column) -> Column:
    """struct(title, description, paragraphs, published) of a page: Open Graph before the title tag,
    up to four paragraphs of 60 characters or more, date from metadata, LD-JSON or a time tag."""

    def meta(name: str) -> Column:
        return F.nullif(F.regexp_extract(page, rf"""(?is)<meta[^>]+(?:property|name)=["']{name}["'][^>]+content=["']([^"']*)["']""", 1), F.lit(""))

    tag = F.nullif(T.strip_html(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    found = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), T.strip_html)
    paragraphs = F.slice(F.filter(found, lambda p: F.length(p) >= 60), 1, 4)
    ld = F.nullif(F.regexp_extract(page, r'"datePublished"\s*:\s*"([^"]+)"', 1), F.lit(""))
    time = F.nullif(F.regexp_extract(page, r"""(?is)<time[^>]+datetime=["']([^"']+)["']""", 1), F.lit(""))
    day = N.partial_date(F.substring(F.coalesce(meta("article:published_time"), meta("date"), ld, time), 1, 10))
    return F.struct(F.coalesce(meta("og:title"), meta("twitter:title"), tag).alias("title"), F.coalesce(meta("og:description"), meta("description")).alias("description"), paragraphs.alias("paragraphs"), day.alias("published"))


def sitemap_entries(maps: DataFrame, body: str) -> DataFrame:
    """maps with is_index and one row for each entry: loc, lastmod."""
    entry = F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?s)(<(?:url|sitemap)>.*?</(?:url|sitemap)>)"), F.lit(1)))
    out = maps.withColumn("is_index", F.col(body).rlike("<sitemapindex")).withColumn("__e", entry)
    return out.withColumn("loc", _tag(F.col("__e"), "loc")).withColumn("lastmod", N.partial_date(F.substring(_tag(F.col("__e"), "lastmod"), 1, 10))).drop("__e")


def cdx_entries(rows: DataFrame, line: str) -> DataFrame:
    """rows with url, captured_at, status, digest of capture index lines; only captures of pages
    (status 200, no file extension of media) whose path gives a title of three words."""
    p = F.split(F.col(line), " ")
    out = rows.withColumn("captured_at", F.try_to_timestamp(F.try_element_at(p, F.lit(2)), F.lit("yyyyMMddHHmmss"))).withColumn("url", F.try_element_at(p, F.lit(3))).withColumn("status", F.try_element_at(p, F.lit(5))).withColumn("digest", F.try_element_at(p, F.lit(6)))
    title = T.slug_title(U.path(F.col("url")))
    good = (F.col("status") == "200") & ~F.lower(U.path(F.col("url"))).rlike(r"\.(jpe?g|png|gif|css|js|pdf|xml|svg|ico)$")
    return out.withColumn("title", title).where(good & (F.size(F.split("title", " ")) >= 3))


def decode(content: Column) -> Column:
    """Text of bytes: by byte-order mark, else by the XML declaration's Latin encodings, else UTF-8."""
    head = F.substring(content, 1, 4)
    declared = F.lower(F.regexp_extract(F.decode(F.substring(content, 1, 200), "ISO-8859-1"), r"""encoding=["']([\w-]+)["']""", 1))
    return (
        F.when(F.hex(F.substring(head, 1, 3)) == "EFBBBF", F.decode(F.substring(content, F.lit(4), F.length(content)), "UTF-8"))
        .when(F.hex(F.substring(head, 1, 2)).isin("FEFF", "FFFE"), F.decode(content, "UTF-16"))
        .when(declared.isin("iso-8859-1", "latin-1", "windows-1252"), F.decode(content, "ISO-8859-1"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def normalise(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and rejected rows (url, reason) of raw rows of DOCUMENT: cleaned title of at most
    500 characters and body of at most 20 000, canonical URL and its hash, content hash, quality."""
    out = raw.withColumn("canonical_url", U.canonical("url")).withColumn("title", T.truncate_words(T.clean_whitespace(T.strip_html("title")), 500)).withColumn("body", T.truncate_words(T.clean_whitespace(T.strip_html("body")), 20_000))
    reason = F.when(F.col("canonical_url").isNull(), "INVALID_URL").when(F.col("title") == "", "EMPTY_TITLE").when(F.lower("title").rlike(r"^(advertisement|sponsored)\b"), "ADVERTISEMENT")
    out = out.withColumn("reason", reason)
    kept = out.where("reason IS NULL").drop("reason").withColumn("url_hash", F.sha2("canonical_url", 256)).withColumn("domain", U.origin_domain("url")).withColumn("content_hash", T.content_hash("title", "body")).withColumn("text_quality", T.text_quality("body")).withColumn("doi", T.doi("doi"))
    return kept, out.where("reason IS NOT NULL").select("url", "reason")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One header per part file; the number of files is left to Spark."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_partition(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """name, ok: whether each file of a folder has the SHA-256 of the manifest (name, sha256)."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return manifest.join(files, "name", "left").select("name", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("ok"))


def report_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, topic, key, value of text reports: a line `== topic ==` opens a block of `key: value`
    lines. Files are small; each is one row, split in place."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    blocks = F.regexp_extract_all("value", F.lit(r"(?m)(^==[^\n]*==\n(?:(?!^==)[^\n]*\n?)*)"), F.lit(1))
    block = whole.select("file", F.explode(blocks).alias("b")).withColumn("topic", F.trim(F.regexp_extract("b", r"^==\s*(.*?)\s*==", 1)))
    line = block.select("file", "topic", F.posexplode(F.regexp_extract_all("b", F.lit(r"(?m)^([^=\n:][^\n:]*:[^\n]*)$"), F.lit(1))).alias("pos", "line"))
    return line.select("file", "topic", "pos", F.trim(F.split_part("line", F.lit(":"), F.lit(1))).alias("key"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))
