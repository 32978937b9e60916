"""Records of search services as documents: what each field of their public answers becomes.

Every mapping of a service takes a table of JSON texts, one record each, and gives formats.DOCUMENT. Records that
are no object, or have no usable title or link, are dropped. Texts are whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import phrases as P
from tidemark.functions import text as T

from .formats import DOCUMENT, _document

WEB = "^https?://"


def _parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    return rows.select(F.from_json(F.col(column), schema).alias("r")).where("r IS NOT NULL").select("r.*")


def _kept(rows: DataFrame) -> DataFrame:
    return rows.where((F.trim(F.coalesce("title", F.lit(""))) != "") & F.col("url").rlike(WEB)).withColumn("title", F.trim("title")).select(*DOCUMENT)


#: Entities of HTML texts, the ampersand last (fixed values).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _plain(c: Column) -> Column:
    out = T.strip_html(F.coalesce(c, F.lit("")))
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def scholar(rows: DataFrame, column: str) -> DataFrame:
    """Papers with paperId, url, title, abstract, year, publicationDate, citationCount, externalIds."""
    r = _parsed(rows, column, "paperId string, url string, title string, abstract string, year int, publicationDate string, citationCount int, externalIds struct<DOI:string,ArXiv:string>")
    url = F.when(F.col("url").rlike(WEB), F.col("url")).otherwise(F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.nullif("paperId", F.lit(""))))
    day = F.coalesce(N.partial_date(F.col("publicationDate")), F.make_date("year", F.lit(1), F.lit(1)))
    return _kept(_document(r, url=url, title=F.col("title"), body=F.coalesce("abstract", F.lit("")), published_at=day, doi=T.doi("externalIds.DOI"), citations=F.col("citationCount"), source=F.lit("scholar")))


def crossref(rows: DataFrame, column: str) -> DataFrame:
    """Works with DOI, URL, title (a list), abstract (JATS), issued (date parts), is-referenced-by-count."""
    r = _parsed(rows, column, "DOI string, URL string, title array<string>, abstract string, issued struct<`date-parts`:array<array<int>>>, `is-referenced-by-count` int")
    parts = F.get(F.col("issued.date-parts"), F.lit(0))
    day = F.try_make_timestamp(F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(1)), F.coalesce(F.get(parts, F.lit(2)), F.lit(1)), F.lit(0), F.lit(0), F.lit(0))
    title = F.get("title", F.lit(0))
    url = F.coalesce(F.nullif("URL", F.lit("")), F.concat(F.lit("https://doi.org/"), F.nullif("DOI", F.lit(""))))
    return _kept(_document(r, url=url, title=title, body=_joined(F.coalesce(title, F.lit("")), _plain(F.col("abstract"))), published_at=day, doi=T.doi("DOI"), citations=F.col("is-referenced-by-count"), source=F.lit("crossref")))


def repositories(rows: DataFrame, column: str) -> DataFrame:
    """Code repositories with html_url, full_name, name, description, topics, stargazers_count, created_at."""
    r = _parsed(rows, column, "html_url string, full_name string, name string, description string, topics array<string>, stargazers_count int, created_at string")
    topics = F.array_join(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 10), " ")
    return _kept(_document(r, url=F.col("html_url"), title=F.coalesce("full_name", "name"), body=_joined(F.coalesce("description", F.lit("")), topics), published_at=N.parse_timestamp(F.col("created_at")), engagement=F.col("stargazers_count"), source=F.lit("repositories")))


def models(rows: DataFrame, column: str, dataset: bool = False) -> DataFrame:
    """Models or data sets with id (owner/name), tags, likes, createdAt. Tags with a colon are technical."""
    r = _parsed(rows, column, "id string, modelId string, tags array<string>, likes int, createdAt string")
    r = r.withColumn("repo", F.trim(F.coalesce(F.nullif("id", F.lit("")), "modelId"))).where(F.contains("repo", F.lit("/")))
    tags = F.slice(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: ~F.contains(t, F.lit(":"))), 1, 20)
    name = F.replace(F.regexp_replace("repo", "^[^/]*/", ""), F.lit("-"), F.lit(" "))
    url = F.concat(F.lit("https://huggingface.co/" + ("datasets/" if dataset else "")), F.col("repo"))
    return _kept(_document(r, url=url, title=F.replace("repo", F.lit("/"), F.lit(" / ")), body=_joined(name, F.array_join(tags, " ")), published_at=N.parse_timestamp(F.col("createdAt")), engagement=F.col("likes"), source=F.lit("models")))


def deposits(rows: DataFrame, column: str) -> DataFrame:
    """Deposits with id, doi, links, metadata; only preprints, or those that don't say what they are."""
    meta = "struct<title:string,description:string,publication_date:string,language:string,doi:string,resource_type:struct<id:string,subtype:string>>"
    r = _parsed(rows, column, f"id string, doi string, links struct<self_html:string,html:string>, metadata {meta}")
    kind = F.col("metadata.resource_type")
    r = r.where(kind.isNull() | (F.coalesce(F.nullif(kind["id"], F.lit("")), F.concat(F.lit("publication-"), kind["subtype"])) == "publication-preprint"))
    url = F.coalesce("links.self_html", "links.html", F.concat(F.lit("https://zenodo.org/records/"), F.nullif("id", F.lit(""))))
    return _kept(_document(r, url=url, title=F.col("metadata.title"), body=_plain(F.col("metadata.description")), published_at=N.partial_date(F.col("metadata.publication_date")), language=T.language_code("metadata.language"), doi=T.doi(F.coalesce("doi", "metadata.doi")), source=F.lit("deposits")))


def news_articles(rows: DataFrame, column: str, languages: dict[str, str]) -> DataFrame:
    """Articles with title, url, seendate (20260923T120000Z), language (a name of `languages`)."""
    r = _parsed(rows, column, "title string, url string, seendate string, language string")
    names = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair]) if languages else F.create_map().cast("map<string,string>")
    seen = F.try_to_timestamp(F.col("seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return _kept(_document(r, url=F.col("url"), title=F.col("title"), body=F.trim("title"), published_at=seen, language=F.try_element_at(names, F.lower(F.trim("language"))), source=F.lit("news_articles")))


def stories(rows: DataFrame, column: str) -> DataFrame:
    """Stories with objectID, title, url, story_text, points, created_at, created_at_i; those without a
    link lead to their own page."""
    r = _parsed(rows, column, "objectID string, story_id string, title string, url string, story_text string, points int, created_at string, created_at_i long")
    item = F.coalesce(F.nullif("objectID", F.lit("")), "story_id")
    url = F.when(F.col("url").rlike(WEB), F.col("url")).otherwise(F.concat(F.lit("https://news.ycombinator.com/item?id="), item))
    when = F.coalesce(N.parse_timestamp(F.col("created_at")), F.timestamp_seconds("created_at_i"))
    return _kept(_document(r, url=url, title=F.col("title"), body=_joined(F.trim(F.coalesce("title", F.lit(""))), _plain(F.col("story_text"))), published_at=when, engagement=F.col("points"), source=F.lit("stories")))


def patents(rows: DataFrame, column: str, language: str = "en", site: str = "https://searchplatform.rospatent.gov.ru/doc/") -> DataFrame:
    """Patents with id, biblio (by language), snippet, common. The title is that of the snippet's
    language, else of ru, en or any other; else that of the snippet."""
    r = _parsed(rows, column, "id string, biblio map<string,struct<title:string>>, snippet struct<lang:string,title:string,description:string>, common struct<publication_date:string>")
    own = F.coalesce(F.nullif(F.lower("snippet.lang"), F.lit("")), F.lit(language))
    keys = F.concat(F.array(own, F.lit("ru"), F.lit("en")), F.array_sort(F.map_keys("biblio")))
    titles = F.filter(F.transform(keys, lambda k: F.trim(F.try_element_at(F.col("biblio"), k)["title"])), lambda t: t != "")
    title = F.coalesce(F.get(titles, F.lit(0)), "snippet.title")
    day = N.partial_date(F.replace("common.publication_date", F.lit("."), F.lit("-")))
    url = F.concat(F.lit(site), F.url_encode(F.nullif("id", F.lit(""))))
    return _kept(_document(r, url=url, title=title, body=_plain(F.col("snippet.description")), published_at=day, language=own, source=F.lit("patents")))


def encyclopedia(titles: DataFrame, key: str, summaries: DataFrame, views: DataFrame, revisions: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """key, found, url, views, created of titles (key) by an encyclopedia's recorded answers: summaries
    (key, status, url), where 4xx means that there is no article and a title without an answer is unknown
    (null); views (key, day, n) of the last `days` days, -1 without any answer; the first of revisions
    (key, at). Each side is reduced to one row a key before it is joined; repeated titles repeat, a null
    title is unknown. Of several answers the best (lowest status) counts."""
    said = summaries.groupBy(F.col(key).alias("k1")).agg(F.min(F.struct("status", "url")).alias("s"))
    seen = views.groupBy(F.col(key).alias("k2")).agg(F.sum(F.when((F.col("day") >= F.date_sub(now, days)) & (F.col("day") <= now), F.col("n")).otherwise(0)).cast("long").alias("v"))
    first = revisions.groupBy(F.col(key).alias("k3")).agg(F.min("at").alias("a"))
    out = titles.select(key).join(said, F.col(key) == F.col("k1"), "left").join(seen, F.col(key) == F.col("k2"), "left").join(first, F.col(key) == F.col("k3"), "left")
    found = F.when(F.col("s.status").between(200, 299), True).when(F.col("s.status").between(400, 499), False)
    only = lambda c: F.when(found, c)
    return out.select(key, found.alias("found"), only(F.col("s.url")).alias("url"), only(F.coalesce("v", F.lit(-1))).alias("views"), only(F.col("a")).alias("created"))


def positive_rows(rows: DataFrame, domains: dict[str, str], leaks: tuple[str, ...] = (), limit: int = 4000) -> DataFrame:
    """Training rows of label 1 from an expert's table (n, tech, domain, why, stage, sources): row_id,
    group_id, title, description (without phrases that leak the label and links, at most `limit`
    characters), domain, label, kind, source_urls. Columns beyond these are left out, as are the companies,
    which other rows lack."""
    domain = F.lower(F.trim(T.empty_if_null("domain")))
    known = F.coalesce(*[F.when(domain == k, v) for k, v in domains.items()], F.lit("other"))
    title = F.trim(T.empty_if_null("tech"))
    return rows.select(F.format_string("pos-%04d", F.col("n").cast("long")).alias("row_id"), T.slug(title).alias("group_id"), title.alias("title"), F.left(P.clean_description("why", leaks), F.lit(limit)).alias("description"), known.alias("domain"), F.lit(1).alias("label"), F.lit("WEAK_SIGNAL").alias("kind"), P.source_urls("sources").alias("source_urls"))


def negative_rows(rows: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Training rows of label 0 from candidates (n, title, description, domain, subtype, url), and the
    candidates refused with their reason: an unknown subtype, an empty title, or the title (letter case
    aside) of a candidate with a smaller n."""
    title, subtype = F.trim(T.empty_if_null("title")), F.lower(F.trim(T.empty_if_null("subtype")))
    first = rows.groupBy(F.lower(title).alias("__t")).agg(F.min("n").alias("__n"))
    kind = F.coalesce(*[F.when(subtype == k, v) for k, v in kinds.items()])
    reason = F.when(kind.isNull(), "UNKNOWN_SUBTYPE").when(title == "", "EMPTY_TITLE").when(F.col("n") > F.col("__n"), "REPEATED_TITLE")
    judged = rows.join(first, F.lower(title) == F.col("__t")).withColumn("__why", reason)
    urls = F.when(F.coalesce("url", F.lit("")) != "", F.array("url")).otherwise(F.array().cast("array<string>"))
    kept = judged.where("__why IS NULL").select(F.format_string("neg-%04d", F.col("n").cast("long")).alias("row_id"), T.slug(title).alias("group_id"), title.alias("title"), F.trim(T.empty_if_null("description")).alias("description"), "domain", F.lit(0).alias("label"), kind.alias("kind"), urls.alias("source_urls"))
    return kept, judged.where("__why IS NOT NULL").select("n", F.col("__why").alias("reason"))
