"""Records of services, the harvest as a stream, and filters of recorded scans."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import harvest, records
from tidemark.sources.recorded import PushedReader, scan


def mapped(spark, f, *items, **more):
    rows = spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in items], "j string")
    return f(rows, "j", **more).collect()


def test_records_of_each_service(spark):
    r = mapped(spark, records.scholar, {"paperId": "p1", "title": " A ", "year": 2020, "externalIds": {"DOI": "10.1/AB"}, "citationCount": 7}, {"paperId": "p2", "url": "https://x.org/2", "title": "B", "abstract": "text", "publicationDate": "2021-03-04", "year": 1990}, {"title": "no link"}, {"paperId": "p3", "title": "  "}, "[]", "broken")
    assert [(x.url, x.title, x.body, x.published_at.date(), x.citations) for x in r] == [("https://www.semanticscholar.org/paper/p1", "A", "", date(2020, 1, 1), 7), ("https://x.org/2", "B", "text", date(2021, 3, 4), None)]
    assert r[0].doi == "10.1/ab"
    r = mapped(spark, records.crossref, {"DOI": "10.1/x", "title": ["T"], "abstract": "<jats:p>An  abstract &amp; more</jats:p>", "issued": {"date-parts": [[2023, 5]]}, "is-referenced-by-count": 3}, {"title": [], "DOI": "10.1/y"}, {"title": ["U"], "URL": "ftp://x", "DOI": ""}, {"title": ["V"], "URL": "http://v", "issued": {"date-parts": [[None]]}})
    assert [(x.url, x.title, x.published_at, x.citations) for x in r] == [("https://doi.org/10.1/x", "T", datetime(2023, 5, 1), 3), ("http://v", "V", None, None)]
    assert r[0].body == "T An abstract & more"
    r = mapped(spark, records.repositories, {"html_url": "https://g/a", "full_name": "o/a", "description": "does", "topics": ["t1", "t2"], "stargazers_count": 5, "created_at": "2024-02-03T04:05:06Z"}, {"html_url": "https://g/b"}, {"full_name": "o/c"})
    assert [(x.title, x.body, x.engagement, x.published_at) for x in r] == [("o/a", "does t1 t2", 5, datetime(2024, 2, 3, 4, 5, 6))]
    r = mapped(spark, records.models, {"id": "org/some-model", "tags": ["vision", "license:mit"], "likes": 4, "createdAt": "2024-01-01T00:00:00.000Z"}, {"modelId": "a/b"}, {"id": "flat"})
    assert [(x.url, x.title, x.body, x.engagement) for x in r] == [("https://huggingface.co/org/some-model", "org / some-model", "some model vision", 4), ("https://huggingface.co/a/b", "a / b", "b", None)]
    assert mapped(spark, records.models, {"id": "a/b"}, dataset=True)[0].url == "https://huggingface.co/datasets/a/b"
    meta = {"title": "Z", "description": "<p>d</p>", "publication_date": "2022-06"}
    r = mapped(spark, records.deposits, {"id": 7, "metadata": meta}, {"id": 8, "metadata": {**meta, "resource_type": {"id": "publication-preprint"}}}, {"id": 9, "metadata": {**meta, "resource_type": {"id": "dataset"}}}, {"id": 10, "metadata": {**meta, "resource_type": {"subtype": "preprint"}}})
    assert [(x.url, x.body) for x in r] == [(f"https://zenodo.org/records/{i}", "d") for i in (7, 8, 10)]
    r = mapped(spark, records.news_articles, {"title": " N ", "url": "http://n", "seendate": "20260923T120000Z", "language": "English"}, {"title": "x", "url": "n"}, {"title": "y", "url": "http://y", "seendate": "soon"}, languages={"english": "en"})
    assert [(x.title, x.published_at, x.language) for x in r] == [("N", datetime(2026, 9, 23, 12), "en"), ("y", None, None)]
    r = mapped(spark, records.stories, {"objectID": "1", "title": "Ask", "story_text": "<p>why&nbsp;not", "points": 9, "created_at_i": 0}, {"title": "no id"}, {"objectID": "2", "title": "L", "url": "https://l", "created_at": "2024-05-05T00:00:00Z"})
    assert [(x.url, x.engagement, x.published_at) for x in r] == [("https://news.ycombinator.com/item?id=1", 9, datetime(1970, 1, 1)), ("https://l", None, datetime(2024, 5, 5))]
    r = mapped(spark, records.patents, {"id": "RU 1/2", "biblio": {"en": {"title": "E"}, "ru": {"title": "R"}}, "snippet": {"lang": "de", "description": "s"}, "common": {"publication_date": "2024.03.02"}}, {"id": "2", "biblio": {"fr": {"title": "F"}}}, {"id": "3"}, {"biblio": {"en": {"title": "none"}}})
    assert [(x.title, x.language) for x in r] == [("R", "de"), ("F", "en")] and r[0].published_at == datetime(2024, 3, 2) and "RU+1%2F2" in r[0].url


def page(records_, token=""):
    body = "".join(f'<record><header{" status=\'deleted\'" if gone else ""}><datestamp>{changed}</datestamp></header><metadata><x:arXiv xmlns:x="u"><x:id>{i}</x:id><x:created>{created}</x:created><x:title>T {i}\n v</x:title><x:abstract>a</x:abstract><x:categories>c.a c.b</x:categories></x:arXiv></metadata></record>' for i, created, changed, gone in records_)
    return f'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>{body}<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>'


def test_harvest_stops_and_goes_on(spark, tmp_path):
    """A query stops in the middle of a list and restarts from its checkpoint; each record comes once,
    and a changed one again."""
    spark.dataSource.register(harvest.HarvestSource)
    src = tmp_path / "pages"
    src.mkdir()

    def run():
        stream = spark.readStream.format("harvest").option("path", f"file://{src}").option("since", "2021").load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.paper_id, str(r.changed), r.page) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (src / "start.xml").write_text(page([("1", "2022-01-01", "2024-01-01", False), ("2", "2019-01-01", "2024-01-01", False), ("3", "2022-01-01", "2024-01-02", True)], "t1"))
    assert run() == [("1", "2024-01-01", "start")]
    assert run() == [("1", "2024-01-01", "start")]  # nothing new
    (src / "t1.xml").write_text(page([("4", "2023-01-01", "2024-01-05", False)], "t2"))
    (src / "t2.xml").write_text(page([("5", "2023-01-01", "2024-01-03", False)]))
    assert run() == [("1", "2024-01-01", "start"), ("4", "2024-01-05", "t1"), ("5", "2024-01-03", "t2")]
    (src / "from-2024-01-05.xml").write_text(page([("1", "2022-01-01", "2024-02-01", False), ("6", "2024-01-30", "2024-02-01", False)]))
    got = run()
    assert len(got) == 5 and ("1", "2024-02-01", "from-2024-01-05") in got
    assert run() == got
    newest = {r.paper_id: str(r.changed) for r in harvest.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert newest == {"1": "2024-02-01", "4": "2024-01-05", "5": "2024-01-03", "6": "2024-02-01"}
    whole = spark.read.format("harvest").option("path", f"file://{src}").load()
    assert whole.count() == 6 and {tuple(r.categories) for r in whole.collect()} == {("c.a", "c.b")} and whole.first().title.endswith(" v")


@pytest.fixture
def recorded(tmp_path):
    for source, phrase, day in (("works", "solid cells", "2024-01-01"), ("works", "fuel cells", "2021-01-01"), ("news", "solid cells", "2023-01-01"), ("code", "robots", None)):
        p = tmp_path / source / phrase
        p.mkdir(parents=True)
        (p / "1.json").write_text(json.dumps({"items": [{"url": f"{source}/{phrase}", "title": "t", "published": day}]}))
    return f"file://{tmp_path}"


def test_filters_reach_the_pages(spark, recorded):
    def rows(condition):
        return scan(spark, condition, path=recorded)

    works = F.col("source") == "works"
    pages = rows(works).rdd.getNumPartitions()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert pages == 4 and rows(works).rdd.getNumPartitions() == 2
        assert {r.phrase for r in rows(works).collect()} == {"solid cells", "fuel cells"}
        two = F.col("source").isin("works", "news") & F.col("phrase").startswith("solid")
        assert rows(two).rdd.getNumPartitions() == 2 and rows(two).count() == 2
        assert [r.url for r in rows(F.col("published") >= "2023-06-01").collect()] == ["works/solid cells"]
        assert rows(F.col("published").isNull()).count() == 1 and rows(F.lit(True)).count() == 4
        assert rows(F.col("source") == "none").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert rows(works).count() == 2


def test_what_can_not_be_settled_is_given_back():
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull, Not

    reader = PushedReader({"path": "file:///x"})
    filters = [EqualTo(("source",), "a"), GreaterThan(("published",), "2020"), IsNull(("title",)), Not(EqualTo(("phrase",), "b"))]
    assert list(reader.pushFilters(filters)) == filters[1:] and reader.least == "2020"


def test_dates_of_feeds(spark):
    from tidemark.functions import numeric as N

    want = {"Fri, 05 Jan 2024 06:07:08 GMT": datetime(2024, 1, 5, 6, 7, 8), "5 Jan 2024 06:07 +0100": datetime(2024, 1, 5, 5, 7), "Fri, 05 Jan 2024 06:07:08 EST": datetime(2024, 1, 5, 11, 7, 8), "2024-01-05T06:07:08Z": datetime(2024, 1, 5, 6, 7, 8), "Fri, 05 Jan 2024 06:07:08 XYZ": None, "soon": None, None: None}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", N.parse_timestamp(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == want
