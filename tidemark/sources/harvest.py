"""An incremental harvest of record lists as a stream: format("harvest").

A list comes in pages; a page names the next one by a resumption token, and its records bear the date
on which they last changed. When a list has ended, the next one asks for what changed since the latest
date seen. Pages are recorded files of one folder: `start.xml`, `<token>.xml` behind a page with that
token, and `from-<date>.xml` for the list since a date.

Options: path (a folder that the driver can list and tasks can read), since (first year of creation).
Each page is a partition, which a task fetches and reads; the driver reads the end of a page for its
token. An offset holds how many pages have been given out, so that a query that restarts from its
checkpoint goes on behind them. Records that were deleted, that are older than `since`, or that have
no identifier or title are left out. A record that changed later comes once more, with its new date;
latest() keeps the newest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "paper_id string, title string, abstract string, categories array<string>, created date, changed date, page string"


class Page(InputPartition):
    def __init__(self, path: str, name: str):
        super().__init__(name)
        self.path, self.name = path, name


def _read(path: str) -> bytes | None:
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    if store.get_file_info(where).type != fs.FileType.File:
        return None
    with store.open_input_stream(where) as f:
        return f.read()


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _field(record, name: str) -> str:
    return next((" ".join("".join(e.itertext()).split()) for e in record.iter() if _tag(e) == name), "")


def token_and_date(page: bytes) -> tuple[str, str]:
    """The resumption token of a page (empty at the end of a list) and its latest change."""
    token = re.search(rb"<(?:\w+:)?resumptionToken[^>]*>\s*([^<\s]*)\s*<", page)
    dates = re.findall(rb"<(?:\w+:)?datestamp>\s*(\d{4}-\d\d-\d\d)", page)
    return (token[1].decode() if token else ""), max((d.decode() for d in dates), default="")


def records(page: bytes, since: int) -> Iterator[tuple]:
    """paper_id, title, abstract, categories, created, changed of the records of a page that count."""
    from datetime import date

    for record in (e for e in ElementTree.fromstring(page).iter() if _tag(e) == "record"):
        header = next((e for e in record if _tag(e) == "header"), None)
        if header is not None and header.get("status") == "deleted":
            continue
        created, changed = _field(record, "created"), _field(record, "datestamp")
        paper, title = _field(record, "id"), _field(record, "title")
        if not re.fullmatch(r"\d{4}-\d\d-\d\d", created) or int(created[:4]) < since or not paper or not title:
            continue
        yield paper, title, _field(record, "abstract"), _field(record, "categories").split(), date.fromisoformat(created), date.fromisoformat(changed) if changed else None


class _Lists:
    """The pages that are there, in order: name -> the name behind it."""

    def __init__(self, options: dict):
        self.root, self.since = options["path"].rstrip("/"), int(options.get("since", 0))
        self.names: list[str] = []
        self.next, self.latest = "start", ""

    def extend(self) -> list[str]:
        """All pages known by now; goes on from the last one that was there."""
        while (page := _read(f"{self.root}/{self.next}.xml")) is not None:
            self.names.append(self.next)
            token, day = token_and_date(page)
            asked = self.next
            self.latest = max(self.latest, day)
            self.next = token or f"from-{self.latest}"
            if self.next == asked or self.next in self.names:  # nothing has changed since
                break
        return self.names

    def page(self, name: str) -> Page:
        return Page(f"{self.root}/{name}.xml", name)

    def rows(self, page: Page | None) -> Iterator[tuple]:
        if page is None:  # no page is there yet
            return
        for row in records(_read(page.path) or b"<none/>", self.since):
            yield *row, page.name


class HarvestStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.lists = _Lists(options)

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(self.lists.extend())}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [self.lists.page(n) for n in self.lists.extend()[start["pages"] : end["pages"]]]

    def read(self, page: Page) -> Iterator[tuple]:
        return self.lists.rows(page)


class HarvestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.lists = _Lists(options)

    def partitions(self) -> list[Page]:
        return [self.lists.page(n) for n in self.lists.extend()]

    def read(self, page: Page) -> Iterator[tuple]:
        return self.lists.rows(page)


class HarvestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HarvestReader:
        return HarvestReader(dict(self.options))

    def streamReader(self, schema) -> HarvestStream:
        return HarvestStream(dict(self.options))


def latest(rows: DataFrame) -> DataFrame:
    """The newest version of each record (by changed, null first; ties by page)."""
    newest = F.max_by(F.struct(*[c for c in rows.columns if c != "paper_id"]), F.struct(F.col("changed").isNotNull(), "changed", "page"))
    return rows.groupBy("paper_id").agg(newest.alias("r")).select("paper_id", "r.*")
