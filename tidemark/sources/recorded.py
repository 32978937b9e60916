"""A Python data source that replays recorded search responses: format("recorded").

Options: path (a folder of <source>/<phrase>/<page>.json files), since (first year), cap. One
partition for each recorded page; rows are url, title, published, source, phrase. Undated rows pass
the year filter. The folder is listed where the reader is planned, so it must be a path that the
driver can list; tasks read their own file.

With the option pushdown (and spark.sql.python.filterPushdown.enabled in the session, without which
Spark refuses such a reader), conditions on source and phrase (equal, in a list, with a prefix) are
settled by the pages that are planned: others are not read. A lower bound of published drops rows
where they are read; Spark applies it once more. Spark 4.1 keeps one reader for each load(), with the
filters that it was given last, so such a DataFrame is for one query: scan() loads a new one."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith

SCHEMA = "url string, title string, published string, source string, phrase string"


class Page(InputPartition):
    def __init__(self, path: str, source: str, phrase: str):
        super().__init__(path)
        self.path, self.source, self.phrase = path, source, phrase


class RecordedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.since, self.cap = options["path"], int(options.get("since", 0)), int(options["cap"]) if "cap" in options else None
        self.planned: list[tuple[str, Filter]] = []
        self.least = ""

    def wanted(self, page: Page) -> bool:
        for name, f in self.planned:
            value = getattr(page, name)
            if isinstance(f, StringStartsWith):
                fits = value.startswith(f.value)
            else:
                fits = value in f.value if isinstance(f, In) else value == f.value
            if not fits:
                return False
        return True

    def partitions(self) -> list[Page]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.root)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".json"))
        return [p for p in (Page(f, *f.split("/")[-3:-1]) for f in files) if self.wanted(p)]

    def read(self, page: Page | None) -> Iterator[tuple]:
        from pyarrow import fs

        if page is None:  # no page is planned
            return

        store, _ = fs.FileSystem.from_uri(self.root)
        with store.open_input_stream(page.path) as f:
            items = json.loads(f.read()).get("items", [])
        for x in items[: self.cap]:
            year = (x.get("published") or "")[:4]
            early = self.least and (x.get("published") or "") < self.least
            if x.get("url") and not early and (not year.isdigit() or int(year) >= self.since):
                yield x["url"], x.get("title"), x.get("published"), page.source, page.phrase


class PushedReader(RecordedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in ("source", "phrase") and isinstance(f, EqualTo | In | StringStartsWith):
                self.planned.append((name, f))
                continue
            if name == "published" and isinstance(f, GreaterThan | GreaterThanOrEqual) and isinstance(f.value, str):
                self.least = max(self.least, f.value)
            yield f


class RecordedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordedReader:
        options = dict(self.options)
        return PushedReader(options) if options.get("pushdown", "false").lower() == "true" else RecordedReader(options)


def scan(spark: SparkSession, condition: Column, **options: str) -> DataFrame:
    """The recorded rows that fit a condition, which is pushed down where the session allows it."""
    spark.dataSource.register(RecordedSource)
    on = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") or "false"
    return spark.read.format("recorded").options(**options, pushdown=on).load().where(condition)
