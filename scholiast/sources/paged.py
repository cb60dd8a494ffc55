"""Services that answer in pages, as a Spark source for batches and streams (SRC-10, SRC-11, SRC-24).

A service is an object that can be pickled, with `keys()`, `page(key, cursor, since)` -> (rows, next cursor or None) and `newest(key)`, the
cursor behind all that it has now. Rows are (published, *fields). Filters on `key` and a least `published` are pushed to the
service: only pages of those keys are asked for, with the day as the service's own filter, and what it sends from before that
day all the same is left out here. In a stream the offset is the cursor of every key, so a restart asks for nothing twice.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition

from scholiast.sources.files import place


class Service(Protocol):
    def keys(self) -> list[str]: ...

    def page(self, key: str, cursor: str, since: datetime.date | None) -> tuple[list[tuple], str | None]: ...

    def newest(self, key: str) -> str: ...


FIRST = "0"


@dataclass
class Span(InputPartition):
    """The pages of one key from a cursor on, up to another or to the last."""

    key: str
    begin: str
    end: str | None


def _rows(service: Service, span: Span, since: datetime.date | None, most: int | None) -> Iterator[tuple]:
    cursor, sent = span.begin, 0
    while cursor is not None and cursor != span.end:
        rows, cursor = service.page(span.key, cursor, since)
        for row in rows:
            if since is not None and (row[0] is None or row[0] < since):
                continue
            if most is not None and sent >= most:
                return
            sent += 1
            yield (span.key, *row)


class Reader(DataSourceReader):
    def __init__(self, service: Service, most: int | None):
        self.service, self.most, self.wanted, self.since = service, most, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("key",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("published",) and isinstance(f.value, datetime.date):
                self.since = f.value if self.since is None else max(self.since, f.value)
            else:
                yield f

    def partitions(self) -> list[Span]:
        keys = [k for k in self.service.keys() if self.wanted is None or k in self.wanted]
        return [Span(k, FIRST, None) for k in keys] or [Span("", FIRST, FIRST)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return _rows(self.service, partition, self.since, self.most)


class StreamReader(DataSourceStreamReader):
    def __init__(self, service: Service):
        self.service = service

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {k: self.service.newest(k) for k in self.service.keys()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(k, start.get(k, FIRST), to) for k, to in sorted(end.items()) if start.get(k, FIRST) != to] or [Span("", FIRST, FIRST)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return _rows(self.service, partition, None, None)

    def commit(self, end: dict) -> None:
        pass


def _source(service: Service, fields: str, most: int | None) -> type[DataSource]:
    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "pages_of_service"

        def schema(self) -> str:
            return f"key string, published date, {fields}"

        def reader(self, schema: object) -> Reader:
            return Reader(service, most)

        def streamReader(self, schema: object) -> StreamReader:  # noqa: N802
            return StreamReader(service)

    return Pages


def read_service(spark: SparkSession, service: Service, fields: str, most: int | None = None) -> DataFrame:
    """(key, published, *fields): what a service has, at most `most` rows of each key if given. Filter the result by key and day: it sets the session to push that down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(_source(service, fields, most))
    return spark.read.format("pages_of_service").load()


def stream_service(spark: SparkSession, service: Service, fields: str) -> DataFrame:
    """The same as a stream of what is new."""
    spark.dataSource.register(_source(service, fields, None))
    return spark.readStream.format("pages_of_service").load()


@dataclass
class FolderService:
    """Pages that lie as files `key-number.json` in a folder, each a list of [published, *fields]; a cursor is the number of the next page. For tests and for answers that were stored."""

    folder: str

    def _pages(self) -> list[tuple[str, int]]:
        system, at = place(self.folder)
        names = [f.base_name for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.endswith(".json") and "-" in f.base_name]
        return sorted((k, int(n)) for k, n in (name[: -len(".json")].rsplit("-", 1) for name in names))

    def keys(self) -> list[str]:
        return sorted({k for k, _ in self._pages()})

    def newest(self, key: str) -> str:
        return str(max((n + 1 for k, n in self._pages() if k == key), default=0))

    def page(self, key: str, cursor: str, since: datetime.date | None) -> tuple[list[tuple], str | None]:
        system, at = place(self.folder)
        path = f"{at}/{key}-{int(cursor)}.json"
        if system.get_file_info(path).type != fs.FileType.File:
            return [], None
        with system.open_input_stream(path) as file:
            rows = json.loads(file.read())
        return [(r[0] and datetime.date.fromisoformat(r[0]), *r[1:]) for r in rows], str(int(cursor) + 1)
