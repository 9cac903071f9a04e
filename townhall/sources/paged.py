"""Records that come in pages with a stated total, as a Spark source, for batches and streams.

    register(spark)
    spark.read.format("paged").option("limit", 500).load("https://site.example/records?limit={limit}&offset={offset}")
    spark.readStream.format("paged").option("limit", 500).load("/landed/page={page}")

A page is JSON: {"total": n, "records": [...]}. The address has {offset}, {limit} or {page} (from 0 on) for what tells pages
apart; a folder stands for the one file in it. Each page is one task's, so pages are fetched side by side, and a task that is
lost fetches its own again. Rows are number (the record's place, from 0 on) and record (its JSON).

A stream's offset is the number of records reached, so a run goes on where the checkpoint says, in the middle of a page,
too, if the total has grown since. All records up to the total have to be there: a page that is missing or too short
fails its task and, with it, the batch, and the next run fetches it again; nothing is lost or comes twice. Without a
first page there are no records yet."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SECONDS = 60


def fetch(address: str) -> dict | None:
    """The payload at an address; None where nothing is."""
    if address.startswith(("http://", "https://")):
        try:
            with urllib.request.urlopen(address, timeout=SECONDS) as response:
                return json.load(response)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise
    if address.startswith("file:"):
        address = "/" + address.removeprefix("file:").lstrip("/")
    system, path = pafs.FileSystem.from_uri(address) if "://" in address else (pafs.LocalFileSystem(), address)
    info = system.get_file_info(path)
    if info.type == pafs.FileType.Directory:
        inner = sorted(f.path for f in system.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and f.base_name[0] not in "._")
        info = system.get_file_info(inner[0]) if inner else info
    if info.type != pafs.FileType.File:
        return None
    with system.open_input_stream(info.path) as f:
        return json.loads(f.read())


@dataclass
class Page(InputPartition):
    """The records from first up to last (not with it), all of one page."""

    first: int
    last: int

    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Pages:
    def __init__(self, options: dict):
        self.template, self.limit = options["path"], int(options.get("limit", 500))
        if self.limit < 1:
            raise ValueError("a page has one record at least")

    def page(self, number: int) -> dict | None:
        values = {"offset": number * self.limit, "limit": self.limit, "page": number}
        address = self.template
        for name, value in values.items():
            address = address.replace(f"{{{name}}}", str(value))
        return fetch(address)

    def total(self) -> int:
        first = self.page(0)
        return int(first.get("total") or 0) if first else 0

    def between(self, start: int, end: int) -> list[Page]:
        """The pages that hold the records from start up to end, each with its part of them."""
        numbers = range(start // self.limit, -(-end // self.limit)) if end > start else ()
        return [Page(max(start, n * self.limit), min(end, (n + 1) * self.limit)) for n in numbers]

    def records(self, part: Page) -> Iterator[tuple[int, str]]:
        number = part.first // self.limit
        held = (self.page(number) or {}).get("records") or []
        skip = number * self.limit
        if len(held) < part.last - skip:
            raise ValueError(f"page {number} has {len(held)} records, and {part.last - skip} of the total are to be there")
        for n in range(part.first, part.last):
            yield n, json.dumps(held[n - skip], ensure_ascii=False)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def partitions(self) -> list[InputPartition]:
        return self.pages.between(0, self.pages.total()) or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        return self.pages.records(partition) if partition.last > partition.first else iter(())


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def initialOffset(self) -> dict:
        return {"records": 0}

    def latestOffset(self) -> dict:
        return {"records": self.pages.total()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.pages.between(start["records"], end["records"])

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        return self.pages.records(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """Pages of records. Options: path, the address of a page; limit, the records of a page."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "number bigint, record string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format paged known to a session."""
    spark.dataSource.register(PagedSource)
