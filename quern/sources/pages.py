"""A Spark data source over paged JSON services: executors read ranges of pages and post batches of rows.

``spark.dataSource.register(PagedJson)`` once, then ``spark.read.format("quern_pages").schema(..).options(url=.., total=..)``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _call(url: str, body: bytes | None = None) -> bytes:
    with urlopen(Request(url, data=body, headers={"Content-Type": "application/json"}), timeout=60) as r:  # noqa: S310
        return r.read()


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    """options: url; total (rows the service has), page_size, pages_per_task; data_path (dots lead to the list of records)."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)
        self.size = int(self.options.get("page_size", "1000"))

    def partitions(self) -> list[Pages]:
        pages = -(-int(self.options["total"]) // self.size)
        step = max(1, int(self.options.get("pages_per_task", "100")))
        return [Pages(k, min(k + step, pages)) for k in range(0, pages, step)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        """One page at a time is held.  A page that comes short in the middle is an error, not the end."""
        total, url = int(self.options["total"]), self.options["url"]
        for page in range(partition.first, partition.last):
            at = page * self.size
            data = json.loads(_call(f"{url}{'&' if '?' in url else '?'}offset={at}&limit={self.size}"))
            for part in filter(None, self.options.get("data_path", "").split(".")):
                data = data[part]
            if len(data) != min(self.size, total - at):
                raise ValueError(f"page {page} has {len(data)} rows")
            for r in data:
                yield tuple(self._cell(r.get(f.name), f.dataType.simpleString()) for f in self.schema.fields)

    @staticmethod
    def _cell(v: object, kind: str) -> object:
        if v is None or kind != "string":
            return v
        return v if isinstance(v, str) else json.dumps(v)


class PagedWriter(DataSourceWriter):
    """Posts rows as JSON arrays of at most ``batch`` rows; a task that is run again posts its rows again (at least once)."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.names, dict(options)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        held: list[dict] = []
        for row in iterator:
            held.append(dict(zip(self.names, row, strict=True)))
            if len(held) == int(self.options.get("batch", "500")):
                self._post(held)
                held = []
        if held:
            self._post(held)
        return WriterCommitMessage()

    def _post(self, rows: list[dict]) -> None:
        _call(self.options["url"], json.dumps(rows, default=str).encode())


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_pages"

    def schema(self) -> str:
        if "schema" not in self.options:
            raise ValueError("give a schema")
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a service can't be overwritten")
        return PagedWriter(schema, self.options)
