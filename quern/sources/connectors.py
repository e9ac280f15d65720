"""Connectors: one interface over file, database, message and service sources and sinks, with a registry by kind.

A connector lists its entities, describes and previews them, reads an entity as a DataFrame, writes one, and says whether it can
be reached.  New kinds are added with ``register_connector``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..plans.store import Store
from . import files, remote


class Connector:
    """What every kind offers; settings are keyword arguments of its own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def entities(self) -> list[str]:
        return []

    def read(self, entity: str | None = None) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} does not read")

    def write(self, df: DataFrame, entity: str | None = None, mode: str = "append", key: Sequence[str] = ()) -> None:
        raise NotImplementedError(f"{type(self).__name__} does not write")

    def describe(self, entity: str | None = None) -> list[tuple[str, str]]:
        """Column names and types; nothing is read but what the schema needs."""
        return self.read(entity).dtypes

    def preview(self, entity: str | None = None, rows: int = 100) -> DataFrame:
        return self.read(entity).limit(rows)

    def ping(self) -> tuple[bool, str]:
        """Whether it can be reached, and why not."""
        try:
            self.entities()
            return True, ""
        except Exception as e:  # the answer to the caller's question
            return False, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


class Files(Connector):
    """Entities are the files and folders of ``path`` of the kind; without an entity the path itself is read."""

    suffix = ""

    def __init__(self, spark: SparkSession, path: str, **options):
        super().__init__(spark)
        self.path, self.options = path.rstrip("/"), options

    def _at(self, entity: str | None) -> str:
        return f"{self.path}/{entity}" if entity else self.path

    def entities(self) -> list[str]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = list(fs.globStatus(p) or []) if any(c in self.path for c in "*?[{") else [fs.getFileStatus(p)]
        if len(found) == 1 and found[0].isDirectory():
            found = list(fs.listStatus(found[0].getPath()))
        names = [s.getPath().getName() for s in found]
        return sorted(n for n in names if n.endswith(self.suffix) and n[0] not in "._")


class Csv(Files):
    """Options: delimiter, encoding, strict, nulls."""

    suffix = ".csv"

    def read(self, entity: str | None = None) -> DataFrame:
        return files.read_csv(self.spark, self._at(entity), **self.options)

    def write(self, df: DataFrame, entity: str | None = None, mode: str = "append", key: Sequence[str] = ()) -> None:
        _no_key(key)
        files.write_csv(df, self._at(entity), mode)


class Parquet(Files):
    suffix = ".parquet"

    def read(self, entity: str | None = None) -> DataFrame:
        return self.spark.read.options(**self.options).parquet(self._at(entity))

    def write(self, df: DataFrame, entity: str | None = None, mode: str = "append", key: Sequence[str] = ()) -> None:
        _no_key(key)
        df.write.options(**self.options).mode(mode).parquet(self._at(entity))


class Xml(Files):
    """row_tag: the element of a row; by default the most frequent child of the root in the first file."""

    suffix = ".xml"

    def __init__(self, spark: SparkSession, path: str, row_tag: str | None = None):
        super().__init__(spark, path)
        self.row_tag = row_tag

    def read(self, entity: str | None = None) -> DataFrame:
        at = self._at(entity)
        return files.read_xml(self.spark, at, self.row_tag or files.guess_row_tag(self.spark, at))

    def write(self, df: DataFrame, entity: str | None = None, mode: str = "append", key: Sequence[str] = ()) -> None:
        _no_key(key)
        files.write_xml(df, self._at(entity), self.row_tag or "row", mode=mode)


class Database(Connector):
    """A database over JDBC; with a key, writes are upserts."""

    def __init__(self, spark: SparkSession, url: str, dialect: str | None = None, partition: Sequence[object] | None = None, **properties: str):
        super().__init__(spark)
        self.jdbc = remote.Jdbc(url, dialect or remote.dialect_of(url), tuple(properties.items()))
        self.partition = tuple(partition) if partition else None

    def entities(self) -> list[str]:
        return self.jdbc.tables(self.spark)

    def read(self, entity: str | None = None) -> DataFrame:
        return self.jdbc.read(self.spark, entity, partition=self.partition)

    def changes(self, slot: str, most: int = 100_000) -> DataFrame:
        """(lsn, xid, data) that wait in a logical slot, without taking them; ``confirm`` takes what was applied."""
        return self.spark.read.format("jdbc").options(url=self.jdbc.url, dbtable=f"({remote.slot_query(slot, most)}) q", **dict(self.jdbc.properties)).load()

    def confirm(self, slot: str, lsn: str) -> None:
        self.jdbc.execute(self.spark, [remote.confirm_statement(slot, lsn)])

    def write(self, df: DataFrame, entity: str | None = None, mode: str = "append", key: Sequence[str] = ()) -> None:
        if key:
            self.jdbc.upsert(df, entity, list(key))
        else:
            self.jdbc.write(df, entity, mode)


class Kafka(Connector):
    """Entities are topics.  fmt: json (with ``schema``), csv (with ``schema``), avro (``schema`` is Avro's JSON) or text."""

    def __init__(self, spark: SparkSession, servers: str, fmt: str = "json", schema: str = "", group: str | None = None, start: str = "earliest", reader: str = "kafka", **options: str):
        super().__init__(spark)
        self.servers, self.fmt, self.schema, self.group, self.start, self.reader, self.options = servers, fmt, schema, group, start, reader, options

    def read(self, entity: str | None = None) -> DataFrame:
        raw = self.spark.read.format(self.reader).options(**remote.kafka_options(self.servers, entity, self.group, self.start), **self.options).load()
        return remote.parse_messages(raw, self.schema, self.fmt)

    def stream(self, entity: str) -> DataFrame:
        """The topic as a stream; its offsets are kept in the query's checkpoint, after each batch (at least once)."""
        raw = self.spark.readStream.format(self.reader).options(**remote.kafka_options(self.servers, entity, self.group, self.start), **self.options).load()
        return remote.parse_messages(raw, self.schema, self.fmt)

    def write(self, df: DataFrame, entity: str | None = None, mode: str = "append", key: Sequence[str] = ()) -> None:
        remote.to_messages(df, key[0] if key else None).write.format(self.reader).option("kafka.bootstrap.servers", self.servers).option("topic", entity).options(**self.options).save()


class JsonHttp(Connector):
    """Entities are paths under ``url``; settings as of ``remote.read_json_http``."""

    def __init__(self, spark: SparkSession, url: str, fetch: remote.Fetch = remote.http_fetch, **settings):
        super().__init__(spark)
        self.url, self.fetch, self.settings = url.rstrip("/"), fetch, settings

    def _at(self, entity: str | None) -> str:
        return f"{self.url}/{entity}" if entity else self.url

    def read(self, entity: str | None = None) -> DataFrame:
        return remote.read_json_http(self.spark, self._at(entity), fetch=self.fetch, **self.settings)

    def write(self, df: DataFrame, entity: str | None = None, mode: str = "append", key: Sequence[str] = ()) -> None:
        remote.post_rows(df, self._at(entity), send=self.fetch)

    def ping(self) -> tuple[bool, str]:
        try:
            self.fetch(self.url, None, {})
            return True, ""
        except Exception as e:
            return False, f"{type(e).__name__}: {e}"


class Soap(JsonHttp):
    """template: the request with ``{StartRow}`` and ``{PageSize}``; row_tag: the element of a row; operation: the element of a write."""

    def read(self, entity: str | None = None) -> DataFrame:
        return remote.read_soap(self.spark, self.url, self.settings["template"], self.settings.get("row_tag") or entity, int(self.settings.get("page_size", 100)), self.fetch)

    def write(self, df: DataFrame, entity: str | None = None, mode: str = "append", key: Sequence[str] = ()) -> None:
        remote.post_soap(df, self.url, entity or self.settings.get("operation", "Insert"), send=self.fetch)


class Eai(JsonHttp):
    """data_path: where the records stand; page_size: rows of a page."""

    def read(self, entity: str | None = None) -> DataFrame:
        return remote.read_eai(self.spark, self._at(entity), self.settings.get("data_path", "items"), int(self.settings.get("page_size", 100)), self.fetch)

    def write(self, df: DataFrame, entity: str | None = None, mode: str = "append", key: Sequence[str] = ()) -> None:
        remote.post_eai(df, self.url, entity or "Object", send=self.fetch)


def _no_key(key: Sequence[str]) -> None:
    if key:
        raise ValueError("files have no keys; upsert into a table instead")


class XmlHttp(JsonHttp):
    """row_tag: the element of a row, by default the most frequent child of the root; the driver fetches one document."""

    def read(self, entity: str | None = None) -> DataFrame:
        return remote.read_xml_http(self.spark, self._at(entity), self.settings.get("row_tag"), self.fetch)

    def write(self, df: DataFrame, entity: str | None = None, mode: str = "append", key: Sequence[str] = ()) -> None:
        remote.post_soap(df, self._at(entity), self.settings.get("root_tag", "rows"), send=self.fetch, envelope=False)


CONNECTORS: dict[str, Callable[..., Connector]] = {"csv": Csv, "parquet": Parquet, "xml": Xml, "jdbc": Database, "kafka": Kafka, "json_http": JsonHttp, "xml_http": XmlHttp, "soap": Soap, "eai": Eai}
for _dialect in ("postgresql", "greenplum", "mssql", "oracle"):
    CONNECTORS[_dialect] = lambda spark, url, _d=_dialect, **kw: Database(spark, url, _d, **kw)


def register_connector(kind: str, make: Callable[..., Connector]) -> None:
    CONNECTORS[kind] = make


def open_connector(spark: SparkSession, kind: str, **settings) -> Connector:
    if kind not in CONNECTORS:
        raise ValueError(f"unknown connector {kind}; there are {sorted(CONNECTORS)}")
    return CONNECTORS[kind](spark, **settings)


class Connections:
    """Named settings of connectors, kept in a store.  ``${NAME}`` in a value is the environment's, so that secrets aren't kept."""

    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store

    def save(self, name: str, kind: str, **settings) -> None:
        if kind not in CONNECTORS:
            raise ValueError(f"unknown connector {kind}")
        self.store.write(f"connection-{name}", {"kind": kind, "settings": settings})

    def names(self) -> list[str]:
        return [n.removeprefix("connection-") for n in self.store.names() if n.startswith("connection-")]

    def delete(self, name: str) -> bool:
        return self.store.delete(f"connection-{name}")

    def open(self, name: str, **more) -> Connector:
        _, found = self.store.read(f"connection-{name}")
        if not found:
            raise KeyError(f"no connection {name}")
        fill = lambda v: re.sub(r"\$\{(\w+)\}", lambda m: os.environ[m[1]], v) if isinstance(v, str) else v
        return open_connector(self.spark, found["kind"], **{k: fill(v) for k, v in (found["settings"] | more).items()})
