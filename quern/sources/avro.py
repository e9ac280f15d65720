"""Avro values of messages, decoded in Arrow batches by the public binary format."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_PLAIN = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "null": T.StringType()}


class Reader:
    """Reads values from bytes, one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the value ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        out = shift = 0
        while True:
            byte = self.take(1)[0]
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out >> 1 ^ -(out & 1)
            shift += 7
            if shift > 63:
                raise ValueError("a number is too long")

    def blocks(self, one: Callable[[], None]) -> None:
        while n := self.long():
            if n < 0:
                n = -n
                self.long()
            for _ in range(n):
                one()


def _kind(schema: object, names: dict[str, object]) -> object:
    """The schema with named types resolved and single-entry forms unwrapped."""
    if isinstance(schema, dict) and schema.get("name"):
        names[schema["name"]] = schema
    if isinstance(schema, dict) and isinstance(schema["type"], (dict, list)):
        return _kind(schema["type"], names)
    if isinstance(schema, str) and schema not in _PLAIN:
        return names[schema]
    return schema


def read_value(r: Reader, schema: object, names: dict[str, object]) -> object:
    schema = _kind(schema, names)
    if isinstance(schema, list):
        return read_value(r, schema[r.long()], names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "null":
        return None
    if kind == "boolean":
        return r.take(1) == b"\x01"
    if kind in ("int", "long"):
        return r.long()
    if kind in ("float", "double"):
        return struct.unpack("<f" if kind == "float" else "<d", r.take(4 if kind == "float" else 8))[0]
    if kind in ("bytes", "string"):
        data = r.take(r.long())
        return data.decode() if kind == "string" else data
    if kind == "fixed":
        return r.take(schema["size"])
    if kind == "enum":
        return schema["symbols"][r.long()]
    if kind == "record":
        return {f["name"]: read_value(r, f["type"], names) for f in schema["fields"]}
    if kind == "array":
        out: list = []
        r.blocks(lambda: out.append(read_value(r, schema["items"], names)))
        return out
    if kind == "map":
        got: dict = {}

        def entry() -> None:
            k = r.take(r.long()).decode()
            got[k] = read_value(r, schema["values"], names)

        r.blocks(entry)
        return got
    raise ValueError(f"unknown type {kind}")


def _column(schema: object, names: dict[str, object]) -> T.DataType:
    """The column type of a field: plain types as they are, unions with null as their other type, nested values as JSON text."""
    schema = _kind(schema, names)
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        return _column(rest[0], names) if len(rest) == 1 else T.StringType()
    kind = schema["type"] if isinstance(schema, dict) else schema
    return T.BinaryType() if kind == "fixed" else _PLAIN.get(kind, T.StringType())


def decode_messages(df: DataFrame, schema_json: str) -> DataFrame:
    """(kafka_offset, fields) from (kafka_offset, value); a value may have the registry's five-byte header.

    Null values and values that don't fit the schema have null fields; nested fields are JSON text.
    """
    schema = json.loads(schema_json)
    names: dict[str, object] = {}
    kinds = [_column(f["type"], names) for f in schema["fields"]]
    fields = [f["name"] for f in schema["fields"]]

    def text(v: object, kind: T.DataType) -> object:
        if v is None or not isinstance(kind, T.StringType) or isinstance(v, str):
            return v
        return json.dumps(v, default=lambda b: b.decode("latin-1"))

    def one(data: bytes | None) -> list:
        known: dict[str, object] = {}
        for skip in (5, 0) if data and data[0] == 0 and len(data) > 5 else (0,):
            if data is None:
                break
            try:
                r = Reader(data[skip:])
                got = read_value(r, schema, known)
                if r.at == len(r.data):
                    return [text(got[f], k) for f, k in zip(fields, kinds, strict=True)]
            except (ValueError, IndexError, KeyError, UnicodeDecodeError):
                continue
        return [None] * len(fields)

    out = T.StructType([T.StructField("kafka_offset", T.LongType()), *(T.StructField(f, k) for f, k in zip(fields, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            rows = [one(v) for v in b.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], to_arrow_type(t)) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["kafka_offset", *fields])

    return df.select("kafka_offset", "value").mapInArrow(run, out)
