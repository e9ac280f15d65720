"""File sources and sinks: CSV with the null contract, Parquet, XML, encodings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def detect_encoding(data: bytes) -> str:
    """BOM, else valid UTF-8, else the Cyrillic code page whose lower-case letters are most frequent."""
    for bom, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(bom):
            return name
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    common = set("оеаинтсрвлкмдпуя ")
    return max(("cp1251", "cp866", "koi8-r"), key=lambda e: sum(c in common for c in data.decode(e, "replace")))


def sniff_encoding(spark: SparkSession, path: str, most: int = 1 << 20) -> str:
    """The encoding of the first file, by its first ``most`` bytes (without a character that the cut may have split)."""
    data = head(spark, path, most)
    if len(data) == most:
        data = data[: data.rfind(b"\n") + 1] or data
    return detect_encoding(data)


def split_csv(text: str, delimiter: str = ",") -> list[list[tuple[str, bool]]]:
    """Records of (value, quoted) fields by RFC 4180; line breaks may stand in quotes; a quote out of place is an error."""
    rows, row, i, n = [], [], 0, len(text)
    while i < n:
        if text[i] == '"':
            end, parts = i + 1, []
            while True:
                q = text.find('"', end)
                if q < 0:
                    raise ValueError("a quoted field has no end")
                parts.append(text[end:q])
                if text[q + 1 : q + 2] != '"':
                    break
                parts.append('"')
                end = q + 2
            i = q + 1
            if i < n and text[i] not in (delimiter, "\n", "\r"):
                raise ValueError("text after a closing quote")
            row.append(("".join(parts), True))
        else:
            end = i
            while end < n and text[end] not in (delimiter, "\n", "\r"):
                if text[end] == '"':
                    raise ValueError("a quote within an unquoted field")
                end += 1
            row.append((text[i:end], False))
            i = end
        if i < n and text[i] == delimiter:
            i += 1
            if i == n:
                row.append(("", False))
            continue
        if text[i : i + 2] == "\r\n":
            i += 1
        i += 1
        rows.append(row)
        row = []
    if row:
        rows.append(row)
    return [r for r in rows if r != [("", False)]]


#: The character sets that Spark's own readers know.
SPARK_CHARSETS = ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32")


def _first_file(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """The first file that has bytes, and their number; contents are not read."""
    found = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length").orderBy("path").first()
    return (found[0], found[1]) if found else None


def head(spark: SparkSession, path: str, most: int = 1 << 20) -> bytes:
    """The first ``most`` bytes of the first file that has bytes."""
    found = _first_file(spark, path)
    if not found:
        return b""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(found[0])
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(found[1], most)))
    finally:
        stream.close()


def _first_line(spark: SparkSession, path: str, encoding: str, most: int = 1 << 20) -> str:
    """The first line of the first file that has bytes."""
    return head(spark, path, most).decode(encoding, "ignore").lstrip("\ufeff").split("\n")[0].rstrip("\r")


def _records(spark: SparkSession, path: str, table: Callable[[bytes, bool], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """Files read in splits by line feeds, of which those in quotes are told by the quotes before.

    One pass counts the quotes of each split; the driver adds them up, so each split knows whether it starts in quotes.  A split
    gives the records that start and end in it, and hands what is left at its ends to one that joins the ends of a record.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    quotes = F.length("value") - F.length(F.translate(F.decode("value", "iso-8859-1"), '"', ""))
    counts = raw.groupBy("file", "start").agg(F.sum(quotes).alias("n")).orderBy("file", "start").collect()
    odd: dict[tuple[str, int], bool] = {}
    for i, r in enumerate(counts):
        odd[r.file, r.start] = i > 0 and counts[i - 1].file == r.file and odd[r.file, counts[i - 1].start] != bool(counts[i - 1].n % 2)
    first = {}
    for r in counts:
        first.setdefault(r.file, r.start)

    def cut(parts: Iterator[pd.DataFrame], ends: bool) -> Iterator[tuple[str, int, int, bytes]]:
        """(file, start, kind, bytes): whole records in groups (kind 1), or the ends of a split (0: before, 2: after, 3: all of it)."""
        key, inside, begun, held, whole, size = None, False, False, [], [], 0

        def end():
            if key and held and ends:
                yield (*key, 2 if begun else 3, b"\n".join(held))

        for pdf in parts:
            for file, start, value in zip(pdf["file"], pdf["start"], pdf["value"]):
                now = (file, int(start))
                if now != key:
                    if whole and not ends:
                        yield (*key, 1, b"\n".join(whole))
                    yield from end()
                    key, inside, held, whole, size = now, odd[now], [], [], 0
                    begun = not inside
                value = bytes(value)
                inside ^= bool(value.count(b'"') % 2)
                held.append(value)
                if not inside:
                    if not begun:
                        if ends:
                            yield (*key, 0, b"\n".join(held))
                    elif not ends:
                        whole += held
                        size += sum(map(len, held))
                    begun, held = True, []
                    if size > 1 << 22:
                        yield (*key, 1, b"\n".join(whole))
                        whole, size = [], 0
        if whole and not ends:
            yield (*key, 1, b"\n".join(whole))
        yield from end()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for file, start, _, data in cut(parts, False):
            yield table(data, first[file] == start and (file, start) not in seen)
            seen.add((file, start))

    def run_ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in cut(parts, True):
            yield pd.DataFrame([x], columns=["file", "start", "kind", "data"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = [], []
        for _, _, kind, data in sorted(pdf.itertuples(index=False, name=None)):
            if kind == 2 or (kind == 3 and not held):
                held = [bytes(data)]
                continue
            held.append(bytes(data))
            if kind == 0:
                out.append(b"\n".join(held))
                held = []
        if held:
            out.append(b"\n".join(held))
        return pd.concat([table(x, False) for x in out] or [table(b"", False)])

    whole = raw.mapInPandas(run, schema)
    if len(counts) == len(first):
        # Each file is one split: only a quoted field without an end is left over, which is an error.
        open_files = [r.file for r in counts if r.n % 2]
        if open_files:
            raise ValueError(f"a quoted field has no end in {open_files[0]}")
        return whole
    ends = raw.mapInPandas(run_ends, "file string, start bigint, kind int, data binary")
    return whole.unionByName(ends.groupBy("file").applyInPandas(join, schema))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, strict: bool = False, encoding: str = "UTF-8", nulls: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """CSV files with a header (of up to a megabyte) as nullable text columns.

    Encodings that Spark's readers don't know, such as code pages, are read the strict way.
    The delimiter is the more frequent of ``,`` and ``;`` in the header unless it is given.  The fast way is Spark's reader.  The
    strict way tells an unquoted empty field (null) from a quoted one (empty text), pads short rows with nulls, and fails as a
    whole on bad quoting or long rows; files are split there, after a pass that counts quotes; in encodings of wide characters a
    file is one task and may have 2 GB at most (the size of a binary value).  With ``lines`` a record is a line, so files of any size are split over tasks; a line break
    in quotes is an error then, and lines that equal the header are left out.
    """
    first = _first_line(spark, path, encoding)
    delimiter = delimiter or (";" if first.count(";") > first.count(",") else ",")
    if encoding.lower() not in SPARK_CHARSETS:
        strict, lines = True, False
    if not strict:
        return spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, encoding=encoding)
    names = [v for v, _ in split_csv(first, delimiter)[0]] if first else []

    def table(rows: list[list[tuple[str, bool]]]) -> pd.DataFrame:
        if any(len(r) > len(names) for r in rows):
            raise ValueError("a row has more fields than the header")
        out = [[None if (not q and (v == "" or v.lower() in nulls)) else v for v, q in r] + [None] * (len(names) - len(r)) for r in rows]
        return pd.DataFrame(out, columns=names, dtype=object)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for data in pdf.content:
                yield table(split_csv(bytes(data).decode(encoding).lstrip("﻿"), delimiter)[1:])

    def run_lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield table([r for x in pdf.value if x.lstrip("﻿") != first for r in split_csv(x, delimiter)])

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if lines:
        if encoding.lower() not in ("utf-8", "us-ascii"):
            raise ValueError("files are split by lines in UTF-8 only")
        return spark.read.text(path).filter("value <> ''").mapInPandas(run_lines, schema)
    if re.fullmatch(r"utf-?8(-sig)?|(us-)?ascii|iso-?8859.*|latin.*|(cp|windows-)125\d|cp866|koi8.*", encoding.lower()) and names:
        # Quotes and line feeds are single bytes there, which no other character holds.
        return _records(spark, path, lambda data, top: table(split_csv(data.decode(encoding).lstrip("\ufeff"), delimiter)[top:]), schema)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header, RFC 4180 quotes, null as nothing and the empty text in quotes."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """XML records as text columns."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false").load(path)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def guess_row_tag(spark: SparkSession, path: str) -> str:
    """The most frequent child of the root element in the first file's first megabyte."""
    from xml.etree import ElementTree

    data = head(spark, path)
    if not data:
        raise ValueError(f"no XML in {path}")
    depth, found, parser = 0, {}, ElementTree.XMLPullParser(("start", "end"))
    try:
        parser.feed(data)
        for event, e in parser.read_events():
            depth += 1 if event == "start" else -1
            if event == "start" and depth == 2:
                tag = e.tag.rpartition("}")[2]
                found[tag] = found.get(tag, 0) + 1
    except ElementTree.ParseError:
        pass
    if not found:
        raise ValueError(f"no element under the root in {path}")
    return max(found, key=found.get)


def write_xml(df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "rows", mode: str = "error") -> None:
    df.write.mode(mode).format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)
