"""Token ids of documents in Parquet files that allow selective reads.

Files are in ascending id order, over files as well as within them.  Ids are a list column with dictionary encoding; document
ids, lengths, file numbers and places within the file are delta-encoded columns beside it, so that where a document's ids stand is
read without the ids.  Row groups and pages have controlled sizes and page indexes, so a few documents cost a few pages.  Spark's
own writer and committer write them: any store that Spark reaches will do, and a lost executor's files are written anew.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, slices
from .wordmemo import WordTable, sums

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 64 << 10, 1_000
#: Bytes of text that make a file at most, roughly.
FILE_BYTES = 128 << 20


#: The parts of the tokenizer for which ``word_encoder`` knows a quicker way.
_LOWER = r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])'
_UNITS = r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])"""
#: Words of these letters are one unit for a lower-casing byte-level tokenizer; no normalisation makes them anything but letters.
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_PLAIN = re.compile(f"{_LETTER}+")
#: Runs of these marks are a unit of their own behind a letter.  No special token holds one of them.
_CLOSING = f"({_LETTER})([.,!?;:#*$%&]+)(\\s|$)"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for the bytes of the characters up to U+00FF."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    letter = {b: chr(b if b in shown else next(hidden)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


def word_encoder(tokenizer_json: str):
    """A function from words without white space to their ids, equal to the tokenizer's, and whether ``apart`` may precede it.

    For a tokenizer whose parts are known (lower case, letters apart from marks, byte level), the model alone takes words of
    plain letters, which is much quicker; the whole tokenizer takes all others.
    """
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    known = str(t.normalizer) == _LOWER and str(t.pre_tokenizer) == _UNITS

    def whole(words: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]

    if not known:
        return whole, False
    tokenize, letters, plain = t.model.tokenize, _byte_letters(), _PLAIN.fullmatch

    def quick(words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if w.isalpha():
                if w.isascii():
                    out[i] = [x.id for x in tokenize(w.lower())]
                    continue
                if plain(w):
                    out[i] = [x.id for x in tokenize(w.lower().translate(letters))]
                    continue
            rest.append(i)
        for i, ids in zip(rest, whole([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    return quick, True


@functools.lru_cache(maxsize=1)
def _memo(tokenizer_json: str) -> tuple[WordTable, bool]:
    """A Python worker keeps the tokenizer and its words from task to task."""
    words, plain = word_encoder(tokenizer_json)
    return WordTable(words), plain


def apart(texts: pa.Array) -> pa.Array:
    """Texts in ASCII lower case, closing marks between a letter and white space set apart: fewer distinct words, equal ids.

    Texts with what may be a special token keep their case.
    """
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    return pc.replace_substring_regex(texts, _CLOSING, r"\1 \2\3")


def encode(docs: DataFrame, tokenizer_json: str, end_id: int, text_col: str = "text") -> DataFrame:
    """``docs`` (id columns and the text) with the text replaced by ``ids``, the end id appended, and ``place``.

    place counts the ids of the rows before it in its partition.  Null texts are empty.  tokenizer_json is the tokenizer's file as
    text: vocabularies have a fixed size, so it travels with the tasks.  Words are cut at white space, which the tokenizer drops
    and never joins across.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (memo, plain), before = _memo(tokenizer_json), 0
        for whole in batches:
            for b in slices(whole, text_col):
                texts = pc.fill_null(b.column(b.schema.get_field_index(text_col)), "")
                lists = pc.ascii_split_whitespace(apart(texts) if plain else texts)
                offsets = lists.offsets.to_numpy()
                ids, sizes = memo.ids(lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
                ends = np.cumsum(sums(sizes, offsets - offsets[0]))
                ids = np.insert(ids, ends, end_id)
                bounds = np.append(0, ends + np.arange(1, len(ends) + 1)).astype(np.int32)
                place = before + bounds[:-1].astype(np.int64)
                before += int(bounds[-1])
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids, pa.int32())), pa.array(place)], [*names, "ids", "place"])

    kept = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.mapInArrow(run, f"{schema}, ids array<int>, place long")


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Encodes all documents and writes files (doc_id, n_tokens, part, place, ids) in ascending id order to ``path``.

    Null ids come first; rows of one id are ordered by a hash of their text, so many rows of one id spread over files.  There are
    as many files as shuffle partitions, or more, so that a file has ``FILE_BYTES`` of text at most (roughly: ranges come from a
    sample of rows, and a row is never split).  No rows give files without rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    if not files:
        total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES), 1)
    ordered = d.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    coded = encode(ordered.select("doc_id", "text"), tokenizer_json, end_id)
    out = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.spark_partition_id().alias("part"), "place", "ids")
    options = {"parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true", "compression": "zstd"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "n_tokens", "part", "place")}
    w = out.write.mode("overwrite")
    for k, v in options.items():
        w = w.option(k, v)
    w.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "part", "place", "ids")) -> DataFrame:
    """The files' rows; only the named columns are read, and filters on doc_id skip row groups and pages."""
    return spark.read.parquet(path).select(*columns)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part) of every document, from the files alone.

    start counts the ids of all documents before it in the files' order: a row's own place in its file, and the sum of the files
    before.  Only those sums, one row a file, are brought together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:e].tobytes()) for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path, ("doc_id", "part", "place", "ids")).mapInArrow(run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    totals = read_tokens(spark, path, ("part", "n_tokens")).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "part")
