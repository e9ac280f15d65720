"""A pipeline from raw documents to token ids: language, quality, near-duplicates, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of documents.  Extra columns travel along; repeated rows, null columns, empty
texts and empty tables are allowed in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import language, mixing, quality, queries, simhash
from quern.llm.common import cut, shared_dir, table

#: No SQL: the stages rest on models, draws and XXH64; tests hold them against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; null texts and texts without a letter are rejected."""
    return language.keep_identified(docs, queries.language_model(docs))


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees, which learn from the labels of what is left."""
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    Rows take part by their texts: rows of one id with unlike texts all stay, and rows without an id are compared like others.
    """
    return simhash.drop_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows that share an id take the same, the largest drawn for them.

    Documents without an id are told apart by a hash of their text, language and source.
    """
    key = F.coalesce("doc_id", F.xxhash64("text", "lang", "source"))
    copies = mixing.mix(docs.select(key.alias("doc_id"), "text", "source")).groupBy(F.col("doc_id").alias("mix_key__")).agg(F.max("copies").alias("mix_copies__"))
    taken = docs.withColumn("mix_key__", key).join(cut(copies.filter("mix_copies__ > 0")), "mix_key__")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies__")).alias("mix_copy__")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32, decoded_crc32 of each document that the mix took, repeats included."""
    return queries.piece_digest(docs, queries.piece_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("quality", apply_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
