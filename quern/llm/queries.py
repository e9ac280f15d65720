"""The registered queries of the operators and, where SQL can express one, its DuckDB text.

Each query applies its operator with production parameters to its whole table and derives the digest columns.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, language, licenses, mixing, pieces, quality, simhash, tokens, urls
from .common import bound_batches, shared_dir, table

#: (verdict, host, path)
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the identifiers of its licence sentences and its licences, comma-separated, and the unknown sentences."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_unknown")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4, seed=42)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    model = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, model, end_id=1)
    return tokens.token_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"), piece_vocabulary()).drop("ids")


def piece_vocabulary() -> pieces.Pieces:
    return pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def piece_digest(docs: DataFrame, vocabulary: pieces.Pieces) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and the crc32 of the decoded text.

    The operator's batches are digested by the worker that made them.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, vocabulary.table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordmemo import ragged

        known, (flat, starts, sizes) = shared.value
        for b in pieces.encode_batches(batches, known):
            lists, crc, text = b.column(1), [], []
            offsets, got = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = got[a:e]
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                text.append(zlib.crc32(flat[ragged(starts[ids], sizes[ids])][int(known.dummy) :].tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(text, pa.int64())], ["doc_id", "ids", "n_pieces", "ids_crc32", "decoded_crc32"])

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, decoded_crc32 long")


def language_model(docs: DataFrame) -> language.Model | None:
    """Learns from the documents whose crc32(doc_id as text) mod 4 is not 2."""
    return language.fit_language(docs.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language_model(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return got.select("doc_id", "size", "source_size", "target", "taken")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, trees).drop("score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_simhash, op3_token_files, op4_sentencepiece, op5_language_id, op6_source_mixing, op7_embedding_dedup, op8_chat_format, op9_quality_rules, op10_url_filter)
}


#: Written apart from the operator's patterns: the sentence forms that stand on one line, and single-sentence rules.
_OP1_SQL = r"""
WITH hinted AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n]+', chr(1), 'g'), '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_matches(s, '(?i)licen[cs]e|copyright|\(c\)|©|warrant|redistribut|permission|free software|as is|reserved|endorse|(released|distributed|available) under|unencumbered|public domain')) AS parts
  FROM documents),
bare AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s: lower(regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '^[\s#/*%>;:-]+|[\s.!?;:*/-]+$', '', 'g'))), lambda s: s <> '') AS parts
  FROM hinted),
granted AS (
  SELECT doc_id, parts, list_transform(parts, lambda s: regexp_extract(s, '^(?:this .{1,60} is )?(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(.*)$', 1)) AS names
  FROM bare),
named AS (
  SELECT doc_id, list_transform(generate_series(1, len(parts)), lambda i: CASE
    WHEN regexp_full_match(names[i], 'apache licen[sc]e,? (?:version |v)?2(?:\.0)?') THEN 'apache2'
    WHEN regexp_full_match(names[i], '(?:mit|expat) licen[sc]e') THEN 'mit'
    WHEN regexp_full_match(names[i], '(?:gnu general public licen[sc]e|gnu gpl|gpl),? (?:version |v)?2(?:\.0)?') THEN 'gpl2'
    WHEN regexp_full_match(names[i], '(?:gnu general public licen[sc]e|gnu gpl|gpl),? (?:version |v)?3(?:\.0)?') THEN 'gpl3'
    WHEN regexp_full_match(names[i], 'cc by-nc(?: \d(?:\.\d)?)?') THEN 'ccbync'
    WHEN regexp_full_match(names[i], 'cc by-sa(?: \d(?:\.\d)?)?') THEN 'ccbysa'
    WHEN regexp_full_match(names[i], 'cc by(?: \d(?:\.\d)?)?') THEN 'ccby'
    WHEN regexp_full_match(parts[i], '(?:copyright|\(c\)|©) .{1,80}') THEN 'copyright'
    WHEN parts[i] = 'all rights reserved' THEN 'rights' ELSE 'unknown' END) AS ids
  FROM granted),
rules AS (
  SELECT * FROM (VALUES ('apache2', 'Apache-2.0', 1), ('mit', 'MIT', 2), ('gpl3', 'GPL-3.0', 3), ('gpl2', 'GPL-2.0', 4), ('ccbync', 'CC-BY-NC-4.0', 5), ('ccbysa', 'CC-BY-SA-4.0', 6), ('ccby', 'CC-BY-4.0', 7)) AS r(id, license, place))
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
  coalesce((SELECT string_agg(license, ',' ORDER BY place) FROM rules WHERE list_contains(ids, id)), '') AS licenses,
  CAST(len(list_filter(ids, lambda x: x = 'unknown')) AS BIGINT) AS n_unknown
FROM named"""


_OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER w AS pos, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line,
    CASE WHEN role IS NULL THEN '-' ELSE '+' || replace(role, chr(1), chr(1) || chr(2)) END || chr(1) || CASE WHEN text IS NULL THEN '-' ELSE '+' || replace(text, chr(1), chr(1) || chr(2)) END || chr(1) AS code
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
p AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
whole AS (SELECT conv_id, n, prefix FROM p WHERE pos = n),
uniq AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS n_same FROM whole GROUP BY n, prefix),
kept AS (SELECT conv_id, n_same FROM uniq u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = u.n AND p.prefix = u.prefix))
SELECT t.conv_id, count(*) AS n_turns, any_value(n_same) AS n_same, string_agg(line, '' ORDER BY pos) AS chat
FROM t JOIN kept USING (conv_id) GROUP BY t.conv_id"""


def _op10_sql() -> str:
    """Links of absolute, host and root forms make classes by a recursive closure; an own rule decides, then an allowed alias, then a blocked one."""
    rest = lambda url: f"CASE WHEN position('://' IN {url}) > 0 THEN substr({url}, position('://' IN {url}) + 3) ELSE '' END"
    host = lambda r: f"translate(regexp_extract({r}, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}')"
    path = lambda r: f"regexp_extract({r}, '^[^/?#]*([^?#]*)', 1)"
    node = lambda r: f"nullif({host(r)} || regexp_extract({r}, '^[^/?#]*([^#]*)', 1), '')"
    order = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))

    def cases(r: str, k: int) -> str:
        fits = {h + p: f"(({host(r)} = '{h}' OR ends_with({host(r)}, '.{h}')) AND starts_with({path(r)}, '{p}'))" for _, h, p in URL_RULES}
        return " ".join(f"WHEN {fits[h + p]} THEN '{(h + p, v)[k]}'" for v, h, p in order)

    rel = r"""string_split_regex(lower(concat_ws(' ', regexp_extract(tag, '(?is)\brel\s*=\s*"([^"]*)"', 1), regexp_extract(tag, '(?is)\brel\s*=\s*''([^'']*)''', 1), regexp_extract(tag, '(?is)\brel\s*=\s*([^\s>"''/]+)', 1))), '\s+')"""
    aim = r"""CASE WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(""" + rel + r""", 'canonical') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
      WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh["''\s/>]') THEN regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1) END"""
    bare = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g')"
    tags = r"regexp_extract_all(" + bare + r", '(?is)<(?:link|meta)\b[^>]*>')"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, {rest('url')} AS rest FROM pages),
tags AS (SELECT rest, unnest({tags}) AS tag FROM p WHERE rest <> '' AND regexp_matches(html, '(?i)canonical|refresh')),
named AS (SELECT rest, replace({aim}, '&amp;', '&') AS t FROM tags),
aims AS (
  SELECT rest, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {rest('t')} WHEN starts_with(t, '//') THEN substr(t, 3)
    WHEN starts_with(t, '/') THEN regexp_extract(rest, '^[^/?#]*') || t END AS aim FROM named),
links AS (SELECT a, b FROM (SELECT {node('rest')} AS a, {node('aim')} AS b FROM aims WHERE aim IS NOT NULL) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT a, a FROM sides UNION SELECT r.a, l.b FROM reach r JOIN sides l ON l.a = r.b),
told AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM (SELECT a, CASE {cases('b', 1)} END AS v FROM reach) GROUP BY a)
SELECT page_id, {host('rest')} AS host, {path('rest')} AS path, CASE {cases('rest', 0)} ELSE NULL END AS rule, coalesce(CASE {cases('rest', 1)} END, told.v, 'allow') AS verdict
FROM p LEFT JOIN told ON told.a = {node('rest')}"""


ORACLE: dict[str, str] = {"op1_license_scan": _OP1_SQL, "op8_chat_format": _OP8_SQL, "op10_url_filter": _op10_sql()}
