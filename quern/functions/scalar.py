"""Scalar functions beyond Spark's built-ins, as Column helpers and as SQL functions.

All are compositions of built-ins, so they stay in generated code; SQL functions are temporary SQL UDFs that Catalyst inlines.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def trim_blank(s: Column) -> Column:
    """Strips spaces and tabs on both sides."""
    return F.btrim(s, F.lit(" \t"))


def normalize_name(s: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(s), "[ \t\n\r]+", " "))


def normalize_inn(s: Column) -> Column:
    """The digits of a tax number."""
    return F.regexp_replace(s, "[^0-9]", "")


def substr(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based substring by code points; starts before 1 count as 1, a negative length runs to the end."""
    start = start if isinstance(start, Column) else F.lit(start)
    rest = F.length(s)
    n = rest if length is None else F.when(F.lit(length) < 0, rest).otherwise(F.lit(length))
    return F.substring(s, F.greatest(start, F.lit(1)), n)


def split_part(s: Column, delimiters: str, n: int) -> Column:
    """The n-th part between any of the delimiter characters; empty parts don't count; null where there are fewer."""
    parts = F.filter(F.split(s, "[" + "".join("\\" + c if not c.isalnum() else c for c in delimiters) + "]"), lambda p: p != "")
    return F.get(parts, F.lit(n - 1))


def to_int(s: Column) -> Column:
    """The floor of a number in text; null where it is none."""
    return F.floor(s.try_cast("double")).cast("bigint")


def to_bool(s: Column) -> Column:
    return s.isNotNull() & F.lower(s).isin("true", "1")


def safe_divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a, b)


def trigrams(q: Column) -> Column:
    """The trigram at every position of a text; one empty or short entry where it has fewer than three characters."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(q) - 2, F.lit(1))), lambda i: F.substring(q, i, F.lit(3)))


def word_similarity(q: Column, d: Column) -> Column:
    """The share of q's trigram positions whose trigram occurs in d.

    Where both are shorter than three: equality without case, as 1 or 0.  Where only q is: 0.  Built-in functions only.
    """
    return word_similarity_of(q, trigrams(q), d)


def word_similarity_of(q: Column, grams: Column, d: Column) -> Column:
    """``word_similarity`` with q's trigrams made before."""
    n = F.length(q) - 2
    share = F.size(F.filter(grams, lambda g: F.instr(d, g) > 0)).cast("double") / F.greatest(n, F.lit(1))
    short = F.when((F.length(q) < 3) & (F.length(d) < 3), (F.lower(q) == F.lower(d)).cast("double"))
    return F.coalesce(short, F.when(q.isNull() | d.isNull(), F.lit(None).cast("double")).when(n < 1, F.lit(0.0)).otherwise(share))


SQL_FUNCTIONS = {
    "normalize_name": ("s STRING", "STRING", "trim(regexp_replace(lower(s), '[ \\t\\n\\r]+', ' '))"),
    "normalize_inn": ("s STRING", "STRING", "regexp_replace(s, '[^0-9]', '')"),
    "to_int_floor": ("s STRING", "BIGINT", "cast(floor(try_cast(s AS DOUBLE)) AS BIGINT)"),
    "word_similarity": (
        "q STRING, d STRING",
        "DOUBLE",
        "CASE WHEN q IS NULL OR d IS NULL THEN NULL WHEN length(q) < 3 AND length(d) < 3 THEN cast(lower(q) = lower(d) AS DOUBLE) WHEN length(q) < 3 THEN 0D"
        " ELSE size(filter(transform(sequence(1, greatest(length(q) - 2, 1)), i -> substring(q, i, 3)), g -> instr(d, g) > 0)) / cast(length(q) - 2 AS DOUBLE) END",
    ),
}


def register_functions(spark: SparkSession) -> None:
    """SQL functions of the session: the above, and jaro_winkler as an Arrow UDF."""
    from .similarity import jaro_winkler

    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udf.register("jaro_winkler", jaro_winkler)
