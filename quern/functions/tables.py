"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ``SELECT .. FROM t, LATERAL trigrams(t.text)``: the trigram at every position, from 1 on; none of shorter texts.  Catalyst
#: inlines it, so no row leaves the JVM.
TRIGRAMS = """CREATE OR REPLACE TEMPORARY FUNCTION trigrams(text STRING) RETURNS TABLE (pos INT, gram STRING)
RETURN SELECT i + 1, substring(text, i + 1, 3) FROM explode(CASE WHEN length(text) > 2 THEN sequence(0, length(text) - 3) END) AS e(i)"""


def register_tables(spark: SparkSession) -> None:
    spark.sql(TRIGRAMS)
