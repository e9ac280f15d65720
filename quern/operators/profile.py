"""Profiles, quality checks and anomalies."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(column_name, n_rows, n_nulls, n_distinct, min_value, max_value) of every column.

    exact: each column is grouped by itself, so a column costs a scan of that column alone and a shuffle of its values, counted
    before they are shuffled; never a row copied once a column.  Otherwise one pass without a shuffle of values, in which
    n_distinct is an estimate.
    """
    names = list(columns or df.columns)
    if not exact:
        aggs = []
        for i, c in enumerate(names):
            v = F.col(f"`{c}`")
            aggs += [F.count_if(v.isNull()).alias(f"n{i}"), F.approx_count_distinct(v).alias(f"d{i}"), F.min(v).cast("string").alias(f"a{i}"), F.max(v).cast("string").alias(f"z{i}")]
        one = df.agg(F.count("*").alias("n"), *aggs)
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"n{i}").alias("n_nulls"), F.col(f"d{i}").alias("n_distinct"), F.col(f"a{i}").alias("min_value"), F.col(f"z{i}").alias("max_value")) for i, c in enumerate(names)])
        return one.select(F.inline(rows))

    def of(c: str) -> DataFrame:
        v, n = F.col("v"), F.coalesce(F.sum("n"), F.lit(0))
        nulls = F.coalesce(F.sum(F.when(v.isNull(), F.col("n"))), F.lit(0))
        values = df.select(F.col(f"`{c}`").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
        return values.agg(n.alias("n_rows"), nulls.alias("n_nulls"), F.count(v).alias("n_distinct"), F.min(v).cast("string").alias("min_value"), F.max(v).cast("string").alias("max_value")).select(F.lit(c).alias("column_name"), "*")

    return functools.reduce(DataFrame.unionByName, [of(c) for c in names])


@dataclass(frozen=True)
class Check:
    """kind: NOT_NULL, UNIQUE, RANGE (args: low, high), REGEX (args: pattern) or CUSTOM (args: SQL predicate)."""

    name: str
    kind: str
    column: str = ""
    args: tuple = ()


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check_name, n_rows, n_failed, passed); UNIQUE counts the rows above one for each value.

    All checks of single rows are one aggregation; each UNIQUE check groups its own column.
    """
    n = F.count("*").alias("n_rows")
    parts = []
    for c in (c for c in checks if c.kind == "UNIQUE"):
        v, k = F.col("v"), F.col("k")
        values = df.select(F.col(c.column).alias("v")).groupBy("v").agg(F.count("*").alias("k"))
        more = F.coalesce(F.sum(F.when(v.isNotNull(), k - 1)), F.lit(0))
        parts.append(values.agg(F.coalesce(F.sum(k), F.lit(0)).alias("n_rows"), more.alias("n_failed")).select(F.lit(c.name).alias("check_name"), "n_rows", "n_failed"))
    plain = [c for c in checks if c.kind != "UNIQUE"]
    if plain:
        bad = {
            "NOT_NULL": lambda c: F.col(c.column).isNull(),
            "RANGE": lambda c: ~F.col(c.column).between(*c.args),
            "REGEX": lambda c: ~F.col(c.column).rlike(c.args[0]),
            "CUSTOM": lambda c: ~F.expr(c.args[0]),
        }
        one = df.agg(n, *[F.count_if(bad[c.kind](c)).alias(f"f{i}") for i, c in enumerate(plain)])
        rows = F.array(*[F.struct(F.lit(c.name).alias("check_name"), F.col("n_rows"), F.col(f"f{i}").alias("n_failed")) for i, c in enumerate(plain)])
        parts.append(one.select(F.inline(rows)))
    return functools.reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("n_failed") == 0)


def anomalies(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str, window: int = 128, limit: float = 3.0, split: Column | None = None, chunk: int = 500_000) -> DataFrame:
    """``df`` with z (against the mean and population deviation of up to ``window`` previous values) and is_anomaly.

    z is 0 with fewer than two previous values; the deviation is at least 1e-10.  split: an expression that never falls along
    the order (such as the hour of a time); with it a partition of more than ``chunk`` rows is cut into chunks that are worked on
    apart, each with the ``window`` rows before it.  Without it a partition is one task.
    """
    chunk = max(chunk, window)
    if split is None or (df.groupBy(*partition).count().agg(F.max("count")).first()[0] or 0) <= chunk:
        return _scored(df, list(partition), list(order), value, window, limit)
    own = [f"__p{i}" for i in range(len(partition))]
    d = df.withColumns({"__s": split} | {p: F.col(c) for p, c in zip(own, partition, strict=True)})
    # Positions come from counts of the split's values, which are few, and the order within each value.
    sizes = d.groupBy(*own, "__s").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*own).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(p).alias(f"{p}_") for p in own], F.col("__s").alias("__s_"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    same = F.col("__s").eqNullSafe(F.col("__s_"))
    for p in own:
        same = same & F.col(p).eqNullSafe(F.col(f"{p}_"))
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy(*own, "__s").orderBy(*order)) - 1).join(starts, same)
    at = F.col("__start") + F.col("__r")
    d = d.withColumn("__at", at).withColumn("__chunk", F.floor(F.col("__at") / chunk))
    # The last rows of a chunk go to the next one, too, as rows before it.
    ahead = F.col("__at") % chunk >= chunk - window
    to = F.when(ahead, F.array(F.col("__chunk"), F.col("__chunk") + 1)).otherwise(F.array("__chunk"))
    d = d.withColumn("__to", F.explode(to))
    out = _scored(d, [*own, "__to"], ["__at"], value, window, limit).filter("__to = __chunk")
    return out.select(*df.columns, "z", "is_anomaly")


def _scored(df: DataFrame, partition: list[str], order: list[str], value: str, window: int, limit: float) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-window, -1)
    sd = F.greatest(F.stddev_pop(value).over(w), F.lit(1e-10))
    z = F.when(F.count(value).over(w) < 2, F.lit(0.0)).otherwise((F.col(value) - F.avg(value).over(w)) / sd)
    return df.withColumn("z", z).withColumn("is_anomaly", F.abs("z") > limit)


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """(median) of a numeric column, as ``percentile`` has it.

    An estimate within a hundred-thousandth bounds the middle thousandth of the rows (of fewer than 100,000 rows, all); values
    there are counted and put in order, those below are only counted.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    found = values.agg(F.count("*").alias("all"), F.percentile_approx("v", [0.4995, 0.5005], 100_000).alias("q"), F.min("v").alias("least"), F.max("v").alias("most"))
    few = F.col("all") < 100_000
    bounds = found.select("all", F.when(few, F.col("least")).otherwise(F.col("q")[0]).alias("low"), F.when(few, F.col("most")).otherwise(F.col("q")[1]).alias("high"))
    middle = values.crossJoin(F.broadcast(bounds)).filter("v <= high").groupBy("all", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    ordered = middle.withColumn("upto", F.sum("n").over(Window.partitionBy("all").orderBy(F.col("v").asc_nulls_first())))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    return ordered.agg(((at(F.floor((F.col("all") - 1) / 2)) + at(F.ceil((F.col("all") - 1) / 2))) / 2).alias("median"))
