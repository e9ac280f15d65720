"""Slowly changing dimensions, type 2, as one set of joins."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scd2:
    """key, effective-from and effective-to columns; the rest is optional.

    compare: columns whose change makes a version (default: all but key, metadata, deleted and ignored ones); transaction_time:
    source column that gives a version's start; deleted: source column that closes a key; hash, current, version: columns kept
    in the history if named.
    """

    key: tuple[str, ...]
    valid_from: str = "valid_from"
    valid_to: str = "valid_to"
    current: str | None = "is_current"
    version: str | None = None
    hash: str | None = None
    compare: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    transaction_time: str | None = None
    deleted: str | None = None


def _truthy(c: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(c.cast("string"))).isin("0", "false", "f", "no", "n", ""), F.lit(False))


def validate(source: DataFrame, spec: Scd2) -> None:
    """Fails if a key part is null or empty, or a key repeats; one pass, of which three numbers are collected."""
    empty = F.lit(False)
    for k in spec.key:
        empty = empty | F.col(k).isNull() | (F.col(k).cast("string") == "")
    keys = source.groupBy(*spec.key).agg(F.count("*").alias("__n"))
    got = keys.agg(F.sum(F.when(empty, F.col("__n"))).alias("empty"), F.max(F.when(~empty, F.col("__n"))).alias("most")).first()
    if got.empty:
        raise ValueError(f"{got.empty} source rows have a null or empty key")
    if (got.most or 0) > 1:
        raise ValueError("a key repeats in the source")


def apply_scd2(source: DataFrame, history: DataFrame | None, spec: Scd2, now: datetime | Column, check: bool = True) -> DataFrame:
    """The new history: unchanged versions, closed versions, and new versions.

    A key's current version is the one with the latest start, even if it is closed.  A deleted source row closes the open
    version; a new or changed one opens the next.  Comparison is null-safe.
    """
    if check:
        validate(source, spec)
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    meta = [c for c in (spec.valid_from, spec.valid_to, spec.current, spec.version, spec.hash) if c]
    payload = [c for c in source.columns if c not in spec.key and c != spec.deleted]
    watched = list(spec.compare) or [c for c in payload if c not in meta and c not in spec.ignore and c != spec.transaction_time]
    start = F.coalesce(F.col(spec.transaction_time).cast("timestamp_ntz"), now) if spec.transaction_time else now
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in watched]))
    src = source.withColumns({"__gone": _truthy(F.col(spec.deleted)) if spec.deleted else F.lit(False), "__start": start, "__hash": digest})
    made = {spec.valid_from: F.col("__start"), spec.valid_to: F.lit(None).cast("timestamp_ntz")}
    made |= {spec.current: F.lit(True)} if spec.current else {}
    made |= {spec.hash: F.col("__hash")} if spec.hash else {}
    if history is None:
        made |= {spec.version: F.lit(1).cast("bigint")} if spec.version else {}
        return src.filter("not __gone").withColumns(made).select(*spec.key, *payload, *meta)
    # Both sides meet in one shuffle on the key: joins would read a history twice, and a chain of them as often as two to its length.
    kept = list(dict.fromkeys([*watched, *([spec.hash] if spec.hash else []), *([spec.version] if spec.version else []), spec.valid_from, spec.valid_to]))
    keys = [f"__key_{k}" for k in spec.key]
    new = src.select(*[F.col(k).alias(n) for k, n in zip(spec.key, keys, strict=True)], F.struct(*src.columns).alias("__src"))
    known = history.select(*[F.col(k).alias(n) for k, n in zip(spec.key, keys, strict=True)], F.struct(*history.columns).alias("__known"))
    met = known.unionByName(new, allowMissingColumns=True)
    of = lambda side, c: F.col(side).getField(c)
    latest = Window.partitionBy(*keys).orderBy(of("__known", spec.valid_from).desc_nulls_last(), of("__known", spec.valid_to).desc_nulls_first())
    latest = latest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    old = F.when(F.col("__known").isNotNull(), F.struct(*[of("__known", c).alias(c) for c in kept if c in history.columns]))
    now_is = F.when(F.col("__src").isNotNull(), F.struct(*[of("__src", c).alias(c) for c in (*watched, "__gone", "__hash")]))
    # Null keys meet nothing.
    whole = F.lit(True)
    for n in keys:
        whole = whole & F.col(n).isNotNull()
    met = met.withColumns({"__old": F.when(whole, F.first(old, ignorenulls=True).over(latest)), "__is": F.when(whole, F.first(now_is, ignorenulls=True).over(latest))})
    hashed = spec.hash and spec.hash in history.columns
    same = of("__old", spec.hash) == F.coalesce(of("__src", "__hash"), of("__is", "__hash")) if hashed else F.lit(True)
    for c in () if hashed else watched:
        same = same & F.when(F.col("__src").isNotNull(), of("__src", c)).otherwise(of("__is", c)).eqNullSafe(of("__old", c))
    fresh = F.col("__src").isNotNull()
    changed = ~F.coalesce(same, F.lit(False))
    opens = fresh & ~of("__src", "__gone") & (F.col("__old").isNull() | changed)
    hit = ~fresh & F.col("__is").isNotNull() & of("__known", spec.valid_to).isNull() & (of("__is", "__gone") | changed)
    judged = met.withColumn("__hit", hit).filter(~fresh | opens)
    changes = {spec.valid_to: F.when(F.col("__hit"), now).otherwise(of("__known", spec.valid_to))}
    changes |= {spec.current: of("__known", spec.current) & ~F.col("__hit")} if spec.current else {}
    made = {spec.valid_from: of("__src", "__start"), spec.valid_to: F.lit(None).cast("timestamp_ntz")}
    made |= {spec.current: F.lit(True)} if spec.current else {}
    made |= {spec.hash: of("__src", "__hash")} if spec.hash else {}
    made |= {spec.version: F.coalesce(of("__old", spec.version), F.lit(0)).cast("bigint") + 1} if spec.version else {}
    start_of = lambda c: made[c] if c in made else of("__src", c) if c in source.columns else F.lit(None)
    return judged.select(*[F.when(fresh, start_of(c)).otherwise(changes.get(c, of("__known", c))).alias(c) for c in history.columns])
