"""Copy-on-write changes to tables: update, delete, upsert and buffered transactions over Parquet snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import Conflict, Store


def update(df: DataFrame, values: Mapping[str, object], where: Column | str | None = None) -> DataFrame:
    """Sets columns to literals or expressions where the predicate is true; null predicates change nothing."""
    hit = F.lit(True) if where is None else F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    kinds = {f.name: f.dataType for f in df.schema}
    if odd := [c for c in values if c not in kinds]:
        raise ValueError(f"no columns {odd}")
    return df.withColumns({c: F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column | str | None = None) -> DataFrame:
    """Removes the rows for which the predicate is true."""
    if where is None:
        return df.filter(F.lit(False))
    return df.filter(~F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False)))


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the source replace those of the same key; others stay; running it again changes nothing."""
    return target.join(source.select(*key), list(key), "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


class Database:
    """Tables as folders of Parquet snapshots under one pointer.

    A change writes new snapshots and then a new version of the pointer, which names every table's snapshots.  What is being read
    is never overwritten, readers see all tables before or after a change, and a change that is based on a snapshot which another
    writer has replaced meanwhile fails with ``Conflict``.  Appends add a folder to a table's list instead of rewriting it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, f"{self.path}/_pointers")

    def state(self) -> tuple[int, dict[str, list[str]]]:
        """The pointer's version, and each table's snapshot folders."""
        version, value = self.store.read("tables", {})
        return version, dict(value)

    def tables(self) -> list[str]:
        return sorted(self.state()[1])

    def exists(self, name: str) -> bool:
        return name in self.state()[1]

    def read(self, name: str) -> DataFrame:
        return self._frame(self.state()[1][name])

    def _frame(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def commit(self, frames: Mapping[str, DataFrame], appends: Mapping[str, DataFrame] | None = None, seen: Mapping[str, list[str]] | None = None, cluster_by: Sequence[str] = (), tries: int = 10) -> None:
        """Replaces tables, and appends to others, as one change.

        seen: the folders that replaced tables had when the change was computed (by default those of now).  Changes of other
        tables, and appends by others, don't conflict.
        """
        seen = self.state()[1] if seen is None else seen
        made = {n: self._write(n, df, cluster_by) for n, df in frames.items()}
        added = {n: self._write(n, df, cluster_by) for n, df in (appends or {}).items()}
        for attempt in range(tries):
            version, now = self.state()
            for n in made:
                if now.get(n) != seen.get(n):
                    raise Conflict(f"{n} was changed by another writer")
            new = now | {n: [f] for n, f in made.items()}
            new |= {n: [*new.get(n, []), f] for n, f in added.items()}
            try:
                self.store.write("tables", new, version)
                return
            except Conflict:
                if attempt == tries - 1:
                    raise

    def _write(self, name: str, df: DataFrame, cluster_by: Sequence[str]) -> str:
        folder = f"{name}/s-{uuid.uuid4().hex}"
        if cluster_by:
            df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def write(self, name: str, df: DataFrame, mode: str = "overwrite", cluster_by: Sequence[str] = ()) -> None:
        """mode: overwrite or append (columns by name; the table is made if there is none).

        cluster_by: files hold ranges of these columns and are sorted by them, so that point and range filters skip files, row
        groups and pages by their statistics (what an index is for).
        """
        if mode == "append":
            self.commit({}, {name: df.select(*self.read(name).columns) if self.exists(name) else df}, cluster_by=cluster_by)
        elif mode == "overwrite":
            self.commit({name: df}, cluster_by=cluster_by)
        else:
            raise ValueError(f"unknown mode {mode}")

    def drop(self, name: str) -> None:
        version, now = self.state()
        now.pop(name)
        self.store.write("tables", now, version)

    def register(self) -> None:
        """Temporary views of all tables as they are now."""
        for name in self.tables():
            self.read(name).createOrReplaceTempView(name)

    def vacuum(self) -> int:
        """Removes snapshots that the pointer doesn't name (running readers of older versions lose theirs); their number."""
        held = {f for folders in self.state()[1].values() for f in folders}
        fs, n = self.store._fs(), 0
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        for table in [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName()[0] != "_"]:
            for s in fs.listStatus(table):
                if s.getPath().getName().startswith("s-") and f"{table.getName()}/{s.getPath().getName()}" not in held:
                    fs.delete(s.getPath(), True)
                    n += 1
        return n


class Table:
    """One table of a database of its own, or of a given one."""

    def __init__(self, spark: SparkSession, path: str, name: str = "data"):
        self.database, self.name = Database(spark, path), name

    def exists(self) -> bool:
        return self.database.exists(self.name)

    def read(self) -> DataFrame:
        return self.database.read(self.name)

    def write(self, df: DataFrame, mode: str = "overwrite") -> None:
        self.database.write(self.name, df, mode)

    def append(self, df: DataFrame) -> None:
        self.write(df, "append")


class Transaction:
    """Changes to one or more tables, buffered in order and applied at commit as one change; rollback forgets them.

    The changes are computed from the snapshots at the transaction's begin; commit fails with ``Conflict`` if a changed table was
    replaced by another writer since.
    """

    def __init__(self, tables: Table | Database):
        self.database = tables.database if isinstance(tables, Table) else tables
        self.default = tables.name if isinstance(tables, Table) else None
        self.seen = self.database.state()[1]
        self.ops: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def _add(self, table: str | None, op: Callable[[DataFrame], DataFrame]) -> Transaction:
        name = table or self.default
        if name not in self.seen:
            raise KeyError(f"no table {name}")
        self.ops.append((name, op))
        return self

    def update(self, values: Mapping[str, object], where: str | None = None, table: str | None = None) -> Transaction:
        return self._add(table, lambda d: update(d, values, where))

    def delete(self, where: str | None = None, table: str | None = None) -> Transaction:
        return self._add(table, lambda d: delete(d, where))

    def insert(self, rows: DataFrame, table: str | None = None) -> Transaction:
        return self._add(table, lambda d: d.unionByName(rows.select(*d.columns)))

    def upsert(self, rows: DataFrame, key: Sequence[str], table: str | None = None) -> Transaction:
        return self._add(table, lambda d: upsert(d, rows, key))

    def preview(self, table: str | None = None) -> DataFrame:
        """The table as the buffered changes leave it."""
        name = table or self.default
        df = self.database._frame(self.seen[name])
        for own, op in self.ops:
            df = op(df) if own == name else df
        return df

    def commit(self) -> None:
        if self.ops:
            self.database.commit({n: self.preview(n) for n in dict.fromkeys(n for n, _ in self.ops)}, seen=self.seen)
        self.rollback()

    def rollback(self) -> None:
        self.ops, self.seen = [], self.database.state()[1]
