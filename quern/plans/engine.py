"""The query surface: tables, statements with parameters, ingest, saved results, row-level security and access control."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import register_functions
from ..operators.dml import Database, Transaction
from ..sources import files
from .statements import Change, bind_positional, parse_statement
from .store import Store


@dataclass
class Policy:
    """Row filters by table and allowed actions by role and table pattern.

    filters: table -> SQL predicate, in which ``{user_id}`` stands for the user.  grants: (role, pattern, actions); actions are
    select, insert, update and delete.
    """

    filters: Mapping[str, str] = field(default_factory=dict)
    grants: Sequence[tuple[str, str, frozenset[str]]] = ()

    def allows(self, role: str, table: str, action: str) -> bool:
        return role == "admin" or any(r == role and fnmatch.fnmatchcase(table, p) and action in a for r, p, a in self.grants)

    def rule(self, table: str, who: Principal) -> str | None:
        """The predicate that holds for this user's rows of a table."""
        rule = self.filters.get(table) if who.role != "admin" else None
        return rule.replace("{user_id}", "'" + who.user_id.replace("\\", "\\\\").replace("'", "\\'") + "'") if rule else None


@dataclass(frozen=True)
class Principal:
    user_id: str
    role: str


class Engine:
    """Queries over registered paths and the tables of a database.

    A principal's queries run in a session of their own in which every table is a filtered view, so subqueries, set operations
    and derived tables are covered, and tables without a grant don't exist.  Changes go through the database: they need the
    action's grant, and touch only rows that the principal may see.
    """

    def __init__(self, spark: SparkSession, policy: Policy | None = None, database: Database | None = None):
        self.spark, self.policy, self.database, self.paths = spark, policy, database, {}
        self.open: Transaction | None = None
        self.written: list[Callable[[str], None]] = []
        register_functions(spark)
        self._views()

    # Tables

    def register(self, name: str, path: str) -> None:
        self.paths[name] = path
        self.spark.read.parquet(path).createOrReplaceTempView(name)

    def _views(self) -> None:
        for name in self.database.tables() if self.database else ():
            self.database.read(name).createOrReplaceTempView(name)

    def tables(self) -> list[str]:
        return sorted({*self.paths, *(self.database.tables() if self.database else ())})

    def schema(self, name: str) -> list[tuple[str, str]]:
        return self.spark.table(name).dtypes

    def drop(self, name: str) -> None:
        if self.paths.pop(name, None) is None and self.database:
            self.database.drop(name)
        self.spark.catalog.dropTempView(name)

    def _frame(self, s: SparkSession, name: str) -> DataFrame:
        if name in self.paths:
            return s.read.parquet(self.paths[name])
        return s.read.parquet(*[f"{self.database.path}/{f}" for f in self.database.state()[1][name]])

    def information_schema(self) -> None:
        """Views information_schema_tables, information_schema_columns, pg_class and pg_namespace of the tables as they are now."""
        schemas = {n: self._frame(self.spark, n).schema for n in self.tables()}
        t = [("quern", "public", n, "BASE TABLE") for n in schemas]
        c = [("quern", "public", n, f.name, k, f.dataType.simpleString(), "YES" if f.nullable else "NO") for n, s in schemas.items() for k, f in enumerate(s.fields, 1)]
        self.spark.createDataFrame(t, "table_catalog string, table_schema string, table_name string, table_type string").createOrReplaceTempView("information_schema_tables")
        self.spark.createDataFrame(c, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string").createOrReplaceTempView("information_schema_columns")
        # The numbers of the schemas, and of the first table.
        self.spark.createDataFrame([(11, "pg_catalog", 10), (2200, "public", 10)], "oid bigint, nspname string, nspowner bigint").createOrReplaceTempView("pg_namespace")
        self.spark.createDataFrame([(16384 + k, n, 2200, "r") for k, n in enumerate(schemas)], "oid bigint, relname string, relnamespace bigint, relkind string").createOrReplaceTempView("pg_class")

    # Ingest

    def ingest_csv(self, name: str, path: str, encoding: str | None = None, delimiter: str | None = None, strict: bool = True) -> int:
        """Appends the rows of CSV files with a header to a table (made of text columns if there is none); their number.

        The encoding is detected unless it is given.  All rows are read and checked before the table changes.  Columns the table
        has not are an error; those the file has not are null.
        """
        df = files.read_csv(self.spark, path, delimiter, strict, encoding or files.sniff_encoding(self.spark, path))
        if self.database.exists(name):
            kinds = dict(self.database.read(name).dtypes)
            if odd := [c for c in df.columns if c not in kinds]:
                raise ValueError(f"{name} has no columns {odd}")
            df = df.select(*[F.col(f"`{c}`").cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
        self.database.write(name, df, "append")
        self._changed(name)
        return self.spark.read.parquet(f"{self.database.path}/{self.database.state()[1][name][-1]}").count()

    def ingest_parquet(self, name: str, path: str) -> int:
        """Replaces a table by the rows of Parquet files; their number."""
        self.database.write(name, self.spark.read.parquet(path))
        self._changed(name)
        return self.database.read(name).count()

    def _changed(self, name: str) -> None:
        if self.database.exists(name):
            self.database.read(name).createOrReplaceTempView(name)
        for f in self.written:
            f(name)

    # Queries

    def _session(self, who: Principal) -> SparkSession:
        s = self.spark.newSession()
        register_functions(s)
        for name in self.tables():
            if self.policy and not self.policy.allows(who.role, name, "select"):
                continue
            df, rule = self._frame(s, name), self.policy.rule(name, who) if self.policy else None
            (df.filter(rule) if rule else df).createOrReplaceTempView(name)
        return s

    def sql(self, text: str, params: Mapping[str, object] | Sequence[object] | None = None, principal: Principal | None = None) -> DataFrame:
        """Runs a query; ``:name`` parameters come as a mapping, ``?`` or ``$1`` parameters as a sequence."""
        s = self._session(principal) if principal else self.spark
        if params is None:
            return s.sql(text)
        if isinstance(params, Mapping):
            return s.sql(text, args=dict(params))
        text, values = bind_positional(text, params)
        return s.sql(text, args=values)

    def page(self, text: str, limit: int = 10_000, **kw) -> tuple[list[dict], bool]:
        """At most ``limit`` rows for a client, and whether there are more; the engine itself has no cap."""
        rows = self.sql(text, **kw).limit(limit + 1).collect()
        return [r.asDict() for r in rows[:limit]], len(rows) > limit

    def arrow(self, text: str, limit: int = 1_000_000, **kw) -> pa.Table:
        """The result as an Arrow table for a client, of at most ``limit`` rows; larger results are written as files instead."""
        table = self.sql(text, **kw).limit(limit + 1).toArrow()
        if table.num_rows > limit:
            raise ValueError(f"the result has more than {limit} rows")
        return table

    # Changes

    def execute(self, text: str, principal: Principal | None = None) -> DataFrame | None:
        """Runs a statement: a query, INSERT, UPDATE, DELETE, BEGIN, COMMIT or ROLLBACK.

        Outside a transaction a change is one of its own.  Tables that are not the database's can't be changed.
        """
        c = parse_statement(text)
        if c.kind == "select":
            return self.sql(text, principal=principal)
        if c.kind == "begin":
            if self.open:
                raise ValueError("a transaction is open")
            self.open = Transaction(self.database)
        elif c.kind in ("commit", "rollback"):
            if not self.open:
                raise ValueError("no transaction is open")
            tx, self.open = self.open, None
            names = dict.fromkeys(n for n, _ in tx.ops)
            tx.commit() if c.kind == "commit" else tx.rollback()
            for n in names if c.kind == "commit" else ():
                self._changed(n)
        else:
            if principal and self.policy and not self.policy.allows(principal.role, c.table, c.kind):
                raise PermissionError(f"{principal.role} may not {c.kind} {c.table}")
            tx = self.open or Transaction(self.database)
            self._buffer(tx, c, principal)
            if tx is not self.open:
                tx.commit()
                self._changed(c.table)
        return None

    def _buffer(self, tx: Transaction, c: Change, who: Principal | None) -> None:
        rule = self.policy.rule(c.table, who) if who and self.policy else None
        where = " AND ".join(f"({p})" for p in (c.where, rule) if p) or None
        if c.kind == "update":
            tx.update({k: F.expr(v) for k, v in c.values.items()}, where, c.table)
        elif c.kind == "delete":
            tx.delete(where, c.table)
        else:
            rows = self.sql(c.query, principal=who)
            kinds = dict(tx.preview(c.table).dtypes)
            names = list(c.columns) or list(kinds)
            if len(names) != len(rows.columns) or (odd := [n for n in names if n not in kinds]):
                raise ValueError(f"{c.table} takes {list(kinds)}, not {names if len(names) == len(rows.columns) else rows.columns}")
            rows = rows.toDF(*names)
            tx.insert(rows.select(*[F.col(f"`{n}`").cast(k).alias(n) if n in names else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]), c.table)

    # Saved results

    def _results(self) -> Store:
        return Store(self.spark, f"{self.database.path}/_results/_index")

    def save_result(self, name: str, text: str, **kw) -> int:
        """Keeps a query's rows under a name; its number."""
        store, df = self._results(), self.sql(text, **kw)
        version, rows = store.read("results", [])
        ident = 1 + max((r["id"] for r in rows), default=0)
        path = f"{self.database.path}/_results/{ident}"
        df.write.mode("overwrite").parquet(path)
        store.write("results", [*rows, {"id": ident, "name": name, "sql": text, "columns": df.dtypes, "n_rows": self.spark.read.parquet(path).count()}], version)
        return ident

    def results(self) -> list[dict]:
        return self._results().read("results", [])[1]

    def result(self, ident: int) -> DataFrame:
        if ident not in [r["id"] for r in self.results()]:
            raise KeyError(f"no result {ident}")
        return self.spark.read.parquet(f"{self.database.path}/_results/{ident}")

    def delete_result(self, ident: int) -> None:
        store = self._results()
        version, rows = store.read("results", [])
        if ident not in [r["id"] for r in rows]:
            raise KeyError(f"no result {ident}")
        store.write("results", [r for r in rows if r["id"] != ident], version)
