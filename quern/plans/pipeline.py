"""Pipelines: steps in dependency order, with retries, materialised targets, incremental sources and a run log.

A step is one of, in this order of precedence: a sink (its query's rows are written out), a callable, a connector source, match
rules or a type 2 history over its query's rows, or a query alone.  Without a database the steps' frames are composed lazily as
views; with one, named targets are written as tables, so that a failure shows within the step that has it and a step that is used
twice is computed once.
"""

from __future__ import annotations

import graphlib
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dml import Database
from ..operators.match import MatchRule, match
from ..operators.scd2 import Scd2, apply_scd2
from ..sources.connectors import Connections, Connector, open_connector
from .store import Store
from .templates import fill_vars, render

#: Seconds that all retries of a run may wait together.
MAX_WAIT = 30.0
#: Errors of these kinds, or with these words, are the same on every try.
HOPELESS = (AnalysisException, ParseException, KeyError, TypeError, ValueError, PermissionError, FileNotFoundError)
HOPELESS_WORDS = ("syntax error", "permission denied", "access denied", "unauthorized", "forbidden", "authentication", "password", "unknown host", "unknownhost", "does not exist", "already exists", "duplicate key", "violates", "constraint")


def hopeless(error: BaseException) -> bool:
    """Whether trying again cannot help: wrong queries and values, missing rights or objects, violated constraints."""
    return isinstance(error, HOPELESS) or any(w in str(error).lower() for w in HOPELESS_WORDS)


@dataclass
class Step:
    """One step of a pipeline.

    sql: a query, or a template with ``params``; fn: a callable from the frames of its dependencies (or of its own query);
    source: a callable or a connector's settings (``connector`` or ``connection``, ``entity`` and its own); cursor: a column whose largest value so
    far is remembered, so that only rows above it are read; match: rules; scd2: a history kept in ``target``; sink: a callable or a
    connector's settings, with ``mode`` append or overwrite, or ``key`` for an upsert; target: the name of the result.
    """

    id: str
    sql: str | None = None
    fn: Callable[..., DataFrame] | None = None
    source: Callable[[SparkSession], DataFrame] | Mapping[str, object] | None = None
    sink: Callable[[DataFrame], None] | Mapping[str, object] | None = None
    deps: tuple[str, ...] = ()
    target: str | None = None
    retries: int = 0
    params: Mapping[str, object] = field(default_factory=dict)
    cursor: str | None = None
    match: Sequence[MatchRule] = ()
    scd2: Scd2 | None = None
    mode: str = "overwrite"

    @staticmethod
    def from_dict(s: Mapping[str, object], functions: Mapping[str, Callable] | None = None) -> Step:
        """A step from plain values, as YAML and JSON have them; ``fn`` names one of the given functions."""
        known = {"id", "sql", "fn", "source", "sink", "deps", "target", "retries", "params", "cursor", "match", "scd2", "mode"}
        if odd := set(s) - known:
            raise ValueError(f"step {s.get('id')}: unknown settings {sorted(odd)}")
        fn = None
        if s.get("fn"):
            if s["fn"] not in (functions or {}):
                raise ValueError(f"step {s['id']}: no function {s['fn']}")
            fn = functions[s["fn"]]
        tuples = lambda m, names: {k: tuple(v) if k in names and isinstance(v, list) else v for k, v in m.items()}
        rules = tuple(MatchRule(**tuples(r, ("scan_columns", "test_columns"))) for r in s.get("match") or ())
        spec = Scd2(**tuples(s["scd2"], ("key", "compare", "ignore"))) if s.get("scd2") else None
        return Step(s["id"], s.get("sql"), fn, s.get("source"), s.get("sink"), tuple(s.get("deps") or ()), s.get("target"), int(s.get("retries") or 0), s.get("params") or {}, s.get("cursor"), rules, spec, s.get("mode") or "overwrite")


@dataclass
class Pipeline:
    """state: a store in which runs, times and cursors are kept; database: where targets are written."""

    name: str
    steps: list[Step]
    values: Mapping[str, object] = field(default_factory=dict)
    log: list[tuple[str, str]] = field(default_factory=list)
    database: Database | None = None
    state: Store | None = None
    connections: Connections | None = None

    @staticmethod
    def from_dict(spec: Mapping[str, object], functions: Mapping[str, Callable] | None = None, **kw) -> Pipeline:
        steps = [Step.from_dict(s, functions) for s in spec["steps"]]
        if len({s.id for s in steps}) < len(steps):
            raise ValueError("two steps have one id")
        return Pipeline(spec.get("name", "pipeline"), steps, spec.get("vars") or {}, **kw)

    @staticmethod
    def from_yaml(text: str, values: Mapping[str, object] | None = None, functions: Mapping[str, Callable] | None = None, **kw) -> Pipeline:
        """Steps from YAML with ``vars``; given values override the file's."""
        import yaml

        own = ((yaml.safe_load(text) or {}).get("vars") or {}) | dict(values or {})
        return Pipeline.from_dict(yaml.safe_load(fill_vars(text, own)) | {"vars": own}, functions, **kw)

    def order(self) -> list[Step]:
        """Dependencies first, otherwise as written; a cycle is an error."""
        by = {s.id: s for s in self.steps}
        place = {s.id: i for i, s in enumerate(self.steps)}
        sorter = graphlib.TopologicalSorter({s.id: s.deps for s in self.steps})
        sorter.prepare()
        out, ready = [], []
        while sorter.is_active():
            ready = sorted([*ready, *sorter.get_ready()], key=place.__getitem__)
            first = ready.pop(0)
            out.append(by[first])
            sorter.done(first)
        return out

    def remembered(self) -> dict:
        """What the store has of this pipeline: ``last_run``, ``cursors`` by step, and the latest ``runs``."""
        return self.state.read(f"pipeline-{self.name}", {})[1] if self.state else {}

    def run(self, spark: SparkSession, now: float | None = None, wait: Callable[[float], None] = time.sleep, only: str | None = None) -> DataFrame | None:
        """Runs the steps (or one of them with what it needs); results are views named by target or id; gives the last frame."""
        began = time.time() if now is None else now
        known = self.remembered()
        cursors, left, frames, last, prev = dict(known.get("cursors", {})), MAX_WAIT, {}, None, None
        needed = self._needed(only) if only else {s.id for s in self.steps}
        status, done = "failed", []
        try:
            for step in (s for s in self.order() if s.id in needed):
                for attempt in range(step.retries + 1):
                    try:
                        special = {"now": _clock(began), "last_run": _clock(known.get("last_run", 0)), "prev": prev}
                        last = frames[step.id] = self._one(spark, step, frames, special, cursors, began)
                        self.log.append((step.id, "ok"))
                        break
                    except Exception as error:
                        self.log.append((step.id, "failed"))
                        pause = min(2.0**attempt, left)
                        if attempt == step.retries or hopeless(error) or pause <= 0:
                            raise
                        left -= pause
                        wait(pause)
                prev = step.target or step.id
                last.createOrReplaceTempView(prev)
                done.append(step.id)
            status = "ok"
        finally:
            self._remember(began, status, done, cursors, whole=only is None)
        return last

    def preview(self, spark: SparkSession, step: str, limit: int = 100) -> DataFrame:
        """At most ``limit`` rows of one step and what it needs; sinks and targets are not written, and nothing is remembered."""
        bare = [Step(s.id, s.sql, s.fn, s.source, None, s.deps, s.target, 0, s.params, s.cursor, s.match, s.scd2) for s in self.steps]
        return Pipeline(self.name, bare, self.values).run(spark, only=step).limit(limit)

    def _remember(self, began: float, status: str, done: list[str], cursors: Mapping[str, object], whole: bool) -> None:
        if not self.state:
            return
        name = f"pipeline-{self.name}"
        version, value = self.state.read(name, {})
        value["runs"] = [*value.get("runs", []), {"began": began, "status": status, "steps": done}][-100:]
        # A cursor moves once its step's rows are where they belong; the time of the last run once all steps are done.
        value["cursors"] = value.get("cursors", {}) | {s: cursors[s] for s in done if s in cursors}
        if status == "ok" and whole:
            value["last_run"] = began
        self.state.write(name, value, version)

    def _needed(self, only: str) -> set[str]:
        by, out, todo = {s.id: s for s in self.steps}, set(), [only]
        while todo:
            if (k := todo.pop()) not in out:
                out.add(k)
                todo += by[k].deps
        return out

    def _one(self, spark: SparkSession, step: Step, frames: Mapping[str, DataFrame], special: Mapping[str, object], cursors: dict, now: float) -> DataFrame:
        def cells(ident: str, column: str) -> list[object]:
            return [r[0] for r in frames[ident].select(column).collect()]

        def query() -> DataFrame:
            if not step.sql:
                return frames[step.deps[-1]] if step.deps else spark.range(0).select()
            return spark.sql(render(step.sql, {**self.values, **step.params}, special, cells))

        if step.source and not step.fn:
            df = self._read(spark, step, cursors)
        elif step.fn:
            df = step.fn(query()) if step.sql else step.fn(*[frames[d] for d in step.deps])
        elif step.match:
            df = match(query(), step.match)
        elif step.scd2:
            df = self._history(step, query(), now)
        else:
            df = query()
        if callable(step.sink):
            step.sink(df)
        elif step.sink:
            settings = dict(step.sink)
            entity, key = settings.pop("entity", None), tuple(settings.pop("key", ()))
            self._open(spark, settings).write(df, entity, mode=step.mode, key=key)
        elif step.target and self.database:
            self.database.write(step.target, df, "overwrite" if step.scd2 else step.mode)
            df = self.database.read(step.target)
        return df

    def _open(self, spark: SparkSession, settings: dict) -> Connector:
        """The connector of a named connection, or of a kind with settings of its own."""
        if "connection" in settings:
            if not self.connections:
                raise ValueError("the pipeline has no connections")
            return self.connections.open(settings.pop("connection"), **settings)
        return open_connector(spark, settings.pop("connector"), **settings)

    def _read(self, spark: SparkSession, step: Step, cursors: dict) -> DataFrame:
        if callable(step.source):
            df = step.source(spark)
        else:
            settings = dict(step.source)
            entity = settings.pop("entity", None)
            df = self._open(spark, settings).read(entity)
        if step.cursor:
            df, top = incremental(df, step.cursor, cursors.get(step.id))
            if top is not None:
                cursors[step.id] = str(top)
        return df

    def _history(self, step: Step, source: DataFrame, now: float) -> DataFrame:
        known = self.database.read(step.target) if self.database and step.target and self.database.exists(step.target) else None
        return apply_scd2(source, known, step.scd2, F.lit(_clock(now)).cast("timestamp_ntz"))


class Specs:
    """Pipelines and templates kept as YAML in a store."""

    def __init__(self, store: Store):
        self.store = store

    def save(self, name: str, text: str) -> int:
        """Keeps a pipeline's text, which may hold ``{{ vars }}``; the number of its version."""
        Pipeline.from_yaml(text)
        return self.store.write(f"spec-{name}", text)

    def names(self) -> list[str]:
        return [n.removeprefix("spec-") for n in self.store.names() if n.startswith("spec-")]

    def text(self, name: str) -> str:
        _, text = self.store.read(f"spec-{name}")
        if text is None:
            raise KeyError(f"no pipeline {name}")
        return text

    def load(self, name: str, values: Mapping[str, object] | None = None, **kw) -> Pipeline:
        return Pipeline.from_yaml(self.text(name), values, **kw)

    def delete(self, name: str) -> bool:
        return self.store.delete(f"spec-{name}")


def _clock(seconds: float) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%d %H:%M:%S")


def incremental(df: DataFrame, column: str, last: object | None) -> tuple[DataFrame, object | None]:
    """The rows above the watermark up to the new one, and the new watermark (the old one if there is no new row).

    The watermark may be text, as it is kept between runs.  The upper bound makes the rows and the watermark agree when the
    source grows meanwhile.
    """
    kind = df.schema[column].dataType
    new = df if last is None else df.filter(F.col(column) > F.lit(last).cast(kind))
    top = new.agg(F.max(column)).first()[0]
    if top is None:
        return new.filter(F.lit(False)), last
    return new.filter(F.col(column) <= F.lit(top).cast(kind)), top
