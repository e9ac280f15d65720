"""Triggers that run pipelines: cron times, new files, writes to tables, intervals, calls from outside; and a log of their runs."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..operators.datamart import Datamart
from .pipeline import Pipeline
from .store import Store

#: Names of common cron expressions.
ALIASES = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *"}
_SPANS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def _field(text: str, low: int, high: int) -> set[int]:
    """The numbers that a field of a cron expression stands for: ``*``, lists, ranges and steps."""
    out: set[int] = set()
    for part in text.split(","):
        body, _, step = part.partition("/")
        first, _, last = body.partition("-")
        a, b = (low, high) if body == "*" else (int(first), int(last or (high if step else first)))
        if not low <= a <= b <= high or (step and int(step) < 1):
            raise ValueError(f"cron field {text!r} is not within {low}-{high}")
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def cron_matches(spec: str, t: time.struct_time) -> bool:
    """Whether a five-field cron expression fires at this minute; if both days are restricted, either is enough."""
    fields = ALIASES.get(spec, spec).split()
    if len(fields) != 5:
        raise ValueError(f"{spec!r} has not five fields")
    minute, hour, day, month, weekday = (_field(f, *s) for f, s in zip(fields, _SPANS, strict=True))
    weekday = {d % 7 for d in weekday}
    on_day, on_weekday = t.tm_mday in day, (t.tm_wday + 1) % 7 in weekday
    right_day = on_day or on_weekday if fields[2] != "*" and fields[4] != "*" else on_day and on_weekday
    return t.tm_min in minute and t.tm_hour in hour and t.tm_mon in month and right_day


@dataclass(frozen=True)
class Trigger:
    """kind: cron (``spec`` an expression), file (a glob), table (a table's name), interval (seconds) or webhook (a secret)."""

    pipeline: str
    kind: str
    spec: str = ""


@dataclass
class Metrics:
    """The latest runs (a ring of bounded size), and callbacks that are told of each."""

    runs: deque = field(default_factory=lambda: deque(maxlen=3_600))
    listeners: list[Callable[[Mapping[str, object]], None]] = field(default_factory=list)

    def add(self, **run) -> None:
        self.runs.append(run)
        for f in self.listeners:
            f(run)

    def summary(self) -> dict[str, dict[str, float]]:
        """By pipeline: number of runs, failures, and mean seconds."""
        out: dict[str, dict[str, float]] = {}
        for r in self.runs:
            x = out.setdefault(r["pipeline"], {"runs": 0, "failed": 0, "seconds": 0.0})
            x["runs"] += 1
            x["failed"] += r["status"] != "ok"
            x["seconds"] += (r["seconds"] - x["seconds"]) / x["runs"]
        return out


class Runner:
    """Runs pipelines when their triggers fire, and refreshes datamarts.

    What has fired (minutes, files, times) is kept in a store, so that a restarted runner neither repeats nor forgets a run; files
    count as seen after the run that they fired has succeeded.
    """

    def __init__(self, spark: SparkSession, state: Store, metrics: Metrics | None = None):
        self.spark, self.state, self.metrics = spark, state, metrics or Metrics()
        self.pipelines: dict[str, Pipeline] = {}
        self.triggers: list[Trigger] = []
        self.marts: dict[str, Datamart] = {}

    def add(self, pipeline: Pipeline, *triggers: Trigger) -> None:
        for t in triggers:
            if t.kind not in ("cron", "file", "table", "interval", "webhook"):
                raise ValueError(f"unknown kind of trigger {t.kind}")
            if t.kind == "cron":
                cron_matches(t.spec, time.gmtime(0))
        self.pipelines[pipeline.name] = pipeline
        self.triggers += triggers

    def run(self, name: str, now: float | None = None, why: str = "manual") -> bool:
        """Runs a pipeline; a failure is logged and told, not raised."""
        began, status, error = time.time(), "ok", ""
        try:
            self.pipelines[name].run(self.spark, now)
        except Exception as e:
            status, error = "failed", f"{type(e).__name__}: {e}"[:500]
        self.metrics.add(pipeline=name, why=why, status=status, error=error, seconds=time.time() - began, at=now or began)
        return status == "ok"

    def webhook(self, name: str, secret: str, now: float | None = None) -> bool:
        if not any(t.kind == "webhook" and t.pipeline == name and t.spec == secret for t in self.triggers):
            raise PermissionError(f"no webhook for {name}")
        return self.run(name, now, "webhook")

    def table_written(self, table: str, now: float | None = None) -> None:
        """Tells that a table was written: pipelines of it run, datamarts of it turn stale and those refreshed on writes follow."""
        for t in self.triggers:
            if t.kind == "table" and t.spec == table:
                self.run(t.pipeline, now, f"table {table}")
        for m in self.marts.values():
            if m.invalidate(table):
                m.refresh(self.spark, now)

    def _files(self, glob: str) -> dict[str, int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(glob)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {s.getPath().toString(): s.getModificationTime() for s in fs.globStatus(p) or []}

    def tick(self, now: float | None = None) -> list[str]:
        """Runs what is due now; the names of what ran."""
        now = time.time() if now is None else now
        version, held = self.state.read("triggers", {})
        ran, minute = [], int(now // 60)
        for k, t in enumerate(self.triggers):
            key = f"{t.pipeline}/{t.kind}/{t.spec}/{k}"
            if t.kind == "cron" and held.get(key, -1) < minute and cron_matches(t.spec, time.gmtime(now)):
                held[key] = minute
                self.run(t.pipeline, now, "cron")
            elif t.kind == "interval" and now - held.get(key, 0.0) >= float(t.spec):
                held[key] = now
                self.run(t.pipeline, now, "interval")
            elif t.kind == "file" and (found := self._files(t.spec)) != held.get(key, {}):
                new = any(held.get(key, {}).get(f) != m for f, m in found.items())
                if not new or self.run(t.pipeline, now, "file"):
                    held[key] = found
                if not new:
                    continue
            else:
                continue
            ran.append(t.pipeline)
        for m in self.marts.values():
            if m.due(now):
                m.refresh(self.spark, now)
                ran.append(m.name)
        self.state.write("triggers", held, version)
        return ran

    def serve(self, every: float = 15.0, until: Callable[[], bool] = lambda: False) -> None:
        while not until():
            self.tick()
            time.sleep(every)
