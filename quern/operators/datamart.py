"""Datamarts: named SQL definitions that are kept as tables and refreshed by hand, on writes or by age."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .dml import Table


@dataclass
class Datamart:
    name: str
    sql: str
    path: str
    mode: str = "manual"
    interval_s: float = 0.0
    sources: tuple[str, ...] = ()
    stale: bool = True
    refreshed: float = field(default=0.0)

    def invalidate(self, table: str) -> bool:
        """A write to a source makes it stale; on-write marts want a refresh then."""
        if table in self.sources:
            self.stale = True
        return self.stale and self.mode == "on_write"

    def due(self, now: float | None = None) -> bool:
        now = time.time() if now is None else now
        return (self.mode == "interval" and now - self.refreshed >= self.interval_s) or (self.mode == "on_write" and self.stale)

    def refresh(self, spark: SparkSession, now: float | None = None) -> DataFrame:
        table = Table(spark, self.path)
        table.write(spark.sql(self.sql))
        self.stale, self.refreshed = False, time.time() if now is None else now
        return table.read()
