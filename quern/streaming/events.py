"""Streams of events: windows with late data, sessions, deduplication, file arrival and change feeds."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def _late(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    """With a watermark, which needs timestamps with a zone; those without one are taken in the session's."""
    if not late:
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(events: DataFrame, ts: str, value: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(window_start, keys, n, total) over tumbling or sliding windows; ``late`` is the watermark's delay."""
    e, kind = _late(events, ts, late), events.schema[ts].dataType
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").cast(kind).alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n) of activity with pauses shorter than ``gap``."""
    e, kind = _late(events, ts, late), events.schema[ts].dataType
    return e.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").cast(kind).alias("session_start"), F.col("s.end").cast(kind).alias("session_end"), "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    e = _late(events, ts, late)
    return e.dropDuplicatesWithinWatermark(keys) if events.isStreaming else e.dropDuplicates(keys)


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Processes what has arrived in micro-batches and stops; run again it goes on where it ended."""
    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def apply_changes(target: DataFrame, changes: DataFrame, key: list[str], order: str = "lsn", op: str = "op") -> DataFrame:
    """The target after a batch of INSERT, UPDATE and DELETE events; of one key's events the last counts."""
    last = changes.groupBy(*key).agg(F.max(F.struct(F.col(order), *[F.col(c) for c in changes.columns if c not in (*key, order)])).alias("e")).select(*key, "e.*")
    kept = target.join(last.select(*key), key, "left_anti")
    return kept.unionByName(last.filter(F.col(op) != "DELETE").select(*target.columns))


def joined(left: DataFrame, right: DataFrame, keys: list[str], ts: str, other_ts: str, within: str, late: str | None = None, kind: str = "inner") -> DataFrame:
    """Rows of two streams (or tables) with equal keys, the right one at most ``within`` later than the left one.

    With ``late`` both sides get watermarks, so that the state of a stream is bounded and left rows without a partner can be told.
    """
    a, b = _late(left, ts, late), _late(right, other_ts, late)
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = (F.col(other_ts) >= F.col(ts)) & (F.col(other_ts) <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return a.join(b, on, kind).drop(*[f"__{k}" for k in keys])


#: One column of a logical change: name, type in brackets, and a value that is quoted, or bare up to the next blank.
_CHANGE = r"^table (\S+): (INSERT|UPDATE|DELETE): (?:old-key: .*? new-tuple: )?(.*)$"
_COLUMN = r"(?:^| )(\"[^\"]+\"|[^\s\[\"]+)\[[^\]]+(?:\[\])?\]:('(?:[^']|'')*'|\S+)"


def parse_changes(slot: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(lsn, op, columns) of one table's rows from (lsn, data) of a logical slot in its text form; other lines are left out.

    Values are text, ``null`` is null, and columns that a change does not name are null.  lsn orders as the log does.
    """
    parts = F.split("lsn", "/")
    at = F.conv(parts[0], 16, 10).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(20,0)") + F.conv(parts[1], 16, 10).cast("decimal(20,0)")
    body = F.regexp_extract("data", _CHANGE, 3)
    names, values = (F.regexp_extract_all(body, F.lit(_COLUMN), k) for k in (1, 2))
    d = slot.filter(F.regexp_extract("data", _CHANGE, 1) == table).select(at.cast("decimal(20,0)").alias("lsn"), F.regexp_extract("data", _CHANGE, 2).alias("op"), F.map_from_arrays(F.transform(names, lambda n: F.btrim(n, F.lit('"'))), values).alias("m"))

    def text(c: str):
        v = F.col("m").getItem(c)
        return F.when(v.startswith("'"), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), "''", "'")).when(v != "null", v)

    return d.select("lsn", "op", *[text(c).alias(c) for c in columns])


def consume(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame], None], every: str = "10 seconds"):
    """Runs for as long as its query is not stopped: each micro-batch is handed to ``apply``, then its offsets are committed.

    A batch whose commit was lost is handed over again (at least once), so ``apply`` should be an upsert.
    """
    return stream.writeStream.foreachBatch(lambda df, _: apply(df)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Progress(StreamingQueryListener):
    """Keeps the latest progress of a session's streams (a ring of bounded size) and tells callbacks of each."""

    def __init__(self, most: int = 3_600):
        self.seen: deque[dict] = deque(maxlen=most)
        self.listeners: list[Callable[[dict], None]] = []

    def _tell(self, what: dict) -> None:
        self.seen.append(what)
        for f in self.listeners:
            f(what)

    def onQueryStarted(self, event) -> None:
        self._tell({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._tell({"event": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "per_second": p.processedRowsPerSecond})

    def onQueryTerminated(self, event) -> None:
        self._tell({"event": "failed" if event.exception else "ended", "id": str(event.id)})
