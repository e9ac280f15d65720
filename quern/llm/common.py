"""What several operators share: the shared folder, table reading, Arrow batches of bounded size and grouped streams."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Python workers see Arrow batches of at most so many rows; long texts are cut into smaller slices by ``slices``.
ROWS_PER_BATCH = 1000
#: Bytes of text that a Python worker turns into words at a time (a single longer text is still taken whole).
BYTES_PER_SLICE = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset a temporary folder is made, but only for a local master: on a cluster that would be one machine's disk.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quern-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def few(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that is small by its meaning; more than ``most`` are an error, before they reach the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """DataFrames made inside free their shuffles' files as soon as an action on them ends, not when the driver collects garbage.

    For operators of many steps that hand on checkpoints.  The session's setting is put back; it decides no result.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, salts: int = 8) -> DataFrame:
    """An inner join of many rows with one row a key, in which a hot key's rows spread over ``salts`` tasks by a hash of ``by``."""
    salt = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    spread = one.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("salt__", salt).join(spread, [key, "salt__"]).drop("salt__")


def bound_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Lowers the rows in an Arrow batch, for operators whose rows hold whole texts.

    The setting is the session's and stays: Spark reads it when a plan is run, which may be long after the operator was called.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def slices(batch: pa.RecordBatch, column: str, most: int = BYTES_PER_SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch that hold about ``most`` bytes of ``column`` each, and one row at least."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from batches that are sorted by these keys (a run may span batches).

    A run is held in memory, so callers split large keys into blocks of bounded size first.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        first = tuple(c[0].as_py() for c in cols)
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            x = c.to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(change)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        if len(starts):
            tail = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, tail)])
            held = [batch.slice(tail)]
        else:
            held.append(batch)
        last = tuple(c[-1].as_py() for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def run_starts(arrays: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys start, with the length at the end."""
    n = len(arrays[0])
    change = np.ones(n, bool)
    if n:
        change[1:] = False
        for x in arrays:
            change[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(change), n)
