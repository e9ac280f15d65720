"""Near-duplicate vectors by spherical-cap filters.

Filter directions are structured random product codes: the dimensions are cut into blocks, each block has random unit
codewords, and every combination of codewords is a direction.  A vector is list-decoded to all directions whose inner product
reaches the cap's height: partial sums that cannot reach it any more are cut off block by block, so the directions are never
enumerated.  Vectors meet on shared filters and pairs are verified by cosine in double precision.

A pair may share several filters; it counts only in the first filter that both have, so exact numbers of links come from sums of
counts and pairs are never written out.  Equal vectors are one class with a multiplicity.  Filters above ``BLOCK`` classes are
dealt out by pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, few, run_starts, runs
from .components import connected_components

#: Classes of one filter that a task compares at once.
BLOCK = 8192
#: Different lengths of vectors, at most; more are an error.
DIMS = 1_000
#: Classes that a filter holds on average, at most.
TARGET = 4096


class Filters:
    """Product codes for one dimension, with the cap height that gives the wanted recall.

    n: vectors that can meet.  Directions that share codewords are not independent, so several independently turned codes are
    used, and the height is calibrated on random pairs at the cosine: it is the highest at which the wanted share of them has a
    filter in common.  Of the numbers of codes and codewords whose filters hold ``TARGET`` vectors at most, those count that put
    a vector into the fewest filters.
    """

    def __init__(self, dim: int, n: int, cosine: float, recall: float = 0.99, blocks: int = 2, turns: tuple[int, ...] = (2, 4, 8, 16), pairs: int = 2000, seed: int = 7):
        self.dim, self.blocks, self.seed = dim, max(1, min(blocks, dim)), seed
        rng = np.random.default_rng([seed, dim])
        a, z = rng.standard_normal((2, pairs, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        z -= (z * a).sum(1, keepdims=True) * a
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * z if dim > 1 else a
        best = None
        for t in turns:
            words = 2
            while True:
                self._make(t, words)
                height, mean = self._calibrate(a, b, recall)
                group = n * mean / (t * self.codes)
                if group <= TARGET or self.codes >= 1 << 40:
                    break
                words = max(words + 1, math.ceil(words * min(4.0, (group / TARGET) ** (1 / self.blocks))))
            if best is None or mean < best[0]:
                best = (mean, t, words, height)
        self.mean, t, words, height = best
        self._make(t, words)
        self.height = height

    def _make(self, turns: int, words: int) -> None:
        self.turns, self.words, self.codes = turns, words, words**self.blocks
        rng = np.random.default_rng([self.seed, self.dim, turns, words])
        self.cuts, self.height = [self._code(self.dim, rng) for _ in range(turns)], -2.0

    def _calibrate(self, a: np.ndarray, b: np.ndarray, recall: float) -> tuple[float, float]:
        """The highest cap at which this share of the pairs meets, and the mean number of filters of a vector there."""
        low, high = -1.0, 1.0
        if self.turns * self.codes * len(a) > 1 << 24:
            a, b = a[:500], b[:500]
            low = 0.1
        for _ in range(14):
            self.height = (low + high) / 2
            if self._met(a, b)[0] >= recall:
                low = self.height
            else:
                high = self.height
        self.height = low
        return low, self._met(a, b)[1]

    def _met(self, a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
        found = each = 0
        span = self.turns * self.codes
        for at in range(0, len(a), 500):
            (i, c), (j, d) = self.decode(a[at : at + 500]), self.decode(b[at : at + 500])
            found += len(np.unique(np.intersect1d(i * span + c, j * span + d, assume_unique=True) // span))
            each += len(i)
        return found / len(a), each / len(a)

    def _code(self, dim: int, rng: np.random.Generator) -> list[np.ndarray]:
        out, at = [], 0
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for k in range(self.blocks):
            size = (dim - at) // (self.blocks - k)
            code = rng.standard_normal((self.words, size))
            code *= math.sqrt(size / dim) / np.linalg.norm(code, axis=1, keepdims=True)
            out.append(turn[:, at : at + size] @ code.T)
            at += size
        return out

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that rows of unit vectors exceed, ordered by row and filter."""
        rows, filters = [], []
        for t, cuts in enumerate(self.cuts):
            dots = [unit @ c for c in cuts]
            best = [d.max(1) for d in dots]
            rest = [sum(best[k + 1 :], np.zeros(len(unit))) for k in range(self.blocks)]
            row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
            for k, d in enumerate(dots):
                reach = total[:, None] + d[row]
                i, j = np.nonzero(reach >= (self.height - rest[k][row])[:, None])
                row, code, total = row[i], code[i] * self.words + j, reach[i, j]
            rows.append(row)
            filters.append(code + t * self.codes)
        row, code = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((code, row))
        return row[order], code[order]


def _links(x: np.ndarray, mult: np.ndarray, lo_side: np.ndarray, same: bool, early: np.ndarray, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links that each class has here, and links of a spanning forest, as positions.

    early: bit sets of the filters before this one; a pair with a common bit was counted there.
    """
    n = len(x)
    count, near = np.zeros(n, np.int64), np.zeros((n, n), bool)
    for a in range(0, n, 512):
        hit = x[a : a + 512] @ x.T >= cosine
        if not same:
            hit &= lo_side[a : a + 512, None] != lo_side[None, :]
        hit[np.arange(len(hit)), np.arange(a, a + len(hit))] = False
        near[a : a + 512] = hit
        for r in range(0, len(hit), 64):
            i, j = np.nonzero(hit[r : r + 64])
            if len(i):
                first = ~(early[a + r + i] & early[j]).any(1)
                count[a + r : a + r + 64] += np.bincount(i[first], mult[j[first]], min(64, len(hit) - r)).astype(np.int64)
    forest, left = [], np.ones(n, bool)
    for s in range(n):
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue:
            u = queue.pop()
            found = np.flatnonzero(near[u] & left)
            left[found] = False
            forest += [(u, int(v)) for v in found]
            queue.extend(found.tolist())
    return count, forest


def _bits(lists: list[np.ndarray]) -> np.ndarray:
    """Bit sets, numbered over the values that occur, of lists of filters."""
    sizes = np.array([len(v) for v in lists])
    values, index = np.unique(np.concatenate(lists), return_inverse=True)
    out = np.zeros((len(lists), max(1, -(-len(values) // 64))), np.uint64)
    np.bitwise_or.at(out, (np.repeat(np.arange(len(lists)), sizes), index >> 6), np.uint64(1) << (index & 63).astype(np.uint64))
    return out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, recall: float = 0.99) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors are compared when their labels are equal and not null and their lengths are equal.  A vector that is null, empty,
    all zero or holds null or non-finite components links with nothing, nor does a row with a null id: such rows have no links
    and are their own component.  Rows with the same id but different vectors are one node of the components.  Equal vectors
    are found exactly, others when they share a filter; every link found has the cosine.  No rows give no rows.

    A vector is shuffled once a filter, as it came in (single or double precision), with the filters before that one.
    """
    kind = vectors.schema[vec_col].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    cell, single = ("float", np.dtype("<f4")) if narrow else ("double", np.dtype("<f8"))
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{cell}>").alias("emb"), F.col(label_col).cast("string").alias("label"))
    odd = F.exists("emb", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("emb").isNotNull() & ~odd & F.exists("emb", lambda x: x != 0)
    # -0.0 + 0.0 is 0.0, so that equal vectors have equal hashes.
    v = v.withColumn("emb", F.when(ok, F.transform("emb", lambda x: (x + F.lit(0.0).cast(cell)).cast(cell))))
    v = v.withColumns({"h1": F.when(F.col("emb").isNotNull(), F.xxhash64(F.lit(1), "label", "emb")), "h2": F.when(F.col("emb").isNotNull(), F.xxhash64(F.lit(2), "label", "emb"))})
    classes = v.filter("emb is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("emb").alias("emb"), F.first("label").alias("label"))
    classes = cut(classes.withColumn("dim", F.size("emb")))
    # The largest set of vectors that are compared with each other sets the codes of all.
    made = {r.dim: Filters(r.dim, r.n, cosine, recall) for r in few(classes.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")), DIMS, "lengths of vectors")}
    keys, own = ["label", "dim", "filter"], ["h1", "h2", "rep", "mult"]

    def units(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one length with their vectors, and (row, filter) of the filters they exceed."""
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                dims = b.column(b.schema.get_field_index("dim")).to_numpy()
                for dim in np.unique(dims).tolist():
                    part = b.filter(pa.array(dims == dim))
                    x = part.column(part.schema.get_field_index("emb")).flatten().to_numpy().reshape(-1, dim)
                    yield part, x, *made[dim].decode(units(x))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, row, code in decoded(batches):
            yield pa.RecordBatch.from_arrays([*part.select(["label", "dim"]).take(pa.array(row)).columns, pa.array(code)], keys)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, row, code in decoded(batches):
            starts = np.searchsorted(row, np.arange(len(x)))
            early = [code[s:r].astype("<i8").tobytes() for r, s in enumerate(starts[row].tolist())]
            data = np.ascontiguousarray(x, single)
            vecs = [data[r].tobytes() for r in range(len(x))]
            yield pa.RecordBatch.from_arrays([*part.select([*own, "label", "dim"]).take(pa.array(row)).columns, pa.array(code), pa.array([vecs[r] for r in row.tolist()], pa.binary()), pa.array(early, pa.binary())], [*own, *keys, "vec", "early"])

    keyed = classes.mapInArrow(ship, "h1 long, h2 long, rep long, mult long, label string, dim int, filter long, vec binary, early binary")
    large = cut(classes.select("label", "dim", "emb").mapInArrow(name, "label string, dim int, filter long").groupBy(*keys).count().filter(F.col("count") > BLOCK))
    ways = keyed.withColumns({"lo": F.lit(0), "hi": F.lit(0), "own": F.lit(0)})
    if not large.isEmpty():
        dealt = keyed.join(large, keys, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")).drop("count")
        dealt = dealt.withColumn("own", F.pmod("h1", F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        ways = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks")
    group = [*keys, "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, group):
            t = t.combine_chunks()
            at = run_starts([t.column(k).to_numpy() for k in group])
            out: dict[str, list] = {k: [] for k in ("h1", "h2", "n", "src", "dst")}
            side, mult, rep = (t.column(k).to_numpy() for k in ("own", "mult", "rep"))
            h1, h2 = (t.column(k).to_numpy() for k in ("h1", "h2"))
            for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - a < 2:
                    continue
                part = t.slice(a, e - a)
                dim, lo, hi = part.column("dim")[0].as_py(), part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
                x = units(np.frombuffer(b"".join(part.column("vec").to_pylist()), single).reshape(-1, dim))
                early = _bits([np.frombuffer(z, "<i8") for z in part.column("early").to_pylist()])
                n, forest = _links(x, mult[a:e], side[a:e] == lo, lo == hi, early, cosine)
                some = np.flatnonzero(n)
                out["h1"] += h1[a:e][some].tolist()
                out["h2"] += h2[a:e][some].tolist()
                out["n"] += n[some].tolist()
                out["src"] += [int(rep[a + i]) for i, _ in forest]
                out["dst"] += [int(rep[a + j]) for _, j in forest]
            none = lambda k: pa.nulls(k, pa.int64())
            n, m = len(out["n"]), len(out["src"])
            if n or m:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(out[k], pa.int64()), none(m)]) for k in ("h1", "h2", "n")] + [pa.concat_arrays([none(n), pa.array(out[k], pa.int64())]) for k in ("src", "dst")], ["h1", "h2", "n", "src", "dst"])

    found = cut(ways.repartition(*group).sortWithinPartitions(*group).mapInArrow(verify, "h1 long, h2 long, n long, src long, dst long"))
    counts = found.filter("n is not null").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    # A repeated id ties its classes together: every row's id is linked to its class's smallest.
    known = classes.select("h1", "h2", "rep", "mult")
    tied = v.filter("emb is not null").select("vec_id", "h1", "h2").join(known.filter("mult > 1"), ["h1", "h2"]).filter("vec_id <> rep").select(F.col("vec_id").alias("src"), F.col("rep").alias("dst"))
    of = connected_components(found.filter("src is not null").select("src", "dst").unionByName(tied))
    links = known.join(counts, ["h1", "h2"], "left").select("h1", "h2", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = v.select("vec_id", "h1", "h2").join(links, ["h1", "h2"], "left").join(of, F.col("vec_id") == F.col("node"), "left")
    named = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), named.alias("component_id"), F.col("vec_id").eqNullSafe(named).alias("kept"))
