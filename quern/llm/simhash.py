"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated fingerprint bits are grouped into partitions.  Partition i gets a threshold t_i >= -1 with sum(t_i + 1) = radius + 1,
so two fingerprints within the radius agree up to t_i bits in at least one partition.  A dynamic programme chooses the unequal
thresholds from candidate counts that are estimated from histograms of all fingerprints.  Every fingerprint then emits the keys
of its partitions with up to t_i set bits cleared (two values within t_i bits meet at their bitwise and), keys are grouped and
every group is verified by Hamming distance.

A group is searched breadth first and gives only a star for each of its components, never all pairs.  Groups above ``BLOCK``
fingerprints are split into blocks, each pair of blocks being a group of its own, so that no task holds an unbounded group and
no link is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, brief_shuffles, cut, run_starts, runs, salted_join, slices
from .components import connected_components
from .wordmemo import ragged, sums

BITS = 64
#: Fingerprints of one key that a task compares at once; larger groups are dealt out by pairs of blocks.
BLOCK = 32_768
#: In groups of up to so many fingerprints those without a neighbour are set aside before the search.
SMALL = 256
#: Coarse groups of more shingles than the first are dealt out by pairs of blocks: up to ``SPREAD`` blocks as long as a block has
#: fewer than the second, which a task holds twice at most.
SHINGLES, MOST_SHINGLES, SPREAD = 50_000, 4_000_000, 4
#: Bits in which fingerprints of five-word shingles may differ to be found by probing: 29 keys each at 200,000 texts, 179 at 10^7.
RADIUS = 8
#: The largest threshold of a partition.
MOST = 4
#: Cost of a probe key (emitted, shuffled, sorted) in units of one verified candidate pair.
PROBE_COST = 60.0


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits are independent of those of h (the finaliser of SplitMix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def halves(text: str | None, words: int = 4, seed: int = 42, looks: int = 1) -> list[int]:
    """One or more independent SimHashes of a text's word shingles, of the same hashes mixed once more each; 0 without words."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not got:
        return [0] * looks
    joined = b" ".join(got)
    sizes = np.fromiter(map(len, got), np.int64, len(got))
    ends = np.cumsum(sizes + 1) - 1
    left, right = (ends - sizes)[: 1 - words or None].tolist(), ends[words - 1 :].tolist()
    if len(got) <= words:
        left, right = [0], [len(joined)]
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros((looks, BITS), np.int64), len(left)
    for at in range(0, total, 65536):
        part = zip(left[at : at + 65536], right[at : at + 65536], strict=True)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in part), np.uint64)
        for k in range(looks):
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            h = _mixed(h) if k + 1 < looks else h
    return [int.from_bytes(np.packbits(2 * x > total, bitorder="little").tobytes(), "little") for x in ones]


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles as an unsigned number; 0 for a text without words."""
    return halves(text, words, seed)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, looks: int = 1) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's bits as a signed long.  Null texts get 0.

    With two looks a second, independent half follows as ``other``.
    """
    bound_batches(docs.sparkSession)
    names = ["fp", "other"][:looks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([halves(t.as_py(), words, seed, looks) for t in b.column(1)], np.uint64).reshape(-1, looks).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(fps[:, k].copy()) for k in range(looks))], ["doc_id", *names])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *names]))


def _bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the 64 x 64 counts of bits that are set together, over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
            n += len(bits)
        if n:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i * BITS + j, -1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["cell", "n"])

    got = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = {r.cell: r.n for r in got}
    return cells.get(-1, 0), np.array([cells.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of the bits, each grown from a seed by the bits most correlated with what it holds."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        rest = sorted(free)
        mine = [max(rest, key=lambda i: (corr[i, rest].sum(), -i))]
        free.discard(mine[0])
        while len(mine) < size:
            best = max(sorted(free), key=lambda i: (corr[i, mine].sum(), -i))
            mine.append(best)
            free.discard(best)
        out.append(sorted(mine))
    return out


def _ball(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two values of independent bits with these rates differ in at most 0, 1, .. most bits."""
    dist = np.zeros(len(p) + 1)
    dist[0] = 1
    for d in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return np.cumsum(dist)[: most + 1]


def allocate(costs: list[list[float]], radius: int) -> list[int]:
    """Thresholds t_i >= -1 of least total cost with sum(t_i + 1) = radius + 1; costs[i][t + 1] is the cost of t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for k in range(min(len(row) - 1, radius + 1 - used) + 1):
                new = (cost + row[k], [*ts, k - 1])
                if used + k not in now or new < now[used + k]:
                    now[used + k] = new
        best = now
    return best[radius + 1][1]


def _probes(ones: float, t: int) -> int:
    """Keys of a value with about so many set bits: up to t of them cleared."""
    return sum(math.comb(max(round(ones), t), k) for k in range(t + 1))


def _costs(n: float, rate: np.ndarray, groups: list[list[int]], radius: int, same: dict[int, float] | None = None) -> list[list[float]]:
    """The cost of each threshold from -1 on in each partition, in verified pairs.

    same: pairs of equal values by partition; by default those of independent bits.  Values that differ in up to t bits either way
    meet, which is at most 2 t bits.
    """
    out = []
    for i, bits in enumerate(groups):
        most = min(radius, MOST, len(bits))
        ball, ones = _ball(rate[bits], 2 * most), rate[bits].sum()
        ball = np.append(ball, np.full(2 * most + 1 - len(ball), ball[-1]))
        equal = n * (n - 1) / 2 * ball[0] if same is None else same.get(i, 0.0)
        out.append([0.0, *(equal * ball[2 * t] / max(ball[0], 1e-30) + PROBE_COST * n * _probes(ones, t) for t in range(most + 1))])
    return out


def weighed(n: float, radius: int, rate: np.ndarray | None = None) -> dict[int, float]:
    """The cost of every number of partitions for n fingerprints with these rates of set bits, as if bits were independent.

    Every number that can hold the radius at the largest threshold is weighed with its best thresholds, so the least cost rises
    smoothly with n: few fingerprints meet on many short values, many on few long ones with more keys each.
    """
    rate, cost = np.full(BITS, 0.5) if rate is None else rate, {}
    for parts in range(math.ceil((radius + 1) / (MOST + 1)), radius + 2):
        groups = [list(range(BITS))[i::parts] for i in range(parts)]
        # Keys hold a partition's value in 32 bits.
        if max(map(len, groups)) <= 32:
            rows = _costs(n, rate, groups, radius)
            cost[parts] = sum(r[t + 1] for r, t in zip(rows, allocate(rows, radius), strict=True))
    return cost


def plan(fps: DataFrame, radius: int, parts: int | None = None) -> tuple[list[list[int]], list[int]]:
    """Bit partitions and their thresholds of least cost for these distinct fingerprints.

    Of the numbers of partitions that cost little for independent bits, the up to three best are weighed again with the measured
    pairs of equal values, of which correlated bits have more.
    """
    n, together = _bit_statistics(fps)
    rate, cost = np.diag(together) / max(n, 1), {parts: 0.0} if parts else weighed(n, radius)
    likely = [p for p in sorted(cost, key=cost.get)[:3] if cost[p] <= 10 * min(cost.values())]
    best = None
    for p in likely:
        groups = group_bits(n, together, p)
        sizes = _keyed(fps.select("fp"), groups, [0] * p).groupBy("key").count()
        same = {r.part: float(r.pairs) for r in sizes.groupBy(F.shiftright("key", 32).alias("part")).agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
        rows = _costs(n, rate, groups, radius, same)
        thresholds = allocate(rows, radius)
        total = sum(r[t + 1] for r, t in zip(rows, thresholds, strict=True))
        if best is None or total < best[0]:
            best = (total, groups, thresholds)
    return best[1], best[2]


def _pack(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values' bits at these places, side by side, as unsigned 32-bit numbers."""
    at, byte = fp.view(np.uint8).reshape(-1, 8), np.arange(256)
    out = np.zeros(len(fp), np.uint32)
    for k in {b // 8 for b in bits}:
        out |= sum(((byte >> b % 8 & 1) << j for j, b in enumerate(bits) if b // 8 == k)).astype(np.uint32)[at[:, k]]
    return out


def _keyed(fps: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(fp, key): the value of every partition with up to its threshold of set bits cleared, each key once.

    Where there is ``other``, it goes along.  A key holds the partition's number above its 32 low bits and the packed value in them.
    """
    plans, names = [], [c for c in ("fp", "other") if c in fps.columns]
    for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        gone = [sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(range(len(bits)), k)]
        plans.append((i, bits, ~np.array(gone, np.uint32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for i, bits, keep in plans:
                for at in range(0, len(fp) if len(keep) else 0, max(1, 200_000 // len(keep))):
                    own = fp[at : at + max(1, 200_000 // len(keep))]
                    keys = np.sort(_pack(own, bits)[:, None] & keep[None, :], axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    row, col = np.nonzero(new)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at + row)) for c in b.columns), pa.array(keys[row, col].astype(np.int64) | i << 32)], [*names, "key"])

    return fps.select(*names).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "key"]))


def _close(x: np.ndarray, y: np.ndarray, radius: int, wide: int, similarity: float = 0.0) -> np.ndarray:
    """Which columns of x and y (a row for each half) differ in few bits, in the first half and in all.

    A third row has sizes, whose ratio must be ``similarity`` at least.
    """
    d = np.bitwise_count(x[:2] ^ y[:2])
    near = d[0] <= radius
    if len(d) > 1:
        near = near & (d[0] + d[1] <= wide)
    if len(x) > 2:
        near &= np.minimum(x[2], y[2]) >= similarity * np.maximum(x[2], y[2]) - 1e-9
    return near


def _linked(x: np.ndarray, group: np.ndarray, most: int, radius: int, wide: int, similarity: float = 0.0) -> np.ndarray:
    """Which columns have another one of their group that is close; groups are runs of at most ``most`` columns."""
    out = np.zeros(x.shape[1], bool)
    for d in range(1, min(most, len(out))):
        near = (group[d:] == group[:-d]) & _close(x[:, d:], x[:, :-d], radius, wide, similarity)
        out[d:] |= near
        out[:-d] |= near
    return out


def _forest(x: np.ndarray, radius: int, wide: int = 2 * BITS, similarity: float = 0.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stars (smallest, others) over the components of the graph of close fingerprints, by breadth-first search.

    A fingerprint of two halves is named by their exclusive or, or by the fourth row where there is one.  Groups that overlap mostly share their smallest names, so
    different groups give few different links.
    """
    out, left = [], x
    while left.shape[1] > 1:
        queue, mine, left = [left[:, :1]], [left[:, :1]], left[:, 1:]
        while queue and left.shape[1]:
            near = _close(left, queue.pop(), radius, wide, similarity)
            if near.any():
                found = left[:, near]
                mine.append(found)
                queue.extend(np.split(found, found.shape[1], 1))
                left = left[:, ~near]
        if len(mine) > 1:
            whole = np.concatenate(mine, 1)
            whole = whole[3] if len(whole) > 3 else np.bitwise_xor.reduce(whole, 0)
            least = whole.min()
            rest = whole[whole != least]
            out.append((np.full(len(rest), least), rest))
    return out


def _star_links(keyed: DataFrame, large: DataFrame, parts_of: list[str], radius: int, wide: int, similarity: float = 0.0) -> DataFrame:
    """(src, dst): stars over the close ones of every ``key``'s group.  Large groups are dealt out by pairs of blocks.

    ``large`` has the keys of groups above ``BLOCK`` with a count, which may be higher than the group's.  The columns are ``fp``,
    perhaps ``other``, and perhaps ``size`` and a name ``rep``, in this order.
    """
    large = cut(large)
    ways, names = keyed, ["key"]
    if not large.isEmpty():
        dealt = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("long"))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64(parts_of[-1]), F.col("blocks"))).withColumn("against", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        ways, names = dealt.select(*parts_of, "key", F.least("own", "against").alias("lo"), F.greatest("own", "against").alias("hi")), ["key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, names):
            x, at = np.stack([t.column(c).to_numpy() for c in parts_of]).view(np.uint64), run_starts([t.column(k).to_numpy() for k in names])
            size = np.diff(at)
            group, small = np.repeat(np.arange(len(size)), size), np.repeat(size <= SMALL, size)
            some = np.ones(len(small), bool)
            some[small] = _linked(x[:, small], group[small], int(size[size <= SMALL].max(initial=0)), radius, wide, similarity)
            x, at = x[:, some], run_starts([group[some]])
            found = [(x[0, :0], x[0, :0])]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                found += _forest(x[:, a:b], radius, wide, similarity)
            src, dst = (np.concatenate(x).astype(np.uint64).view(np.int64) for x in zip(*found, strict=True))
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return ways.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "src long, dst long").distinct()


def links(fps: DataFrame, radius: int = 4, parts: int | None = None, wide: int = 2 * BITS) -> DataFrame:
    """(src, dst) whose components are those of all pairs within the radius, for distinct fingerprints ``fp``.

    Where there is a column ``other`` with a second half, both halves together must differ in at most ``wide`` bits too, and
    src and dst are the exclusive or of the halves.
    """
    if fps.isEmpty():
        return fps.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).filter(F.lit(False))
    groups, thresholds = plan(fps, radius, parts)
    keyed = _keyed(fps, groups, thresholds)
    large = keyed.groupBy("key").count().filter(F.col("count") > BLOCK)
    return _star_links(keyed, large, [c for c in ("fp", "other") if c in fps.columns], radius, wide)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable by links of at most ``radius`` differing bits.

    Every row gets a row, repeated ids too.  Null, empty and blank texts have fingerprint zero and are linked like any other.
    A null id stays null and never names a component of rows that have ids.  No rows give no rows.  Other columns are ignored.
    """
    fp = cut(fingerprints(docs, id_col, text_col, words, seed))
    distinct = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    of = connected_components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component"))
    named = distinct.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return fp.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles (fewer words: of the whole sequence; none: no hash)."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = [b" ".join(got[i : i + words]) for i in range(max(1, len(got) - words + 1))] if got else []
    return np.unique(np.array([xxhash.xxh64_intdigest(j, seed) for j in joined], np.uint64))


def _similar(fps: np.ndarray, sets: np.ndarray, sizes: np.ndarray, labels: np.ndarray, wide: int, least: float) -> list[tuple[int, np.ndarray]]:
    """Spanning-forest links (position, positions) of pairs within ``wide`` bits of both halves whose sets have the Jaccard similarity.

    Those of one label are linked already: they are followed, but neither compared nor given.
    """
    starts, codes = np.cumsum(sizes) - sizes, np.unique(sets, return_inverse=True)[1]
    mark, out, left = np.zeros(int(codes.max(initial=-1)) + 1, bool), [], np.arange(fps.shape[1])
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            same = labels[left] == labels[x]
            if same.any():
                queue.extend(left[same].tolist())
                left = left[~same]
            own = codes[starts[x] : starts[x] + sizes[x]]
            near = np.flatnonzero((np.bitwise_count(fps[:, left] ^ fps[:, x : x + 1]).sum(0) <= wide) & (np.minimum(sizes[left], sizes[x]) >= least * np.maximum(sizes[left], sizes[x]) - 1e-9))
            if not len(near):
                continue
            mark[own] = True
            y = left[near]
            both = sums(mark[codes[ragged(starts[y], sizes[y])]], np.append(0, np.cumsum(sizes[y])))
            mark[own] = False
            hit = both >= least * (sizes[x] + sizes[y] - both) - 1e-9
            if hit.any():
                out.append((x, y[hit]))
                queue.extend(y[hit].tolist())
                left = np.delete(left, near[hit])
    return out


def _digest(text: Column) -> Column:
    """The md5 of a text; null texts are empty ones."""
    return F.coalesce(F.md5(text), F.md5(F.lit("")))


def _prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, by hash and common ones last; sets of at least this Jaccard similarity share one of them.

    Similar sets share ``similarity`` of either one's size, so the first of what is shared is among so many of both.  A set without
    shingles has the key 0.
    """
    if not len(hashes):
        return np.zeros(1, np.uint64)
    late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    return np.concatenate([hashes[~late], hashes[late]])[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def _common_shingles(texts: DataFrame, n: int, words: int, seed: int, docs: int = 4_000, most: int = 20_000) -> np.ndarray:
    """Shingles of many texts of a sample, sorted; they stand last in the order of shingles, which changes costs, not links."""
    spot = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *(shingles(t.as_py(), words, seed) for t in b.column(0))]).view(np.int64))], ["h"])

    sample = texts.filter(spot < int(1_000_000 * docs / max(n, 1)) + 1).select("text")
    least = max(8, min(n, docs) // 2_000)
    got = sample.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(most).select("h").toPandas()
    return np.sort(got.h.to_numpy(np.int64).view(np.uint64))


def _prefix_links(texts: DataFrame, words: int, wide: int, similarity: float, seed: int) -> DataFrame:
    """(src, dst) whose components hold every pair of texts (rep, text) of the similarity, and others; texts come from a checkpoint.

    Linked texts share one of the first shingles of their sets (prefix filter: no pair of the similarity is missed), have sizes that
    allow it and differ in at most ``wide`` bits of two 64-bit fingerprints.  Each key's group gives stars.
    """
    bound_batches(texts.sparkSession)
    n = texts.select("rep").count()
    common = _common_shingles(texts, n, words, seed)
    # A key of more than BLOCK texts is in so many texts of one partition at least; only such keys are shuffled to be counted.
    parts = max(1, texts.rdd.getNumPartitions())
    least = max(1, BLOCK // parts)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)]
        for whole in batches:
            for b in slices(whole, "text"):
                held.append(np.concatenate([np.zeros(0, np.uint64), *(_prefix(shingles(t.as_py(), words, seed), common, similarity) for t in b.column(0))]))
        keys, count = np.unique(np.concatenate(held), return_counts=True)
        some = count >= least
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(count[some].astype(np.int64))], ["key", "n"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                got = [t.as_py() for t in b.column(1)]
                fps = np.array([halves(t, words, seed, 2) for t in got], np.uint64).reshape(-1, 2).view(np.int64)
                sets = [shingles(t, words, seed) for t in got]
                first = [_prefix(x, common, similarity) for x in sets]
                row = np.repeat(np.arange(len(got)), [len(x) for x in first])
                size = np.array([len(x) for x in sets], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(fps[row, 0]), pa.array(fps[row, 1]), pa.array(size[row]), pa.array(np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64))], ["rep", "fp", "other", "size", "key"])

    keyed = texts.select("rep", "text").mapInArrow(keys, "rep long, fp long, other long, size long, key long")
    large = texts.select(F.col("rep").alias("key"), F.lit(0).cast("long").alias("count")).limit(0)
    if n > BLOCK:
        # Partitions that tell nothing of a key have less than ``least`` texts of it each.
        told = texts.select("text").mapInArrow(frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("partitions"))
        large = told.select("key", (F.col("n") + (parts - F.col("partitions")) * (least - 1)).alias("count")).filter(F.col("count") > BLOCK)
    return _star_links(keyed, large, ["fp", "other", "size", "rep"], BITS, wide, similarity)


def _undecided(members: DataFrame) -> DataFrame:
    """The rows (rep, coarse, label) of coarse groups that hold more than one label."""
    several = members.groupBy("coarse").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("coarse")
    return cut(salted_join(members, several, "coarse", "rep"))


def _measured(texts: DataFrame, reps: DataFrame, words: int, seed: int) -> DataFrame:
    """(rep, fp, other, sets) of these texts: both fingerprints and all distinct shingles."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [t.as_py() for t in b.column(1)]
            fps = np.array([halves(t, words, seed, 2) for t in got], np.uint64).reshape(-1, 2).view(np.int64)
            sets = [shingles(t, words, seed).view(np.int64) for t in got]
            bounds = np.append(0, np.cumsum(np.fromiter(map(len, sets), np.int64, len(sets)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps[:, 0].copy()), pa.array(fps[:, 1].copy()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))], ["rep", "fp", "other", "sets"])

    return cut(texts.join(reps, "rep", "left_semi").select("rep", "text").mapInArrow(measure, "rep long, fp long, other long, sets array<long>"))


def _verified(measured: DataFrame, members: DataFrame, wide: int, similarity: float) -> DataFrame:
    """(src, dst): links of pairs of the similarity between the labels of a coarse group, breadth first in blocks, not all pairs."""
    rows = measured.join(members, "rep")
    total = rows.groupBy("coarse").agg(F.sum(F.size("sets") + 1).alias("total"))
    dealt = salted_join(rows, total, "coarse", "rep").withColumn("blocks", F.greatest(F.least(F.ceil(F.col("total") / SHINGLES), F.lit(SPREAD)), F.ceil(F.col("total") / MOST_SHINGLES)).cast("long")).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = dealt.withColumn("against", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    names = ["coarse", "lo", "hi"]
    dealt = dealt.select("coarse", F.least("own", "against").alias("lo"), F.greatest("own", "against").alias("hi"), "rep", "label", "fp", "other", "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, names):
            t = t.combine_chunks()
            at = run_starts([t.column(k).to_numpy() for k in names])
            rep, label = (t.column(c).to_numpy() for c in ("rep", "label"))
            fps, sets = np.stack([t.column(c).to_numpy() for c in ("fp", "other")]).view(np.uint64), t.column("sets").combine_chunks()
            offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
            src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for x, ys in _similar(fps[:, a:e], flat[offsets[a] : offsets[e]], np.diff(offsets[a : e + 1]), label[a:e], wide, similarity):
                    src.append(np.full(len(ys), rep[a + x]))
                    dst.append(rep[a + ys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(compare, "src long, dst long")


def _similar_texts(texts: DataFrame, words: int, radius: int, wide: int, similarity: float, seed: int) -> DataFrame:
    """(node, component) of the texts (rep, text) that have a similar one; the table comes from a checkpoint.

    The pigeonhole search gives components of fingerprints within the radius, in which shingle sets are compared exactly; what is
    alike gets a label.  A fingerprint can't promise a similarity, so the pairs beyond the radius are looked for by the prefix
    filter, and compared only where its components hold more than one label.
    """
    probed = cut(near_duplicates(texts, "rep", "text", words, radius, seed).select(F.col("doc_id").alias("rep"), F.col("component_id").alias("coarse"), F.col("doc_id").alias("label")))
    probed = _undecided(probed)
    measured = _measured(texts, probed.select("rep"), words, seed)
    known = connected_components(_verified(measured, probed, wide, similarity))
    close = connected_components(_prefix_links(texts, words, wide, similarity, seed)).select(F.col("node").alias("rep"), F.col("component").alias("coarse"))
    rest = close.join(known.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    rest = _undecided(rest)
    new = _measured(texts, rest.select("rep").join(probed.select("rep"), "rep", "left_anti"), words, seed)
    found = _verified(measured.unionByName(new), rest, wide, similarity)
    return connected_components(found.unionByName(known.select(F.col("node").alias("src"), F.col("component").alias("dst"))))


def verified_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = RADIUS, wide: int = 40, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, component_id) of near-duplicates that are verified on the texts' shingle sets.

    A link is a pair whose sets of word shingles have at least this Jaccard similarity; texts without words are like each other.
    One row for every distinct id that is not null; of an id's texts the one of the smallest digest is compared.
    """
    with brief_shuffles(docs.sparkSession):
        d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
        exact = cut(d.select("doc_id", _digest(F.col("text")).alias("digest")).groupBy("doc_id").agg(F.min("digest").alias("digest")))
        reps = exact.groupBy("digest").agg(F.min("doc_id").alias("rep"))
        texts = d.join(reps.select(F.col("rep").alias("doc_id"), "digest"), "doc_id").filter(_digest(F.col("text")) == F.col("digest")).dropDuplicates(["doc_id"])
        of = _similar_texts(cut(texts.select(F.col("doc_id").alias("rep"), "text")), words, radius, wide, similarity, seed).select(F.col("node").alias("rep"), "component")
        named = reps.join(of, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
        return exact.join(named, "digest").select("doc_id", "component_id")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = RADIUS, wide: int = 40, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """One row of each group of near-duplicate rows: of the smallest id, of its texts the one of the smallest digest.

    Fingerprints are probed within the radius and what they link is verified on shingle sets; an exact search finds the rest.
    Rows take part by their texts, so ids may repeat or be null; a null id stays only where its group has no other.  Of rows that
    share id and text any one stays.  Texts are shuffled once to be made distinct; what is dropped then are rows of numbers.
    """
    order = F.struct(F.col(id_col).isNull(), F.col(id_col))
    whole = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("row")
    with brief_shuffles(docs.sparkSession):
        digests = cut(docs.groupBy(_digest(F.col(text_col)).alias("digest")).agg(whole).withColumn("rep", F.monotonically_increasing_id()))
        of = _similar_texts(digests.select("rep", F.col("row").getField(text_col).alias("text")), words, radius, wide, similarity, seed).select(F.col("node").alias("rep"), "component")
        ident = F.col("row").getField(id_col)
        members = of.join(digests.select("rep", F.struct(ident.isNull().alias("none"), ident.alias("id"), "digest").alias("order")), "rep")
        stays = members.groupBy("component").agg(F.min_by("rep", "order").alias("rep"))
        gone = cut(of.select("rep").join(stays.select("rep"), "rep", "left_anti"))
        return digests.join(gone, "rep", "left_anti").select("row.*")
