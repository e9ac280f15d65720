"""Quality rules: base statistics and gradient-boosted trees over them.

Trees are fitted on a bounded sample of labelled documents by histograms, with monotonic constraints on chosen features, and
flattened into numpy node arrays, so that a batch of documents is scored level by level without a loop over documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Features of the trees; +1 or -1: the verdict may only rise or fall with it; 0: free.
FEATURES: tuple[tuple[str, int], ...] = (
    ("log_words", 0), ("word_length", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", 0),
    ("digit_share", -1), ("punct_share", 0), ("line_words", 0), ("distinct_share", 1), ("longest_word", 0), ("end_share", 0),
)
#: Rows of class 1 that set the threshold, at least.
LEAST = 40
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])
_KIND = {k: np.isin(_BYTES, np.frombuffer(v, np.uint8)) for k, v in {"symbol": b"#*$%&|<>", "digit": b"0123456789", "upper": bytes(range(65, 91)), "punct": b"!?,;:.\"'()-", "end": b".!?"}.items()}
_POWERS = np.random.default_rng(3).integers(1, 1 << 63, WINDOW, np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h += codes[k : k + n] * _POWERS[k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base statistics (``BASE``) and the features of one text; null is a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[bytes] = set()
    lines = dups = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            dups += line in seen
            seen.add(line)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    count = {k: int(hist[v].sum()) for k, v in _KIND.items()}
    chars = int(hist.sum() - hist[0x80:0xC0].sum() - hist[_SPACE].sum())
    n, repeats = len(words), repeated_words(words)
    base = [n, chars, count["symbol"], dups, repeats]
    c, w = max(chars, 1), max(n, 1)
    longest = max(map(len, words), default=0)
    return base, [np.log1p(n), chars / w, count["symbol"] / c, dups / max(lines, 1), repeats / w, count["upper"] / c, count["digit"] / c, count["punct"] / c, n / max(lines, 1), len(set(words)) / w, min(longest, 1000), count["end"] / w]


@dataclass
class Trees:
    """Flat node arrays of all trees; ``feature`` is -1 at a leaf.  Verdict: score >= threshold."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of quality 1 for each row."""
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                go = np.where(x[rows, np.maximum(f, 0)] <= self.cut[node], self.left[node], self.right[node])
                node = np.where(f < 0, node, go)
            out += self.value[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0, keep: float = 0.995) -> Trees | None:
    """Boosted trees for log loss; None without both classes.

    A split on a constrained feature must order its children's values, and the middle between them bounds both subtrees, so
    whole trees are monotone.  The trees learn from four fifths of the rows; the threshold keeps at least the share ``keep`` of the
    other fifth's rows of class 1, which they have not seen.  With fewer than ``LEAST`` such rows all rows do both.
    """
    if not len(y) or y.min() == y.max():
        return None
    held = np.random.default_rng(1).permutation(len(y)) % 5 == 0
    if y[held].sum() >= LEAST and y[~held].min() < y[~held].max():
        unseen, x, y = x[held & (y == 1)], x[~held], y[~held]
    else:
        unseen = x[y == 1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    rate_1 = y.mean()
    prior = float(np.log(rate_1 / (1 - rate_1)))
    score, nodes, roots = np.full(len(y), prior), [], []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at, best = len(nodes), (1e-6, -1, 0, 0.0, 0.0)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(gs / (hs + l2), low, high))
        nodes.append([-1, 0.0, at, at, value * rate])
        if level == depth or len(rows) < 40:
            return at
        for f, e in enumerate(edges):
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[rows, f], minlength=len(e) + 1))[:-1]
            vl, vr = np.clip(gl / (hl + l2), low, high), np.clip((gs - gl) / (hs - hl + l2), low, high)
            # The gain of clipped leaf values, not of the free optimum.
            gain = (gl * vl - 0.5 * (hl + l2) * vl**2) + ((gs - gl) * vr - 0.5 * (hs - hl + l2) * vr**2) - (gs * value - 0.5 * (hs + l2) * value**2)
            gain[(nl < 20) | (len(rows) - nl < 20)] = 0
            if monotone[f]:
                gain[(vr - vl) * monotone[f] < 0] = 0
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        _, f, k, vl, vr = best
        if f < 0:
            return at
        mid, bound = (vl + vr) / 2, [(low, high), (low, high)]
        if monotone[f]:
            bound = [(low, mid), (mid, high)] if monotone[f] > 0 else [(mid, high), (low, mid)]
        go = binned[rows, f] <= k
        nodes[at][:2] = [f, float(edges[f][k])]
        nodes[at][2] = grow(rows[go], g, h, level + 1, *bound[0])
        nodes[at][3] = grow(rows[~go], g, h, level + 1, *bound[1])
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), 0, -4.0, 4.0))
        made = Trees(*map(np.array, zip(*nodes, strict=True)), np.array(roots[-1:]), depth, 0.0, 0.0)
        score += made.score(x)
    out = Trees(*map(np.array, zip(*nodes, strict=True)), np.array(roots), depth, prior, 0.0)
    good = np.sort(out.score(unseen))
    out.threshold = min(0.0, float(good[int((1 - keep) * len(good))]))
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 10_000, seed: int = 5) -> Trees | None:
    """Fits the trees on about ``rows`` labelled documents (all if there are fewer), drawn by a hash of the id.

    Null labels are left out; a document with several labels takes the smallest.  None if the labels hold one class or none.
    """
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    n = told.count()
    if not n:
        return None
    if n > rows:
        told = told.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    bound_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(told, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py())[1] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    got = picked.select("id", "text", "y").mapInArrow(run, "id long, y int, x array<double>").toPandas().sort_values("id", kind="stable")
    if not len(got):
        return None
    return fit_trees(np.array(got.x.tolist()), (got.y.to_numpy() > 0).astype(float), [m for _, m in FEATURES])


def _judge(texts: pa.Array, trees: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base statistics, base failures, scores and verdicts of a batch of texts."""
    got = [statistics(t.as_py()) for t in texts]
    base = np.array([b for b, _ in got], np.int64).reshape(-1, len(BASE))
    x = np.array([f for _, f in got], float).reshape(-1, len(FEATURES))
    failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
    score = trees.score(x) if trees else np.zeros(len(x))
    return base, failed, score, ~failed & (score >= (trees.threshold if trees else 0.0))


def judge_quality(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score), one row per input row.

    Null texts have no words and fail the base.  Without trees the base rules decide alone.  Repeated rows are judged alike.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, failed, score, kept = _judge(b.column(1), trees)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *map(pa.array, base.T.copy()), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *BASE, "base_failed", "kept", "score"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, score double"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_quality(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and without a shuffle."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = _judge(b.column(b.schema.get_field_index(text_col)), trees)[3]
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
