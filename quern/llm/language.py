"""Language identification by interpolated Kneser-Ney character models.

One model per language over lower-cased letters, every run of other characters being one space.  The n-grams of all languages
stand in one sorted array of 64-bit hashes an order, with a row of log probabilities (a column a language); histories have a row
of back-off weights.  A text's cross-entropy is its mean over characters, and the lowest wins.  A text whose lowest is above
its language's calibrated limit is rejected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, few, slices

ORDER = 4
#: Characters that are scored at once, so that memory does not follow the length of a text.
PLACES = 1 << 18
#: Rows of a language that calibrate its limit, at least; a language with too few gives all of its rows to both ends, in folds.
CALIBRATE = 100
#: Languages that models are made for, at most; more are an error.
LANGUAGES = 2_000
#: Folds of such languages.
FOLDS = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    if not _FOLD:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                out[c] = ord(low[0]) if low[0].isalpha() else c
        _FOLD.append(out)
    return _FOLD[0]


def _codes(text: str) -> np.ndarray:
    """A text's letters, runs of others as one space, with spaces before and after; empty if it has no letter."""
    raw = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = raw == 32
    if gap.all():
        return raw[:0]
    raw = raw[~(gap & np.append(True, gap[:-1]))]
    return np.concatenate([np.full(ORDER - 1, 32, np.uint32), raw, np.full(int(raw[-1] != 32), 32, np.uint32)])


def _hashes(codes: np.ndarray, order: int, ends: np.ndarray | None = None) -> np.ndarray:
    """The hash of the ``order`` characters that end at each of these places (by default from the ORDER-th on)."""
    ends = np.arange(ORDER - 1, len(codes)) if ends is None else ends
    h = np.full(len(ends), order, np.uint64)
    for k in range(order):
        h ^= codes[ends - (order - 1 - k)]
        h *= _MUL
        h ^= h >> np.uint64(29)
    return h


def _gram_hash(gram: str) -> int:
    return int(_hashes(np.array([32] * (ORDER - len(gram)) + [ord(c) for c in gram], np.uint32), len(gram))[0])


@dataclass
class Model:
    """langs; per order: sorted hashes with log probabilities, and hashes of histories with log back-off weights.

    floor: the log probability of an unseen character in every language; limits: the highest cross-entropies accepted.
    """

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    back: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    limits: np.ndarray

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character in every language (rows: texts), and the number of characters scored."""
        out, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held: list[tuple[int, np.ndarray]] = []
        for i, t in enumerate(texts):
            codes = _codes(t) if t else np.zeros(0, np.uint32)
            sizes[i] = max(0, len(codes) - ORDER + 1)
            for at in range(0, int(sizes[i]), PLACES):
                held.append((i, codes[at : at + PLACES + ORDER - 1]))
                if sum(len(c) for _, c in held) >= PLACES:
                    self._add(held, out)
                    held = []
        self._add(held, out)
        some = sizes > 0
        out[some] /= -np.log(2) * sizes[some, None]
        return out, sizes

    def _add(self, parts: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        """Adds the log probabilities of the places of parts of texts to the texts' rows."""
        if not parts:
            return
        codes = np.concatenate([c for _, c in parts])
        sizes = np.array([len(c) - ORDER + 1 for _, c in parts])
        stops = np.cumsum(sizes)
        places = np.arange(stops[-1]) + np.repeat((ORDER - 1) * np.arange(1, len(parts) + 1), sizes)
        total = np.zeros((len(places), len(self.langs)), np.float32)
        open_ = np.arange(len(places))
        for k in range(ORDER, 0, -1):
            open_ = open_[~self._look(self.grams[k - 1], _hashes(codes, k, places[open_]), open_, total)]
            if k > 1 and len(open_):
                self._look(self.back[k - 2], _hashes(codes, k - 1, places[open_] - 1), open_, total)
        total[open_] += self.floor
        np.add.at(out, [i for i, _ in parts], np.add.reduceat(total, stops - sizes, axis=0, dtype=np.float64))

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, rows: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Adds what the table has for the hashes to these rows; which hashes it has."""
        keys, logs = table
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        total[rows[hit]] += logs[at[hit]]
        return hit


def kneser_ney(counts: dict[str, dict[str, int]]) -> Model:
    """Models from the counts of n-grams of the highest order in every language.

    Probabilities of the union of n-grams are stored for every language, those that a language has not seen by its back-off.
    """
    langs = sorted(counts)
    tables: list[list[dict[str, float]]] = []
    backs: list[list[dict[str, float]]] = []
    alphabet = {g[-1] for c in counts.values() for g in c}
    union = [{g[-k:] for c in counts.values() for g in c} for k in range(1, ORDER + 1)]
    for lang in langs:
        level: dict[str, int] = dict(counts[lang])
        orders = []
        for k in range(ORDER, 0, -1):
            orders.append(level)
            lower: dict[str, int] = defaultdict(int)
            for g in level:
                lower[g[1:]] += 1
            level = dict(lower)
        orders.reverse()
        probs: list[dict[str, float]] = []
        back: list[dict[str, float]] = []
        for k, seen in enumerate(orders, 1):
            ones, twos = (sum(1 for v in seen.values() if v == w) for w in (1, 2))
            d = ones / (ones + 2 * twos) if ones else 0.5
            d = min(max(d, 0.05), 0.95)
            total: dict[str, int] = defaultdict(int)
            kinds: dict[str, int] = defaultdict(int)
            for g, v in seen.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            lam = {h: d * kinds[h] / total[h] for h in total}
            here = {}
            for g in union[k - 1]:
                lower_p = probs[-1][g[1:]] if k > 1 else 1 / (len(alphabet) + 1)
                h = g[:-1]
                here[g] = (max(seen.get(g, 0) - d, 0) / total[h] + lam[h] * lower_p) if h in total else lower_p
            probs.append(here)
            back.append(lam)
        tables.append(probs)
        backs.append(back)

    def sort(rows: dict[str, list[float]]) -> tuple[np.ndarray, np.ndarray]:
        h = np.array([_gram_hash(g) for g in rows], np.uint64)
        order = np.argsort(h)
        return h[order], np.log(np.array(list(rows.values()), np.float64))[order].astype(np.float32)

    grams = [sort({g: [t[k][g] for t in tables] for g in union[k]}) for k in range(ORDER)]
    back = []
    for k in range(1, ORDER):
        histories = {h for b in backs for h in b[k]}
        back.append(sort({h: [b[k].get(h, 1.0) for b in backs] for h in histories}))
    floor = np.log([b[0][""] / (len(alphabet) + 1) for b in backs]).astype(np.float32)
    return Model(langs, grams, back, floor, np.full(len(langs), np.inf))


def fit_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", rows: int = 2_000, keep: float = 0.999, slack: float = 0.5, seed: int = 9) -> Model | None:
    """Fits models on about ``rows`` labelled rows (``rows`` over the number of languages from each, all if it has fewer).

    Rows are drawn by a hash of the key, whole texts; rows without language or text are left out; None if no row is left.  Four
    fifths give n-grams.  The other fifth, but about ``CALIBRATE`` rows a language at least, calibrates the rejection: a language's
    limit is the quantile ``keep`` of its own cross-entropies plus ``slack`` bits.  A language with too few rows for both gives all
    of them to the n-grams, and each fifth of them is calibrated under models without that fifth.  With fewer than 20 calibrated
    rows the limit is the larger one of its own and of all languages pooled; with none in any language it is that of letters at
    random.  Only counts of n-grams and one number a sampled row reach the driver.
    """
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(key_col), F.lit(seed)).alias("draw")).filter("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in few(known.groupBy("lang").count(), LANGUAGES, "languages")}
    if not sizes:
        return None
    # Twice the standard deviation above the floor, as rows are drawn independently.
    trained, tested = 0.8 * rows / len(sizes), max(CALIBRATE + 2 * CALIBRATE**0.5, 0.2 * rows / len(sizes))
    short = [k for k, n in sizes.items() if n < trained + tested]
    places = lambda m: F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(1_000_000 * m / n) + 1)) for k, n in sizes.items()])
    spot, scarce = F.pmod("draw", F.lit(1_000_000)), F.col("lang").isin(short)
    part = F.when(scarce, F.pmod(F.shiftright("draw", 32), F.lit(FOLDS))).when(spot < places(tested), -1).when(spot < places(tested) + places(trained), -2)
    # part: a fold of a scarce language, -1 for rows that calibrate, -2 for rows that give n-grams.
    sample = known.withColumn("part", part.cast("long")).filter("part is not null").select("text", "lang", "part")
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, int], int] = defaultdict(int)
        for b in batches:
            for t, lang, fold in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                codes = _codes(t)
                if len(codes) < ORDER:
                    continue
                _, first, n = np.unique(_hashes(codes, ORDER), return_index=True, return_counts=True)
                whole = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                for i, k in zip(first.tolist(), n.tolist(), strict=True):
                    found[lang, whole[i : i + ORDER], fold] += k
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "part", "n"])

    counted = sample.filter("part <> -1").mapInArrow(count, "lang string, gram string, part long, n long").groupBy("lang", "gram", "part").agg(F.sum("n").alias("n")).collect()

    def model_without(fold: int | None) -> Model | None:
        got: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for r in counted:
            if r.part != fold:
                got[r.lang][r.gram] += r.n
        return kneser_ney(got) if got else None

    def bits_under(model: Model, fold: int) -> dict[str, list[float]]:
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, "text", 1_000_000):
                    bits, n = model.entropies(b.column(0).to_pylist())
                    own = [float(bits[i, model.langs.index(x)]) if x in model.langs and n[i] else None for i, x in enumerate(b.column(1).to_pylist())]
                    yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, pa.float64())], ["lang", "bits"])

        out: dict[str, list[float]] = defaultdict(list)
        for r in sample.filter(F.col("part") == fold).select("text", "lang").mapInArrow(measure, "lang string, bits double").dropna().collect():
            out[r.lang].append(r.bits)
        return out

    model = model_without(None)
    if not model:
        return None
    found = bits_under(model, -1)
    for fold in sorted({r.part for r in counted if r.part >= 0}):
        if less := model_without(fold):
            for lang, bits in bits_under(less, fold).items():
                found[lang] += bits
    pooled = np.concatenate([np.zeros(0), *found.values()])
    # No row could be calibrated: letters at random have this cross-entropy.
    common = float(np.quantile(pooled, keep)) if len(pooled) else float(np.log2(len(model.grams[0][0]) + 1))
    for k, lang in enumerate(model.langs):
        own = float(np.quantile(found[lang], keep)) if found[lang] else common
        model.limits[k] = (own if len(found[lang]) >= 20 else max(own, common)) + slack
    return model


def _predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, scores, lowest cross-entropies and rejections."""
    bits, n = model.entropies(texts)
    best = bits.argmin(1)
    rows = np.arange(len(texts))
    low = bits[rows, best]
    # A posterior with 12 nats a bit: close calls on short texts stay near one half.
    score = 1 / np.exp(np.minimum(0, -12 * (bits - low[:, None]))).sum(1)
    none = n == 0
    langs = ["und" if z else model.langs[k] for k, z in zip(best, none, strict=True)]
    return langs, np.where(none, 0.0, score), np.where(none, np.nan, low), none | (low > model.limits[best])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits, rejected), one row per input row, from the text alone.

    Null texts and texts without a letter are ``und`` with score 0, null bits and rejected; so is every text without a model.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1_000_000):
                texts = b.column(1).to_pylist()
                if model:
                    langs, score, low, odd = _predict(model, texts)
                else:
                    langs, score, low, odd = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(score), pa.array(low, from_pandas=True), pa.array(odd)], ["doc_id", "lang_pred", "score", "bits", "rejected"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns and without a shuffle."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text_col, 1_000_000):
                if model:
                    yield b.filter(pa.array(~_predict(model, b.column(b.schema.get_field_index(text_col)).to_pylist())[3]))

    return docs.mapInArrow(run, docs.schema)
