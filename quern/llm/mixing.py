"""Mixing sources to target weights by the cube method.

Every source has a target of words, so every document of it has the same expected number of copies: a whole part that it gets
and a fractional inclusion probability.  The flight phase moves the probabilities of three documents at a time through the null
space of the constraints (number of documents, number of words) until one of them is 0 or 1, so both totals of a source are
kept exactly.  It runs in blocks of bounded size; the two documents that may be left of a block fly on in the next level, until
one block a source is left, whose last two are settled by a draw (the landing).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, few

#: Documents of a source that fly together in one task.
BLOCK = 20_000


#: Sources of a mix, at most; more are an error.
SOURCES = 100_000


def targets(sizes: list[float], weights: list[float], share: float, most: float) -> list[float]:
    """Splits ``share`` times the total by weight; no target is above ``most`` times its size, the excess is shared again."""
    total, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        unit = rest / sum(weights[i] for i in free)
        above = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in above or free:
            out[i] = most * sizes[i] if above else unit * weights[i]
        if not above:
            break
        free -= above
    return out


def fly(sizes: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: at most two chances are left strictly between 0 and 1; sums and size-weighted sums are kept."""
    x, s, eps = chance.astype(float).tolist(), sizes.astype(float).tolist(), 1e-9
    open_, draws, at = [], rng.random(2 * len(x) + 2).tolist(), 0
    for k in range(len(x)):
        if eps < x[k] < 1 - eps:
            open_.append(k)
        else:
            x[k] = round(x[k])
        while len(open_) == 3:
            a, b, c = open_
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - x[i]) / w if w > 0 else -x[i] / w for i, w in zip(open_, u, strict=True) if w)
            down = min(x[i] / w if w > 0 else (x[i] - 1) / w for i, w in zip(open_, u, strict=True) if w)
            step = up if draws[at] * (up + down) < down else -down
            at += 1
            for i, w in zip(open_, u, strict=True):
                x[i] = min(1.0, max(0.0, x[i] + step * w))
            left = [i for i in open_ if eps < x[i] < 1 - eps]
            for i in open_:
                if i not in left:
                    x[i] = float(round(x[i]))
            open_ = left
    if len(open_) == 2 and s[open_[0]] == s[open_[1]]:
        # Two documents of one size can trade their chances without a change in words.
        a, b = open_
        total, first = x[a] + x[b], x[a]
        high, low = min(1.0, total), max(0.0, total - 1)
        x[a] = high if draws[at] * (high - low) < first - low else low
        x[b] = total - x[a]
        for i in open_:
            x[i] = float(round(x[i])) if not eps < x[i] < 1 - eps else x[i]
    return np.array(x)


def land(sizes: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settles what the flight left: of all ways, those of least expected change in words, by a draw that keeps the chances."""
    out = chance.copy()
    left = np.flatnonzero((out > 0) & (out < 1))
    if len(left) == 2 and abs(out[left].sum() - 1) < 1e-6:
        first = rng.random() < out[left[0]]
        out[left] = (1.0, 0.0) if first else (0.0, 1.0)
    else:
        out[left] = (rng.random(len(left)) < out[left]).astype(float)
    return out


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from (source, size).

    Weights repeat over the sources in code-point order, null last.  One row a source reaches the driver: sources are what a
    mix is written for, not what grows with the rows.
    """
    rows = few(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), SOURCES, "sources")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    got = targets([float(r["size"]) for r in rows], [float(weights[i % len(weights)]) for i in range(len(rows))], share, most)
    out = [(r.source, int(r["size"]), t, t / r["size"] if r["size"] else 0.0, int(r.n)) for r, t in zip(rows, got, strict=True)]
    return sized.sparkSession.createDataFrame(out, "source string, source_size long, target double, rate double, n_docs long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken), one row per input row.

    size counts words (null text: 0); copies is the document's whole copies plus the outcome of the cube method; taken is size
    times copies.  Documents without words are never taken.  Null sources are a source of their own.  Repeated ids are
    documents of their own.  The order of flight comes from the ids and sizes and the draws from the block, so reruns agree.
    """
    spark: SparkSession = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    sized = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.col(source_col).cast("string").alias("source")))
    goal = source_targets(sized, weights, share, most)
    rate = F.when(F.col("size") > 0, F.col("rate")).otherwise(F.lit(0.0))
    x = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    x = x.withColumns({"base": F.floor(rate + 1e-9).cast("long"), "hash": F.xxhash64("doc_id", "size", F.lit(seed))})
    x = x.withColumn("chance", F.greatest(rate - F.col("base"), F.lit(0.0)))
    x = x.withColumns({"blocks": F.ceil(F.col("n_docs") / BLOCK).cast("long"), "fixed": F.col("chance") <= 1e-9})
    x = x.withColumn("block", F.pmod("hash", F.col("blocks")))
    names = ["doc_id", "size", "source", "source_size", "target", "base", "hash", "chance", "blocks", "block"]
    schema = "doc_id long, size long, source string, source_size long, target double, base long, hash long, chance double, blocks long, block long"
    done = x.filter("fixed").select(*names)
    flying, level = x.filter("not fixed").select(*names), 0
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def one(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["hash", "doc_id", "size"], kind="stable").reset_index(drop=True)
            rng = np.random.default_rng([seed, level, int(pdf.block.iloc[0]), *(pdf.source.iloc[0] or "\0").encode("utf-8", "surrogatepass")])
            got = fly(pdf["size"].to_numpy(), pdf.chance.to_numpy(), rng)
            if pdf.blocks.iloc[0] == 1:
                got = land(pdf["size"].to_numpy(), got, rng)
            pdf["chance"] = got
            return pdf[names]

        return run

    while True:
        flown = cut(flying.groupBy("source", "block").applyInPandas(one(level), schema))
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        done = done.unionByName(flown.filter(~open_))
        most_blocks = flown.agg(F.max("blocks")).first()[0] or 1
        if most_blocks <= 1:
            break
        level += 1
        # Two of each block are left, so a thousandth of the blocks is enough to hold them.
        flying = flown.filter(open_).withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK).cast("long")).withColumn("block", F.pmod("block", F.col("blocks")))
    copies = F.col("base") + F.round("chance").cast("long")
    return done.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
