"""Rule-based entity resolution: equi-joins on block keys, a metric on normalised text, a threshold."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import normalize_inn, normalize_name, trigrams, word_similarity_of
from ..functions.similarity import jaro_winkler

#: Rows of a block that are compared in one group; larger blocks are dealt out by pairs of parts.
BLOCK = 5_000
#: Ids of a block that share a text and are carried as one row.
CHUNK = 100


@dataclass(frozen=True)
class MatchRule:
    name: str
    id_column: str
    scan_columns: tuple[str, ...]
    test_columns: tuple[str, ...]
    metric: str = "word_similarity"
    operator: str = ">="
    threshold: float = 0.8
    normalize: str = "name"


@dataclass(frozen=True)
class Metric:
    """prepare: further columns of a row, made once before rows meet; compare: the metric of rows a and b (prefixes of columns)."""

    compare: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
    prepare: Callable[[Column], dict[str, Column]] = lambda t: {}


def _bits(grams: Column) -> dict[str, Column]:
    """Which of 256 bits the hashes of trigrams set, as four numbers."""
    def word(i: int) -> Column:
        bit = lambda g: F.when(F.pmod(F.shiftright(F.hash(g), 6), F.lit(4)) == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(g), F.lit(64)))).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate(grams, F.lit(0).cast("bigint"), lambda s, g: s.bitwiseOR(bit(g)))

    return {f"bits{i}": word(i) for i in range(4)}


METRICS = {
    "word_similarity": Metric(lambda a, b: word_similarity_of(a("t"), a("grams"), b("t")), lambda t: {"grams": trigrams(t)} | _bits(trigrams(t))),
    "jaro_winkler": Metric(lambda a, b: jaro_winkler(a("t"), b("t"))),
    "levenshtein": Metric(lambda a, b: F.levenshtein(a("t"), b("t")).cast("double")),
    "equal": Metric(lambda a, b: (a("t") == b("t")).cast("double")),
}
NORMALIZERS = {"name": normalize_name, "inn": normalize_inn, "none": lambda c: c}


def _holds(metric: Column, operator: str, threshold: float) -> Column:
    return {">=": metric >= threshold, "<=": metric <= threshold, ">": metric > threshold, "<": metric < threshold}[operator]


def _keeper(rule: MatchRule) -> Callable[[Column], Column]:
    return lambda v: _holds(v, rule.operator, rule.threshold)


def _possible(rule: MatchRule, a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """What lengths say about pairs that satisfy the rule, before the metric is computed."""
    x, y = F.length(a("t")), F.length(b("t"))
    if rule.metric == "levenshtein" and rule.operator in ("<", "<="):
        return F.abs(x - y) <= rule.threshold
    if rule.metric == "jaro_winkler" and rule.operator in (">", ">="):
        # m common characters are at most the shorter length s of the longer l, so Jaro is at most (2 + s / l) / 3; the prefix
        # adds at most 0.4 of the rest.
        jaro = (F.lit(2.0) + F.when(x == y, 1.0).otherwise(F.least(x, y) / F.greatest(x, y, F.lit(1)))) / 3
        return jaro + 0.4 * (1 - jaro) >= rule.threshold - 1e-9
    if rule.metric == "word_similarity" and rule.operator in (">", ">="):
        # A bit that only a's trigrams set is a trigram, so at least one position, that b lacks.
        lacks = sum((F.bit_count(a(f"bits{i}").bitwiseAND(F.bitwise_not(b(f"bits{i}")))) for i in range(1, 4)), F.bit_count(a("bits0").bitwiseAND(F.bitwise_not(b("bits0")))))
        n = F.greatest(x - 2, F.lit(1))
        return (x < 3) | _holds((n - lacks).cast("double") / n, rule.operator, rule.threshold)
    return F.lit(True)


def _edits(rule: MatchRule) -> bool:
    """Whether the rule asks for at most one edit."""
    return rule.metric == "levenshtein" and ((rule.operator == "<" and 0 < rule.threshold <= 2) or (rule.operator == "<=" and 0 <= rule.threshold < 2))


def _variants(t: Column) -> Column:
    """A text, and all that come of it by leaving out a character: texts at most one edit apart have one in common."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(t)), lambda i: F.when(i == 0, t).otherwise(F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))))


def _units(side: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of up to ``CHUNK`` sorted ids that share their keys and text, so that texts are compared once for all of them."""
    ids = side.filter(F.col("id").isNotNull()).groupBy(*keys, "t").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / CHUNK).cast("int")), lambda i: F.slice("ids", i * CHUNK + 1, CHUNK))
    return ids.select(*keys, "t", F.explode(parts).alias("ids")).withColumns({"first": F.element_at("ids", 1), "last": F.element_at("ids", -1)})


def _pairs(side: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], Column]:
    """The rows with the columns on which they meet; and what keeps a pair from being met twice.

    Rows of a block above ``BLOCK`` (or ten times as many ids) are dealt into parts and go to every pair of parts, so that no
    task compares a whole block.
    """
    many = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("ids") / (10 * BLOCK))).cast("int")
    large = side.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).withColumn("parts", many).filter("parts > 1")
    if large.isEmpty():
        return side, keys, F.lit(True)
    dealt = side.join(large.select(*keys, "parts"), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("t", "first"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("parts", "other")
    return dealt, [*keys, "lo", "hi"], (F.col("a_own") != F.col("b_own")) | (F.col("lo") == F.col("hi"))


def _meet(side: DataFrame, keys: list[str], metric: Metric, rule: MatchRule | None = None) -> DataFrame:
    """(a_id, b_id, v) of the pairs of rows (id, keys, t) with equal keys where a has the smaller id, those of the rule if there is one.

    Each pair of texts of a block has its metric computed once for up to ``CHUNK`` ids on either side.
    """
    side = _units(side, keys)
    edits = rule is not None and _edits(rule)
    if edits:
        # The outer generator, as the inner one has a filter on sizes inferred, which makes the variants of every row before it is grouped.
        side = side.withColumn("variants", _variants(F.col("t"))).withColumn("variant", F.explode_outer("variants"))
        keys = [*keys, "variant"]
    side, on, once = _pairs(side, keys)
    side = side.withColumns(metric.prepare(F.col("t")) or {"t": F.col("t")})
    a, b = (side.withColumnsRenamed({c: f"{p}_{c}" for c in side.columns if c not in on}) for p in "ab")
    left, right = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    # Pairs are more work than rows, so even small tables are spread over all cores.
    a = a.repartition(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
    met = a.join(b.drop("b_grams"), on).filter((F.col("a_first") < F.col("b_last")) & once)
    if edits:
        met = met.filter(F.col("variant") == F.array_min(F.array_intersect("a_variants", "b_variants")))
    value = metric.compare(left, right)
    if rule:
        # The generator computes the metric once; a filter on a column would be computed again for the output.
        hit = met.filter(_possible(rule, left, right)).select("a_ids", "b_ids", F.explode(F.filter(F.array(value), _keeper(rule))).alias("v"))
    else:
        hit = met.select("a_ids", "b_ids", F.explode(F.array(value)).alias("v"))
    hit = hit.select(F.explode("a_ids").alias("a_id"), "b_ids", "v")
    return hit.select("a_id", F.explode("b_ids").alias("b_id"), "v").filter("a_id < b_id")


def pairs(df: DataFrame, id_column: str, keys: Sequence[str], text: str | None = None, metric: str | Metric | None = None) -> DataFrame:
    """(a_id, b_id, v): all pairs of rows with equal keys, the smaller id first, and the metric of their texts."""
    names = [f"k{i}" for i in range(len(keys))]
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    side = df.filter(full).select(F.col(id_column).alias("id"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], (F.col(text) if text else F.lit("")).alias("t"))
    found = METRICS[metric] if isinstance(metric, str) else metric
    return _meet(side, names, found or Metric(lambda a, b: F.lit(0)))


def match(df: DataFrame, rules: Sequence[MatchRule]) -> DataFrame:
    """(id_a, id_b, rule_name, metric_value) of unordered pairs with equal block keys that satisfy a rule; a has the smaller id.

    Rows with a null or empty block key match nothing.  Rules are independent of each other.  Blocks are shuffled on their keys,
    large ones dealt out by pairs of parts; pairs are compared as they are joined, and each metric is computed once.
    """
    out = None
    for rule in rules:
        if not (rule.id_column and rule.scan_columns and rule.test_columns):
            continue
        norm, metric = NORMALIZERS[rule.normalize], METRICS[rule.metric]
        kinds = dict(df.dtypes)
        full = F.lit(True)
        for c in rule.scan_columns:
            full = full & F.col(c).isNotNull() & ((F.col(c) != "") if kinds[c] == "string" else F.lit(True))
        text = F.concat_ws(" ", *[norm(F.col(c).cast("string")) for c in rule.test_columns])
        keys = [f"k{i}" for i in range(len(rule.scan_columns))]
        side = df.filter(full).select(F.col(rule.id_column).alias("id"), *[F.col(c).alias(k) for c, k in zip(rule.scan_columns, keys, strict=True)], text.alias("t"))
        hit = _meet(side, keys, metric, rule)
        hit = hit.select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), F.lit(rule.name).alias("rule_name"), F.col("v").alias("metric_value"))
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        raise ValueError("no rule is complete")
    return out
