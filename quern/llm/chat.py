"""Chat logs: cumulative snapshots collapsed to maximal conversations, then rendered.

A rolling hash of every turn prefix is an exclusive-or over position-tagged turn hashes, taken twice with different salts (128
bits).  A conversation whose whole hash is the prefix hash of a longer one is a snapshot of it and an anti-join drops it; of equal
conversations the smallest id stays.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"


def _ties(turns: DataFrame) -> DataFrame:
    """The (conv_id, turn, role) that several turns share; only there does the text decide the order."""
    return turns.groupBy("conv_id", "turn", "role").count().filter("count > 1").drop("count")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, p1, p2): every turn's position and the hash of its conversation up to it.

    Texts are hashed before they are shuffled, and travel along only where they decide the order.
    """
    # A null is told from the empty string by its own flag in the hash.
    parts = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    ties = cut(_ties(turns))
    t = turns.withColumns({"t1": F.xxhash64(F.lit(1), *parts), "t2": F.xxhash64(F.lit(2), *parts)})
    if ties.isEmpty():
        t = t.withColumn("text", F.lit(None).cast("string"))
    else:
        same = (F.col("t.conv_id") == F.col("x.conv_id")) & F.col("t.turn").eqNullSafe(F.col("x.turn")) & F.col("t.role").eqNullSafe(F.col("x.role"))
        t = t.alias("t").join(ties.withColumn("tied", F.lit(True)).alias("x"), same, "left").select("t.conv_id", "t.turn", "t.role", F.when(F.col("tied"), F.col("t.text")).alias("text"), "t1", "t2")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    t = t.withColumn("pos", F.row_number().over(order).cast("long"))
    t = t.withColumns({"h1": F.xxhash64(F.lit(1), "pos", "t1"), "h2": F.xxhash64(F.lit(2), "pos", "t2")})
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select("conv_id", "pos", F.bit_xor("h1").over(upto).alias("p1"), F.bit_xor("h2").over(upto).alias("p2"))


def render(turns: DataFrame, extra: str = "n_same") -> DataFrame:
    """(conv_id, n_turns, n_same, chat): turns in order, each as start mark, role, line break, text, end mark."""
    line = lambda r: F.concat(F.lit(START), F.coalesce(r["role"], F.lit("")), F.lit("\n"), F.coalesce(r["text"], F.lit("")), F.lit(END + "\n"))
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.first(extra).alias(extra), rows.alias("rows"))
    return grouped.select("conv_id", "n_turns", extra, F.array_join(F.transform("rows", line), "").alias("chat"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_same, chat) of every maximal conversation; n_same counts the equal conversations it stands for.

    Turns are ordered by turn, then role, then text; nulls come first, are distinct from empty texts and render as empty.
    Turns with a null conversation belong to none and are left out.  Repeated turns are turns of their own.  No rows give no
    rows; other columns are ignored.  A rendered conversation is one value, so it has to fit a row.

    Only hashes are written between the steps; texts are read again and shuffled once, those of the conversations that are kept.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).filter("conv_id is not null")
    p = cut(prefixes(t))
    whole = p.groupBy("conv_id").agg(F.max(F.struct("pos", "p1", "p2")).alias("last")).select("conv_id", "last.*")
    unique = whole.groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    # A prefix is proper where its conversation has a later turn: it is any prefix hash but the conversation's last.
    lengths = whole.select("conv_id", F.col("pos").alias("n"))
    proper = p.join(lengths, "conv_id").filter(F.col("pos") < F.col("n")).select("pos", "p1", "p2").distinct()
    maximal = cut(unique.join(proper, ["pos", "p1", "p2"], "left_anti").select("conv_id", "n_same"))
    return render(t.join(maximal, "conv_id"))
