"""Chat formatting with cumulative-snapshot collapse. DataFrame functions only.

Logs often hold a conversation again after each turn. A conversation whose turns
are the first turns of a longer one adds nothing; of equal ones, the smallest
id stays. Each turn is hashed with its place, and the hashes are folded by
exclusive or in turn order, so every prefix has a rolling 128-bit hash from one
window pass. A conversation's last hash among other conversations' earlier
prefixes tells that it is a snapshot; an anti-join keeps the maximal ones, which
are rendered.

Defined results
- order of turns: by turn (null first), then role, then text; repeated rows count as turns
- null role or text: rendered empty, hashed apart from the empty text
- null conv_id: one conversation of its own
- ties: of equal conversations the smallest id stays
- very long conversations: one is a task's, as its prompt is one value of at most 2 GB;
  very long turns are hashed where they are read
- empty table: no rows; extra columns are dropped, so names cannot clash
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ORDER = ["turn", "role", "text"]
SAME = ["k", "p1", "p2"]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k and the rolling hash (p1, p2) of its first k turns, and whether k is the last."""
    by = Window.partitionBy("conv_id")
    order = by.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    what = lambda seed: F.xxhash64(F.lit(seed), "k", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    numbered = turns.select("conv_id", *ORDER).withColumn("k", F.row_number().over(order))
    hashed = numbered.select("conv_id", *ORDER, "k", what(1).alias("_1"), what(2).alias("_2"))
    return hashed.select("conv_id", *ORDER, "k", F.bit_xor("_1").over(running).alias("p1"), F.bit_xor("_2").over(running).alias("p2"), F.lead("k").over(order).isNull().alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that no other one repeats or continues."""
    rows = prefixes(turns).select("conv_id", *SAME, "last")
    # equal conversations fall together before the join, so none of its keys repeats
    whole = rows.where("last").groupBy(*SAME).agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("n"), "conv_id"))["conv_id"].alias("conv_id"))
    inner = rows.where(~F.col("last")).select(*SAME).distinct()
    return whole.join(inner, SAME, "left_anti").select("conv_id", F.col("k").alias("n_turns"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and prompt of every maximal conversation."""
    kept = maximal(turns)
    own = turns.select("conv_id", *ORDER).join(kept.withColumnRenamed("conv_id", "_kept"), F.col("conv_id").eqNullSafe(F.col("_kept")))
    turn = F.struct(*[F.struct(F.col(c).isNotNull().alias("n"), F.col(c).alias("v")).alias(c) for c in ORDER])
    grouped = own.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    body = F.array_join(F.transform("_t", lambda t: rendered(t["role"]["v"], t["text"]["v"])), "\n")
    return grouped.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), body.alias("prompt"))
