"""Selecting chunks by place and by lexical saliency, and the gaps a selection leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import saliency as S
from ..functions import text as T


def conv():
    return Window.partitionBy("conv")


def order():
    return conv().orderBy("idx")


def scores(rows: DataFrame) -> DataFrame:
    """(conv, idx, text) with every lexical score and saliency, without retained context.

    The three chunks before a chunk are one window frame; their identifiers
    together are what it is compared with.
    """
    recent = F.array_join(F.collect_list("text").over(order().rowsBetween(-3, -1)), "\n")
    own = rows.withColumn("_tok", T.token_set(F.col("text"))).withColumn("_recent", T.token_set(recent))
    parts = S.lexical(F.col("text"))
    own = own.withColumn("overlap_recent", T.jaccard(F.col("_tok"), F.col("_recent"))).withColumns(parts)
    own = own.withColumns(S.retention(F.col("overlap_recent"), F.lit(0.0))).withColumn("conceptual_gravity", S.gravity())
    return own.withColumn("saliency", S.saliency()).drop("_tok", "_recent", "_methodology", "_structure", "_pivot")


def saliency_spread(rows: DataFrame) -> DataFrame:
    """conv, chunks and the population standard deviation of saliency."""
    spread = F.when(F.count("*") < 2, F.lit(0.0)).otherwise(T.rounded(F.stddev_pop("saliency"), 4))
    return scores(rows).groupBy("conv").agg(F.count("*").alias("chunks"), spread.alias("spread"))


def evolution(scored: DataFrame) -> DataFrame:
    """conv and evolution: how far a conversation looks like dense debugging, 0 to 1."""
    c = F.col
    dense = F.greatest(c("failure") * 1.15, c("reasoning_shift") * 0.9, c("operational") * 0.85, c("transition") * 0.45)
    calm = F.greatest(c("failure") * 1.1, c("operational") * 0.5, F.lit(0.22))
    value = F.when((c("transition") > 0.35) & (c("failure") < 0.12), calm).otherwise(dense)
    rows = scored.select("conv", "failure", value.alias("v"))
    placed = rows.withColumn("r", F.row_number().over(conv().orderBy(F.col("v").desc()))).withColumn("n", F.count("*").over(conv()))
    top = placed.withColumn("_top", F.greatest(F.lit(2), F.floor(F.col("n") / 2)))
    mean = F.avg(F.when(F.col("r") <= F.col("_top"), F.col("v")))
    failing = F.count_if(F.col("failure") >= 0.2)
    capped = F.when((F.first("n") >= 2) & (failing < 2), F.least(mean, F.lit(0.36))).otherwise(mean)
    return top.groupBy("conv").agg(T.rounded(F.least(F.lit(1.0), capped), 4).alias("evolution"))


def head_tail(rows: DataFrame, most: int = 12, head_ratio: float = 0.67) -> DataFrame:
    """Non-blank chunks of the head and the tail, renumbered; all where they are few."""
    head = max(1, round(most * head_ratio))
    tail = max(1, most - head)
    kept = rows.where(~T.blank(F.col("text"))).withColumn("pos", F.row_number().over(order()) - 1).withColumn("n", F.count("*").over(conv()))
    return kept.withColumn("selected", (F.col("n") <= most) | (F.col("pos") < head) | (F.col("pos") >= F.col("n") - tail))


def choose(rows: DataFrame, most: int = 12, strategy: str = "adaptive") -> DataFrame:
    """conv, n, strategy and the selected places of (conv, idx, text), blank chunks left out.

    ``strategy``: adaptive, head_tail or head. Up to three chunks are all taken.
    """
    kept = rows.where(~T.blank(F.col("text"))).withColumn("pos", F.row_number().over(order()) - 1)
    if strategy == "adaptive":
        picked = adaptive(scores(kept.select("conv", F.col("pos").alias("idx"), "text")).withColumn("pos", F.col("idx")), most)
    elif strategy in ("head_tail", "head"):
        placed = head_tail(rows, most) if strategy == "head_tail" else kept.withColumn("n", F.count("*").over(conv())).withColumn("selected", F.col("pos") < most)
        picked = placed.groupBy("conv").agg(F.first("n").cast("int").alias("n"), F.array_sort(F.collect_list(F.when(F.col("selected"), F.col("pos").cast("int")))).alias("selected"))
    else:
        raise ValueError(f"no selection strategy {strategy!r}")
    every = F.sequence(F.lit(0), F.col("n") - 1)
    few = F.col("n") <= 3
    return picked.select("conv", "n", F.when(few, "full").otherwise(strategy).alias("strategy"), F.when(few, every).otherwise(F.col("selected")).alias("selected"))


def coverage(selected: DataFrame) -> DataFrame:
    """conv with counts, characters, coverage ratio and span of a selection."""
    size = F.length("text")
    chosen = F.when(F.col("selected"), F.col("pos"))
    return selected.groupBy("conv").agg(
        F.count("*").alias("chunks"), F.count_if("selected").alias("chosen"), F.sum(size).alias("chars"), F.sum(F.when(F.col("selected"), size).otherwise(0)).alias("chars_chosen"),
        T.rounded(F.sum(F.when(F.col("selected"), size).otherwise(0)) / F.greatest(F.sum(size), F.lit(1)), 4).alias("coverage_ratio"),
        T.rounded((F.max(chosen) - F.min(chosen) + 1) / F.count("*"), 4).alias("continuity"),
    )


def dropped_ranges(selected: DataFrame, least: int = 1) -> DataFrame:
    """conv, first, last of every run of chunks left out that is at least ``least`` long (gaps and islands)."""
    out = selected.where(~F.col("selected"))
    island = F.col("pos") - F.row_number().over(conv().orderBy("pos"))
    runs = out.withColumn("_i", island).groupBy("conv", "_i").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= least).drop("_i")


def slots(most: int, head: int = 3, tail: int = 2) -> tuple[int, int, int]:
    """Head, middle and tail places of a budget."""
    head = max(1, min(most - 2, head))
    tail = max(1, min(most - head - 1, tail))
    if head + tail >= most:
        head, tail = max(1, most // 3), max(1, most // 4)
    return head, max(0, most - head - tail), tail


def adaptive(scored: DataFrame, most: int = 12) -> DataFrame:
    """conv, n and the selected places: head, tail, and the middle by saliency.

    The middle is a constrained greedy fold over candidates in the order of their
    score: first without neighbours of the last taken one (unless 8 % better) and
    without weak near-copies of any taken one, then without those conditions.
    """
    head, middle, tail = slots(most)
    item = F.struct(F.col("pos").cast("int").alias("pos"), F.col("saliency").alias("s"), T.token_set(F.col("text")).alias("tok"))
    grouped = scored.groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("_x"), F.count("*").cast("int").alias("n"))
    inner = F.filter("_x", lambda c: (c["pos"] >= head) & (c["pos"] < F.col("n") - tail))
    ranked = F.transform(F.array_sort(F.transform(inner, lambda c: F.struct((-c["s"]).alias("o"), c["pos"].alias("pos"), c.alias("c")))), lambda r: r["c"])

    def strict(taken: Column, c: Column) -> Column:
        last = F.element_at(taken, -1)
        close = (F.abs(c["pos"] - last["pos"]) <= 1) & (c["s"] < 1.08 * last["s"])
        alike = F.exists(taken, lambda t: (T.jaccard(t["tok"], c["tok"]) >= 0.72)) & (c["s"] < 0.52)
        refuse = (F.size(taken) >= middle) | ((F.size(taken) > 0) & F.coalesce(close | alike, F.lit(False)))
        return F.when(refuse, taken).otherwise(F.concat(taken, F.array(c)))

    def relaxed(taken: Column, c: Column) -> Column:
        known = F.exists(taken, lambda t: t["pos"] == c["pos"])
        return F.when((F.size(taken) >= middle) | known, taken).otherwise(F.concat(taken, F.array(c)))

    first = grouped.withColumn("_r", ranked)
    none = F.filter("_r", lambda c: F.lit(False))
    second = first.withColumn("_t", F.aggregate("_r", none, strict))
    third = second.withColumn("_t", F.aggregate("_r", F.col("_t"), relaxed))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    ends = F.filter(every, lambda p: (p < head) | (p >= F.col("n") - tail))
    chosen = F.array_sort(F.concat(ends, F.transform("_t", lambda t: t["pos"])))
    return third.select("conv", "n", F.when(F.col("n") <= most, every).otherwise(chosen).alias("selected"))
