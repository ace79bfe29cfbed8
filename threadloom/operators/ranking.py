"""Ranking the chunks of a conversation by their embeddings.

Input rows are (conv, idx, embedding, cluster): idx counts a conversation's
chunks from 0. Series operators are windows over (conv, idx) and share one
shuffle. The changepoint search is a helper on the series of a conversation, one number a chunk,
in time near its length where the series has changes in proportion, quadratic (vectorised) where it has
none. The greedy selection is a fold over a conversation's candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values
MMR_LAMBDA, PEAK_Z, PENALTY = 0.7, 1.0, 0.5
#: Costs this near to each other are not told apart by pruning.
MARGIN = 1e-9
WEIGHT_SHIFT, WEIGHT_RECENCY, WEIGHT_MASS, WEIGHT_BOUNDARY = 0.30, 0.30, 0.20, 0.20


def conv():
    return Window.partitionBy("conv")


def order():
    return conv().orderBy("idx")


def default_k(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0)).otherwise(F.greatest(F.lit(3), F.least(F.lit(8), F.ceil(n / 5)))).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)


def unit(v: Column) -> Column:
    """Scaled to length 1."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


def displacement(rows: DataFrame) -> DataFrame:
    """With n, delta (1 - cosine to the chunk before; 0 first) and kappa (its change; 0 for the first two)."""
    before = F.lag("embedding").over(order())
    moved = rows.withColumn("n", F.count("*").over(conv())).withColumn("_prev", before)
    delta = F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(1.0 - dot(F.col("embedding"), F.col("_prev")))
    shifted = moved.withColumn("delta", delta).drop("_prev")
    kappa = F.when((F.col("n") < 3) | (F.row_number().over(order()) < 3), F.lit(0.0)).otherwise(F.col("delta") - F.lag("delta").over(order()))
    return shifted.withColumn("kappa", kappa)


def robust_z(rows: DataFrame, value: str, out: str) -> DataFrame:
    """(x - median) / (1.4826 MAD) within the conversation; unscaled where the MAD vanishes."""
    centred = rows.withColumn("_d", F.col(value) - F.median(value).over(conv()))
    mad = F.median(F.abs(F.col("_d"))).over(conv())
    return centred.withColumn("_mad", mad).withColumn(out, F.col("_d") / F.when(F.col("_mad") > 1e-12, 1.4826 * F.col("_mad")).otherwise(F.lit(1.0))).drop("_d", "_mad")


def peak(value: str, z: str) -> Column:
    v, before, after = F.col(value), F.lag(value).over(order()), F.lead(value).over(order())
    return F.coalesce((v >= before) & (v > after) & (F.col(z) >= PEAK_Z), F.lit(False))


def cluster_columns(rows: DataFrame) -> DataFrame:
    """With mass (the cluster's share of the largest), whether a cluster begins, and whether
    the chunk stands for its cluster: the first and last of three and more, the later of two."""
    own = Window.partitionBy("conv", "cluster")
    sized = rows.withColumn("cluster_size", F.count("*").over(own)).withColumn("_first", F.min("idx").over(own)).withColumn("_last", F.max("idx").over(own))
    marked = sized.withColumn("mass", F.col("cluster_size") / F.max("cluster_size").over(conv()))
    changed = F.coalesce(F.col("cluster") != F.lag("cluster").over(order()), F.lit(False))
    stands = (F.col("idx") == F.col("_last")) | ((F.col("idx") == F.col("_first")) & (F.col("cluster_size") >= 3))
    return marked.withColumn("cluster_start", changed).withColumn("representative", stands).drop("_first", "_last")


def optimal_cuts(series: np.ndarray, price: float) -> list[int]:
    """Optimal partition of a series into segments of constant mean, with a price a segment; the first of equal cuts.

    Segment costs come from prefix sums. A start is dropped once another end is cheaper without the
    price of a segment between, as it can't come first again (pruned exact search, Killick et al., 2012); those
    within ``MARGIN`` stay, so rounding to 12 digits meets the same ties as a search of all starts.
    """
    n = len(series)
    total, squares = np.concatenate([[0.0], np.cumsum(series)]), np.concatenate([[0.0], np.cumsum(series * series)])
    cost, cut = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    starts = np.zeros(1, dtype=np.int64)
    for end in range(1, n + 1):
        sums = total[end] - total[starts]
        spread = np.maximum(squares[end] - squares[starts] - sums * sums / (end - starts), 0.0)
        options = np.round(cost[starts] + spread + price, 12)
        best = int(options.argmin())  # starts ascend, so the first of equal ones
        cost[end], cut[end] = options[best], starts[best]
        starts = np.append(starts[cost[starts] + spread <= cost[end] + MARGIN], end)
    out, at = [], int(cut[n])
    while at > 0:
        out.append(at)
        at = int(cut[at])
    return out[::-1]


def _cuts(series: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([[] if k < 4 else optimal_cuts(np.asarray(s, dtype=np.float64), PENALTY * math.log(max(k, 2))) for s, k in zip(series, n, strict=True)])


def changepoints(series: Column, n: Column) -> Column:
    """Where the segments of a series of ``n`` values begin, but for the first; none below 4 values."""
    return F.pandas_udf(_cuts, "array<int>")(series, n)


def features(rows: DataFrame) -> DataFrame:
    """All series of the ranking, one row a chunk."""
    out = robust_z(robust_z(displacement(rows), "delta", "z_delta"), "kappa", "z_kappa")
    out = cluster_columns(out)
    return out.withColumn("peak_delta", peak("delta", "z_delta")).withColumn("peak_kappa", peak("kappa", "z_kappa")).withColumn("recency", (F.col("idx") + 1) / F.col("n"))


def scored(rows: DataFrame) -> DataFrame:
    """With cuts (the conversation's changepoints), boundary, locked, candidate and score."""
    base = features(rows)
    # once a conversation, not once a row; a join of the cuts to the rows would make all that is below a second time
    rest = [c for c in base.columns if c not in ("conv", "idx")]
    whole = base.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("idx", *rest))).alias("_rows"), F.first("n").alias("_n"))
    cut = whole.withColumn("cuts", changepoints(F.transform("_rows", lambda x: x["delta"]), F.col("_n")))
    base = cut.select("conv", "cuts", F.inline("_rows")).select(*base.columns, "cuts")
    at = F.col("idx").cast("int")
    boundary = F.array_contains("cuts", at) | F.array_contains("cuts", at - 1) | F.col("peak_delta") | F.col("peak_kappa") | F.col("cluster_start") | F.col("representative")
    locked = (F.col("idx") == F.col("n") - 1) | ((F.col("n") > 15) & (F.col("idx") == F.col("n") - 2))
    score = WEIGHT_SHIFT * F.col("z_delta") + WEIGHT_RECENCY * F.col("recency") + WEIGHT_MASS * F.col("mass") + WEIGHT_BOUNDARY * F.col("boundary").cast("double")
    return base.withColumn("boundary", boundary).withColumn("locked", locked).withColumn("score", score).withColumn("candidate", F.col("boundary") | F.col("locked"))


def mmr(items: Column, k: Column) -> Column:
    """Indices chosen by maximal marginal relevance from (idx, score, locked, candidate, embedding).

    Locked ones come first; each step adds the open candidate with the best of
    0.7 score - 0.3 (largest cosine to a chosen one); what is missing then comes
    by score, ties to the later chunk. Candidates carry their largest cosine so far, so
    a choice of k takes k cosines a candidate.
    """
    locked = F.filter(items, lambda c: c["locked"])
    idle = F.filter(items, lambda c: c["candidate"] & ~c["locked"])
    nearest = lambda c: F.array_max(F.transform(locked, lambda p: dot(c["embedding"], p["embedding"])))
    pool = F.transform(idle, lambda c: F.struct(c["idx"].alias("idx"), c["score"].alias("score"), c["embedding"].alias("embedding"), nearest(c).alias("near")))
    start = F.struct(F.transform(locked, lambda c: c["idx"]).alias("picked"), pool.alias("pool"))

    def step(state: Column, _: Column) -> Column:
        def worth(c: Column) -> Column:
            return F.struct(T.rounded(MMR_LAMBDA * c["score"] - (1 - MMR_LAMBDA) * F.coalesce(c["near"], F.lit(0.0)), 12).alias("worth"), (-c["idx"]).alias("early"), c.alias("c"))

        def grown(best: Column) -> Column:
            # of each open candidate only the cosine to the one just chosen is new
            left = F.filter(state["pool"], lambda c: c["idx"] != best["idx"])
            pool = F.transform(left, lambda c: F.struct(c["idx"].alias("idx"), c["score"].alias("score"), c["embedding"].alias("embedding"), F.greatest(c["near"], dot(c["embedding"], best["embedding"])).alias("near")))
            return F.struct(F.concat(state["picked"], F.array(best["idx"])).alias("picked"), pool.alias("pool"))

        best = F.array_max(F.transform(state["pool"], worth))["c"]
        return F.when((F.size(state["picked"]) < k) & (F.size(state["pool"]) > 0), F.get(F.transform(F.array(best), grown), F.lit(0))).otherwise(state)

    picked = F.aggregate(F.sequence(F.lit(1), k), start, step, lambda s: s["picked"])
    rest = lambda p: F.transform(
        F.reverse(F.array_sort(F.transform(F.filter(items, lambda c: ~F.array_contains(p, c["idx"])), lambda c: F.struct(c["score"].alias("s"), c["idx"].alias("i"))))), lambda x: x["i"]
    )
    return F.get(F.transform(F.array(picked), lambda p: F.array_sort(F.slice(F.concat(p, rest(p)), F.lit(1), F.greatest(k, F.size(p))))), F.lit(0))


def rank(rows: DataFrame, k: int | None = None) -> DataFrame:
    """conv, n, k, strategy and selected of every conversation; up to k chunks are all taken."""
    budget = F.least(F.col("n"), F.lit(k) if k is not None else default_k(F.col("n"))).cast("int")
    item = F.struct(F.col("idx").cast("int").alias("idx"), "score", "locked", "candidate", "embedding")
    whole = scored(rows).groupBy("conv").agg(F.first("n").alias("n"), F.first("cuts").alias("cuts"), F.array_sort(F.collect_list(item)).alias("_items"))
    full = F.col("n") <= F.col("k")
    return whole.withColumn("k", budget).select(
        "conv", F.col("n").cast("int").alias("n"), "k",
        F.when(full, F.lit("full")).otherwise(F.lit("ranked")).alias("strategy"),
        F.when(full, F.transform("_items", lambda c: c["idx"])).otherwise(mmr(F.col("_items"), F.col("k"))).alias("selected"),
        "cuts",
    )


def cluster_head_tail(rows: DataFrame, most: int = 8) -> DataFrame:
    """The ``most`` best cluster representatives of each conversation by recency and cluster size."""
    placed = cluster_columns(rows).withColumn("n", F.count("*").over(conv()))
    recency = F.col("idx") / F.greatest(F.col("n") - 1, F.lit(1))
    kept = placed.where("representative").withColumn("score", T.rounded(0.6 * recency + 0.4 * F.col("mass"), 6))
    place = F.row_number().over(conv().orderBy(F.col("score").desc(), F.col("idx").desc()))
    return kept.withColumn("place", place).where(F.col("place") <= most).select("conv", "idx", "cluster", "cluster_size", "score", "place")
