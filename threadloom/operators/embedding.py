"""Vectors of chunks and their clusters within a conversation.

An embedder adds ``embedding`` (unit length) to chunk rows. ``hashed`` needs no
weights: signed counts of hashed tokens. A sentence model takes its place as an
Arrow UDF of the same shape.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking

DIMENSIONS = 64


def hashed(chunks: DataFrame, text: str = "chunk", dimensions: int = DIMENSIONS) -> DataFrame:
    """Chunk rows with an embedding of their distinct words: each hash adds 1 or -1 in its dimension."""

    def spread(hashes: pd.Series) -> pd.Series:
        def one(h: np.ndarray) -> np.ndarray:
            h = np.asarray(h, dtype=np.int64)
            v = np.bincount(h % dimensions, weights=np.where(h >> 32 & 1, 1.0, -1.0), minlength=dimensions)
            return v / max(float(np.linalg.norm(v)), 1e-12)

        return hashes.map(one)

    vector = F.pandas_udf(spread, "array<double>")
    hashes = F.transform(T.content_tokens(F.col(text), 2), lambda t: F.xxhash64(t))
    return chunks.withColumn("embedding", vector(hashes))


def k_means(points: np.ndarray, k: int, seed: int = 42, starts: int = 10, rounds: int = 50) -> np.ndarray:
    """Labels of the best of several seeded k-means++ starts; clusters are numbered by first member."""
    best, best_cost = None, np.inf
    for start in range(starts):
        draw = np.random.default_rng(seed + start)
        centres = points[[draw.integers(len(points))]]
        while len(centres) < k:
            gap = ((points[:, None] - centres) ** 2).sum(-1).min(1)
            nxt = draw.choice(len(points), p=gap / gap.sum()) if gap.sum() > 0 else draw.integers(len(points))
            centres = np.vstack([centres, points[nxt]])
        for _ in range(rounds):
            labels = ((points[:, None] - centres) ** 2).sum(-1).argmin(1)
            moved = np.stack([points[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = ((points - centres[labels]) ** 2).sum()
        if cost < best_cost - 1e-12:
            best, best_cost = labels, cost
    _, first = np.unique(best, return_index=True)
    order = {best[i]: n for n, i in enumerate(sorted(first))}
    return np.array([order[x] for x in best])


def clustered(chunks: DataFrame, budget: int | None = None) -> DataFrame:
    """(conv, idx, embedding) with cluster: k-means with the conversation's chunk budget as k
    (default: a fifth of its chunks, 3 to 8).

    A conversation's vectors are one row of an Arrow batch, which holds many conversations. Rows are
    dealt to a set number of tasks: they are small for the work in them, so a number by their bytes would be
    one or two. The ranking that follows reuses this partitioning.
    """

    def label(points: pd.Series) -> pd.Series:
        def one(vectors: np.ndarray | None) -> np.ndarray:
            if vectors is None:
                return np.zeros(0, dtype=np.int32)
            n = len(vectors)
            return k_means(np.array(vectors.tolist(), dtype=float), min(n, budget or max(3, min(8, -(-n // 5))))).astype(np.int32)

        return points.map(one, na_action=None)

    spark = chunks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = chunks.select("conv", F.struct("idx", "embedding").alias("_c")).repartition(tasks, "conv")
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list("_c")).alias("_c"))
    n = F.size("_c")
    k = F.lit(budget) if budget else F.greatest(F.lit(3), F.least(F.lit(8), F.ceil(n / 5)))
    # up to k chunks are all taken: each is its own cluster, and no vector goes to Python
    many = whole.withColumn("_labels", F.pandas_udf(label, "array<int>")(F.when(n > k, F.transform("_c", lambda c: c["embedding"]))))
    own = F.when(n > k, F.col("_labels")).otherwise(F.transform("_c", lambda c, i: i))
    flat = many.select("conv", F.inline(F.zip_with("_c", own, lambda c, l: F.struct(c["idx"].cast("int").alias("idx"), c["embedding"].alias("embedding"), l.alias("cluster")))))
    return flat.select(F.col("conv").cast("long"), "idx", "embedding", "cluster")


def nearest_to_centre(rows: DataFrame) -> DataFrame:
    """conv, cluster and centroid: the chunk nearest to its cluster's mean, the first of equals."""
    dims = rows.select("conv", "cluster", F.posexplode("embedding").alias("d", "x")).groupBy("conv", "cluster", "d").agg(F.avg("x").alias("x"))
    means = dims.groupBy("conv", "cluster").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("m"))
    far = F.aggregate(F.zip_with("embedding", "m", lambda a, b: (a - b["x"]) * (a - b["x"])), F.lit(0.0), lambda s, x: s + x)
    best = F.min(F.struct(T.rounded(far, 12).alias("f"), "idx"))
    return rows.join(means, ["conv", "cluster"]).groupBy("conv", "cluster").agg(best["idx"].alias("centroid"))
