"""Conversations that grow: what a cache still answers, and the newest of repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def reuse(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunk rows (conv, chunk_index, content_hash, ...) with ``hit`` and the cached ``output``.

    A hit needs the place and the content hash; one left join on (conv, chunk_index).
    """
    known = newest(cache, ["conv", "chunk_index"], "updated_at").select("conv", "chunk_index", F.col("content_hash").alias("_hash"), F.col("output").alias("_output"))
    hit = F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False))
    joined = chunks.join(known, ["conv", "chunk_index"], "left")
    return joined.withColumn("hit", hit).withColumn("output", F.when(hit, F.col("_output"))).drop("_hash", "_output")


def misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """The chunks that have to be extracted anew."""
    return chunks.join(cache.select("conv", "chunk_index", "content_hash"), ["conv", "chunk_index", "content_hash"], "left_anti")


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: one row a key; of equal ``order`` any full row, the same at every run."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = F.max(F.struct(order, *rest)).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, "_b.*").select(*rows.columns)


def growth(prior: DataFrame, new: DataFrame) -> DataFrame:
    """conv, append_only, delta and chars_added of transcripts (conv, text); an edit is not append-only."""
    both = new.join(prior.select("conv", F.col("text").alias("_old")), "conv", "left")
    return both.select("conv", T.append_only(F.col("_old"), F.col("text")).alias("append_only"), T.delta(F.col("_old"), F.col("text")).alias("delta"), (F.length("text") - F.coalesce(F.length("_old"), F.lit(0))).alias("chars_added"))


def lineage(reused: DataFrame) -> DataFrame:
    """conv with the ordered chunks reused and extracted."""
    index = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("chunk_index"))))
    return reused.groupBy("conv").agg(index(F.col("hit")).alias("chunks_reused"), index(~F.col("hit")).alias("chunks_extracted"))


def first_per_path(jobs: list[DataFrame]) -> DataFrame:
    """The union of job lists (path, ...); an earlier list wins a path."""
    ranked = [j.withColumn("_p", F.lit(i)) for i, j in enumerate(jobs)]
    out = ranked[0]
    for j in ranked[1:]:
        out = out.unionByName(j, allowMissingColumns=True)
    own = Window.partitionBy("path").orderBy("_p")
    return out.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r", "_p")
