"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard follows from its key and the shard count alone; with one more
shard, a row either stays or moves into the new one.

Defined results
- null key: hashed like the text ``null``; null text: 0 bytes and CRC 0 of the empty text
- repeated rows: each keeps a slot of its own, in the same shard; ties of key hash
  are ordered by id, size and CRC
- very long texts: only their size and CRC are kept
- empty table: no rows; further columns of the input are dropped, so names cannot clash
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

U64 = np.uint64


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among ``shards``; all keys step together until each has landed."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(U64, copy=True)
    landed = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        state = key[live] * U64(2862933555777941757) + U64(1)
        key[live] = state
        # floor((b + 1) * 2^31 / ((state >> 33) + 1)), in doubles as published
        nxt = ((landed[live] + 1) * (float(1 << 31) / ((state >> U64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        inside = nxt < shards
        live = live[inside]
        landed[live] = nxt[inside]
    return landed.astype(np.int32)


def landed_in(key, shards: int):
    """Column (shard, grown_shard) for a column of 64-bit keys: among ``shards``, and with one more."""

    @F.pandas_udf("shard int, grown_shard int")
    def land(keys: pd.Series) -> pd.DataFrame:
        values = keys.to_numpy(np.int64).view(U64)
        return pd.DataFrame({"shard": jump_hash(values, shards), "grown_shard": jump_hash(values, shards + 1)})

    return land(key)


def key_hash(*columns):
    """A stable 60-bit key of any columns, the first digits of an MD5; nulls count as the text ``null``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\0", *parts)), 1, 15), 16, 10).cast("long")


#: Rows that one task ranks, and the most parts of a shard.
BIN_ROWS, MOST_BINS = 100_000, 1 << 16


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", bins: int | None = None) -> DataFrame:
    """Shard, slot and size of every row.

    A slot is the row's place in its shard, ordered by key hash. No shard is
    sorted in one task: its hash range is cut into bins of some ``BIN_ROWS`` rows,
    counted first, and rows are ranked within a bin only. Texts are read once,
    ids and sizes are written and read again.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    rows = docs.select(
        F.col(key),
        size.alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        key_hash(key).alias("_h"),
    )
    rows = written(rows.withColumn("_both", landed_in(F.col("_h"), shards)).select("*", "_both.shard", "_both.grown_shard").drop("_both"), "sharded")
    bins = bins or min(MOST_BINS, max(16, rows.count() // (shards * BIN_ROWS)))
    rows = rows.withColumn("_bin", F.pmod(F.shiftright("_h", 40), F.lit(bins)).cast("int"))
    counts = rows.groupBy("shard", "_bin").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_bin", before.alias("_start"))
    within = Window.partitionBy("shard", "_bin").orderBy("_h", key, "size", "text_crc32")
    ranked = rows.withColumn("_place", F.row_number().over(within) - 1)
    return ranked.join(starts, ["shard", "_bin"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_place")).alias("slot"), "grown_shard"
    )
