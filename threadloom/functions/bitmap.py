"""A filter by broadcast bits, ahead of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITMAP_BITS = 1 << 25
_BUCKET = 8 * 4096


def among(rows: DataFrame, ids: DataFrame, key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``ids``: a filter before a shuffle.

    The ids are hashed to a bitmap of ``bits`` bits, 4 MB whatever their number,
    which is broadcast. It lets every listed id pass, so the join behind it stays
    what decides; above some 10^8 ids it lets most rows pass and only the join works.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    marks = (
        ids.select(place.alias("_p")).distinct()
        .groupBy(F.floor(F.col("_p") / _BUCKET).cast("int").alias("_map"))
        .agg(F.bitmap_construct_agg(F.pmod("_p", F.lit(_BUCKET))).alias("_bits"))
    )
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.pmod("_p", F.lit(_BUCKET)) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod("_p", F.lit(8)).cast("int")) == 1
    looked = rows.withColumn("_p", place).withColumn("_map", F.floor(F.col("_p") / _BUCKET).cast("int"))
    return looked.join(F.broadcast(marks), "_map").where(hit).select(*rows.columns)
