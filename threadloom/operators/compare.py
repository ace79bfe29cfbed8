"""Two extractors side by side: both passes under one scan of the chunks, records merged by chunk, fields compared.

The comparison follows the record's schema: list fields by the sets of their keys, text
fields by their key. A chunk that one side lacks or failed on is a row too.

Defined results
- a record of neither side: no row; rows of one chunk on one side: the greatest counts
- two empty fields agree; an empty and a full one do not, and count as the full side's alone
- a null conv or chunk index matches nothing: left out
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import extraction, handoff

FIELDS = (*extraction.SCALARS, *extraction.LISTS)


def pairs(chunks: DataFrame, left: extraction.Extractor, right: extraction.Extractor) -> DataFrame:
    """conv, chunk_index and the structs left and right: chunks are read once, and no join brings the sides together."""
    sized = chunks.withColumn("input_chars", F.length("chunk")).withColumn("content_hash", T.content_hash(F.col("chunk")))
    rows = right(left(sized).withColumnRenamed("raw", "_left")).withColumnRenamed("raw", "_right")
    keep = rows.columns
    for name in ("left", "right"):
        record = extraction.regular(rows.withColumn("raw", F.col(f"_{name}")))
        rows = record.withColumn(name, F.struct(*FIELDS, "parse_ok", "error")).select(*keep, *[n for n in ("left", "right") if n in rows.columns and n != name], name)
        keep = rows.columns
    return rows.select("conv", "chunk_index", "left", "right")


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same rows from two tables of records: a full outer merge by chunk."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        own = rows.where("conv IS NOT NULL AND chunk_index IS NOT NULL")
        return own.groupBy("conv", "chunk_index").agg(F.max(F.struct(*FIELDS, "parse_ok", "error")).alias(name))

    return side(left, "left").join(side(right, "right"), ["conv", "chunk_index"], "full")


def _keys(side: Column, name: str) -> Column:
    if name in extraction.SCALARS:
        key = T.norm_key(F.coalesce(side[name], F.lit("")))
        return F.when(key != "", F.array(key)).otherwise(F.array().cast("array<string>"))
    items = F.coalesce(side[name], F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(items, T.norm_key), lambda k: k != ""))


def compared(rows: DataFrame) -> DataFrame:
    """conv, chunk_index, outcome and, field by field, (field, verdict, likeness).

    ``outcome``: both, left, right or none parsed. Verdict: same, empty (on both sides), left or
    right (the other is empty), differ. Likeness is the Jaccard index of the keys.
    """
    ok = lambda name: F.coalesce(F.col(name)["parse_ok"], F.lit(False))
    outcome = F.when(ok("left") & ok("right"), "both").when(ok("left"), "left").when(ok("right"), "right").otherwise("none")

    def told(name: str) -> Column:
        a, b = _keys(F.col("left"), name), _keys(F.col("right"), name)
        common, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
        verdict = F.when(all_ == 0, "empty").when(common == all_, "same").when(F.size(b) == 0, "left").when(F.size(a) == 0, "right").otherwise("differ")
        return F.struct(F.lit(name).alias("field"), verdict.alias("verdict"), T.rounded(F.when(all_ == 0, F.lit(1.0)).otherwise(common / all_), 4).alias("likeness"))

    return rows.select("conv", "chunk_index", outcome.alias("outcome"), F.array(*map(told, FIELDS)).alias("fields"))


def agreement(rows: DataFrame) -> DataFrame:
    """One row a field over all of ``compared``: counts of its verdicts and mean likeness where both sides parsed."""
    each = rows.where("outcome = 'both'").select(F.explode("fields").alias("f"))
    count = lambda v: F.count_if(F.col("f.verdict") == v).alias(v)
    return each.groupBy(F.col("f.field").alias("field")).agg(*map(count, ("same", "empty", "left", "right", "differ")), T.rounded(F.avg("f.likeness"), 4).alias("likeness"))


def handoff_blocks(records: DataFrame, version: str = "auto") -> DataFrame:
    """(conv, text): the hand-offs of a conversation's records as numbered blocks to copy, empty ones left out but counted."""
    made = handoff.hand_over(records, version)
    item = F.struct("chunk_index", F.coalesce("handoff", F.lit("")).alias("text"))
    grouped = made.groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("b"), F.count("*").alias("n"))
    block = lambda b: F.concat(F.lit("=== CHUNK "), b["chunk_index"] + 1, F.lit("/"), F.col("n"), F.lit(" — AI HANDOFF ===\n"), b["text"])
    return grouped.select("conv", F.array_join(F.transform(F.filter("b", lambda b: b["text"] != ""), block), "\n\n").alias("text"))


def parse_rates(rows: DataFrame) -> DataFrame:
    """Per conversation: chunks compared, and how many each side parsed."""
    has = lambda *v: F.count_if(F.col("outcome").isin(*v))
    return rows.groupBy("conv").agg(F.count("*").alias("chunks"), has("both", "left").alias("left_ok"), has("both", "right").alias("right_ok"), has("none").alias("neither"))
