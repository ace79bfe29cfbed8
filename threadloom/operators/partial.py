"""Mergeable partial states: what a conversation's state needs of its chunk records, kept up by deltas.

A partial holds, by chunk index, the newest version of a chunk's cleaned record. Chunks of the
frontier are whole; a chunk that has left it, which it never enters again as the number of
chunks only grows, keeps the four fields that the state reads of its history. Merging takes the newest
version of every chunk, so it is associative, commutative and idempotent: partials of
any split of the records, merged in any order and repeatedly, give the same state, and a
corrected record replaces its former one.

An update cleans the delta's records, and moves and rewrites the partials of the delta's conversations
alone (``merge_into``); the others stay as they are, in a ``Store`` bucketed by conversation.

Defined results
- two records of a chunk in one version: the greater, by its fields
- null conv or chunk index: left out; records without a version: version 0
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import state

#: What the state reads of a chunk that has left the frontier.
HISTORY = ("topic", "objective", "completed_work", "constraints")


def partials(records: DataFrame, version: str | None = None) -> DataFrame:
    """conv, parts (by chunk index: version and cleaned record) and n of chunk records; ``version`` names a column."""
    own = F.coalesce(F.col(version).cast("long"), F.lit(0).cast("long")) if version else F.lit(0).cast("long")
    # records of one chunk meet first: a repeated chunk is one part
    one = records.where("conv IS NOT NULL AND chunk_index IS NOT NULL").withColumn("_v", own)
    fields = [*state.LISTS, *state.TEXTS]
    newest = one.groupBy("conv", "chunk_index").agg(F.max(F.struct("_v", *fields)).alias("_r"))
    rows = state.cleaned(newest.select("conv", "chunk_index", "_r.*"), "_v")
    part = F.struct(F.col("chunk_index").cast("int").alias("idx"), F.col("_v").alias("version"), *fields)
    return _settled(rows.groupBy("conv").agg(F.collect_list(part).alias("parts")))


def _settled(rows: DataFrame) -> DataFrame:
    """Parts in order, those behind the frontier with their history only."""
    ordered = rows.withColumn("parts", F.array_sort("parts"))
    counted = ordered.withColumn("n", (F.element_at("parts", -1)["idx"] + 1).cast("int"))
    cutoff = F.greatest(F.lit(0), F.col("n") - state.band(F.col("n")))
    none = {n: F.array().cast("array<string>") for n in state.LISTS} | {n: F.lit("") for n in state.TEXTS}

    def settled(p: Column) -> Column:
        slim = F.struct(p["idx"].alias("idx"), p["version"].alias("version"), *[(p[n] if n in HISTORY else none[n]).alias(n) for n in (*state.LISTS, *state.TEXTS)])
        return F.when(p["idx"] < F.col("_cut"), slim).otherwise(p)

    return counted.withColumn("_cut", cutoff).withColumn("parts", F.transform("parts", settled)).select("conv", "parts", "n")


def merge(*some: DataFrame) -> DataFrame:
    """One partial a conversation from any number of tables of partials."""
    each = reduce(DataFrame.unionByName, some).select("conv", F.explode("parts").alias("p"))
    # of one version, the whole part before the one that has left some table's frontier
    weight = F.struct(F.col("p.version"), F.col("p").alias("p"))
    newest = each.groupBy("conv", F.col("p.idx").alias("idx")).agg(F.max(weight).alias("_w"))
    return _settled(newest.groupBy("conv").agg(F.collect_list("_w.p").alias("parts")))


def merge_into(kept: DataFrame, delta: DataFrame) -> DataFrame:
    """The partials that ``delta`` changes, merged; what it does not name is not read further than its key."""
    return merge(kept.join(delta.select("conv"), "conv", "left_semi"), delta)


def build(rows: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The state of every conversation, as ``state.build`` gives it from all records."""
    chunks = F.transform("parts", lambda p: F.struct(p["idx"].alias("idx"), *[p[n].alias(n) for n in (*state.LISTS, *state.TEXTS)]))
    return state.build_gathered(rows.select("conv", chunks.alias("chunks"), "n"), transcripts)
