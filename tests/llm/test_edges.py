"""Very long texts, and what the operators leave behind."""

import pytest
from pyspark.sql import functions as F

from threadloom import session
from threadloom.llm import chat, common, fingerprint, mixing, neardup, sharding

LONG = "word and more words " * 100_000  # 2 MB


def test_very_long_texts(docs, spark):
    df = docs([(1, LONG), (2, "short text"), (3, LONG + "end"), (4, "x" * 1_000_000)])
    assert {r.doc_id: r.size for r in sharding.shard(df).collect()}[1] == len(LONG) + 8
    out = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    assert out[1].n_chars == len(LONG) and len(out[4].fingerprint) == fingerprint.BINS
    mixed = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert mixed[1].size == 400_000 and mixed[4].size == 1
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, neardup.Rule()).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    turns = spark.createDataFrame([(1, 0, "user", LONG), (2, 0, "user", LONG), (2, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    (kept,) = chat.render(turns).collect()
    assert kept.conv_id == 2 and len(kept.prompt) > len(LONG)


def test_written_tables_go(spark):
    df = common.written(spark.range(5), "some")
    assert df.count() == 5 and df.written_path in session._scratch
    common.discard(df)
    assert df.written_path not in session._scratch
    before = spark.conf.get(common._CLEANUP, None)
    common.written(spark.range(2).repartition(2), "other")
    assert spark.conf.get(common._CLEANUP, None) == before


def test_filter_before_a_shuffle_keeps_every_listed_row(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    ids = spark.range(0, 20_000, 40).select(F.col("id").alias("k"))
    got = {r.k for r in common.among(rows, ids, "k").collect()}
    assert set(range(0, 20_000, 40)) <= got and len(got) < 600
    assert common.among(rows, ids.limit(0), "k").count() == 0


def test_joins_in_parts(spark):
    many = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    few = spark.createDataFrame([(0, "a"), (1, "b")], "k long, x string")
    got = sorted((r.k, r.n, r.x) for r in common.parted_join(many, few, "k", "n", "left").collect())
    assert got == sorted((i % 3, i, {0: "a", 1: "b"}.get(i % 3)) for i in range(500))


@pytest.mark.parametrize("cuts", [[], [5], [1, 4, 4, 9, 12]])
def test_places_among_cuts(spark, cuts):
    listed = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<int>")
    got = {r.id: r.c for r in spark.range(15).select("id", common.cuts_below(listed, F.col("id"), len(cuts)).alias("c")).collect()}
    assert got == {v: sum(c <= v for c in cuts) for v in range(15)}
