import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

from threadloom.llm import mixing, sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_as_published():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_shards(docs):
    rows = [(i, f"text {i % 7} é") for i in range(3000)] + [(5, "again"), (5, "again"), (None, None)]
    out = sharding.shard(docs(rows), shards=24, bins=16).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    assert len({r.shard for r in out if r.doc_id == 5}) == 1
    by = {r.doc_id: r for r in out}
    assert by[None].size == 8 and by[None].text_crc32 == 0
    assert by[1].size == len("text 1 é".encode()) + 8 and by[1].text_crc32 == zlib.crc32("text 1 é".encode())
    assert sharding.shard(docs([])).count() == 0


def test_targets_share_and_stop():
    got = mixing.targets([("b", 10), ("a", 1), (None, 1000)])
    # order a, b, null with weights 5, 2, 1: both small sources stop at three times their size
    assert got == {"a": 3, "b": 30, None: 1011 - 33}
    got = mixing.targets([("a", 100), ("b", 100)])
    assert got["a"] == Fraction(1000, 7) and got["b"] == Fraction(400, 7)
    assert mixing.targets([("a", 0)]) == {"a": 0}


def test_mix(docs, spark):
    rows = [(i, "w " * (i % 30 + 1)) for i in range(900)]
    df = docs(rows[:300], source="a").union(docs(rows[300:600], source="b")).union(docs(rows[600:], source=None)).union(docs([(9000, None), (9001, "")], source="c"))
    first, again = (sorted(map(tuple, mixing.mix(df.repartition(k)).collect()), key=repr) for k in (3, 7))
    assert first == again and len(first) == 902
    out = mixing.mix(df).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in out:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        full = int(r.target // r.source_size) if r.source_size else 0
        assert r.taken >= full * r.size
    assert all(abs(taken[s] - target[s]) <= 31 for s in target)
    assert mixing.mix(docs([])).count() == 0


def test_quality_draws_more_often(docs, spark):
    df = docs([(i, "a b c d") for i in range(2000)], source="z").union(docs([(i, "a") for i in range(2000, 40000, 4)], source="a"))
    quality = spark.createDataFrame([(i, 8.0 if i % 2 else 1.0) for i in range(2000)], "doc_id long, quality double")
    out = [r for r in mixing.mix(df, quality).collect() if r.source == "z" and r.taken]
    odd = sum(r.doc_id % 2 for r in out)
    assert odd > 2 * (len(out) - odd)


def test_later_documents_fill_what_a_long_one_leaves(docs, spark):
    rows = [(i, "w " * (400 if i % 10 == 0 else i % 7 + 1)) for i in range(300)]
    df = docs(rows, source="z").union(docs([(i, "w " * 9) for i in range(1000, 2500)], source="a"))
    quality = spark.createDataFrame([(i, 2.0 if i % 3 else 0.5) for i in range(300)], "doc_id long, quality double")
    passed_over = 0
    for seed in range(4):
        out = mixing.mix(df, quality, seed=seed, bins=8).collect()
        z = {r.doc_id: r for r in out if r.source == "z"}
        units = df.where("source = 'z'").select("doc_id", mixing.unit(F.lit(seed), F.col("doc_id").cast("string"), "text").alias("u")).collect()
        left, want, over = round(z[0].target), set(), False
        for r in sorted(units, key=lambda r: -math.log(r.u) / (2.0 if r.doc_id % 3 else 0.5)):
            if left > 0 and z[r.doc_id].size <= 2 * left:
                left -= z[r.doc_id].size
                want.add(r.doc_id)
                passed_over += over
            elif left > 0:
                over = True
        assert {k for k, r in z.items() if r.taken} == want
        assert z[0].target - sum(r.taken for r in z.values()) <= 1
        carried = mixing.mix(df, quality, seed=seed, bins=8, carry=("text",)).where("source = 'z' AND taken > 0").collect()
        assert {r.doc_id for r in carried} == want
    assert passed_over > 0


def test_weights_of_any_scale_part_a_source_alike(docs, spark):
    """Row by row against a plain sampler, under weights of a thousand and odd ones."""
    rows = [(i, "w " * (i % 5 + 1)) for i in range(1500)]
    df = docs(rows, source="z").union(docs([(i, "w " * 9) for i in range(2000, 4500)], source="a"))
    odd = {0: float("nan"), 1: float("inf"), 2: -1.0, 3: 0.0, 4: None}
    weight = {i: odd.get(i % 50, 1000.0 if i % 3 else 1.0) for i in range(1500)}
    quality = spark.createDataFrame(list(weight.items()), "doc_id long, quality double")
    out = {r.doc_id: r for r in mixing.mix(df, quality).collect() if r.source == "z"}
    units = df.where("source = 'z'").select("doc_id", mixing.unit(F.lit(17), F.col("doc_id").cast("string"), "text").alias("u")).collect()
    fair = lambda q: q if q is not None and 0 < q < float("inf") else 1.0
    left, want = round(out[0].target) % out[0].source_size, set()
    for r in sorted(units, key=lambda r: (-math.log(r.u) / fair(weight[r.doc_id]), r.doc_id)):
        if left > 0 and out[r.doc_id].size <= 2 * left:
            left -= out[r.doc_id].size
            want.add(r.doc_id)
    full = round(out[0].target) // out[0].source_size
    assert {k for k, r in out.items() if r.taken > full * r.size} == want


def test_sharding_sql_agrees(docs, duck):
    from threadloom.llm import sql

    df = docs([(i, f"text {i % 7} é") for i in range(300)] + [(5, "again"), (7, None), (None, "x")])
    want, got = duck(sql.OP2, documents=df.toPandas().astype({"doc_id": "Int64"})), sharding.shard(df).toPandas()
    key = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = lambda d: sorted(map(repr, d[key].astype({"doc_id": "Int64"}).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
