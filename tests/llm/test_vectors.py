import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.llm import codebooks, divergence, embeddings, sql

VECTORS = "vec_id long, embedding array<float>, label int, point string, n string, code string"


def rows(vectors, labels=None):
    labels = labels or [None] * len(vectors)
    return [(i, None if v is None else [None if x is None else float(x) for x in v], la, "x", "y", "z") for (i, v), la in zip(vectors, labels, strict=True)]


def plain_links(pairs, cosine=0.9):
    """n_links, component and kept of every row by all pairs."""
    good, length = [], None
    sizes = [len(v) for _, v in pairs if fine(v)]
    length = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else None
    for k, (_, v) in enumerate(pairs):
        if fine(v) and len(v) == length:
            good.append(k)
    x = np.array([pairs[k][1] for k in good], dtype=np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
    near = x @ x.T >= cosine if len(x) else np.zeros((0, 0), dtype=bool)
    group = list(range(len(good)))
    changed = True
    while changed:
        lower = [min((group[j] for j in np.flatnonzero(near[i]).tolist()), default=group[i]) for i in range(len(good))]
        changed, group = lower != group, lower
    out = [(i, 0, i, True) for i, _ in pairs]
    for at, k in enumerate(good):
        ids = [pairs[good[j]][0] for j in range(len(good)) if group[j] == group[at] and pairs[good[j]][0] is not None]
        least = min(ids, default=None)
        out[k] = (pairs[k][0], int(near[at].sum()) - 1, least, pairs[k][0] == least)
    return sorted(out, key=repr)


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def judged(spark, pairs, rule=embeddings.Rule(), kind="float"):
    df = spark.createDataFrame(rows(pairs), VECTORS.replace("<float>", f"<{kind}>"))
    got = embeddings.near_duplicates(df, rule)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=repr)


def groups(seed, sizes, spread, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for size, noise in zip(sizes, spread, strict=True):
        centre = rng.standard_normal(dim)
        out += list((centre + noise * rng.standard_normal((size, dim))).astype(np.float32))
    rng.shuffle(out)
    return [(7 * i + 3, v.tolist()) for i, v in enumerate(out)]


def test_links_against_all_pairs(spark):
    # a third are one group of near copies, others are as wide as the threshold: balls that prove nothing
    pairs = groups(1, [1] * 300 + [400, 150, 40, 8, 2, 2], [1.0] * 300 + [0.05, 0.22, 0.3, 0.25, 0.1, 0.0])
    want = plain_links(pairs)
    assert any(n > 300 for _, n, _, _ in want) and any(0 < n < 30 for _, n, _, _ in want)
    assert judged(spark, pairs) == want


def test_recall_of_points_without_balls(spark):
    """Pairs near the threshold only, which no ball holds: lists alone find them."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.standard_normal((400, 32))
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    angle = np.arccos(rng.uniform(0.905, 0.95, (400, 1)))
    both = np.concatenate([base, np.cos(angle) * base + np.sin(angle) * away])
    pairs = [(i, v) for i, v in enumerate(both.astype(np.float32).tolist())]
    got, want = judged(spark, pairs), plain_links(pairs)
    true, found = sum(n for _, n, _, _ in want), sum(n for _, n, _, _ in got)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.98 * true > 700


def test_balls_shrink_a_group_of_any_size(spark):
    pairs = groups(5, [3000, 1], [0.02, 1.0], dim=16)
    df = spark.createDataFrame(rows(pairs), VECTORS)
    points = df.select(F.col("vec_id").alias("point"), F.col("embedding").alias("vec"), F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("n"))
    left, home = embeddings.balls(points, embeddings.Rule())
    assert left.count() <= 12 and left.agg(F.sum("n")).first()[0] == 3001 and home.count() == 3001
    # every member lies within its ball
    at = {r["point"]: r for r in left.collect()}
    own = dict(pairs)
    for node, point in map(tuple, home.collect()):
        a, b = np.array(own[node]), np.array(at[point]["vec"])
        assert math.acos(min(1.0, a @ b / np.linalg.norm(a) / np.linalg.norm(b))) <= at[point]["radius"] + 1e-7


@pytest.mark.parametrize("kind", ["float", "double"])
def test_edge_vectors(spark, kind):
    nan, inf, big = float("nan"), float("inf"), 1e30
    # 9, 1, 3, 3 has the length 10, so its cosine with the first is 0.9
    pairs = [(1, [1, 0, 0, 0]), (2, [1, 0, 0, 0]), (2, [1, 0, 0, 0]), (3, [2, 0, 0, 0]), (None, [1, 0.01, 0, 0]), (None, [0, 0, 5, 0]), (5, None), (6, [0, 0, 0, 0]), (7, [nan, 1, 0, 0]),
             (8, [inf, 1, 0, 0]), (9, [None, 1, 0, 0]), (10, []), (11, [1, 0]), (12, [0, big, 0, 0]), (13, [0, 1 / big, 0, 0]), (14, [9, 1, 3, 3]), (15, [8.99, 1, 3, 3])]
    assert judged(spark, pairs, kind=kind) == plain_links(pairs)
    assert judged(spark, [], kind=kind) == [] and judged(spark, [(4, None)], kind=kind) == [(4, 0, 4, True)]


def plain_codes(pairs, labels):
    """The codes by loops over Python integers."""
    sizes = [len(v) for _, v in pairs if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    length = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], la) for (i, v), la in zip(pairs, labels, strict=True) if v is not None and len(v) == length and length and all(x is not None and math.isfinite(x) for x in v)]
    places = codebooks.cuts(length, 8)
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[r[1][p] for r in order] for p in places]

    def best(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, c, strict=True)) for c in book]
        return far.index(min(far)), min(far)

    for _ in range(6):
        for p, place in enumerate(places):
            held = {}
            for _, v, _ in kept:
                held.setdefault(best(v[place], books[p])[0], []).append(v[place])
            for e, own in held.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for i, v, la in kept:
        found = [best(v[place], books[p]) for p, place in enumerate(places)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), la))
    total = {la: sum(r[2] for r in out if r[3] == la) for la in {r[3] for r in out}}
    return sorted(((i, c, e, total[la], digest) for i, c, e, la in out), key=repr)


@pytest.mark.parametrize("n,dim", [(120, 64), (5, 16), (40, 13)])
def test_codes_against_loops(spark, duck, n, dim):
    rng = np.random.default_rng(n)
    pairs = [(int(i), rng.standard_normal(dim).round(2).tolist()) for i in rng.permutation(n)]
    labels = [None if i % 5 == 0 else int(i % 3) for i in range(n)]
    pairs += [(n, None), (n + 1, [float("nan")] * dim), (n + 2, [None] * dim), (n + 3, [1.0]), (n + 4, [])]
    labels += [1, 1, 1, 1, 1]
    df = spark.createDataFrame(rows(pairs, labels), VECTORS)
    got = codebooks.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == plain_codes(pairs, labels)
    if dim == 64:
        frame = pd.DataFrame([(i, v, la) for (i, v), la in list(zip(pairs, labels, strict=True))[:n]], columns=["vec_id", "embedding", "label"]).astype({"label": "Int64"})
        other = duck(sql.OP13.replace("FROM embeddings", "FROM (SELECT vec_id, embedding::FLOAT[] AS embedding, label FROM frame)"), frame=frame)
        assert sorted(map(tuple, other[["vec_id", "code", "error", "label_error", "codebooks_sha256"]].itertuples(index=False)), key=repr) == got


def test_codes_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "LABELS", 0)  # sums of labels are joined in parts
    pairs = [(1, [0.5] * 8), (1, [0.5] * 8), (None, [-0.25] * 8), (2, [0.5] * 8)]
    labels = [None, None, 4, 4]
    df = spark.createDataFrame(rows(pairs, labels), VECTORS)
    assert sorted(map(tuple, codebooks.compress(df).collect()), key=repr) == plain_codes(pairs, labels)
    assert codebooks.compress(df.limit(0)).count() == 0
    books = codebooks.learn(df, 8, codebooks.Rule())
    coded = codebooks.encode(df, 8, books, codebooks.Rule())
    back = {(r["vec_id"], *r["embedding"]) for r in codebooks.decode(coded, books, codebooks.Rule()).collect()}
    assert back == {(i, *v) for i, v in pairs}
    with pytest.raises(Exception, match="scale the vectors down"):
        codebooks.compress(spark.createDataFrame(rows([(1, [1e9] * 8)]), VECTORS)).collect()


def _audit_docs():
    words = "the of and to in is you that it he was for on are as with".split()
    rng = np.random.default_rng(9)
    out = []
    for i in range(300):
        lang, source = [("en", "a"), ("en", "b"), ("en", None), (None, "a"), ("", "a"), ("de", "x"), ("fr", "y")][i % 7]
        bias = 4 if source == "b" else 16
        text = " ".join(rng.choice(words[:bias], 12)) + [" Ünïcode ÄÖ é", " THE The the", " 1x2 \U0001f600z", " ..."][i % 4]
        out.append((i, None if i % 50 == 0 else text, lang, source))
    # a group without a term, and a language that keeps none
    return [*out, (400, None, "en", "empty"), (401, "", "en", "empty"), (402, "only once", "la", "p"), (403, "too few", "la", "q"), (403, "too few", "la", "q")]


@pytest.mark.parametrize("groups_", [100_000, 0])
def test_audit_against_sql(spark, duck, monkeypatch, groups_):
    monkeypatch.setattr(divergence, "GROUPS", groups_)
    data = _audit_docs()
    df = spark.createDataFrame([(*r, "n", "p") for r in data], "doc_id long, text string, lang string, source string, term string, item string")
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert [f.dataType.simpleString() for f in got.schema][4:] == ["bigint", "int"]
    got = sorted(map(tuple, got.collect()))
    want = duck(sql.OP12, documents=pd.DataFrame(data, columns=["doc_id", "text", "lang", "source"]))
    assert sorted(map(tuple, want[["lang", "source", "part", "item", "value", "rank"]].itertuples(index=False))) == got
    assert ("la", "p", "pair", "q", 0, 1) in got and any(r[1] == "empty" and r[2] == "pair" for r in got)
    assert any(r["term"] == "\U0001f600z" and r["in_docs"] == r["n"] for r in divergence.term_counts(df).collect())
    assert divergence.audit(df.limit(0)).count() == 0


def test_ids_and_counts_are_not_broadcast_by_the_driver(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    seen, plain = [], DataFrameWriter.parquet

    def parquet(self, *a, **b):
        seen.append((spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")))
        return plain(self, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    pairs = groups(5, [20, 30, 1], [0.1, 0.3, 0.1])
    df = spark.createDataFrame(rows(pairs), VECTORS)
    got = embeddings.near_duplicates(df)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_links(pairs)
    assert set(seen) == {("256k", "256k")}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # joins that the caller's settings would plan
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "256k"
