import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import chunking, ranking, selection


def changepoints_plain(series: list[float]) -> list[int]:
    """The same search in plain Python, for tests."""
    n = len(series)
    if n < 4:
        return []
    price, cost, cut = ranking.PENALTY * math.log(max(n, 2)), [0.0], [0]
    for end in range(1, n + 1):
        options = []
        for start in range(end):
            part = series[start:end]
            mean = sum(part) / len(part)
            options.append((round(cost[start] + sum((x - mean) ** 2 for x in part) + price, 12), start))
        best = min(options)
        cost.append(best[0])
        cut.append(best[1])
    out, at = [], n
    while cut[at] > 0:
        at = cut[at]
        out.insert(0, at)
    return out


def one(spark, value, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in columns.items()))
    return row.select(value.alias("x")).first().x


def pack(items, joiner, most):
    out, open_ = [], ""
    for item in items:
        joined = item if not open_ else open_ + joiner + item
        if len(joined) <= most:
            open_ = joined
        else:
            if open_:
                out.append(open_)
            open_ = item[:most]
    return out + [open_] if open_ else out


def paragraphs(text, most):
    import re

    text = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    out, open_ = [], ""
    for p in [p.strip() for p in re.split(r"\n\s*\n+", text) if p.strip()]:
        joined = p if not open_ else open_ + "\n\n" + p
        if len(joined) <= most:
            open_ = joined
            continue
        if open_:
            out.append(open_)
        open_ = ""
        if len(p) <= most:
            open_ = p
        else:
            out += pack([x.strip() for x in p.split("\n") if x.strip()], "\n", most)
    return out + [open_] if open_ else out


@pytest.mark.parametrize("seed", range(4))
def test_paragraph_chunks(spark, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["ab ", "c" * rng.randint(1, 30), "\n", "\n\n", "\r\n \r\n", "é\t", "\n \n\n"]) for _ in range(120))
    for most in (10, 25, 80):
        assert one(spark, chunking.paragraph_chunks(F.col("t"), most, shorten=True), t=text) == paragraphs(text, most)
        whole = one(spark, chunking.paragraph_chunks(F.col("t"), most), t=text)
        assert max(map(len, whole)) <= most and re.sub(r"\s", "", "".join(whole)) == re.sub(r"\s", "", text)  # nothing is lost by default


def test_overlap_and_branches(spark):
    long = "\n\n".join("p" * 40 + str(i) for i in range(6))
    options = chunking.Chunking(chunk=90, overlap=10, whole=60)
    rows = spark.createDataFrame([(1, long), (2, "short"), (3, "  \n"), (4, None)], "id int, text string")
    out = chunking.chunk_transcripts(rows, "id", options=options).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk_index, r.strategy) for r in out] == [(1, 0, "paragraph_chunk_overlap"), (1, 1, "paragraph_chunk_overlap"), (1, 2, "paragraph_chunk_overlap"), (2, 0, "short_circuit")]
    base = paragraphs(long, 90)
    assert out[1].chunk == base[0][-10:] + "\n\n" + base[1]
    assert one(spark, chunking.merge_sparse(F.col("c"), 2), c=["a", " ", "b", "c"]) == ["a", "b\n\nc"]
    assert one(spark, chunking.merge_sparse(F.col("c"), 1), c=["a", "b"]) == ["a\n\nb"]
    assert one(spark, chunking.longest_chunk(F.col("c")), c=["a", "bb", "cc"]) == "bb"


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, T.norm_key(t), t="  A  b\n") == "a b"
    assert one(spark, T.slug(t), t="  My Projéct: v2!! ") == "my-projéct-v2"
    assert one(spark, T.slug(t), t="!!!") == "conversation"
    assert one(spark, T.sentences(t), t="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert sorted(one(spark, T.token_set(t), t="Ab abc ABC a1_x 9zz x-y")) == ["a1_x", "abc", "x-y"]
    assert one(spark, T.distinct_by_key(F.col("t")), t=["A b", " a  B ", "", "c"]) == ["A b", "c"]
    assert one(spark, T.keep_first(F.col("t"), T.sentence_overlap), t=["x" * 90, "x" * 85, "y"]) == ["x" * 90, "y"]
    assert one(spark, T.append_only(F.col("a"), F.col("b")), a="", b="x") and not one(spark, T.append_only(F.col("a"), F.col("b")), a="x", b="x")
    assert one(spark, T.delta(F.col("a"), F.col("b")), a="abc", b="abc  new") == "new"
    assert one(spark, T.delta(F.col("a"), F.col("b")), a="zzz", b="abc") == "abc"
    assert one(spark, T.near_duplicate(F.col("a"), F.col("b")), a="alpha beta gamma", b="gamma beta alpha!")
    assert one(spark, T.clip_words(t, 2), t="a b c") == "a b…"


def test_changepoints(spark):
    rng = random.Random(5)
    for n in (3, 4, 9, 25):
        series = [round(rng.gauss(0, 0.2) + (3 if i > n // 2 else 0) + (2 if i > 3 * n // 4 else 0), 6) for i in range(n)]
        row = spark.createDataFrame([(series, n)], "s array<double>, n int")
        assert row.select(ranking.changepoints(F.col("s"), F.col("n")).alias("c")).first().c == changepoints_plain(series)


def test_pruned_cuts_equal_a_search_of_all_starts():
    rng = random.Random(8)
    for n in (4, 17, 60, 120):
        for series in ([rng.gauss(0, 0.3) + 2 * (i // 13 % 3) for i in range(n)], [0.0] * n, [float(i % 2) for i in range(n)], [rng.choice([0.0, 0.5, 1.0]) for _ in range(n)], [float(i // 5 % 2) for i in range(n)]):
            price = ranking.PENALTY * math.log(max(n, 2))
            assert ranking.optimal_cuts(np.array(series), price) == changepoints_plain(series)


def test_cuts_of_a_hundred_thousand_points():
    rng = np.random.default_rng(2)
    level = np.repeat(rng.normal(0, 5, 2000), 50)
    began = time.perf_counter()
    cuts = ranking.optimal_cuts(level + rng.normal(0, 0.1, len(level)), ranking.PENALTY * math.log(len(level)))
    assert time.perf_counter() - began < 30
    want = set((np.flatnonzero(np.diff(level)) + 1).tolist())
    assert len(want ^ set(cuts)) < 0.1 * len(want)


def plain_mmr(items, k):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    picked = [c for c in items if c["locked"]]
    pool = [c for c in items if c["candidate"] and not c["locked"]]
    while len(picked) < k and pool:
        best = max(pool, key=lambda c: (round(0.7 * c["score"] - (1 - 0.7) * max([dot(c["e"], p["e"]) for p in picked], default=0.0), 12), -c["idx"]))
        picked.append(best)
        pool.remove(best)
    chosen = [c["idx"] for c in picked]
    for c in sorted(items, key=lambda c: (c["score"], c["idx"]), reverse=True):
        if len(chosen) < k and c["idx"] not in chosen:
            chosen.append(c["idx"])
    return sorted(chosen)


def test_rank_selects_as_plain_python(spark):
    rng = random.Random(9)
    rows = []
    for conv, n in ((1, 2), (2, 9), (3, 22)):
        for i in range(n):
            v = [rng.gauss(0, 1) for _ in range(6)]
            norm = sum(x * x for x in v) ** 0.5
            rows.append((conv, i, [x / norm for x in v], rng.randint(0, 3)))
    df = spark.createDataFrame(rows, "conv long, idx int, embedding array<double>, cluster int")
    features = {}
    for r in ranking.scored(df).collect():
        features.setdefault(r.conv, []).append({"idx": r.idx, "score": r.score, "locked": r.locked, "candidate": r.candidate, "e": r.embedding})
    for r in ranking.rank(df).collect():
        items = sorted(features[r.conv], key=lambda c: c["idx"])
        if r.n <= r.k:
            assert r.strategy == "full" and r.selected == list(range(r.n))
        else:
            assert r.selected == plain_mmr(items, r.k)
            assert r.n - 1 in r.selected


def test_gaps_and_slots(spark):
    rows = spark.createDataFrame([(1, i, f"text {i}") for i in range(15)], "conv int, idx int, text string")
    out = selection.head_tail(rows, most=6)
    assert [(r["first"], r["last"]) for r in selection.dropped_ranges(out).collect()] == [(4, 12)]
    assert selection.dropped_ranges(out, least=10).count() == 0
    assert selection.slots(12) == (3, 7, 2) and selection.slots(3) == (1, 1, 1)
    c = selection.coverage(out).first()
    assert (c.chunks, c.chosen, c.continuity) == (15, 6, 1.0)


def test_adaptive_keeps_ends_and_best(spark):
    texts = [f"word{i} alpha beta" for i in range(20)]
    texts[9] = "error: the test is failing still, bug pending, retry; root cause found, turns out we realized it broke"
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv int, idx int, text string")
    scored = selection.scores(rows).withColumn("pos", F.col("idx"))
    chosen = selection.adaptive(scored, most=6).first().selected
    assert len(chosen) == 6 and chosen[:3] == [0, 1, 2] and chosen[-2:] == [18, 19] and 9 in chosen
    assert selection.evolution(scored).first().evolution <= 0.36


def test_scores_follow_their_sql_at_foreign_letters_and_halves(spark):
    import duckdb

    from threadloom.plans import conversations

    texts = ["ätest te öa", "testä erli", "stau testö und test", "bugé, a bug", "not\rso but still", "ſtill later", "Now instead we moved to it"]
    # 30 words each, of which all but i are those of the turn before: overlaps whose scores end in halves
    words = [" ".join(f"word{k}" for k in range(i, i + 30)) for i in range(0, 60, 3)]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)] + [(2, i, "user", t) for i, t in enumerate(words)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = selection.scores(frame.select(F.col("conv_id").alias("conv"), F.col("turn").cast("int").alias("idx"), "text")).select("conv", "idx", *conversations.SCORES).orderBy("conv", "idx").collect()
    conn = duckdb.connect()
    conn.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    conn.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert [tuple(r) for r in got] == conn.sql(conversations.SQL["saliency_scores"] + " ORDER BY conv, idx").fetchall()


def test_rounded_as_sql_does(spark):
    import duckdb

    values = [0.27595, 0.5 / 3, 1.00005, 2.675, -0.27595, 1e-9, float("inf"), 123456.78905, 0.00125] + [k / 20000 for k in range(1, 2001, 2)]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", T.rounded("v", 4).alias("x")).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0] for v in values]


@pytest.mark.parametrize("name", ["adaptive_selection", "selection_strategies"])
def test_selections_follow_their_sql_at_foreign_letters(spark, tmp_path, name):
    import duckdb

    from threadloom.plans import conversations

    rows = [(c, i, "user", " ".join(f"w{c}x{i}y{k}" for k in range(8)) + (" ätest" if i == 7 else "")) for c in range(2) for i in range(10)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = getattr(conversations, name)(spark, str(tmp_path))
    conn = duckdb.connect()
    conn.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(conn.sql(conversations.SQL[name]).fetchall())


def test_first_repeat_of_many_words_takes_linear_time(spark):
    rows = spark.createDataFrame([(0, ["a", "B", "", " ", "b"]), (1, ["", " "]), (2, []), (3, None), (4, ["x", "", "y"])], "i int, w array<string>")
    assert [r.x for r in rows.orderBy("i").select(T.first_repeat(F.col("w")).alias("x")).collect()] == [4, -1, -1, None, -1]
    many = spark.range(1, numPartitions=1).select(F.transform(F.sequence(F.lit(0), F.lit(100_000)), lambda i: F.concat(F.lit("w"), (i % 100_000).cast("string"))).alias("w"))
    began = time.time()
    assert many.select(T.first_repeat(F.col("w")).alias("x")).first().x == 100_000
    assert time.time() - began < 15
