import random

import numpy as np
import pytest

from threadloom.llm import chat, hamming, sql


def logs(seed):
    rng = random.Random(seed)
    rows, base = [], []
    for c in range(30):
        base.append([(k, rng.choice(["user", "assistant"]), f"t{rng.randint(0, 5)}") for k in range(rng.randint(1, 6))])
    for c in range(120):
        b = rng.choice(base)
        for turn, role, text in b[: rng.randint(1, len(b))]:
            rows.append((c, turn, role, text))
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_collapse_as_sql_and_brute_force(spark, duck, seed):
    rows = logs(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, chat.render(df).collect()))
    byid = {}
    for c, *turn in sorted(rows):
        byid.setdefault(c, []).append(tuple(turn))
    want = []
    for c, t in byid.items():
        more = any(len(o) > len(t) and o[: len(t)] == t for o in byid.values())
        first = min(k for k, o in byid.items() if o == t) == c
        if not more and first:
            want.append((c, len(t), "\n".join(f"<|im_start|>{r}\n{x}<|im_end|>" for _, r, x in t)))
    assert got == sorted(want)
    assert sorted(map(tuple, duck(sql.OP3, conversations=df.toPandas()).values.tolist())) == got


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", None), (3, 0, "user", ""), (4, 0, None, "a"), (None, 0, "user", "b"), (5, 0, "user", "c"), (5, 0, "user", "c"), (6, 0, "user", "c"), (6, 1, "user", "c")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS k", "'x' AS p1", "true AS last", "'y' AS prompt")
    out = {r.conv_id: (r.n_turns, r.prompt) for r in chat.render(df).collect()}
    assert set(out) == {1, 2, 3, 4, None, 5}  # 6 repeats 5: turns compare by order, role and text
    assert out[2][1] == out[3][1] == "<|im_start|>user\n<|im_end|>"
    assert out[5][0] == 2
    assert chat.render(df.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark):
    plan = chat.render(spark.createDataFrame([(1, 0, "u", "a")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def nearest(rows, asked, k):
    code = {i: int("".join("1" if x >= 0 else "0" for x in v), 2) for i, v in rows}
    out = []
    for q in sorted({i for i, _ in asked}):
        d = sorted((bin(code[q] ^ c).count("1"), i) for i, c in code.items() if i != q)[:k]
        out += [(q, r + 1, i, x) for r, (x, i) in enumerate(d)]
    return out


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hamming, "INDEX_BLOCK", 150)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    rows = [(i, (centre * (i % 2) + rng.normal(size=64)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # one very common code
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "0 AS code", "0 AS ids", "0 AS rank")
    asked = df.where("vec_id % 100 = 0 OR vec_id IN (7, 1001)")
    got = sorted(map(tuple, hamming.top_k(df, asked, k=10).collect()))
    assert got == nearest(rows, [r for r in rows if r[0] % 100 == 0 or r[0] in (7, 1001)], 10)


def test_top_k_edges(spark):
    rows = [(1, [1.0] * 64), (1, [1.0] * 64), (2, None), (3, [1.0] * 3), (4, [-1.0] * 64), (None, [1.0] * 64), (5, [1.0] * 63 + [None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, hamming.top_k(df, df, k=3).collect())) == [(1, 1, 4, 64), (4, 1, 1, 64)]
    assert hamming.top_k(df.limit(0), df, k=3).count() == 0
