import hashlib
import random

import pytest

from threadloom.llm import sql, substring


def brute(rows, window):
    seen = {}
    split = {i: (t or "").encode().split() for i, (_, t) in enumerate(rows)}
    for i, (key, _) in enumerate(rows):
        w = split[i]
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            seen[g] = min(seen.get(g, 1 << 63), key if key is not None else (1 << 63) - 1)
    out = []
    for i, (key, _) in enumerate(rows):
        w, k = split[i], key if key is not None else (1 << 63) - 1
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] < k:
                gone |= set(range(p, p + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, n=60, words=140):
    rng = random.Random(seed)
    shared = [[rng.choice("ab cd ef gh ij".split()) + str(rng.randint(0, 9)) for _ in range(k)] for k in (49, 50, 51, 80, 120)]
    rows = []
    for i in range(n):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, words))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            p = rng.choice(shared)
            cut = rng.randint(0, 5)
            w[at:at] = p[cut:]
        rows.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    rows += [(n + k, rows[k][1]) for k in range(8)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    rows = passages(seed)
    got = substring.deduplicate(docs(rows)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, 50)


def test_edge_rows(docs):
    run = " ".join(f"x{i}" for i in range(60))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, run), (8, run), (9, run + " tail"), (None, run), (10, "é\xa0ü " * 70), (11, "word")]
    got = sorted([tuple(r) for r in substring.deduplicate(docs(rows)).collect()], key=repr)
    assert got == brute(rows, 50)
    assert substring.deduplicate(docs([])).count() == 0


def test_sql_agrees(docs, duck):
    rows = passages(3, n=25)
    df = docs(rows)
    want = duck(sql.OP1, documents=df.toPandas())
    got = substring.deduplicate(df).toPandas()
    key = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()


def test_texts_follow(docs):
    run = " ".join(f"x{i}" for i in range(60))
    out = {r.doc_id: r for r in substring.without_repeats(docs([(1, run), (2, "a  b " + run + " c"), (3, run), (4, "plain  text")])).collect()}
    assert set(out) == {1, 2, 4}
    assert out[2].text == "a b c" and out[2].n_chars == 5
    assert out[4].text == "plain  text"


def test_rule_rejects_what_is_no_cover():
    with pytest.raises(ValueError):
        substring.Rule(period=31, cover=(0, 1, 2))


def test_many_copies_and_a_very_long_text(docs, duck):
    base = [f"w{i}" for i in range(70)]
    long = [f"l{i % 5000}" for i in range(30_000)]  # repeats within itself are not another document's
    rows = [(i, " ".join(base)) for i in range(30)] + [(40, " ".join(["a", *base, "b"])), (41, " ".join(long)), (42, " ".join([*long[:60], "end"])), (43, "x" * 300_000)]
    df = docs(rows)
    want = duck(sql.OP1, documents=df.toPandas())
    got = substring.deduplicate(df).toPandas()
    key = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()
