import random

import pytest

from threadloom.llm import neardup, sql


def sets(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, width, percent):
    s = [(k, sets(t, width)) for k, t in rows]
    parent = {k: k for k, _ in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted((k, len(x), root(k), root(k) == k) for k, x in s)


def family(seed, groups=6, copies=12, words=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 10**5)}" for _ in range(rng.randint(3, words))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            rows.append(" ".join(w[: len(w) - rng.randint(0, len(w) // 8)]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_against_brute_force(docs, width, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)  # families span several blocks
    rows = family(width)
    got = neardup.near_duplicates(docs(rows), neardup.Rule(width=width, percent=percent))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute(rows, width, percent)


def test_edge_rows(docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, "A B C"), (7, "a b c"), (None, "a b c"), (9, "É b c"), (10, "é b c")]
    got = neardup.near_duplicates(docs(rows), neardup.Rule(width=3, percent=85)).collect()
    by = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got]
    assert len(by) == len(rows)
    assert (1, 0, 1, True) in by and (3, 0, 3, True) in by
    assert (5, 1, 4, False) in by and by.count((7, 1, 6, False)) == 2
    assert (None, 1, 6, False) in by
    assert (9, 1, 9, True) in by and (10, 1, 10, True) in by  # only A-Z are lower-cased
    assert neardup.near_duplicates(docs([]), neardup.Rule()).count() == 0


def test_sql_agrees(docs, duck):
    df = docs(family(11, groups=4))
    want = duck(sql.OP7, documents=df.toPandas())
    got = neardup.near_duplicates(df, neardup.Rule(width=3, percent=85)).toPandas()
    key = ["doc_id", "n_shingles", "component_id", "kept"]
    assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()


def test_min_and_max_estimate_the_same_index():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    m, f = neardup.permutations(2000)
    x, y = neardup.signature(a, m, f).reshape(-1, 2), neardup.signature(b, m, f).reshape(-1, 2)
    assert abs((x[:, 0] == y[:, 0]).mean() - 0.5) < 0.04
    assert abs((x[:, 1] == y[:, 1]).mean() - 0.5) < 0.04


def test_one_of_each_group_stays(docs):
    text = " ".join(f"w{i}" for i in range(40))
    kept = neardup.without_near_duplicates(docs([(1, text), (2, text + " end"), (3, "other words here"), (3, "other words here"), (4, ""), (5, "")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_word_hashes_follow_words():
    from threadloom.llm.common import hash_words

    rng = random.Random(8)
    raw = b"".join(rng.choice([b" ", b"\n", b"\x0b\t", b"ab", b"c", "é\xa0".encode(), b"\x1c", b"abc " * 9]) for _ in range(4000))
    words = raw.split()
    for block in (1, 7, 100, 1 << 20):
        got = hash_words(raw, block).tolist()
        assert len(got) == len(words)
        assert dict(zip(words, got)) == dict(zip(reversed(words), reversed(got))) and len(set(got)) == len(set(words))
    assert len(hash_words(b"")) == 0 and len(hash_words(b"  ")) == 0


def test_rows_of_one_id_link_all_their_classes(docs):
    words = lambda k: " ".join(f"{k}{i}" for i in range(9))
    rows = [(1, words("a")), (2, words("b")), (3, words("c")), (5, words("a")), (5, words("b")), (5, words("c")), (None, words("n")), (None, words("m"))]
    got = neardup.near_duplicates(docs(rows), neardup.Rule(width=3, percent=85)).collect()
    assert {r.component_id for r in got if r.doc_id is not None} == {1}
    assert sorted(r.kept for r in got if r.doc_id is None) == [True, True]  # texts without an id are documents of their own
    kept = neardup.without_near_duplicates(docs([*rows, (5, words("d")), (7, words("f")), (7, words("e"))]))
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept.collect()) == [(0, "m"), (0, "n"), (1, "a"), (7, "e")]


def test_built_words_of_one_polynomial_hash_differ():
    from threadloom.llm.common import hash_words

    for k in (10, 11, 12):  # Thue-Morse words collide modulo 2^64 under every base
        signs = [bin(i).count("1") % 2 for i in range(1 << k)]
        a, b = (bytes(97 + (x ^ flip) for x in signs) for flip in (0, 1))
        x, y = hash_words(a + b" " + b).tolist()
        assert x != y and hash_words(b"z " + a).tolist()[1] == x


def test_large_families(docs, monkeypatch):
    """Families beyond a block: copies of one text, a chain of neighbours, and texts that share much and are not linked."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "PART", 7)
    monkeypatch.setattr(neardup, "REPS", 2)
    monkeypatch.setattr(neardup, "OWN_REPS", 1)
    rng, rows = random.Random(4), []
    base = [f"b{i}" for i in range(100)]
    for i in range(40):  # mutual likeness about 0.7 to 0.95
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 5, 6])):
            w[rng.randrange(100)] = f"x{i}{rng.random()}"
        rows.append(" ".join(w))
    line = [f"c{i}" for i in range(400)]
    rows += [" ".join(line[i * 4 : i * 4 + 100]) for i in range(60)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    for width, percent in ((3, 85), (5, 80)):
        got = neardup.near_duplicates(docs(rows), neardup.Rule(width=width, percent=percent))
        assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute(rows, width, percent)
