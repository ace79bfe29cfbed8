"""Keep-first among near-copies, over rows, beside the plain fold."""

import random
import re
import time

import pytest

from threadloom.operators import firsts

SCHEMA = "g string, place long, text string, kept boolean"


def tokens(text):
    return set(re.findall("[a-z0-9]{3,}", text.lower()))


def key(text):
    return re.sub(r"\s+", " ", text.lower()).strip()


def alike(a, b):
    x, y = tokens(a), tokens(b)
    return key(a) == key(b) if not x or not y else len(x & y) / len(x | y) >= 0.55


def told(a, b):
    x, y = sorted((key(a), key(b)), key=len)
    return x == y or (len(x) >= 40 and x in y) or x[:80] == y[:80]


def fold(rows, same, shown=lambda t: t):
    kept = {}
    order = sorted(((g, p, shown(t)) for g, p, t, *_ in rows if t and t.strip()), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    for g, p, t in order:
        own = kept.setdefault(g, [])
        if not any(same(t, k) for _, k in own):
            own.append((p, t))
    return sorted(((g, p, t) for g, found in kept.items() for p, t in found), key=str)


def collapsed(text):
    return re.sub(r"\s+", " ", text).strip()


def run(spark, how, rows, **options):
    df = spark.createDataFrame([(*r, True) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in how(df, "g", "place", "text", **options).collect()), key=str)


def varied(rng, words, n):
    """Texts of which many are near an earlier one, by chains of small edits."""
    made = []
    for _ in range(n):
        if made and rng.random() < 0.7:
            own = rng.choice(made).split(" ")
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own = [rng.choice(words), *own, rng.choice(words)]
        else:
            own = [rng.choice(words) for _ in range(rng.randint(1, 18))]
        made.append(" ".join(own))
    return made


@pytest.mark.parametrize("front", [2, 64])
@pytest.mark.parametrize("how, same, shown", [(firsts.alike, alike, collapsed), (firsts.told_once, told, lambda t: t)])
def test_equals_the_fold(spark, how, same, shown, front):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("node", "plan", "row", "key", "by", "x") for b in range(9)]
    texts = varied(rng, words, 160)
    rows = [(rng.choice(("a", "a", "b", None)), rng.randrange(200), t) for t in texts]
    got = run(spark, how, rows, front=front)
    want = fold(rows, same, shown)
    assert got == want and 0 < len(got) < len({(g, t) for g, _, t in rows})


def test_edges(spark):
    rows = [("a", 1, None), ("a", 2, "  "), ("a", None, "is it"), ("a", 3, "Is  it"), ("a", 3, "ab"), ("a", 3, "ab"), (None, 4, "ab"), ("null", 4, "ab"), ("a", 5, "word " * 5000)]
    assert run(spark, firsts.alike, rows) == fold(rows, alike, collapsed)
    assert run(spark, firsts.told_once, rows) == fold(rows, told)
    for how in (firsts.alike, firsts.told_once):
        assert run(spark, how, []) == []


def test_a_text_of_another_is_told_again_wherever_it_stands(spark):
    short = "the plan keeps every row that no other row repeats"
    rows = [("a", 1, f"At last: {short}, we said."), ("a", 2, short), ("a", 3, short[:39]), ("b", 1, short), ("b", 2, f"At last: {short}, we said.")]
    assert run(spark, firsts.told_once, rows) == [("a", 1, rows[0][2]), ("a", 3, short[:39]), ("b", 1, short)]


def test_one_large_group(spark):
    """A group of 50,000 distinct items: 500 statements told 100 times each, with other endings."""
    rng = random.Random(3)
    said = [" ".join(f"w{rng.randrange(4000):04d}" for _ in range(14)) for _ in range(500)]
    rows = [("a", i, f"{said[i % 500]} e{i:06d} f{i:06d}") for i in range(50_000)]
    begun = time.monotonic()
    got = run(spark, firsts.alike, rows)
    assert [p for _, p, _ in sorted(got, key=lambda r: r[1])] == list(range(500))
    assert time.monotonic() - begun < 300


def test_items_that_share_a_few_rare_words_are_not_compared(spark, monkeypatch):
    from threadloom.operators import firsts

    made, plain = {}, firsts._written

    def written(df, name):
        out = plain(df, name)
        made.setdefault(name, []).append((out[0].count(), sorted(out[0].columns)))
        return out

    monkeypatch.setattr(firsts, "_written", written)
    # every two neighbours share a rare word, all share 12 frequent ones; the last repeats the first but for one word
    own = lambda i: [f"own{i}x{k}" for k in range(20)]
    common = [f"common{k}" for k in range(12)]
    texts = [" ".join([*own(i), f"rare{i // 2}", *common]) for i in range(40)] + [" ".join([*own(0)[1:], "rare0", *common])]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "g string, i long, t string")
    kept = firsts.alike(df, "g", "i", "t")
    assert sorted(r.i for r in kept.collect()) == list(range(40))
    assert sum(n for n, _ in made["firsts-pairs"]) == 1
    assert all(c == ["_at", "_bucket", "_id", "_n", "_rank"] for _, c in made["firsts-ranked"])  # numbers only


@pytest.mark.parametrize("driven", [0, 1 << 20])
def test_frequent_words_alone_make_no_buckets(spark, monkeypatch, driven):
    """Texts of frequent words, near copies in chains among them, dealt to many parts in many turns: an item is dealt as a row, whatever its tokens."""
    for name, value in (("LEAST", 50), ("MOST", 50), ("ABREAST", 3), ("DRIVEN", driven)):
        monkeypatch.setattr(firsts, name, value)
    made, plain = {}, firsts._written

    def written(df, name):
        out = plain(df, name)
        made.setdefault(name, []).append(out[0].count())
        return out

    monkeypatch.setattr(firsts, "_written", written)
    rng = random.Random(7)
    words = [f"word{i}" for i in range(300)]
    texts = [rng.sample(words, 120) for _ in range(300)]
    for i in range(240):  # each near the one before, few near those before that
        own = texts[-1] if i % 8 else rng.choice(texts)
        texts.append(own[30:] + rng.sample([w for w in words if w not in own], 30))
    rows = [("a", i, " ".join(t)) for i, t in enumerate(texts)]
    got = run(spark, firsts.alike, rows, front=2)
    assert got == fold(rows, alike, collapsed) and 300 < len(got) < len(rows)
    assert max(made["firsts-ranked"]) <= len(rows) and sum(made["firsts-pairs"]) < 20 * len(rows)
