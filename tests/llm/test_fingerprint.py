import hashlib
import random

import pytest
from pyspark.sql import functions as F

from threadloom.llm import fingerprint


def sets(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_estimates_and_edits(docs):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 6, 40, 300, 900]))]
        rows.append((3 * i, " ".join(w)))
        if i % 4 == 0:
            rows.append((3 * i + 1, " ".join(w[:-1] + ["x"])))
    out = {r.doc_id: r for r in fingerprint.fingerprints(docs(rows)).collect()}
    errors = []
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = out[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - jaccard(sets(text), sets(edited)), r.near_next - jaccard(sets(text), sets(after))]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert max(map(abs, errors)) < 0.2
    assert abs(sum(errors) / len(errors)) < 0.02


def test_edge_rows(docs):
    rows = [(None, "null first"), (1, None), (2, ""), (3, "a b"), (4, "a  b\n"), (5, "a b"), (5, "a b"), (9, "\U0001f600é one two three four five")]
    out = fingerprint.fingerprints(docs(rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].fingerprint == by[2].fingerprint == "" and by[1].near_next == 1.0 and by[2].near_next == 0.0
    assert by[3].fingerprint == by[4].fingerprint == by[5].fingerprint and by[3].near_next == 1.0
    # the last row is followed by the first, the row without an id
    text, after = rows[-1][1], "null first"
    half = len(text) // 2
    assert by[9].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    assert fingerprint.fingerprints(docs([])).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 1500])
def test_next_across_buckets(docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 7)
    ids = [i * i for i in range(rows)]
    df = docs([(k, f"t{k}") for k in ids]).select("doc_id", "text", F.lit("f").alias("fingerprint"))
    got = {r.doc_id: r._next_text for r in fingerprint.pair_with_next(df).collect()}
    assert got == {k: f"t{n}" for k, n in zip(ids, ids[1:] + ids[:1])}


@pytest.mark.parametrize("ids", [[*range(300), (1 << 63) - 5], [7] * 200 + [9, 11], [None] * 150 + [3], [(i * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for i in range(400)]])
def test_sparse_and_repeated_ids_are_parted(docs, ids, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 10)
    df = docs([(k, f"t{i}") for i, k in enumerate(ids)]).select("doc_id", "text", F.lit("f").alias("fingerprint"))
    sizes = [r["count"] for r in fingerprint._buckets(df).where("not _ghost").groupBy("_bucket").count().collect()]
    assert max(sizes) < 40 and sum(sizes) == len(ids)
    rows = sorted(df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = [(r.doc_id, r.text, n.text) for r, n in zip(rows, rows[1:] + rows[:1])]
    got = [(r.doc_id, r.text, r._next_text) for r in fingerprint.pair_with_next(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def plain(spark, text):
    """The fingerprint by loops over one table of hashes, as the definition says."""
    h = lambda *x: spark.range(1).select(F.xxhash64(*x)).first()[0]
    words = text.split()
    grams = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    hashes = [h(*[F.lit(w) for w in g]) if len(words) >= 5 else h(F.lit(" ".join(words))) for g in grams]
    bins = [None] * fingerprint.BINS
    for x in hashes:
        b = ((x % (1 << 64)) >> 56) ^ 0x80  # bins in the order of signed numbers
        bins[b] = x if bins[b] is None else min(bins[b], x)
    pairs = [(i, k) for i in range(fingerprint.BINS) for k in range(fingerprint.ATTEMPTS)]
    frame = spark.createDataFrame(pairs, "i int, k int")
    probe = {(r.i, r.k): r.h % fingerprint.BINS for r in frame.select("i", "k", F.xxhash64("i", "k").alias("h")).collect()}
    dense = []
    for i, b in enumerate(bins):
        tries = [bins[probe[i, k]] for k in range(fingerprint.ATTEMPTS)]
        dense.append(b if b is not None else next((t for t in tries if t is not None), None))
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(dense)], "i int, d long").where("d IS NOT NULL")
    digit = {r.i: r.h & 15 for r in frame.select("i", F.xxhash64("d", "i").alias("h")).collect()}
    return "".join(f"{digit[i]:x}" if i in digit else "?" for i in range(fingerprint.BINS))


def test_digits_against_a_plain_densification(docs, spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(n)) for n in (3, 60, 150)]
    got = [r.f for r in fingerprint.with_fingerprint(docs(texts).orderBy("doc_id"), "text", "f").collect()]
    for text, own in zip(texts, got):
        want = plain(spark, text)
        assert len(own) == len(want) and all(a in (b, "?") for a, b in zip(want, own))
        assert len(text.split()) < 5 or want.count("?") < 256 * 0.2


def test_plan_has_no_python(docs):
    plan = fingerprint.fingerprints(docs(["a b c d e f", "g"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
