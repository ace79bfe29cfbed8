import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import language, mixing, tokenise

from test_neardup import brute as near_groups
from test_substring import brute as passages_left

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "ing", "er", "st", "on", "an"]) for _ in range(rng.randint(1, 4))) + str(rng.randint(0, 400))
    passage = " ".join(word() for _ in range(70))
    rows = []
    for i in range(70):
        w = [word() for _ in range(rng.randint(1, 160))]
        if i % 9 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        rows.append((i, " ".join(w), rng.choice(["en", "en", None]), rng.choice(["a", "a", "b", None])))
    for i in range(70, 85):
        w = rows[rng.randrange(70)][1].split()
        w[rng.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w), "en", "b"))
    rows += [(85, rows[3][1], "en", "a"), (86, None, "en", "a"), (87, "", None, None), (88, "123 456 !", "en", "a"), (89, " \n\t", "en", "b"), (90, "x", "en", "c")]
    return [(k, t, lang, s, len(t or "")) for k, t, lang, s in rows]


@pytest.fixture(scope="module")
def stages(spark):
    """The output of every stage, each reread by the next, with its input."""
    docs, out = spark.createDataFrame(corpus(7), SCHEMA).withColumn("seq", F.lit("extra")), []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, "unused")
        kept = [r.asDict() for r in rows.collect()]
        out.append((name, [r.asDict() for r in docs.collect()], kept))
        docs = spark.createDataFrame([tuple(r[c] for c in rows.columns) for r in kept], rows.schema)
    return {name: (before, after) for name, before, after in out}


def test_names_and_columns(stages):
    assert list(stages) == ["language_id", "minhash_near_dedup", "substring_dedup", "source_mixing", "byte_bpe"]
    for name, (_, after) in list(stages.items())[:-1]:
        assert set(after[0]) == {"doc_id", "text", "lang", "source", "n_chars"}, name


def test_language_rejects_only_what_has_no_letter(stages):
    before, after = stages["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {86, 87, 88, 89}
    assert all(r["lang"] == "en" for r in after)


def test_language_without_a_learnable_label(spark):
    rows = [(k, t, None, s, n) for k, t, _, s, n in corpus(7)]
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "unused").collect()
    assert {r[0] for r in rows} - {r["doc_id"] for r in kept} == {86, 87, 88, 89}
    assert all(r["lang"] is None for r in kept)


def test_language_rejects_what_is_foreign_to_all_learned(spark):
    foreign = "слова другого языка, которых нет ни в одной выборке"
    rows = corpus(7) + [(100, foreign, None, "a", 0), (101, foreign, "en", "a", 0), (102, foreign, "ru", "a", 0), (103, "ж", None, "a", 0)]
    learnt = [r for r in rows if r[0] < 100]
    model = language.fit({"en": [t.encode() for _, t, *_ in learnt if t]})
    kept = language.in_a_language(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert {r[0] for r in rows} - {r["doc_id"] for r in kept} == {86, 87, 88, 89, 100, 101}
    stage = corpus_pipeline.identify_language(spark, spark.createDataFrame(learnt + rows[-4:-3], SCHEMA), "unused")
    assert 100 not in {r["doc_id"] for r in stage.collect()}


def test_near_duplicates_as_brute_force(stages):
    before, after = stages["minhash_near_dedup"]
    want = [k for k, _, _, kept in near_groups([(r["doc_id"], r["text"]) for r in before], 5, 80) if kept]
    assert sorted(r["doc_id"] for r in after) == sorted(want)
    assert len(after) < len(before)


def test_passages_as_brute_force(stages):
    before, after = stages["substring_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before]
    want = {k: (removed, sha) for k, n, removed, sha in passages_left(rows, 50) if n > removed}
    got = {r["doc_id"]: r["text"] for r in after}
    assert set(got) == set(want) and any(removed for removed, _ in want.values())
    texts = dict(rows)
    for k, (removed, sha) in want.items():
        assert hashlib.sha256(b" ".join(got[k].encode().split())).hexdigest() == sha
        assert removed or got[k] == texts[k]
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_mixing_meets_targets(stages):
    before, after = stages["source_mixing"]
    size = lambda t: len(t.encode().split())
    sums, taken, longest = defaultdict(int), Counter(), defaultdict(int)
    for r in before:
        sums[r["source"]] += size(r["text"])
        longest[r["source"]] = max(longest[r["source"]], size(r["text"]))
    for r in after:
        taken[r["source"]] += size(r["text"])
    for s, target in mixing.targets(list(sums.items())).items():
        assert abs(taken[s] - target) <= longest[s] / 2
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}


def test_mixing_draws_by_the_quality_of_labels(spark, tmp_path):
    rows = [(i, "a b c d", "en", "z", 7) for i in range(1000)] + [(i, "a", "en", "a", 1) for i in range(1000, 4000)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(1000)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = {}
    for sf_dir in ("unused", str(tmp_path)):
        taken = [r["doc_id"] % 2 for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).where("source = 'z'").collect()]
        odd[sf_dir] = sum(taken) / len(taken)
    assert 0.4 < odd["unused"] < 0.6 and odd[str(tmp_path)] > 0.7


def test_tokens_as_the_library(stages):
    before, after = stages["byte_bpe"]
    coder = tokenise.bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    want = sorted((r["doc_id"], library.encode_ordinary(r["text"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in before)
    assert sorted((r["doc_id"], np.asarray(r["ids"]).tolist(), r["decoded_sha256"]) for r in after) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in after)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
        assert docs.count() == 0


def test_run_reads_the_table(spark, tmp_path):
    spark.createDataFrame(corpus(3)[:12], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
