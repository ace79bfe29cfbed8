"""Streamed updates, mergeable partial states and the versioned store."""

import random
import time

import pytest
from pyspark.sql import functions as F

from threadloom.operators import checkpoint, partial, state
from threadloom.plans import growing
from threadloom.sources.store import Store
from threadloom.streaming import updates as stream


def pieces(*chunks):
    return [(i, c) for i, c in enumerate(chunks)]


def snapshot(conv, version, *chunks):
    return conv, version, "\n\n".join(chunks), pieces(*chunks)


@pytest.fixture
def feed(spark, tmp_path):
    """Adds snapshots to a folder and runs the stream over what is new; its rows so far."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def answer(chunk, place, total, calls=str(calls)):
        with open(f"{calls}/{time.monotonic_ns()}", "w") as f:
            f.write(chunk)
        return chunk.upper()

    def run(rows, name="s", initial=None, idle_ms=None, trigger=None):
        if rows:
            spark.createDataFrame(rows, growing.SNAPSHOTS).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        arrived = spark.readStream.schema(growing.SNAPSHOTS).parquet(f"{tmp_path}/{name}/in")
        with stream.rocks_db(spark):
            query = stream.updates(arrived, answer, initial, idle_ms).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}/checkpoint")
            query = query.trigger(**(trigger or {"availableNow": True})).start(f"{tmp_path}/{name}/out")
            if trigger:
                return query
            query.awaitTermination()
        out = spark.read.schema(stream.UPDATES).parquet(f"{tmp_path}/{name}/out")
        return sorted((r["conv"], r["version"], r["kind"], r["place"], r["record"]) for r in out.collect()), len(list(calls.iterdir()))

    run.out = lambda name="s": spark.read.schema(stream.UPDATES).parquet(f"{tmp_path}/{name}/out")
    return run


def test_only_new_chunks_are_extracted_across_restarts_and_replays(feed):
    rows, calls = feed([snapshot(1, 1, "a", "b")])
    assert rows == [(1, 1, "extracted", 0, "A"), (1, 1, "extracted", 1, "B")] and calls == 2
    # a new run on the same checkpoint: the state is still there; a replay and an edit extract nothing
    rows, calls = feed([snapshot(1, 2, "a", "b", "c"), snapshot(1, 1, "a", "b"), snapshot(1, 3, "x", "b", "c", "d"), (2, 1, None, None), (None, 1, "a", []), (3, None, "a", [])])
    assert [r for r in rows if r[1:3] != (1, "extracted")] == [(1, 2, "extracted", 2, "C"), (1, 2, "reused", 0, "A"), (1, 2, "reused", 1, "B"), (1, 3, "rejected", None, None), (2, 1, "rejected", None, None)]
    assert calls == 3
    again, calls = feed([snapshot(1, 2, "a", "b", "c"), snapshot(1, 3, "x", "b", "c", "d")])
    assert again == rows and calls == 3
    # a chunk whose end moved is another chunk, and a place that is no longer named is dropped
    rows, calls = feed([(1, 4, "a\n\nb\n\nc d", pieces("a", "b\n\nc d")), (1, 5, "a\n\nb\n\nc d e", pieces("a", "b\n\nc d", "e"))])
    assert [r for r in rows if r[1] > 3] == [(1, 4, "extracted", 1, "B\n\nC D"), (1, 4, "reused", 0, "A"), (1, 5, "extracted", 2, "E"), (1, 5, "reused", 0, "A"), (1, 5, "reused", 1, "B\n\nC D")]
    assert calls == 5


def test_a_new_stream_starts_from_stored_rows(feed):
    feed([snapshot(1, 1, "a", "b"), snapshot(2, 1, "z")])
    feed([snapshot(1, 2, "a", "b", "c"), snapshot(1, 3, "other")])
    kept = stream.initial_state(feed.out())
    assert sorted((r["conv"], r["version"], r["place"], r["record"]) for r in kept.collect()) == [(1, 3, 0, "A"), (1, 3, 1, "B"), (1, 3, 2, "C"), (2, 1, 0, "Z")]
    rows, calls = feed([snapshot(1, 3, "a"), snapshot(1, 4, "a", "b", "c", "d"), snapshot(2, 2, "y z"), snapshot(3, 1, "q")], name="t", initial=kept)
    assert rows == [(1, 4, "extracted", 3, "D"), (1, 4, "reused", 0, "A"), (1, 4, "reused", 1, "B"), (1, 4, "reused", 2, "C"), (2, 2, "rejected", None, None), (3, 1, "extracted", 0, "Q")]
    assert calls == 4 + 2


def test_idle_conversations_leave_the_state(feed):
    query = feed([snapshot(1, 1, "a")], idle_ms=1500, trigger={"processingTime": "500 milliseconds"})
    try:
        until = time.monotonic() + 60
        kinds = []
        while "expired" not in kinds and time.monotonic() < until:
            time.sleep(1)
            kinds = [r["kind"] for r in feed.out().select("kind").collect()]
        assert sorted(kinds) == ["expired", "extracted"]
    finally:
        query.stop()


TOLD = "conv long, chunk_index int, v long, topic string, summary string, current_state string, continuation_context string, " + ", ".join(f"{n} array<string>" for n in state.LISTS)


def _records(rng, convs=6, most=40):
    facts = [f"Finished the {w} of the {p} module" for w in ("draft", "review", "testing", "layout") for p in ("payment", "search", "profile", "export", "upload")]
    rows = []
    for conv in range(convs):
        for idx in rng.sample(range(most), rng.randint(1, most // 2)):
            pick = lambda: rng.sample(facts, rng.randint(0, 3))
            rows.append((conv, idx, 0, rng.choice(facts), "Said so.", rng.choice(facts), rng.choice(facts), *[pick() for _ in state.LISTS]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_partials_merged_in_any_order_give_the_whole_state(spark, seed):
    rng = random.Random(seed)
    rows = _records(rng)
    stale = [(r[0], r[1], -1, "Older topic of this chunk", "x", "Older state", "Older context", *[["Something that was corrected later"] for _ in state.LISTS]) for r in rows if rng.random() < 0.3]
    labels = spark.createDataFrame([(c, "Some text. Thanks.", f"L{c}", "debugging") for c in range(6)], "conv long, conversation string, label string, archetype string")
    whole = sorted(map(str, state.build(spark.createDataFrame(rows, TOLD), labels).collect()))
    parts = [[] for _ in range(4)]
    for r in rows + stale:
        parts[rng.randrange(4)].append(r)
    tables = [partial.partials(spark.createDataFrame(p, TOLD), "v") for p in parts]
    rng.shuffle(tables)
    a, b, c, d = tables
    merged = partial.merge(partial.merge(d, b), partial.merge(c, a, d))
    assert sorted(map(str, partial.build(merged, labels).collect())) == whole
    # behind the frontier only the history is kept
    behind = merged.select("n", F.explode("parts").alias("p")).where(F.col("p.idx") < F.greatest(F.lit(0), F.col("n") - state.band(F.col("n"))))
    assert behind.where(F.size("p.goals") + F.size("p.active_problems") + F.length("p.current_state") > 0).count() == 0 < behind.where(F.size("p.completed_work") > 0).count()


def test_an_update_touches_the_conversations_of_its_delta(spark):
    rows = _records(random.Random(3))
    kept = partial.partials(spark.createDataFrame(rows, TOLD), "v")
    new = (2, 60, 1, "A topic that is new", "s", "Now here", "Next there", *[["Finished the last part of all"] for _ in state.LISTS])
    changed = partial.merge_into(kept, partial.partials(spark.createDataFrame([new], TOLD), "v"))
    assert [(r["conv"], r["n"]) for r in changed.collect()] == [(2, 61)]
    want = partial.merge(kept, partial.partials(spark.createDataFrame([new], TOLD), "v")).where("conv = 2")
    assert changed.collect() == want.collect()
    assert partial.merge(kept.limit(0)).count() == 0


def _store(spark, tmp_path, buckets=8):
    return Store(spark, str(tmp_path / "store"), "project string, value string", buckets=buckets)


def test_many_projects_in_few_files_and_one_bucket_a_lookup(spark, tmp_path):
    store = _store(spark, tmp_path)
    rows = spark.range(100_000).select(F.concat(F.lit("p"), "id").alias("project"), F.col("id").cast("string").alias("value"))
    store.append(rows, 1)
    store.append(rows.where("value % 2 = 0").withColumn("value", F.lit("two")), 2)
    files = [p for p in (tmp_path / "store").rglob("*.parquet")]
    assert len(files) == 16
    found = store.lookup("p77")
    assert [tuple(r) for r in found.collect()] == [("p77", "77", 1)]
    assert len(store._read(store.bucket_of("p77")).inputFiles()) == 2  # one a version
    assert store.lookup("none").count() == 0
    assert store.compact() == 2 and store.compact() is None
    assert store.vacuum() == 2 and len(store._read(store.bucket_of("p77")).inputFiles()) == 1
    assert store.view().groupBy("version").count().orderBy("version").collect() == [(1, 50_000), (2, 50_000)]


def test_versions_replays_deletions_and_broken_writes(spark, tmp_path):
    store = _store(spark, tmp_path)
    make = lambda *rows: spark.createDataFrame(list(rows), "project string, value string, extra int")
    view = lambda at=None: sorted(map(tuple, store.view(at).collect()))
    assert view() == [] and store.lookup("a").count() == 0 and store.compact() is None
    store.append(make(("a", "1", 0), ("b", "1", 0), (None, "x", 0), ("a", "0", 0)), 1)
    store.append(make(("b", "2", 0)), 2)
    assert view() == [("a", "1", 1), ("b", "2", 2)] and view(1) == [("a", "1", 1), ("b", "1", 1)]
    for _ in range(2):  # a version that is written again replaces itself
        store.append(make(("c", "2", 0)), 2)
        assert view() == [("a", "1", 1), ("b", "1", 1), ("c", "2", 2)]
    store.append(make(("a", "gone", 0)), 3, deleted=F.lit(True))
    assert view() == [("b", "1", 1), ("c", "2", 2)] and store.lookup("a").count() == 0
    store.append(make(("z", "9", 0)), 9)
    (tmp_path / "store/log/version=9/_SUCCESS").unlink()  # a write that did not end
    assert store.versions() == [1, 2, 3] and view() == [("b", "1", 1), ("c", "2", 2)]
    store.compact()
    with pytest.raises(ValueError, match="below the base"):
        store.view(2)
    store.append(make(("a", "back", 0)), 4)
    assert view() == [("a", "back", 4), ("b", "1", 1), ("c", "2", 2)]
    assert store.vacuum() == 3 and view() == [("a", "back", 4), ("b", "1", 1), ("c", "2", 2)]


def test_resume_with_refresh(spark, tmp_path):
    sources = spark.createDataFrame([(i, "User: how do I fix the parser?\n\nAssistant: rewrite the lexer. " * 3, f"proj {i}", "debugging", "", "2024-01-01T00:00:00+00:00") for i in range(3)], "conv long, conversation string, label string, archetype string, path string, created_at string")
    from threadloom.operators import pipeline

    made = checkpoint.records(pipeline.run(sources), sources)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)
    store = Store(spark, str(tmp_path / "records"), schema, buckets=4)
    store.append(made, 1)
    before = checkpoint.looked_up(store, "proj 1").first()["text"]
    assert before and checkpoint.looked_up(store, "proj 1", "claude").first()["text"].startswith("Continue this conversation")
    longer = spark.createDataFrame([(1, "User: and now the printer?\n\nAssistant: begin with its tests. " * 5)], "conv long, conversation string")
    after = checkpoint.refreshed(store, "proj 1", 2, "2024-05-05T00:00:00+00:00", transcripts=longer).collect()
    assert len(after) == 1 and after[0]["text"]
    row = store.lookup("proj 1").first()
    assert row["version"] == 2 and row["updated_at"].startswith("2024-05") and "printer" in row["source"]["transcript_snapshot"]
    assert checkpoint.refreshed(store, "no such project", 3, "2024-05-05T00:00:00+00:00").count() == 0
    assert store.view().count() == 3


def test_a_task_writes_one_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), "project string, text string", buckets=16)
    store.append(spark.range(500).selectExpr("concat('p', id) AS project", "'x' AS text"), 1)
    files = [f for f in (tmp_path / "store").rglob("part-*.parquet")]
    assert len(files) == 16 and len({f.name.split("-")[1] for f in files}) == 16
    assert store.view().count() == 500
