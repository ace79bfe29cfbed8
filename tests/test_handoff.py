import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import checkpoint, explain, extraction, incremental, quality, state
from threadloom.sources import transcripts as src
from threadloom.streaming import growth

from test_state import SCHEMA, record


def one(spark, column, **values):
    kind = lambda v: "array<string>" if isinstance(v, list) else "double" if isinstance(v, float) else "int" if isinstance(v, int) else "string"
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_explanation(spark):
    rows = [
        record(topic="Topic: parsing of long texts", summary="A summary that is long enough to lead the whole overview", decisions=["Use a hand written parser"], open_questions=["Which encoding is used?"], completed_work=["Learned tokenizers by heart"]),
        record(topic="The slice covers parsing", summary="The slice discusses the final grammar and its remaining conflicts.", active_problems=["Shift reduce conflicts remain."], important_facts=["Grammar has forty rules", "tiny"]),
    ]
    records = spark.createDataFrame([(1, i, *[r[k] for k in extraction.LISTS], *[r[k] for k in extraction.SCALARS]) for i, r in enumerate(rows)], SCHEMA)
    labels = spark.createDataFrame([(1, "notes", "mixed")], "conv long, label string, archetype string")
    r = explain.explain(records, labels).first()
    assert r.topics == ["parsing of long texts", "This section parsing"]
    assert r.learnings == ["tokenizers by heart", "Use a hand written parser"]
    assert r.questions == ["Which encoding is used?", "Unresolved: Shift reduce conflicts remain"]
    assert r.overview == "A summary that is long enough to lead the whole overview (notes)." or r.overview.endswith("(notes).")
    assert "Major thread: parsing of long texts" in r.takeaways and "tiny" not in r.takeaways
    assert [x for x in r.explanation.split("\n") if x.isupper()] == ["OVERVIEW", "MAIN TOPICS", "LEARNINGS / DECISIONS", "CURRENT STATUS", "OPEN QUESTIONS", "KEY TAKEAWAYS"]


def test_rubrics(spark):
    full = "Next Action: x\nCurrent Position: y\nCompleted Work\nActive Problems " + "w " * 80
    assert one(spark, quality.briefing_quality(F.col("t")), t=full).asDict() == {"verdict": "pass", "score": 7, "words": 90, "issues": []}
    short = one(spark, quality.briefing_quality(F.col("t")), t="current position only")
    assert (short.verdict, short.score, short.issues) == ("fail", 2, ["missing next action", "short"])
    assert one(spark, quality.briefing_quality(F.col("t")), t=" ").issues == ["empty"]
    e = one(spark, quality.explain_quality(F.col("t")), t="Overview\nMain topics\n- a\n - b\n- c\nCurrent status\nKey takeaways " + "w " * 80)
    assert (e.verdict, e.score) == ("pass", 6)
    assert one(spark, quality.explain_quality(F.col("t")), t="overview next action continue fetch").score == 0


def test_scores(spark):
    assert one(spark, quality.duplication_rate(F.col("c"), F.col("a")), c=["alpha beta gamma", "other words"], a=["gamma beta alpha"]) == 0.5
    assert one(spark, quality.duplication_rate(F.col("c"), F.col("a")), c=["x"], a=[]) == 0.0
    assert one(spark, quality.next_action_score(F.col("n"), F.col("p")), n="Fix the failing unit tests of the parser", p="") == 5
    assert one(spark, quality.next_action_score(F.col("n"), F.col("p")), n="Why?", p="") == 1
    assert one(spark, quality.active_problems_score(F.col("a")), a=["The learner is lost?"]) == 0
    assert one(spark, quality.active_problems_score(F.col("a")), a=[]) == 2
    assert one(spark, quality.field_jaccard(F.col("a"), F.col("b")), a=["A ", "b"], b=["a"]) == 0.5
    assert one(spark, quality.field_jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 1.0
    assert one(spark, quality.same_action(F.col("a"), F.col("b")), a=" Do it ", b="do IT")
    assert one(spark, quality.incremental_verdict(F.col("s"), F.col("u"), F.col("q"), F.col("r")), s=1.0, u=2.9, q=1.0, r=10.0) == "fail"
    assert one(spark, quality.incremental_verdict(F.col("s"), F.col("u"), F.col("q"), F.col("r")), s=0.4, u=1.0, q=0.95, r=10.0) == "pass"


@pytest.mark.parametrize("path,text,want", [
    ("/x/tutorial/a.txt", "", "tutorial"), ("/x/debugging_2/a.txt", "", "coding"), ("/x/career_talk.txt", "", "journal"), ("/x/my_rfc.md", "", "project"),
    ("/x/a.txt", "a patient with a rash", "medical"), ("/x/a.txt", "nothing", "other"), ("/x/a.txt", "lesson and bug", "tutorial"),
])
def test_archetypes(spark, path, text, want):
    assert one(spark, quality.archetype(F.col("p"), F.col("t")), p=path, t=text) == want


def test_archetype_report(spark):
    rows = [("a", "file", 1, "tutorial", 2, 1, 2, 0.0, "low"), ("a", "cache", 2, "tutorial", 8, 5, 2, 0.5, "high"), ("b", "file", 3, "tutorial", 4, 3, 2, 0.1, "medium")]
    df = spark.createDataFrame(rows, "name string, source string, position int, archetype string, usefulness int, next_action_score int, active_problems_score int, duplication_rate double, tier string")
    r = quality.archetype_report(df).first()
    assert (r.n, r.avg_usefulness, r.pct_high, r.pct_low, r.avg_duplication_rate) == (2, 6.0, 50.0, 0.0, 0.3)
    times = quality.stage_shares(spark.createDataFrame([("a", 30.0), ("b", 60.0), ("a", 10.0)], "stage string, ms double")).collect()
    assert {(r.stage, r.ms, r.share) for r in times} == {("a", 40.0, 40.0), ("b", 60.0, 60.0)}


def test_incremental(spark):
    chunks = spark.createDataFrame([(1, 0, "h0"), (1, 1, "h1"), (1, 2, "h2")], "conv long, chunk_index int, content_hash string")
    cache = spark.createDataFrame([(1, 0, "h0", "old", 1), (1, 0, "h0", "new", 2), (1, 1, "zz", "x", 1)], "conv long, chunk_index int, content_hash string, output string, updated_at int")
    out = incremental.reuse(chunks, cache)
    assert [(r.chunk_index, r.hit, r.output) for r in out.orderBy("chunk_index").collect()] == [(0, True, "new"), (1, False, None), (2, False, None)]
    line = incremental.lineage(out).first()
    assert (line.chunks_reused, line.chunks_extracted) == ([0], [1, 2])
    assert sorted(r.chunk_index for r in incremental.misses(chunks, cache).collect()) == [1, 2]
    old, new = (spark.createDataFrame([(1, a)], "conv long, text string") for a in ("abc", "abc def"))
    g = incremental.growth(old, new).first()
    assert (g.append_only, g.delta, g.chars_added) == (True, "def", 4)
    assert not incremental.growth(new, old).first().append_only
    a, b = (spark.createDataFrame(r, "path string, name string") for r in ([("p", "one")], [("p", "two"), ("q", "three")]))
    assert {(r.path, r.name) for r in incremental.first_per_path([a, b]).collect()} == {("p", "one"), ("q", "three")}


def test_checkpoint_round_trip(spark, tmp_path):
    rows = [record(topic="A parser", objective=["Ship the parser module"], next_steps=["Write the grammar file next"], current_state="The tokenizer is done already.")]
    records = spark.createDataFrame([(1, 0, *[rows[0][k] for k in extraction.LISTS], *[rows[0][k] for k in extraction.SCALARS])], SCHEMA)
    sources = spark.createDataFrame([(1, "the talk", "lbl", "mixed", "/p/a.txt", "2024")], "conv long, conversation string, label string, archetype string, path string, created_at string")
    states = state.build(records, sources).withColumn("briefing", state.briefing()).withColumn("explanation", F.lit("E"))
    df = checkpoint.records(states, sources).drop("conv")
    assert df.select(F.size(checkpoint.issues(F.col("format_version"), F.col("state")))).first()[0] == 0
    assert "cached_exports" not in checkpoint.records(states, sources, tier="minimal").columns
    value = checkpoint.to_json(df).first().value
    assert json.loads(value)["checkpoint"]["state"]["next_action"] == "Write the grammar file next"
    src.write_checkpoints(df, str(tmp_path / "cp"))
    back = spark.read.schema(df.schema).parquet(str(tmp_path / "cp"))
    text = checkpoint.resume(back, "lbl").first().text
    assert text.startswith("## PROJECT\n\nlbl\n")
    blank = back.withColumn("cached_exports", F.col("cached_exports").withField("briefing", F.lit("")))
    assert checkpoint.resume(blank, "lbl").first().text.endswith("Next Action:\nWrite the grammar file next")
    assert checkpoint.resume(back, "none").count() == 0
    assert json.loads(checkpoint.resume(back, "lbl", "state").first().text)["project_title"] == "lbl"
    schema = "project string, format_version int"
    one_ = spark.createDataFrame([(value,), ('{"project": "flat", "objective": []}',)], "value string").select(checkpoint.parse_json(F.col("value"), schema).alias("r"))
    assert [r.r.project for r in one_.collect()] == ["lbl", "flat"]
    flat = spark.createDataFrame([("", ["o"], "c", ["d"], [], [], "n")], "project string, objective array<string>, current_state string, completed_work array<string>, active_problems array<string>, constraints array<string>, next_action string")
    m = checkpoint.from_flat(flat, "2024").first()
    assert m.project == "conversation" and m.state.next_action == "n" and m.migrated and len(m.id) == 8
    assert one(spark, checkpoint.looks_mock(F.col("t"), F.col("b")), t="A Mock goal chunk 1", b="") and one(spark, checkpoint.looks_mock(F.col("t"), F.col("b")), t="", b="MOCK")


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.txt").write_text("  hello \n")
    (tmp_path / "sub" / "a.txt").write_text("one\ntwo")
    (tmp_path / "c.json").write_text(json.dumps({"conversation": "", "body": "from json"}))
    (tmp_path / "d.json").write_text("[1, 2]")
    (tmp_path / "e.txt").write_text(" \n")
    (tmp_path / "f.md").write_text("not read")
    got = {r.label: r.text for r in src.read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {"b": "hello", "a": "one\ntwo", "c": "from json", "d": "[1, 2]"}
    assert [r.label for r in src.read_transcripts(spark, str(tmp_path), limit=3).collect()] == ["b", "a", "c"]
    (tmp_path / "m.json").write_text(json.dumps({"sessions": {"x": {"path": "p", "priority": 2, "category": "k"}, "y": "q"}}))
    m = {r.session: (r.path, r.category, r.priority) for r in src.read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert m == {"x": ("p", "k", 2), "y": ("q", None, None)}
    (tmp_path / "cache.jsonl").write_text('{"id": "Kafka", "transcript": "", "text": "t"}\n{"id": "other", "full_text": "f"}\n')
    cache = src.read_cache(spark, str(tmp_path / "cache.jsonl"))
    found, missing = src.wanted_sessions(cache, spark.createDataFrame([("kafka",), ("gone",)], "id string"))
    assert [(r.id, r.transcript) for r in found.collect()] == [("Kafka", "t")] and [r.id for r in missing.collect()] == ["gone"]
    rows = spark.createDataFrame([(1, 8, "b", 5), (1, 2, "a", 3), (1, 3, " ", 1)], "conv int, chunk_index int, text string, input_chars int")
    assert src.copy_blocks(rows).first().text == "=== CHUNK 3/2 (3 chars) ===\na\n\n=== CHUNK 9/2 (5 chars) ===\nb"
    out = spark.createDataFrame([("l", "claude", "x")], "label string, target string, text string")
    src.write_exports(out, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().file == "l_claude.md"


def test_growth_stream(spark, tmp_path):
    schema = "conv long, version long, text string"
    inbox = tmp_path / "in"
    for i, rows in enumerate(([(1, 0, "a"), (1, 1, "a b"), (2, 0, "x")], [(1, 2, "edited"), (1, 3, "a b\nc"), (2, 0, "x")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(inbox / f"b{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(inbox))
    query = growth.growth(stream).writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = sorted((r.conv, r.version, r.accepted, r.delta) for r in spark.table("grown").collect())
    assert rows == [(1, 0, True, "a"), (1, 1, True, "b"), (1, 2, False, ""), (1, 3, True, "c"), (2, 0, True, "x")]
    assert sum(p["rows"] for p in growth.progress(query)) == 6


def test_event_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "click", 1.0), ("2024-01-01 00:50:00", "click", 2.0), ("2024-01-01 05:00:00", "view", 3.0), ("2024-01-02 05:00:00", "view", 4.0)]
    spark.createDataFrame(rows, "t string, event_type string, value double").selectExpr("CAST(t AS timestamp) ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    query = growth.event_counts(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("counted").collect()) == [("click", 2, 3.0), ("view", 1, 3.0)]
