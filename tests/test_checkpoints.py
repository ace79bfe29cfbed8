import json

from pyspark.sql import functions as F

from threadloom.operators import extraction
from threadloom.sources import checkpoints as src

STATE = {"project_title": "P", "objective": ["o"], "current_state": "c", "completed_work": [], "active_problems": [], "constraints": [], "next_action": "n"}


def record(project, **more):
    return {"format_version": 2, "id": "x", "project": project, "label": project, "state": STATE, "source": {"path": "/p/a.txt", "transcript_snapshot": " snap "}, "cached_exports": {"briefing": "b"}, **more}


def test_files_of_every_kind(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"checkpoint": record("one")}))
    (tmp_path / "b.yaml").write_text("checkpoint:\n  format_version: 2\n  project: two\n  state:\n    objective: [o]\n    current_state: c\n    next_action: ''\n")
    (tmp_path / "c.yaml").write_text('project: flat "q"\nobjective:\n  - go\ncurrent_state: here\ncompleted_work: []\nactive_problems: []\nconstraints: []\nnext_action: on\n')
    (tmp_path / "d.yaml").write_text("a: [unclosed")
    (tmp_path / "e.json").write_text(json.dumps({"checkpoint": record("old", format_version=1)}))
    rows = {r.file.rsplit("/", 1)[1]: r for r in src.read_records(spark, str(tmp_path)).collect()}
    assert rows["a.json"].record.project == "one" and rows["a.json"].issues == []
    assert rows["b.yaml"].issues == ["missing next_action"] and rows["b.yaml"].record.project == "two"
    assert rows["c.yaml"].migrated and rows["c.yaml"].record.project == 'flat "q"' and rows["c.yaml"].record.state.objective == ["go"]
    assert rows["d.yaml"].record is None and rows["d.yaml"].issues == ["unreadable"]
    assert rows["e.json"].record is None and "unsupported format_version" in rows["e.json"].issues
    assert {r.record.project for r in src.usable(src.read_records(spark, str(tmp_path))).collect()} == {"one", 'flat "q"'}


def test_first_place_wins_and_prior_texts(spark, tmp_path):
    for place, name, more in (("near", "a", {}), ("far", "a", {"label": "far"}), ("far", "b", {"source": {"path": "/p/b.txt"}}), ("far", "c", {"source": {"path": "-"}, "engine": {"extractor_backend": "mock"}})):
        (tmp_path / place).mkdir(exist_ok=True)
        (tmp_path / place / f"{name}.json").write_text(json.dumps({"checkpoint": record(name, **more)}))
    chosen = src.choose(src.read_records(spark, str(tmp_path / "near")), src.read_records(spark, str(tmp_path / "far")))
    assert {(r.record.project, r.record.label) for r in chosen.collect()} == {("a", "a"), ("b", "b"), ("c", "c")}
    texts = spark.createDataFrame([("/p/b.txt", "from file")], "path string, text string")
    assert {(r.project, r.conversation) for r in src.prior_transcripts(chosen, texts).collect()} == {("a", "snap"), ("b", "from file"), ("c", "")}
    assert [r.project for r in src.mock_records(chosen).collect()] == ["c"]


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(2, "id1", "My Talk", ("some text",), ("next action: go",), ("go",))], "format_version int, id string, project string, source struct<transcript_snapshot:string>, cached_exports struct<briefing:string>, state struct<next_action:string>")
    files, summary = src.artifacts(df, spark.createDataFrame([("My Talk", "research")], "project string, category string"))
    got = {r.name: r.text for r in files.collect()}
    assert set(got) == {"checkpoint.json", "resume.txt", "claude_prompt.txt", "chatgpt_prompt.txt", "gemini_prompt.txt", "metadata.json"}
    assert got["claude_prompt.txt"] == got["gemini_prompt.txt"] and "next question or experiment" in got["claude_prompt.txt"]
    assert json.loads(got["metadata.json"])["category"] == "research"
    assert summary.first().session == "my-talk"
    src.write_artifacts(files, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_labels(spark):
    df = spark.createDataFrame([("/a/talk.one.txt", ""), ("-", ""), ("/a/b.txt", " L ")], "p string, l string")
    assert [r[0] for r in df.select(src.label_of(F.col("p"), F.col("l"))).collect()] == ["talk.one", "", "L"]


def test_a_model_as_extractor(spark):
    def generate(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no answer")
        return ['{"topic": "%s", "summary": "s"}' % p.split("\n")[-1] for p in prompts]

    chunks = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "bad one"), (1, 2, "gamma")], "conv long, chunk_index int, chunk string").coalesce(1)
    out = extraction.extract(chunks, extractor=extraction.model_extractor(generate, rules="Rules.\n")).orderBy("chunk_index").collect()
    assert [(r.topic, r.parse_ok) for r in out] == [("alpha", True), ("", False), ("gamma", True)]
    assert out[1].error


def test_audit_of_cut_answers(spark):
    raws = ['{"topic": "t", "summary": "s", "objective": ["a"], "constraints": ["b', '{"topic": "t", "summary": "never', "", None]
    df = spark.createDataFrame([(r,) for r in raws], "r string").select(extraction.repaired_audit(F.col("r")).alias("a"))
    assert [tuple(r.a) for r in df.collect()] == [(True, True, "objective", True), (True, False, "topic", False), (False, False, None, False), (False, False, None, False)]
