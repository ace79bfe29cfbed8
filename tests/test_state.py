import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import voice as V
from threadloom.operators import extraction, state

FULL = {
    "topic": "The participant is building a parser", "summary": "The slice discusses parser states. It works.", "important_facts": ["a fact", "a fact", " b "],
    "objective": ["Ship the parser module"], "completed_work": ["Wrote the tokenizer and its tests"], "active_problems": ["Unicode input breaks the tokenizer"],
    "constraints": ["No third-party packages allowed"], "current_state": "The tokenizer is done. The grammar is half written.", "continuation_context": "The next step is to finish the grammar.",
}


def parsed(spark, *raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r.asDict() for r in extraction.regular(df).orderBy("i").collect()]


def test_json_is_made_regular(spark):
    fence = "Sure!\n```json\n" + json.dumps({"topic": "t", "current_goals": ["g", "g"], "current_blocker": "why?"}) + "\n```"
    comma = '{"topic": "x", "decisions": ["a",], "next_steps": "one step",}'
    out = parsed(spark, json.dumps(FULL), fence, comma, "no json", None, "[1]", '{"topic": "", "summary": " "}')
    assert out[0]["important_facts"] == ["a fact", "b"] and out[0]["parse_ok"] and out[0]["error"] is None
    assert out[1]["goals"] == ["g"] and out[1]["open_questions"] == ["why?"]
    assert out[2]["decisions"] == ["a"] and out[2]["next_steps"] == ["one step"]
    assert [o["parse_ok"] for o in out] == [True, True, True, False, False, False, False]
    assert out[3]["important_facts"] == [] and out[3]["error"]


@pytest.mark.parametrize("cut,items,state_text", [
    ('{"topic": "t \\"q\\"", "summary": "s", "objective": ["one", "two", "thr', ["one", "two"], ""),
    ('{"topic": "t", "summary": "s", "objective": ["one"], "current_state": "half way', ["one"], ""),
    ('{"topic": "t", "summary": "s", "objective": ["a\\nb"], "current_state": "done", "constraints": [', ["a\nb"], "done"),
])
def test_cut_json_keeps_what_is_complete(spark, cut, items, state_text):
    out = parsed(spark, cut)[0]
    assert out["parse_ok"] and out["objective"] == items and out["current_state"] == state_text


def test_cut_before_the_summary_is_lost(spark):
    assert not parsed(spark, '{"topic": "t", "summary": "never clo')[0]["parse_ok"]


def test_mock_extraction(spark):
    chunks = spark.createDataFrame([(7, 0, "aaa"), (7, 1, "bb")], "conv long, chunk_index int, chunk string")
    out = {r.chunk_index: r for r in extraction.extract(chunks).collect()}
    assert out[1].topic == "mock conversation topic (chunk 3/2)" and out[0].goals == ["mock goal chunk 2"] and out[0].input_chars == 3
    some = extraction.extract(chunks, chunks.where("chunk_index = 1"))
    assert [r.chunk_index for r in some.collect()] == [1]


def test_voice(spark):
    t = spark.createDataFrame([("The participant is stuck. The slice was explaining  loops.",)], "t string")
    assert t.select(V.clean_voice(F.col("t"))).first()[0] == "You are stuck. Currently explaining loops."
    n = spark.createDataFrame([("So, next: check the logs. Then you should rest.",)], "t string")
    assert n.select(V.next_from_text(F.col("t"))).first()[0] == "Check the logs. Then you should rest"
    assert n.select(V.next_from_text(F.lit("nothing"))).first()[0] == ""


def record(**values):
    base = {k: [] for k in extraction.LISTS} | {k: "" for k in extraction.SCALARS}
    return base | values


SCHEMA = ", ".join(["conv long, chunk_index int", *[f"{n} array<string>" for n in extraction.LISTS], *[f"{n} string" for n in extraction.SCALARS]])


def build(spark, records, conversation="", label="", archetype="mixed"):
    rows = [(1, i, *[r[k] for k in extraction.LISTS], *[r[k] for k in extraction.SCALARS]) for i, r in enumerate(records)]
    texts = spark.createDataFrame([(1, conversation, label, archetype)], "conv long, conversation string, label string, archetype string")
    out = state.build(spark.createDataFrame(rows, SCHEMA), texts)
    return out.withColumn("briefing", state.briefing()).first()


def test_state_of_one_chunk(spark):
    r = build(spark, [record(**{k: v for k, v in FULL.items() if k != "important_facts"})])
    assert r.project_title == "You are building a parser"
    assert r.current_state == "The tokenizer is done. The grammar is half written. The next step is to finish the grammar."
    assert r.completed_work == ["Wrote the tokenizer and its tests"] and r.active_problems == ["Unicode input breaks the tokenizer"]
    assert r.objective == ["You are building a parser", "Ship the parser module"]
    assert r.next_action == "Ship the parser module"
    assert r.briefing.startswith("## PROJECT\n\nYou are building a parser\n\nObjective:\nYou are building a parser\n- Ship the parser module\n\nCurrent Position:\n")
    assert r.briefing.endswith("Constraints:\n- No third-party packages allowed\n\nNext Action:\nShip the parser module")


def test_history_frontier_and_resolved(spark):
    chunks = [record(topic=f"Topic number {i}", active_problems=[f"Problem number {i} is open"], completed_work=[f"Finished piece {i} of it", "Same piece told every time"]) for i in range(12)]
    chunks[11]["resolved_problems"] = ["Problem number 10 is open"]
    r = build(spark, chunks, label="  My label ")
    assert (r.n, r.cutoff) == (12, 9)
    assert r.active_problems == ["Problem number 9 is open", "Problem number 11 is open"]
    assert len(r.completed_work) == 13 and r.project_title == "My label"
    assert r.objective_display.split("\n") == ["Topic number 11", "- Topic number 0", "- Topic number 1", "- Topic number 2"]
    assert r.next_action == "Address: Problem number 9 is open"
    assert r.current_state == "The session covers Topic number 11."


def test_hints_and_closure(spark):
    r = build(spark, [record(topic="A topic")], conversation="... ok, continue my course from Fetch API. bye")
    assert r.closed and r.next_action == "Continue the course from Fetch API"
    assert r.current_state == "Learner should resume the tutorial from Fetch API (prior lessons through Event Handling are complete)."
    r = build(spark, [record(topic="A topic")], conversation="If you want, I can show you: the second way.\n")
    assert not r.closed and r.next_action == "Pick up from tutor offer: the second way"
    r = build(spark, [record(topic="A topic", active_problems=["What will data contain after the loop?"])], conversation="What will data contain? As this chat is long, continue with fetch")
    assert r.active_problems == []
    r = build(spark, [record()], archetype="research")
    assert r.next_action == state.FALLBACKS["research"] and r.objective_display == state.NO_OBJECTIVE and r.current_state == state.NO_POSITION


def test_exports(spark):
    df = spark.createDataFrame([("b ", "L"), ("b", ""), ("  ", "L")], "t string, l string")
    rows = df.select(*[c.alias(k) for k, c in state.exports(F.col("t"), F.col("l")).items()]).collect()
    assert rows[0].claude.startswith("Continue this conversation (L). Treat") and rows[0].claude.endswith("\n\nb")
    assert rows[1].chatgpt == "# Conversation handoff\n\nPaste into a new ChatGPT thread. Continue from where the prior conversation stopped.\n\nb\n\n---\nPlease continue the conversation from the current position."
    assert rows[0].gemini.startswith("You are picking up an in-progress conversation for: L.\n")
    assert (rows[0].markdown, rows[1].markdown) == ("# AI Handoff — L\n\nb", "b")
    assert set(rows[2]) == {""}


def test_whole_conversation_form(spark):
    chunks = [record(topic=f"Topic number {i}", objective=[f"Objective number {i}"], active_problems=[f"Problem number {i} is open"], resolved_problems=["Problem number 0 is open"] if i == 3 else []) for i in range(4)]
    chunks[3] |= {"current_state": "The grammar is written.", "continuation_context": "The grammar is written. Tests for the lexer come after that"}
    data = [(1, i, *[r[k] for k in extraction.LISTS], *[r[k] for k in extraction.SCALARS]) for i, r in enumerate(chunks)]
    labels = spark.createDataFrame([(1, "", "mixed")], "conv long, label string, archetype string")
    r = state.build_whole(spark.createDataFrame(data, SCHEMA), labels).withColumn("briefing", state.briefing()).first()
    assert r.active_problems == [f"Problem number {i} is open" for i in (1, 2, 3)] and r.project_title == "Topic number 3"
    assert r.objective_display.split("\n")[0] == "- Objective number 0" and r.next_action == "Address: Problem number 3 is open"
    assert "Current Position:\nThe grammar is written. Tests for the lexer come after that" in r.briefing


def test_a_text_is_made_once_however_often_it_is_read(spark):
    plan = lambda column: spark.range(1).select(F.col("id").cast("string").alias("s")).select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    text = F.reverse("s")
    assert plan(V.clean_voice(text)).count("reverse(") == 1
    assert plan(V.next_from_text(text)).count("reverse(") <= 2  # as it is and in lower case
    assert plan(V.position(F.col("s"), F.col("s"), F.col("s"), F.col("s"))).count("aggregate(") == 1
    assert plan(extraction.parse(F.col("s"))).count("parse_json(") <= 1


def test_parity_makes_its_records_once(spark, monkeypatch):
    from threadloom.plans import stores, told

    calls, records = [], told.records
    monkeypatch.setattr(told, "records", lambda *args: calls.append(args) or records(*args))
    assert stores.state_parity(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
