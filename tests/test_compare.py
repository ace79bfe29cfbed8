"""Two extractors side by side, runs that measure themselves, and the incremental benchmark."""

import json

import pandas as pd
from pyspark.sql import functions as F

from threadloom.operators import compare, extraction, measured, pipeline


def chunks(spark, n=12):
    return spark.createDataFrame([(i // 6, i % 6, 6, f"chunk number {i} of the text") for i in range(n)], "conv long, chunk_index int, chunk_total int, chunk string")


def telling(marks):
    """An extractor that notes each chunk it sees, and fails on some."""
    def answers(texts: pd.Series) -> pd.Series:
        def one(text):
            n = int(text.split()[2])
            if n % 4 == marks["fails"]:
                return None
            return json.dumps({"topic": "Topic", "summary": f"About {n}", "objective": ["b", "A"] if marks["side"] else ["a", "B"], "goals": [f"goal {n % 2 + marks['side']}"], "decisions": ["x"] if marks["side"] else []})

        return texts.map(one)

    def extract(rows):
        return rows.withColumn("raw", F.pandas_udf(answers, "string")(F.col("chunk")))

    return extract


def test_both_passes_in_one_scan_equal_a_merge_of_two_runs(spark):
    rows = chunks(spark)
    left, right = telling({"side": 0, "fails": 1}), telling({"side": 1, "fails": 2})
    paired = compare.pairs(rows, left, right)
    plan = paired._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    merged = compare.merged(extraction.extract(rows, extractor=left), extraction.extract(rows, extractor=right))
    said = lambda df: sorted(map(str, compare.compared(df).collect()))
    assert said(paired) == said(merged)
    got = {(r["conv"], r["chunk_index"]): (r["outcome"], {f["field"]: (f["verdict"], f["likeness"]) for f in r["fields"]}) for r in compare.compared(merged).collect()}
    assert got[0, 0][0] == "both" and got[0, 1][0] == "right" and got[0, 2][0] == "left"
    assert got[0, 0][1]["objective"] == ("same", 1.0) and got[0, 0][1]["decisions"] == ("right", 0.0) and got[0, 0][1]["goals"] == ("differ", 0.0) and got[0, 0][1]["topic"] == ("same", 1.0)
    assert got[0, 1][1]["objective"] == ("right", 0.0) and got[0, 2][1]["objective"] == ("left", 0.0) and got[0, 0][1]["constraints"] == ("empty", 1.0)
    counts = {r["field"]: r for r in compare.agreement(compare.compared(merged)).collect()}
    assert counts["objective"]["same"] == 6 and counts["goals"]["differ"] == 6 and counts["decisions"]["right"] == 6
    assert sorted(map(tuple, compare.parse_rates(compare.compared(merged)).collect())) == [(0, 6, 4, 5, 0), (1, 6, 5, 4, 0)]


def test_rows_that_one_side_lacks_and_repeats(spark):
    records = extraction.extract(chunks(spark), extractor=telling({"side": 0, "fails": 9}))
    part = records.where("chunk_index < 2 OR conv IS NULL")
    out = compare.compared(compare.merged(records.union(records), part))
    assert {(r["conv"], r["chunk_index"]): r["outcome"] for r in out.collect()} == {(c, i): "both" if i < 2 else "left" for c in range(2) for i in range(6)}
    assert compare.merged(records.limit(0), records.limit(0)).count() == 0


def test_handoffs_of_two_models_as_blocks(spark):
    records = extraction.extract(chunks(spark, 3), extractor=telling({"side": 0, "fails": 1}))
    (row,) = compare.handoff_blocks(records, "v1").collect()
    assert row["text"].startswith("=== CHUNK 1/3 — AI HANDOFF ===\n# AI Handoff Context") and row["text"].count("— AI HANDOFF ===") == 3 and "About 2" in row["text"]


def _transcripts(spark, n=3, words=4000):
    text = lambda c: "\n\n".join(f"Paragraph {i} of {c}: " + f"word{i} " * 60 for i in range(words // 60))
    return spark.createDataFrame([(c, text(c), f"L{c}", "debugging") for c in range(n)], "conv long, conversation string, label string, archetype string")


def test_stages_are_observed_while_they_are_written(spark):
    run = measured.full(_transcripts(spark))
    seen = {r["stage"]: r for r in run.rows(spark).collect()}
    assert list(seen) == ["chunks", "ranked", "records", "texts"] and all(r["ms"] > 0 for r in seen.values())
    pieces = run.tables["chunks"]
    assert seen["chunks"]["rows"] == pieces.count() and seen["chunks"]["measure"] == pieces.agg(F.sum(F.length("chunk"))).first()[0]
    assert seen["ranked"]["rows"] == 3 and seen["records"]["rows"] == seen["ranked"]["measure"] == run.tables["records"].count() == 9
    whole = pipeline.run(_transcripts(spark)).select("conv", "briefing")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, run.tables["texts"].select("conv", "briefing").collect()))
    assert [e["type"] for e in measured.progress(run)] == list(seen)


def test_an_incremental_run_extracts_what_is_new_and_tells_the_same(spark):
    rows, runs, resume = measured.compared(_transcripts(spark, 2), pipeline.Options(budget=1000))
    got = rows.collect()
    assert len(got) == 2 and all(r["quality_ratio"] == 1.0 and r["same_action"] and r["completed_work"] == 1.0 for r in got)
    assert all(0 < r["calls_incremental"] < r["calls_full"] for r in got)
    # the stand-in extractor names the number of chunks, of which a reused record knows the former
    text = lambda c: F.regexp_replace(c, r"(\d+)/\d+|of \d+", "$1")
    same = lambda name: sorted(map(tuple, runs[name].tables["texts"].select("conv", text("briefing"), text("explanation")).collect()))
    assert same("full") == same("incremental")
    told = measured.verdict(runs, rows, resume)
    assert told["quality_ratio"] == 1.0 and told["speedup"] > 0 and told["verdict"] in ("pass", "fail")


def test_an_edited_transcript_is_extracted_in_full(spark):
    base = _transcripts(spark, 2)
    prior = measured.full(base, pipeline.Options(budget=1000))
    edited = base.withColumn("conversation", F.when(F.col("conv") == 0, F.concat(F.lit("Edited. "), "conversation")).otherwise(F.concat("conversation", F.lit("\n\nAnd one more line."))))
    run = measured.update(edited, prior, base, pipeline.Options(budget=1000))
    anew = {r["conv"]: (r["f"], r["n"]) for r in run.tables["records"].groupBy("conv").agg(F.sum("fresh").alias("f"), F.count("*").alias("n")).collect()}
    assert anew[0][0] == anew[0][1] and anew[1][0] == 1


def test_grown_transcripts_are_made_once_and_chunks_cut_once(spark, monkeypatch):
    made, plain = spark.sparkContext.accumulator(0), pipeline.grown

    def grown(transcripts, ratio):
        def seen(texts: pd.Series) -> pd.Series:
            made.add(len(texts))
            return texts

        return plain(transcripts, ratio).withColumn("conversation", F.pandas_udf(seen, "string")("conversation"))

    monkeypatch.setattr(pipeline, "grown", grown)
    rows, _, _ = measured.compared(_transcripts(spark, 2), pipeline.Options(budget=1000))
    assert rows.count() == 2 and made.value == 2
    plan = pipeline.chunks(_transcripts(spark, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("chunk_total") > 0 and not any("aggregate(" in line for line in plan.splitlines() if "Filter" in line)
