"""Runs that measure themselves: every stage is written once and observed while it is written.

The chunks of a run are cut, written and read back; ranking, extraction and
building read what the stage before wrote, so nothing is computed twice, and a lost executor
repeats one stage at most. ``DataFrame.observe`` counts rows and sums within the
writing job itself; no stage is scanned again to be counted. Wall times stand beside
the counts, in columns of their own, as they differ from run to run.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch
from . import explain, extraction, incremental, pipeline, quality, state

STAGES = "stage string, position int, rows long, measure long, ms long"


@dataclass
class Run:
    """What a run wrote, by stage, and what was observed meanwhile."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    stages: list[tuple[str, int, int, int, int]] = field(default_factory=list)

    def step(self, name: str, df: DataFrame, measure: Column) -> DataFrame:
        """Write a stage; ``measure`` is summed over its rows."""
        spark, seen = df.sparkSession, Observation(name)
        path = scratch(spark, name)
        began = time.monotonic()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(measure), F.lit(0)).cast("long").alias("measure")).write.parquet(path)
        found = seen.get
        self.stages.append((name, len(self.stages), found["rows"], found["measure"], int((time.monotonic() - began) * 1000) + 1))
        self.tables[name] = spark.read.schema(df.schema).parquet(path)
        return self.tables[name]

    def rows(self, spark) -> DataFrame:
        """One row a stage: rows written, what was summed over them, milliseconds."""
        return spark.createDataFrame(self.stages, STAGES)

    @property
    def seconds(self) -> float:
        return sum(s[-1] for s in self.stages) / 1000


def _texts(run: Run, records: DataFrame, transcripts: DataFrame) -> Run:
    rows = state.build(records, transcripts, keep=("chunks", "label", "archetype"))
    rows = explain.told(rows).drop("chunks", "label", "archetype", "overview", "topics", "learnings", "questions", "takeaways", "status")
    run.step("texts", rows.withColumn("briefing", state.briefing()), T.word_count(F.col("briefing")))
    return run


def full(transcripts: DataFrame, options: pipeline.Options = pipeline.Options(), texts: bool = True) -> Run:
    """chunks (measure: characters), ranked (chosen chunks), records (parsed ones) and, if wanted, texts (words of briefings)."""
    run = Run()
    pieces = run.step("chunks", pipeline.chunks(transcripts, options), F.length("chunk"))
    ranked = run.step("ranked", pipeline.selected(pieces, options), F.size("selected"))
    picked = ranked.select("conv", F.explode("selected").alias("chunk_index"))
    records = run.step("records", extraction.extract(pieces.select("conv", "chunk_index", "chunk_total", "chunk"), picked, options.extractor), F.col("parse_ok").cast("int"))
    return _texts(run, records, transcripts) if texts else run


def update(transcripts: DataFrame, prior: Run, prior_texts: DataFrame, options: pipeline.Options = pipeline.Options()) -> Run:
    """A run that takes what ``prior`` extracted: chunks, ranked, reuse (measure: chunks reused), records (extracted anew), texts.

    Transcripts that do not continue ``prior_texts`` (conv, conversation) are run in full within it.
    """
    run = Run()
    texts = lambda df: df.select("conv", T.strip(F.coalesce("conversation", F.lit(""))).alias("text"))
    good = incremental.growth(texts(prior_texts), texts(transcripts)).where("append_only").select("conv")
    pieces = run.step("chunks", pipeline.chunks(transcripts, options), F.length("chunk"))
    ranked = run.step("ranked", pipeline.selected(pieces, options), F.size("selected"))
    wanted = pieces.join(ranked.select("conv", F.explode("selected").alias("chunk_index")), ["conv", "chunk_index"], "left_semi")
    cache = prior.tables["records"].join(good, "conv", "left_semi").withColumn("updated_at", F.lit(0))
    looked = run.step("reuse", incremental.reuse(wanted.select("conv", "chunk_index", "content_hash"), cache.withColumn("output", F.lit("cached"))), F.col("hit").cast("int"))
    fresh = extraction.extract(pieces.select("conv", "chunk_index", "chunk_total", "chunk"), looked.where("NOT hit"), options.extractor).withColumn("fresh", F.lit(1))
    old = cache.join(looked.where("hit").select("conv", "chunk_index"), ["conv", "chunk_index"], "left_semi").drop("updated_at").withColumn("fresh", F.lit(0))
    records = run.step("records", fresh.unionByName(old), F.col("fresh"))
    return _texts(run, records.drop("fresh"), transcripts)


def compared(transcripts: DataFrame, options: pipeline.Options = pipeline.Options(), ratio: float = 0.2) -> tuple[DataFrame, dict[str, Run], float]:
    """(rows, runs, resume seconds): base, full and incremental runs of transcripts that grow by ``ratio``.

    Rows: conv, calls_full, calls_incremental, quality_ratio, parity of three fields and same_action.
    """
    path = scratch(transcripts.sparkSession, "grown")  # read by several plans
    grown = pipeline.grown(transcripts, ratio)
    grown.write.parquet(path)
    grown = transcripts.sparkSession.read.schema(grown.schema).parquet(path)
    runs = {"base": full(transcripts, options, texts=False), "full": full(grown, options)}
    runs["incremental"] = update(grown, runs["base"], transcripts, options)
    one, other = runs["full"].tables["texts"], runs["incremental"].tables["texts"]
    score = lambda df, name: df.select("conv", quality.briefing_quality(F.col("briefing"))["score"].alias(name))
    calls = runs["full"].tables["records"].groupBy("conv").agg(F.count("*").alias("calls_full"))
    anew = runs["incremental"].tables["records"].groupBy("conv").agg(F.sum("fresh").cast("long").alias("calls_incremental"))
    ratio_ = F.when(F.col("_f") > 0, T.rounded(F.col("_i") / F.col("_f"), 3)).otherwise(F.lit(1.0))
    rows = pipeline.parity(one, other).join(score(one, "_f"), "conv").join(score(other, "_i"), "conv").join(calls, "conv").join(anew, "conv")
    began = time.monotonic()
    first = other.select("conv", "briefing").limit(1).collect()
    resume = time.monotonic() - began if first else 0.0
    return rows.withColumn("quality_ratio", ratio_).drop("_f", "_i"), runs, resume


def verdict(runs: dict[str, Run], rows: DataFrame, resume_s: float) -> dict:
    """The gates over a whole comparison: speed-up, least quality ratio and resume time."""
    worst = rows.agg(F.min("quality_ratio")).first()[0]
    speedup = runs["full"].seconds / max(runs["incremental"].seconds, 0.001)
    slow = runs["full"].seconds > 0.5 and speedup < 3.0
    passed = not slow and (worst is None or worst >= 0.95) and resume_s < 0.5
    return {"full_seconds": runs["full"].seconds, "incremental_seconds": runs["incremental"].seconds, "speedup": round(speedup, 2), "quality_ratio": worst, "resume_ms": round(resume_s * 1000, 1), "verdict": "pass" if passed else "fail"}


def progress(run: Run) -> Iterator[dict]:
    """The stages of a run as events, in order."""
    for name, position, rows, measure, ms in run.stages:
        yield {"position": position, "type": name, "rows": rows, "measure": measure, "ms": ms}
