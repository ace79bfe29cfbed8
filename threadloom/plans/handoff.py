"""Queries of extraction, state, rendering, quality and incremental operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checkpoint, explain, extraction, handoff, incremental, pipeline, quality, recap, sparse, state
from ..session import table
from . import told
from .conversations import turns

def _states(spark: SparkSession, sf_dir: str, explained: bool = False) -> DataFrame:
    rows = state.build(told.records(spark, sf_dir), told.sources(spark, sf_dir), keep=("chunks", "label", "archetype") if explained else ())
    if explained:
        rows = explain.told(rows).drop("chunks", "label", "archetype", "overview", "topics", "learnings", "questions", "takeaways", "status")
    return rows.withColumn("briefing", state.briefing())


def _one(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


def mock_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("conv", F.col("idx").cast("int").alias("chunk_index"), F.col("text").alias("chunk"))
    return extraction.extract(rows).select("conv", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("input_chars").cast("long").alias("input_chars"), "content_hash", "topic", "summary", *map(_one, ("important_facts", "goals", "open_questions", "next_steps")), "parse_ok")


def regular_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from answers that are plain, fenced, embedded, cut, of older names, or no JSON at all."""
    return told.records(spark, sf_dir).select("conv", F.col("chunk_index").cast("long").alias("chunk_index"), *told.SCALARS, *map(_one, told.LISTS), "parse_ok", F.coalesce("error", F.lit("")).alias("error"))


def answer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each raw answer is complete."""
    rows = turns(spark, sf_dir).select("conv", F.col("idx").cast("int").alias("chunk_index"), F.col("text").alias("chunk"))
    return told.cued(rows).select("conv", F.col("chunk_index").cast("long").alias("chunk_index"), extraction.repaired_audit(F.col("raw")).alias("a")).select("conv", "chunk_index", "a.*")


def briefings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir)
    exports = state.exports(F.col("briefing"), F.col("project"))
    return rows.select("conv", "briefing", "next_action", *[v.alias(k) for k, v in exports.items()])


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.explain(told.records(spark, sf_dir), told.sources(spark, sf_dir)).select("conv", "explanation")


def briefing_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir).withColumn("q", quality.briefing_quality(F.col("briefing")))
    return rows.select("conv", F.col("q.verdict").alias("verdict"), F.col("q.score").cast("long").alias("score"), F.col("q.words").cast("long").alias("words"), F.array_join("q.issues", ",").alias("issues"))


def checkpoint_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint.records(_states(spark, sf_dir, explained=True), told.sources(spark, sf_dir))
    cached = [F.sha2(f"cached_exports.{n}", 256).alias(n) for n in ("briefing", "explain", "claude")]
    return rows.select("conv", "id", "project", *cached, F.array_join(F.transform("pipeline.frontier.indices", lambda i: i.cast("string")), ",").alias("frontier"), F.col("stats.explain_words").cast("long").alias("explain_words"), F.col("source.sha256").alias("sha256"), F.col("source.char_count").alias("char_count"), F.col("stats.compression_ratio").alias("compression_ratio"), F.size(checkpoint.issues(F.col("format_version"), F.col("state"))).cast("long").alias("n_issues"))


def state_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.analysed(_states(spark, sf_dir))
    return rows.select("conv", F.col("usefulness").cast("long").alias("usefulness"), "tier", F.col("next_action_score").cast("long").alias("next_action_score"), F.col("active_problems_score").cast("long").alias("active_problems_score"), "duplication_rate")


def extraction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.metrics(told.records(spark, sf_dir)).select("conv", "chunks", "parse_rate", "topic_rate", "goals_rate", "objective_rate")


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recap.merge(told.records(spark, sf_dir))
    return rows.select("conv", F.col("chunks").cast("long").alias("chunks"), "topic", *map(_one, ("goals", "next_steps", "decisions", "important_facts", "open_questions")), "summary", "parse_ok")


def whole_briefings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.build_whole(told.records(spark, sf_dir), told.sources(spark, sf_dir))
    return rows.select("conv", "project_title", "objective_display", "current_state", "next_action")


def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record handed on in each version, all from one evaluation of the record."""
    rows = told.records(spark, sf_dir).withColumn("archetype", told.archetype())
    for version in ("v1", "v2", "v3"):
        rows = handoff.hand_over(rows, version).withColumnRenamed("handoff", f"_{version}")
    texts = F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"_{v}").alias("handoff")) for v in ("v1", "v2", "v3")])
    return rows.select("conv", F.col("chunk_index").cast("long").alias("chunk_index"), F.inline(texts))


def sparse_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sparse.preserve(turns(spark, sf_dir).select("conv", "idx", "text"), told.sources(spark, sf_dir))
    return rows.select("conv", "mode", F.size("chunks").cast("long").alias("n_chunks"), F.array_join("rejected", ",").alias("rejected"))


def continuation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts through the whole way: chunked, embedded, ranked, extracted, told."""
    rows = pipeline.run(told.sources(spark, sf_dir))
    return rows.select("conv", F.col("n").cast("long").alias("n"), "project_title", "next_action", "briefing", "explanation", "claude")


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.inspect(told.sources(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return rows.select("conv", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), "strategy", text("selected"), text("frontier"))


def page_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archetypes by path, else by the whole page."""
    return _archetypes(spark, sf_dir, None)


def page_archetypes_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' first form, in which a page's first 8,000 characters tell."""
    return _archetypes(spark, sf_dir, quality.HEAD)


def _archetypes(spark: SparkSession, sf_dir: str, most: int | None) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", quality.path_archetype(F.col("url")).alias("by_path"), quality.archetype(F.col("url"), F.col("html"), most).alias("archetype"))


def incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks against a cache in which every third is stale and the newest is missing."""
    own = Window.partitionBy("conv")
    rows = turns(spark, sf_dir).withColumn("n", F.count("*").over(own)).select("conv", F.col("idx").alias("chunk_index"), T.content_hash(F.col("text")).alias("content_hash"), "n")
    stale = F.when(F.col("chunk_index") % 3 == 2, F.lit("stale")).otherwise(F.col("content_hash"))
    cache = rows.where("chunk_index < n - 1").select("conv", "chunk_index", stale.alias("content_hash"), F.lit("kept").alias("output"), F.lit(1).alias("updated_at"))
    return incremental.reuse(rows.drop("n"), cache).select("conv", "chunk_index", "content_hash", "hit", "output")


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of every user and type."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return incremental.newest(rows.withColumn("at", F.struct("ts", "event_id")).drop("ts"), ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id", "value")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents by language: counts and shares."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(
        F.count("*").alias("n"), F.count("quality").alias("labelled"), T.rounded(F.avg("quality"), 4).alias("quality_rate"), T.rounded(F.avg("toxic"), 4).alias("toxic_rate"), T.rounded(F.avg("n_chars"), 2).alias("avg_chars")
    )


QUERIES = [mock_extraction, regular_records, answer_audit, briefings, explanations, briefing_rubric, checkpoint_records, state_analysis, extraction_metrics, merged_records, whole_briefings, handoffs, sparse_modes, continuation_runs, inspections, page_archetypes, page_archetypes_head, incremental_reuse, newest_events, quality_report]

# ---- the same results in SQL ----

def _paths() -> str:
    rules = []
    for name, parts, stems in quality.PATHS:
        tests = [f"contains(p, '{x}')" for x in parts] + [f"contains(s, '{x}')" for x in stems]
        rules.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return "CASE " + " ".join(rules) + " ELSE 'other' END"


def _archetypes_sql(text: str) -> str:
    return f"""
WITH a AS (SELECT page_id, lower(url) AS p, regexp_replace(regexp_extract(lower(url), '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS s, lower({text}) AS t FROM pages),
b AS (SELECT *, {_paths()} AS by_path FROM a)
SELECT page_id, by_path, CASE WHEN by_path <> 'other' THEN by_path {' '.join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in quality.CONTENT)} ELSE 'other' END AS archetype FROM b
"""


SQL = {
    "mock_extraction": """
WITH t AS (SELECT conv_id AS conv, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv, i AS chunk_index, length(text) AS input_chars, left(sha256(trim(text)), 16) AS content_hash, 'mock conversation topic (chunk ' || (i + 2) || '/' || n || ')' AS topic,
       'mock summary for chunk ' || (i + 2) || ' of ' || n || '.' AS summary, 'mock fact from chunk ' || (i + 2) AS important_facts, 'mock goal chunk ' || (i + 2) AS goals,
       'mock question chunk ' || (i + 2) AS open_questions, 'mock next step chunk ' || (i + 2) AS next_steps, true AS parse_ok FROM t
""",
    "regular_records": f"""
WITH {told.RECORDS}
SELECT conv, i AS chunk_index, {', '.join(told.SCALARS)}, {', '.join(f"array_to_string({n}, '|') AS {n}" for n in told.LISTS)}, form <> 4 AND (topic <> '' OR summary <> '') AS parse_ok,
       CASE WHEN form <> 4 AND (topic <> '' OR summary <> '') THEN '' ELSE 'no topic or summary' END AS error FROM rec
""",
    "answer_audit": f"""
WITH {told.RECORDS}
SELECT conv, i AS chunk_index, form NOT IN (4, 5) AS topic_complete, form <> 4 AS summary_complete, CASE WHEN form = 4 THEN NULL WHEN form = 3 THEN 'current_state' ELSE 'continuation_context' END AS last_complete, form NOT IN (4, 5) AS repairable FROM rec
""",
    "briefings": f"""
WITH {told.STATES}, t AS (SELECT conv, next_action, trim(briefing) AS briefing, label FROM bf)
SELECT conv, briefing, next_action,
  'Continue this conversation' || CASE WHEN label <> '' THEN ' (' || label || ')' ELSE '' END || '. Treat the briefing below as your only prior context.' || chr(10) || 'Do not summarize for the user — continue naturally from the stopping point.' || chr(10) || chr(10) || briefing AS claude,
  '# Conversation handoff' || CASE WHEN label <> '' THEN ' — ' || label ELSE '' END || chr(10) || chr(10) || 'Paste into a new ChatGPT thread. Continue from where the prior conversation stopped.' || chr(10) || chr(10) || briefing || chr(10) || chr(10) || '---' || chr(10) || 'Please continue the conversation from the current position.' AS chatgpt,
  'You are picking up an in-progress conversation' || CASE WHEN label <> '' THEN ' for: ' || label ELSE '' END || '.' || chr(10) || 'Use this briefing as your context and continue without recapping for a human audience.' || chr(10) || chr(10) || briefing AS gemini,
  CASE WHEN label <> '' THEN '# AI Handoff — ' || label || chr(10) || chr(10) ELSE '' END || briefing AS markdown
FROM t
""",
    "explanations": f"WITH {told.explain_sql()} SELECT conv, explanation FROM ex",
    "briefing_rubric": rf"""
WITH {told.STATES}, w AS (SELECT conv, lower(briefing) AS low, len(regexp_extract_all(briefing, '\S+')) AS words FROM bf),
s AS (SELECT *, CASE WHEN contains(low, 'next action') THEN 2 ELSE 0 END + CASE WHEN contains(low, 'current position') THEN 2 ELSE 0 END + CASE WHEN contains(low, 'completed work') THEN 1 ELSE 0 END + CASE WHEN contains(low, 'active problems') THEN 1 ELSE 0 END + CASE WHEN words >= 80 THEN 1 ELSE 0 END AS score FROM w)
SELECT conv, CASE WHEN score >= 6 AND contains(low, 'next action') THEN 'pass' WHEN score >= 4 THEN 'partial' ELSE 'fail' END AS verdict, score::BIGINT AS score, words,
       concat_ws(',', CASE WHEN NOT contains(low, 'next action') THEN 'missing next action' END, CASE WHEN NOT contains(low, 'current position') THEN 'missing position' END, CASE WHEN words < 60 THEN 'short' END) AS issues FROM s
""",
    "checkpoint_records": rf"""
WITH {told.STATES}, {told.explain_sql().replace(told.RECORDS + ',' + told.SOURCES + ',', '').replace(told.CLEANED + ',', '')},
s AS (SELECT *, CASE WHEN label = '' THEN 'conversation' ELSE label END AS p, sha256(trim(conversation, ' ' || chr(10))) AS sha FROM bf JOIN ex USING (conv))
SELECT conv, left(sha256(p || ':{told.CREATED}:' || sha), 8) AS id, p AS project, sha256(briefing) AS briefing, sha256(explanation) AS explain,
       sha256('Continue this conversation' || CASE WHEN label <> '' THEN ' (' || label || ')' ELSE '' END || '. Treat the briefing below as your only prior context.' || chr(10) || 'Do not summarize for the user — continue naturally from the stopping point.' || chr(10) || chr(10) || briefing) AS claude,
       array_to_string(range(cutoff, n), ',') AS frontier, len(regexp_extract_all(explanation, '\S+')) AS explain_words, sha AS sha256, length(conversation) AS char_count,
       round(length(conversation)::DOUBLE / length(briefing), 1) AS compression_ratio,
       (CASE WHEN trim(next_action) = '' THEN 1 ELSE 0 END + CASE WHEN trim(current_state) = '' AND len(completed_work) = 0 THEN 1 ELSE 0 END + CASE WHEN len(objective) = 0 THEN 1 ELSE 0 END)::BIGINT AS n_issues FROM s
""",
    "state_analysis": f"WITH {told.analysis_sql()}",
    "extraction_metrics": f"""
WITH {told.RECORDS}
SELECT conv, count(*) AS chunks, {', '.join(f'round(count(*) FILTER (WHERE {c})::DOUBLE / count(*), 4) AS {n}_rate' for n, c in (('parse', "form <> 4 AND (topic <> '' OR summary <> '')"), ('topic', "topic <> ''"), ('goals', 'len(goals) > 0'), ('objective', 'len(objective) > 0')))} FROM rec GROUP BY conv
""",
    "merged_records": f"""
WITH {told.merged_sql()}
SELECT conv, n AS chunks, topic, {', '.join(f"array_to_string({n}, '|') AS {n}" for n in ('goals', 'next_steps', 'decisions', 'important_facts', 'open_questions'))}, recap AS summary, parse_ok FROM mg
""",
    "whole_briefings": f"WITH {told.whole_sql()} SELECT * FROM wh",
    "handoffs": f"""
WITH {told.handoff_sql()}
SELECT conv, i AS chunk_index, v AS version, CASE v WHEN 'v1' THEN v1 WHEN 'v2' THEN v2 ELSE v3 END AS handoff FROM ho, (VALUES ('v1'), ('v2'), ('v3')) x(v)
""",
    "sparse_modes": f"WITH {told.sparse_sql()} SELECT conv, mode, n_chunks, rejected FROM sp",
    "inspections": f"""
WITH RECURSIVE {told.SOURCES}, tx AS (SELECT conv, conversation AS t FROM src), {told.chunks_sql('ch', 'tx')},
c AS (SELECT conv, count(*) AS n FROM ch GROUP BY conv)
SELECT conv, n, least(n, greatest(3, least(8, ceil(n / 5.0))))::BIGINT AS k, 'full' AS strategy, array_to_string(range(0, n), ',') AS selected,
       array_to_string(range(greatest(0, n - greatest(2, least(5, ceil(n * 0.2))))::BIGINT, n), ',') AS frontier FROM c
""",
    "page_archetypes": _archetypes_sql("html"),
    "page_archetypes_head": _archetypes_sql("left(html, 8000)"),
    "incremental_reuse": """
WITH t AS (SELECT conv_id AS conv, row_number() OVER w - 1 AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS n, left(sha256(trim(text)), 16) AS content_hash FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv, chunk_index, content_hash, chunk_index < n - 1 AND chunk_index % 3 <> 2 AS hit, CASE WHEN chunk_index < n - 1 AND chunk_index % 3 <> 2 THEN 'kept' END AS output FROM t
""",
    "newest_events": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL",
    "quality_report": """
SELECT lang, count(*) AS n, count(quality) AS labelled, round(avg(quality), 4) AS quality_rate, round(avg(toxic), 4) AS toxic_rate, round(avg(n_chars), 2) AS avg_chars
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""",
}
