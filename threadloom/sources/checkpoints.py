"""Checkpoint files and stores: reading any version, choosing among places, and session artifacts."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checkpoint, handoff, incremental, quality
from .store import Store

#: What is read of a record; further fields stay in ``raw``.
RECORD = (
    "format_version int, id string, project string, label string, created_at string, updated_at string, "
    "source struct<kind:string,path:string,sha256:string,char_count:bigint,transcript_snapshot:string>, engine struct<archetype:string,extractor_backend:string>, "
    "state struct<project_title:string,objective:array<string>,current_state:string,completed_work:array<string>,active_problems:array<string>,constraints:array<string>,next_action:string>, "
    "cached_exports struct<briefing:string,explain:string,claude:string,chatgpt:string,gemini:string,markdown:string>"
)
FLAT = "project string, objective array<string>, current_state string, completed_work array<string>, active_problems array<string>, constraints array<string>, next_action string"


def _yaml_to_json(value: Column) -> Column:
    """The edge where YAML comes in; everything behind it is JSON."""

    def one(text: str | None) -> str | None:
        import yaml

        if not text:
            return "null"
        try:
            return json.dumps(yaml.safe_load(text), default=str)
        except yaml.YAMLError:
            return None

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(one)

    return convert(value)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, raw, record, migrated, issues) of the checkpoint files below a path.

    JSON and YAML, in the envelope, bare, or flat as in version 1, which is moved
    up. A file that is none of these has a null record and says so in ``issues``.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,yaml,yml}").text(path, wholetext=True)
    return read_rows(files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value")))


def read_rows(rows: DataFrame) -> DataFrame:
    """``read_records`` of rows (file, modified, value), such as the members of packed files."""
    is_json = F.lower("file").endswith(".json")
    # Python sees every row whatever the condition around it says, so JSON goes there as nothing
    raw = F.when(is_json, F.col("value")).otherwise(_yaml_to_json(F.when(is_json, F.lit("")).otherwise(F.col("value"))))
    rows = rows.withColumn("raw", raw).drop("value")
    inside = F.get_json_object("raw", "$.checkpoint")
    is_flat = inside.isNull() & F.get_json_object("raw", "$.project").isNotNull() & F.get_json_object("raw", "$.objective").isNotNull() & F.get_json_object("raw", "$.format_version").isNull()
    old = F.from_json("raw", FLAT)
    title = F.coalesce(F.nullif(old["project"], F.lit("")), F.lit("conversation"))
    none = F.array().cast("array<string>")
    names = ("objective", "completed_work", "active_problems", "constraints")
    lists = {n: F.coalesce(old[n], none) for n in names}
    state = F.to_json(F.struct(title.alias("project_title"), *[lists[n].alias(n) for n in names], F.coalesce(old["current_state"], F.lit("")).alias("current_state"), F.coalesce(old["next_action"], F.lit("")).alias("next_action")))
    moved = F.concat(F.lit('{"format_version":2,"project":'), F.to_json(F.struct(title.alias("p"))), F.lit("}"))
    lifted = F.concat(F.lit('{"format_version":2,"engine":{"archetype":"mixed","extractor_backend":"unknown"},"project":'), F.regexp_extract(moved, r'"p":("(?:[^"\\]|\\.)*")', 1), F.lit(',"label":'), F.regexp_extract(moved, r'"p":("(?:[^"\\]|\\.)*")', 1), F.lit(',"state":'), state, F.lit("}"))
    text = F.when(is_flat, lifted).otherwise(F.coalesce(inside, F.col("raw")))
    out = rows.withColumn("migrated", is_flat).withColumn("record", F.from_json(text, RECORD))
    known = F.coalesce(F.col("record.format_version") == checkpoint.FORMAT_VERSION, F.lit(False))
    issues = F.when(F.col("raw").isNull() | F.col("record").isNull(), F.array(F.lit("unreadable"))).otherwise(checkpoint.issues(F.col("record.format_version"), F.col("record.state")))
    return out.withColumn("issues", issues).withColumn("record", F.when(known, F.col("record")))


def usable(rows: DataFrame) -> DataFrame:
    """Records without issues, or moved up from version 1."""
    return rows.where(F.col("record").isNotNull() & ((F.size("issues") == 0) | F.col("migrated")))


def choose(*places: DataFrame) -> DataFrame:
    """One record a project: from the first place that has a usable one, the newest file there."""
    ranked = [usable(p).withColumn("_place", F.lit(i)) for i, p in enumerate(places)]
    rows = reduce(DataFrame.unionByName, ranked)
    own = Window.partitionBy("record.project").orderBy("_place", F.col("modified").desc(), "file")
    return rows.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r", "_place")


def prior_transcripts(records: DataFrame, sources: DataFrame) -> DataFrame:
    """project and conversation: the snapshot, else the text at the record's path (path, text), else empty."""
    path = F.col("record.source.path")
    rows = records.select(F.col("record.project").alias("project"), F.nullif(T.strip(F.coalesce("record.source.transcript_snapshot", F.lit(""))), F.lit("")).alias("_snap"), F.when(~path.isin("-", "stdin", ""), path).alias("path"))
    texts = incremental.newest(sources.select("path", "text").withColumn("_o", F.lit(0)), ["path"], "_o").drop("_o")
    return rows.join(texts, "path", "left").select("project", F.coalesce("_snap", "text", F.lit("")).alias("conversation"))


def mock_records(records: DataFrame) -> DataFrame:
    """Files whose record stems from the mock backend and should be made anew."""
    return records.where(checkpoint.looks_mock(F.col("record.cached_exports.briefing"), F.col("record.engine.extractor_backend"))).select("file", F.col("record.project").alias("project"))


def artifacts(records: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, summary) of a run: per session the record, its briefing, a prompt for each platform and
    metadata as (session, name, text), and one summary row a session."""
    named = records.join(categories.select("project", "category"), "project", "left").withColumn("category", F.coalesce("category", F.lit("coding")))
    session = T.slug(F.col("project"), "session")
    briefing = F.col("cached_exports.briefing")
    rows = named.withColumn("session", session).withColumn("_q", quality.briefing_quality(briefing)).withColumn("_prompt", handoff.prompt(briefing, F.col("category")))
    record = F.to_json(F.struct(F.struct(*records.columns).alias("checkpoint")))
    meta = F.to_json(F.struct("session", "category", "id", F.length("source.transcript_snapshot").alias("transcript_chars"), T.word_count(briefing).alias("briefing_words"), F.col("_q.verdict").alias("verdict"), F.col("state.next_action").alias("next_action")))
    files = {"checkpoint.json": record, "resume.txt": F.concat(briefing, F.lit("\n")), **{f"{n}_prompt.txt": F.col("_prompt") for n in ("claude", "chatgpt", "gemini")}, "metadata.json": meta}
    made = rows.select("session", F.explode(F.create_map(*[x for n, c in files.items() for x in (F.lit(n), c)])).alias("name", "text"))
    summary = rows.select("session", "category", "id", F.col("_q.verdict").alias("verdict"))
    return made, summary


def write_artifacts(files: DataFrame, path: str) -> None:
    """Files by session and name; a session written again replaces its own."""
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").json(path)


ARTIFACTS = "session string, files array<struct<name:string,text:string>>"


def store_artifacts(files: DataFrame, store: Store, version: int) -> None:
    """Files as a version of a store of ``ARTIFACTS`` with the session as its key: at most as many files as it has buckets
    however many sessions, and a session written again replaces its own."""
    held = F.array_sort(F.collect_list(F.struct("name", "text"))).alias("files")
    store.append(files.where("session IS NOT NULL").groupBy("session").agg(held), version)


def stored_artifacts(store: Store) -> DataFrame:
    """(session, name, text) of every session's newest files."""
    return store.view().select("session", F.inline("files"))


def label_of(path: Column, explicit: Column) -> Column:
    """An explicit label, else the file's stem; none for standard input."""
    from .transcripts import stem

    given = T.strip(F.coalesce(explicit, F.lit("")))
    return F.when(given != "", given).when(path == "-", F.lit("")).otherwise(stem(path))
