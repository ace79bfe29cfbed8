"""Versioned checkpoint records: building, checking, moving older ones up, and reading them back."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import state as S

if TYPE_CHECKING:
    from ..sources.store import Store
    from . import pipeline

FORMAT_VERSION = 2
#: Marks of texts that the mock backend wrote.
MOCK_MARKS = ("mock conversation topic", "mock goal chunk", "mock summary for chunk")


def state_block() -> Column:
    names = ("project_title", "objective", "current_state", "completed_work", "active_problems", "constraints", "next_action")
    return F.struct(*names, F.lit(False).alias("closure_detected"))


def records(states: DataFrame, sources: DataFrame, tier: str = "full") -> DataFrame:
    """One record a conversation, as columns of the nested record.

    ``states``: rows of ``state.build`` with briefing and explanation. ``sources``:
    conv, conversation, path, created_at, archetype. The minimal tier has neither
    exports nor statistics.
    """
    rows = states.join(sources.select("conv", "conversation", "path", "created_at", F.coalesce("archetype", F.lit("mixed")).alias("archetype")), "conv")
    project = F.when(F.col("project") == "", F.lit("conversation")).otherwise(F.col("project"))
    sha = T.transcript_hash(F.col("conversation"))
    out = rows.withColumn("_project", project).withColumn("_sha", sha)
    source = F.struct(
        F.lit("file").alias("kind"), F.col("path"), F.lit("unknown").alias("platform"), F.col("conv").cast("string").alias("conversation_id"), F.col("_sha").alias("sha256"),
        F.length("conversation").cast("long").alias("char_count"), F.lit(0).alias("message_count"), F.col("conversation").alias("transcript_snapshot"),
    )
    cached = {"briefing": T.strip(F.col("briefing")), "explain": T.strip(F.col("explanation")), **S.exports(F.col("briefing"), F.col("project"))}
    ratio = F.when(F.length("briefing") > 0, T.rounded(F.length("conversation") / F.length("briefing"), 1)).otherwise(F.lit(0.0))
    stats = F.struct(T.word_count(F.col("briefing")).alias("briefing_words"), T.word_count(F.col("explanation")).alias("explain_words"), ratio.alias("compression_ratio"))
    columns = [
        F.col("conv"), F.lit(FORMAT_VERSION).alias("format_version"), T.checkpoint_id(F.col("_project"), F.col("created_at"), F.col("_sha")).alias("id"),
        F.col("_project").alias("project"), F.col("_project").alias("label"), F.lit("").alias("message"), "created_at", F.col("created_at").alias("updated_at"),
        source.alias("source"), F.struct("archetype").alias("engine"), state_block().alias("state"),
    ]
    if tier in ("standard", "full"):
        columns += [F.struct(*[v.alias(k) for k, v in cached.items()]).alias("cached_exports"), stats.alias("stats")]
    if tier == "full":
        frontier = F.when(F.col("n") > 0, F.sequence("cutoff", F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
        columns.append(F.struct(F.struct(F.col("n").alias("chunk_count")).alias("chunking"), F.struct(F.col("cutoff").alias("cutoff_index"), S.band(F.col("n")).alias("band_size"), frontier.alias("indices")).alias("frontier")).alias("pipeline"))
    return out.select(*columns)


def issues(version: Column, state: Column) -> Column:
    """What keeps a record from being written."""
    say = lambda bad, what: F.when(bad, F.lit(what))
    return F.array_compact(F.array(
        say(F.coalesce(version, F.lit(0)) != FORMAT_VERSION, "unsupported format_version"),
        say(T.blank(state["next_action"]), "missing next_action"),
        say(T.blank(state["current_state"]) & (F.coalesce(F.size(state["completed_work"]), F.lit(0)) <= 0), "missing current_state and completed_work"),
        say(F.coalesce(F.size(state["objective"]), F.lit(0)) <= 0, "missing objective"),
    ))


def from_flat(rows: DataFrame, now: str) -> DataFrame:
    """Version 1 rows (project, objective, ..., next_action) as version 2 records."""
    empty = T.transcript_hash(F.lit(""))
    project = F.coalesce(F.nullif("project", F.lit("")), F.lit("conversation"))
    flat = rows.withColumn("project_title", project)
    return flat.select(
        F.lit(FORMAT_VERSION).alias("format_version"), T.checkpoint_id(project, F.lit(now), empty).alias("id"), project.alias("project"), project.alias("label"),
        F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), state_block().alias("state"), F.lit(True).alias("migrated"),
    )


def to_json(df: DataFrame) -> DataFrame:
    """project and the record as JSON in its envelope."""
    return df.select("project", F.to_json(F.struct(F.struct(*df.columns).alias("checkpoint"))).alias("value"))


def parse_json(value: Column, schema: str) -> Column:
    """The record of a JSON text, with or without envelope; null where it is neither."""
    inside = F.get_json_object(value, "$.checkpoint")
    return F.from_json(F.coalesce(inside, value), schema)


def resume(df: DataFrame, project: str, form: str = "briefing") -> DataFrame:
    """A stored export of one project: the cached text, else a briefing rendered from the state."""
    own = df.where(F.col("project") == project)
    cached = F.nullif(T.strip(F.col(f"cached_exports.{form}")), F.lit("")) if form in ("briefing", "explain", "claude", "chatgpt", "gemini", "markdown") else F.lit(None)
    if form == "state":
        return own.select("project", F.to_json("state").alias("text"))
    text = cached
    if form == "briefing":
        parts = own.select("project", "cached_exports", "state.*").withColumn("objective_display", F.when(F.size("objective") == 1, F.get("objective", F.lit(0))).otherwise(S.bullets(F.col("objective"))))
        return parts.select("project", F.coalesce(cached, S.briefing()).alias("text"))
    return own.select("project", text.alias("text"))


def looked_up(store: Store, project: str, form: str = "briefing") -> DataFrame:
    """``resume`` from a store: one bucket's files are read, no model and no other project."""
    return resume(store.lookup(project), project, form)


def refreshed(store: Store, project: str, version: int, now: str, options: pipeline.Options | None = None, transcripts: DataFrame | None = None) -> DataFrame:
    """Run one stored project anew, append its record as ``version``, and resume with its briefing.

    ``transcripts``: conv and conversation in place of the stored snapshot. A project
    that is not stored, or has neither, gives no rows and writes an empty version.
    """
    from . import pipeline as P

    old = store.lookup(project).select("conv", "label", "created_at", F.col("source.path").alias("path"), F.col("engine.archetype").alias("archetype"), F.col("source.transcript_snapshot").alias("_snap"))
    given = old if transcripts is None else old.join(transcripts.select("conv", F.col("conversation").alias("_given")), "conv", "left")
    text = F.col("_snap") if transcripts is None else F.coalesce("_given", "_snap")
    sources = given.withColumn("conversation", text).where(~T.blank(F.col("conversation"))).drop("_snap", "_given")
    made = records(P.run(sources, options or P.Options()), sources).withColumn("updated_at", F.lit(now)).withColumn("project", F.lit(project))
    store.append(made, version)
    return looked_up(store, project)


def looks_mock(text: Column, backend: Column) -> Column:
    return T.contains_any(F.lower(F.coalesce(text, F.lit(""))), MOCK_MARKS) | (F.lower(F.coalesce(backend, F.lit(""))) == "mock")
