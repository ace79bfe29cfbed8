"""The whole way from transcripts to texts as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking, embedding, explain, extraction, incremental, quality, ranking, state


@dataclass(frozen=True)
class Options:
    """What a run may vary; nothing is read from the environment."""

    chunking: chunking.Chunking = field(default_factory=chunking.Chunking)
    budget: int | None = None  # chunks to extract; None: a fifth, 3 to 8
    embedder: Callable[[DataFrame], DataFrame] = embedding.hashed
    extractor: extraction.Extractor = extraction.mock


def chunks(transcripts: DataFrame, options: Options = Options()) -> DataFrame:
    """(conv, chunk_index, chunk, ...) of transcripts (conv, conversation, ...)."""
    return chunking.chunk_transcripts(transcripts, "conv", "conversation", options.chunking)


def selected(pieces: DataFrame, options: Options = Options()) -> DataFrame:
    """conv, n, k, strategy and selected of every conversation."""
    vectors = options.embedder(pieces.select("conv", F.col("chunk_index").alias("idx"), "chunk"))
    return ranking.rank(embedding.clustered(vectors, options.budget), options.budget)


def inspect(transcripts: DataFrame, options: Options = Options()) -> DataFrame:
    """Chunk counts, selection and frontier of every conversation; nothing is extracted."""
    ranked = selected(chunks(transcripts, options), options)
    cutoff = F.greatest(F.lit(0), F.col("n") - state.band(F.col("n")))
    out = ranked.withColumn("cutoff", cutoff)
    return out.select("conv", "n", "k", "strategy", "selected", "cuts", "cutoff", F.sequence("cutoff", F.col("n") - 1).alias("frontier"), F.filter("selected", lambda i: i >= F.col("cutoff")).alias("selected_in_frontier"))


def records(transcripts: DataFrame, options: Options = Options()) -> DataFrame:
    """The records of the selected chunks; the choice lies below the extractor."""
    pieces = chunks(transcripts, options)
    picked = selected(pieces, options).select("conv", F.explode("selected").alias("chunk_index"))
    return extraction.extract(pieces.select("conv", "chunk_index", "chunk_total", "chunk"), picked, options.extractor)


def run(transcripts: DataFrame, options: Options = Options()) -> DataFrame:
    """conv with state, briefing, explanation and the platform texts.

    ``transcripts``: conv, conversation, label, archetype.
    """
    rows = state.build(records(transcripts, options), transcripts, keep=("chunks", "label", "archetype"))
    rows = explain.told(rows).drop("chunks", "label", "archetype", "overview", "topics", "learnings", "questions", "takeaways", "status")
    rows = rows.withColumn("briefing", state.briefing())
    return rows.withColumns(state.exports(F.col("briefing"), F.col("project")))


def benchmark(transcripts: DataFrame, options: Options = Options()) -> DataFrame:
    """One row a conversation: counts, words, verdict and issues of its briefing."""
    done = run(transcripts, options).withColumn("_q", quality.briefing_quality(F.col("briefing")))
    return done.select("conv", F.col("project").alias("name"), "n", F.col("_q.words").alias("briefing_words"), F.col("_q.verdict").alias("verdict"), F.col("_q.issues").alias("issues"))


def benchmark_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("runs"), F.count_if(F.col("verdict") == "pass").alias("passed"), F.count_if(F.col("verdict") == "fail").alias("failed"), T.rounded(F.avg("briefing_words"), 2).alias("mean_words"))


def parity(base: DataFrame, other: DataFrame) -> DataFrame:
    """conv with the likeness of two runs' states."""
    b = other.select("conv", *[F.col(c).alias(f"_{c}") for c in ("completed_work", "active_problems", "constraints", "next_action")])
    joined = base.join(b, "conv")
    return joined.select("conv", *[T.rounded(quality.field_jaccard(F.col(c), F.col(f"_{c}")), 4).alias(c) for c in ("completed_work", "active_problems", "constraints")], quality.same_action(F.col("next_action"), F.col("_next_action")).alias("same_action"))


def grown(transcripts: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Transcripts with their last part once more, for runs that measure updates."""
    return transcripts.withColumn("conversation", T.grown(F.col("conversation"), ratio))


def update(transcripts: DataFrame, prior: DataFrame, cache: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, lineage, rejected) of transcripts that continue ``prior`` (conv, conversation).

    ``cache`` holds earlier records with content_hash and updated_at. Chunks are cut
    and ranked anew over the whole text; a selected chunk whose hash is cached is
    reused, the others are extracted. What is not append-only is rejected.
    """
    texts = lambda df: df.select("conv", T.strip(F.coalesce("conversation", F.lit(""))).alias("text"))
    judged = incremental.growth(texts(prior), texts(transcripts))
    good = transcripts.join(judged.where("append_only").select("conv"), "conv", "left_semi")
    rejected = judged.where("NOT append_only").select("conv", F.lit("not append-only: run it in full").alias("error"))
    pieces = chunks(good, options)
    picked = selected(pieces, options).select("conv", F.explode("selected").alias("chunk_index"))
    wanted = pieces.join(picked, ["conv", "chunk_index"], "left_semi")
    known = cache.withColumn("output", F.lit("cached"))
    looked = incremental.reuse(wanted.select("conv", "chunk_index", "content_hash"), known)
    fresh = extraction.extract(pieces.select("conv", "chunk_index", "chunk_total", "chunk"), looked.where("NOT hit"), options.extractor)
    last = incremental.newest(cache.join(looked.where("hit").select("conv", "chunk_index"), ["conv", "chunk_index"], "left_semi"), ["conv", "chunk_index"], "updated_at")
    return fresh.unionByName(last.select(*fresh.columns)), incremental.lineage(looked), rejected


def events(transcripts: DataFrame, options: Options = Options()) -> DataFrame:
    """The steps of a run as rows (conv, position, type, payload: JSON), as a client would follow them."""
    pieces = chunks(transcripts, options)
    ranked = selected(pieces, options)
    found = extraction.extract(pieces.select("conv", "chunk_index", "chunk_total", "chunk"), ranked.select("conv", F.explode("selected").alias("chunk_index")), options.extractor)
    row = lambda at, kind, payload: (F.lit(at).cast("long").alias("position"), F.lit(kind).alias("type"), F.to_json(payload).alias("payload"))
    sizes = pieces.groupBy("conv").agg(F.count("*").alias("chunk_count"))
    begun = sizes.select("conv", *row(0, "started", F.struct("chunk_count")))
    told = ranked.select("conv", *row(1, "ranked", F.struct("selected", "k", "strategy")))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("chunk_index"))
    done = found.withColumn("_at", place).select("conv", (F.col("_at") + 1).cast("long").alias("position"), F.lit("progress").alias("type"), F.to_json(F.struct(F.col("_at").alias("completed"), "chunk_index", "parse_ok")).alias("payload"))
    late = 1 << 40
    built = ranked.select("conv", *row(late, "building", F.struct(F.col("n").alias("chunk_count"))))
    texts = run(transcripts, options).select("conv", *row(late + 1, "complete", F.struct("briefing", "next_action")))
    return begun.union(told).union(done).union(built).union(texts)
