"""Saliency with a memory of what was kept, and the choice to merge the chunks of thin conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import saliency as S
from ..functions import text as T
from . import chunking, selection

# The pattern of issue threads and the thresholds.
ISSUE = r"(?i)\b(github|issue|disabled|jquery|reproduc|expected|actual|steps to|bug\b|focus event)\b"
MAX_CHARS, MAX_CHUNKS, MAX_SPREAD, MAX_EVOLUTION, TWO_CHARS = 5500, 6, 0.20, 0.42, 4000


def retained_scores(rows: DataFrame) -> DataFrame:
    """conv and scores: saliency of each chunk of (conv, idx, text) in order, where the last four
    chunks that scored 0.42 and more count as known.

    What a chunk's own text decides is computed on chunk rows; the fold over a
    conversation holds the kept texts only.
    """
    own = selection.scores(rows)
    fixed = (
        0.16 * F.col("unresolved_pressure") + 0.14 * F.col("reasoning_shift") + 0.12 * F.col("architecture") + 0.08 * F.col("failure") + 0.08 * F.col("operational")
        + 0.10 * F.col("conceptual_gravity") + 0.10 * F.col("transition") + 0.06 * F.col("constraint_binding")
    )
    item = F.struct("idx", F.col("text").alias("text"), T.token_set(F.col("text")).alias("tok"), F.col("overlap_recent").alias("near"), F.col("trajectory_delta").alias("moved"), fixed.alias("fixed"), "failure", "operational", "reasoning_shift", "transition")
    grouped = own.groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<double>").alias("scores"))

    def step(acc: Column, c: Column) -> Column:
        known = T.jaccard(c["tok"], T.token_set(F.array_join(acc["kept"], "\n")))
        most = F.greatest(c["near"], known)
        score = S.clamp01(0.18 * c["moved"] + 0.10 * T.rounded(S.clamp(1.0 - most), 4) - 0.08 * T.rounded(S.clamp(most), 4) + c["fixed"])
        kept = F.when(score >= S.RETAIN, F.slice(F.concat(acc["kept"], F.array(c["text"])), F.greatest(F.lit(1), F.size(acc["kept"]) - 2), F.lit(4))).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), F.concat(acc["scores"], F.array(score)).alias("scores"))

    return grouped.select("conv", "items", F.aggregate("items", start, step, lambda a: a["scores"]).alias("scores"))


def spread(scores: Column) -> Column:
    """Population standard deviation of an array."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / n
    squares = F.aggregate(scores, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when(n < 2, F.lit(0.0)).otherwise(T.rounded(F.sqrt(squares / n), 4))


def assess(rows: DataFrame, transcripts: DataFrame) -> DataFrame:
    """conv, accept and the reasons for and against merging the chunks of (conv, idx, text)."""
    kept = rows.where(~T.blank(F.col("text")))
    scored = retained_scores(kept).withColumn("spread", spread(F.col("scores"))).withColumn("n", F.size("items"))
    evolution = selection.evolution(selection.scores(kept))
    c = F.col
    joined = scored.join(evolution, "conv").join(transcripts.select("conv", F.length(T.strip(F.col("conversation"))).alias("chars")), "conv")
    issue = F.size(F.filter("items", lambda x: x["text"].rlike(ISSUE))) / c("n")
    thread = (issue >= 0.5) & (c("n") <= MAX_CHUNKS)
    joined = joined.withColumn("evolution", F.when(thread, F.least(c("evolution"), F.lit(0.34))).otherwise(c("evolution"))).withColumn("_thread", thread)
    failing = F.size(F.filter("items", lambda x: x["failure"] >= 0.22))
    say = lambda when, what: F.when(when, F.lit(what))
    reject = F.array_compact(F.array(
        say(c("n") <= 1, "already_single_chunk"), say(c("chars") > MAX_CHARS, f"total_chars_gt_{MAX_CHARS}"), say(c("n") > MAX_CHUNKS, f"original_chunks_gt_{MAX_CHUNKS}"),
        say(c("spread") > MAX_SPREAD, f"saliency_variance_gt_{MAX_SPREAD}"), say(c("evolution") >= MAX_EVOLUTION, f"evolution_likelihood_gte_{MAX_EVOLUTION}"),
        say((failing >= 3) & (c("n") >= 4), "multi_chunk_failure_density"), say((c("evolution") >= 0.55) & (c("n") >= 3) & (c("chars") >= 2800), "high_operational_evolution_likelihood"),
    ))
    for_it = F.array_compact(F.array(
        say(c("chars") <= MAX_CHARS, f"total_chars_lte_{MAX_CHARS}"), say(c("n") <= MAX_CHUNKS, f"original_chunks_lte_{MAX_CHUNKS}"), say(c("_thread"), "issue_thread_evo_cap"),
        say(c("spread") <= MAX_SPREAD, "low_saliency_variance"), say(c("evolution") < MAX_EVOLUTION, "low_evolution_likelihood"),
    ))
    out = joined.withColumn("rejected", reject).withColumn("reasons", for_it)
    return out.withColumn("accept", (F.size("rejected") == 0) & (F.size("reasons") >= 3)).select("conv", "n", "chars", "spread", "evolution", "rejected", "reasons", "accept", F.transform("items", lambda x: x["text"]).alias("chunks"))


def preserve(rows: DataFrame, transcripts: DataFrame) -> DataFrame:
    """conv, mode and chunks: merged into one or two where the conversation is thin, else as they are."""
    judged = assess(rows, transcripts)
    two = (F.col("n") > 4) | (F.col("chars") > TWO_CHARS)
    merged = F.when(two, chunking.merge_sparse(F.col("chunks"), 2)).otherwise(chunking.merge_sparse(F.col("chunks"), 1))
    return judged.select("conv", F.when(F.col("accept"), F.lit("sparse_preserved")).otherwise(F.lit("normal")).alias("mode"), F.when(F.col("accept"), merged).otherwise(F.col("chunks")).alias("chunks"), "rejected", "reasons")
