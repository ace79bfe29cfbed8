"""A corpus pipeline: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame; all but the last return the columns of
``documents``.

Defined results of every stage
- null text: no letter, so the language stage drops it; the later stages take it as empty
- null doc_id, lang or source: stays null; near-duplicates tell such rows apart by
  their text, passages take them as later than all others, the mix as a source of
  their own where the source is null
- ties and repeated rows: as the operators say; of near-duplicates the smallest id stays
- very long texts: whole; empty table: no rows; extra columns, whatever their names,
  are dropped
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import language, mixing, neardup, substring, tokenise
from threadloom.llm.common import written
from threadloom.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language (no letter, or foreign to all learned ones); a missing lang is filled in."""
    model = language.fit(language.sample(docs, ~language.held_out("doc_id")))
    judged = language.in_a_language(docs.select(*COLUMNS), model)
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with five-word shingles alike by 0.8 or more."""
    return neardup.without_near_duplicates(docs.select(*COLUMNS), neardup.Rule(width=5, percent=80))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that an earlier document holds."""
    return substring.without_repeats(docs.select(*COLUMNS), substring.Rule(window=50))


def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The weights that labels give; none where the corpus has no such table."""
    try:
        labels = table(spark, sf_dir, "labels")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return mixing.label_weights(labels)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target by the weights of ``labels``; a document comes as often as the mix takes it."""
    mixed = mixing.mix(docs.select(*COLUMNS), label_weights(spark, sf_dir), carry=("text", "lang", "n_chars")).where("epochs > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "epochs"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and the hash of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tokenise.encode(docs, ranks, public_tokenizers.PATTERN, ("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't state PPM code lengths and BPE merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
