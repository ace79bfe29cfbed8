"""Queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import chat, codebooks, divergence, embeddings, fingerprint, hamming, html, language, mixing, neardup, sharding, sql, substring, tokenise

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"), substring.Rule(window=50))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op4_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out("doc_id")
    model = language.fit(language.sample(docs, ~held))
    judged = language.identify(docs, model, keep=["doc_id"])
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = neardup.Rule(width=3, percent=85)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), rule).select("doc_id", "n_shingles", "component_id", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.label_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_substring, op2_sharding, op3_chat, op4_tokenise, op5_fingerprint, op6_language, op7_neardup, op8_mixing, op9_hamming, op10_html, op11_embeddings, op12_divergence, op13_codebooks]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = dict(sql.BY_QUERY)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
