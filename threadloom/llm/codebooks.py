"""Vector code compression: product codebooks learnt in exact integers.

Components become integers, vectors are cut into parts, and each part position has
a codebook of integer entries. A round broadcasts the codebooks (8 x 16 x 8 integers
for 64 components: kilobytes, whatever the table), reads the vectors once in
Arrow batches, computes all squared distances by |x|^2 - 2xc + |c|^2 with exact int64 matrix
products, and takes the first least. A task adds up its parts by entry and emits
one row an entry and position, which a grouped shuffle merges; the driver gets as many
sums as there are integers in the codebooks. Vectors are never shuffled.

Defined results
- null vectors, those with null or non-finite components: dropped
- vectors of another length than most (ties: the longer): dropped too
- lengths that the parts do not divide: parts differ by one component, the longer ones first
- fewer vectors than entries: as many entries as vectors; none: no rows
- null vec_id: after all others; repeated rows: each counts; of one id by their vectors
- floor(4096 x) of 2^27 and more either way: an error, as distances would leave 64 bits
- unused entries stay; ties of distance: the lower index; extra columns are dropped
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, list_column, written

LIMIT = 1 << 27
#: Most labels whose sums are broadcast, some bytes each; more are joined in parts.
LABELS = 100_000


@dataclass(frozen=True)
class Rule:
    """Integer scale, parts of a vector, entries of a codebook, and rounds of learning."""

    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6


Codebooks = list[np.ndarray]  # by part: entries x components, int64


def finite() -> Column:
    """Whether the vector has components, and finite ones only."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole


def usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(finite())


def common_length(vectors: DataFrame) -> int:
    """The most frequent length of ``usable`` vectors; 0 where there are none."""
    top = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def integers(column: pa.Array, length: int, scale: int) -> np.ndarray:
    """floor(scale x) of a list column, one row a vector."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    out = np.floor(flat * scale)
    if len(out) and np.abs(out).max() >= LIMIT:
        raise ValueError(f"a component times {scale} is {LIMIT} or more; scale the vectors down")
    return out.astype(np.int64).reshape(-1, length)


def cuts(length: int, parts: int) -> list[slice]:
    sizes = [length // parts + (i < length % parts) for i in range(parts)]
    edges = np.cumsum([0, *sizes])
    return [slice(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of every row, and its squared distance."""
    squares = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]
    best = squares.argmin(axis=1)
    return best, squares[np.arange(len(x)), best]


def sums(vectors: DataFrame, length: int, books: Codebooks, rule: Rule) -> dict[tuple[int, int], tuple[list[int], int]]:
    """By part and entry: component sums and the number of the parts assigned to it."""
    places = cuts(length, rule.parts)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = integers(batch.column(0), length, rule.scale)
            for held, place, entries in zip(total, places, shared.value, strict=True):
                x = whole[:, place]
                best, _ = nearest(x, entries)
                np.add.at(held, best, np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1))
        rows = [(p, e, row) for p, held in enumerate(total) for e, row in enumerate(held) if row[-1]]
        if rows:
            part, entry, values = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), list_column(list(values), pa.int64())], names=["part", "entry", "sums"])

    partial = vectors.select("embedding").mapInArrow(run, "part int, entry int, sums array<long>")
    each = partial.select("part", "entry", F.posexplode("sums").alias("at", "value"))
    merged = each.groupBy("part", "entry", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # as many rows as the codebooks have integers
    shared.unpersist()
    found: dict[tuple[int, int], dict[int, int]] = {}
    for row in merged:
        found.setdefault((row["part"], row["entry"]), {})[row["at"]] = int(row["value"])
    return {key: ([values[i] for i in range(len(values) - 1)], values[len(values) - 1]) for key, values in found.items()}


def start(vectors: DataFrame, length: int, rule: Rule) -> Codebooks:
    """The parts of the vectors with the smallest ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(rule.entries).select("embedding").collect()
    first = integers(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), length, rule.scale)
    return [first[:, place] for place in cuts(length, rule.parts)]


def learn(vectors: DataFrame, length: int, rule: Rule) -> Codebooks:
    books = start(vectors, length, rule)
    for _ in range(rule.rounds):
        for (part, entry), (values, n) in sums(vectors, length, books, rule).items():
            books[part][entry] = [v // n for v in values]
    return books


def digest(books: Codebooks) -> str:
    """SHA-256 of all integers by part, entry and position, as decimals with commas between."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


ENCODED = "vec_id long, label {label}, code string, error long"


def encode(vectors: DataFrame, length: int, books: Codebooks, rule: Rule) -> DataFrame:
    """vec_id, label, code and error of every usable vector; one pass, no shuffle."""
    places = cuts(length, rule.parts)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = integers(batch["embedding"], length, rule.scale)
            codes, error = np.empty((len(whole), rule.parts), dtype=np.uint8), np.zeros(len(whole), dtype=np.int64)
            for p, (place, entries) in enumerate(zip(places, shared.value, strict=True)):
                codes[:, p], far = nearest(whole[:, place], entries)
                error += far
            text = [bytes(row).hex() for row in codes]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    rows = vectors.select(F.col("vec_id").cast("long"), "label", "embedding")
    return rows.mapInArrow(run, ENCODED.format(label=rows.schema["label"].dataType.simpleString()))


def decode(codes: DataFrame, books: Codebooks, rule: Rule) -> DataFrame:
    """vec_id and the components that a code stands for: the way back, with its ``error``."""
    table = [[[float(v) / rule.scale for v in entry] for entry in b.tolist()] for b in books]
    lit = F.array(*[F.array(*[F.array(*[F.lit(v) for v in entry]) for entry in b]) for b in table])
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.select("vec_id", F.concat(*[F.get(F.get(lit, p), index(p)) for p in range(rule.parts)]).alias("embedding"))


def compress(vectors: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector."""
    whole = usable(vectors)
    length = common_length(whole)
    kept = whole.where(F.size("embedding") == length)
    books = learn(kept, length, rule) if length else []
    coded = written(encode(kept, length, books, rule), "codes")
    of_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    named = of_label.select(F.col("label").alias("_label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if of_label.count() <= LABELS:
        both = coded.join(F.broadcast(named), same)
    else:
        salted = named.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = coded.withColumn("_salt", F.pmod(F.xxhash64("code", "vec_id"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_salt") == F.col("_copy")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
