"""Exact top-k search in binary codes by incremental multi-index hashing.

A code is the signs of an embedding's components, cut into ``SEGMENTS`` segments
that index it (Norouzi et al., 2012). If two codes differ in less than
segments x (r + 1) bits, some segment differs in at most r. A query probes
segments at radius 0, 1, 2, ..., verifies what it meets on whole codes, and stops
once its kth distance is below segments x (r + 1): nothing nearer can be left.

The index is dealt out in blocks, each to one task, which the queries stream
past; the blocks' answers are merged. So no task holds more than one block and
a batch of queries. A small index has fewer blocks than there are cores; then
the queries are dealt out too, each part past a copy of its block. Equal codes are
one entry with their k smallest ids.

Defined results
- null embedding, one with a null or of another length than ``bits``: no code; it is
  neither found nor answered. A table without any of that length is an error
- a row is not its own neighbour; other rows of its code are at distance 0
- ties of distance: by vec_id; repeated rows of one id count once
- fewer than k others: all of them; empty table: no rows; extra columns are dropped
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, written

K, SEGMENTS, BITS = 10, 8, 64
INDEX_BLOCK, QUERY_BLOCK = 500_000, 50


def codes(vectors: DataFrame, bits: int = BITS) -> DataFrame:
    """vec_id and code: bit i is set where component i is at least 0."""
    sign = F.aggregate(
        F.transform("embedding", lambda x, i: F.when((i < bits) & (x >= 0), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b),
    )
    whole = vectors.where((F.size("embedding") == bits) & ~F.exists("embedding", lambda x: x.isNull()) & F.col("vec_id").isNotNull())
    return whole.select(F.col("vec_id").cast("long"), sign.alias("code"))


def smallest_ids(coded: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """code and its k + 1 smallest ids; a common code is first thinned in ``salts`` parts."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts))
    first = Window.partitionBy("code", "_salt").orderBy("vec_id")
    parts = coded.distinct().withColumn("_salt", salt).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    return parts.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))


def flips(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.int64)


class Index:
    """Segment tables of one block of distinct codes, and the ids of each code."""

    def __init__(self, values: np.ndarray, ids: list | None = None, segments: int = SEGMENTS, bits: int = BITS):
        self.values, self.segments, self.width = values, segments, bits // segments
        self.order, self.starts = [], []
        self.seen = np.zeros(len(values), dtype=bool)
        for s in range(segments):
            part = self.part(values, s)
            self.order.append(np.argsort(part, kind="stable").astype(np.int32))
            self.starts.append(np.searchsorted(part[self.order[s]], np.arange((1 << self.width) + 1)))
        ids = [[i] for i in range(len(values))] if ids is None else ids
        self.counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids]) if ids else np.empty(0, dtype=np.int64)

    def part(self, values: np.ndarray, s: int) -> np.ndarray:
        return ((values >> U64(s * self.width)) & U64((1 << self.width) - 1)).astype(np.int64)

    def search(self, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of codes that surely hold the k nearest ids."""
        places, distances = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        q = np.array([query], dtype=U64)
        for radius in range(self.width + 1):
            probes = flips(self.width, radius)
            fresh = []
            for s in range(self.segments):
                key = probes ^ self.part(q, s)[0]
                lo, hi = self.starts[s][key], self.starts[s][key + 1]
                fresh += [self.order[s][a:b] for a, b in zip(lo, hi, strict=True) if a < b]
            if fresh:
                new = np.unique(np.concatenate(fresh))
                new = new[~self.seen[new]]
                self.seen[new] = True
                places = np.concatenate([places, new])
                distances = np.concatenate([distances, np.bitwise_count(self.values[new] ^ q).astype(np.int64)])
            covered = self.segments * (radius + 1)
            if self.counts[places[distances < covered]].sum() >= k:
                break
        self.seen[places] = False
        return places, distances


def search_block(query_ids: np.ndarray, query_codes: np.ndarray, index: Index, k: int) -> Iterator[tuple[int, int, int]]:
    for me, code in zip(query_ids.tolist(), query_codes.tolist(), strict=True):
        places, distances = index.search(code, k + 1)  # one more: the query itself may be among them
        found = []
        for at in np.argsort(distances, kind="stable"):
            if len(found) > k and distances[at] > found[-1][0]:
                break
            first = index.first[places[at]]
            found += [(int(distances[at]), int(other)) for other in index.ids[first : first + index.counts[places[at]]] if other != me]
        for distance, other in sorted(found)[:k]:
            yield me, distance, other


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: the k nearest codes of every query."""
    entries = written(smallest_ids(codes(vectors, bits), k), "codes")
    asked = written(codes(queries, bits).distinct(), "queries")
    n, m = entries.count(), asked.count()
    if not n and not vectors.where("embedding IS NOT NULL").isEmpty():
        raise ValueError(f"no embedding has {bits} components")
    blocks = -(-n // INDEX_BLOCK) or 1
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = min(max(1, -(-2 * cores // blocks)), -(-m // QUERY_BLOCK) or 1)
    every = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = entries.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("i"), every("q", parts), F.lit(None).cast("long").alias("vec_id"), "code", "ids")
    right = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("q"), every("i", blocks), "vec_id", "code")
    both = left.unionByName(right.select("i", "q", "vec_id", "code", F.lit(None).cast("array<long>").alias("ids")))
    work = both.repartition(4 * blocks * parts, "i", "q").sortWithinPartitions("i", "q", F.col("vec_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, ids, index = None, [], [], None
        for batch in batches:
            for unit in runs(batch, ["i", "q"]):
                key = unit["i"][0].as_py(), unit["q"][0].as_py()
                if key != now:
                    now, values, ids, index = key, [], [], None
                held = unit.filter(unit["vec_id"].is_null())
                if held.num_rows:
                    values.append(held["code"].to_numpy(zero_copy_only=False).view(U64))
                    ids += held["ids"].to_pylist()
                asks = unit.filter(unit["vec_id"].is_valid())
                if asks.num_rows and values:
                    index = index or Index(np.concatenate(values), ids, bits=bits)
                    found = list(search_block(asks["vec_id"].to_numpy(zero_copy_only=False), asks["code"].to_numpy(zero_copy_only=False).view(U64), index, k))
                    columns = list(zip(*found, strict=True)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "distance", "vec_id"])

    near = work.mapInArrow(run, "query_id long, distance long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "distance")


def runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The stretches of a sorted batch with equal keys."""
    if not batch.num_rows:
        return
    columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
    change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows > 1 else []
    edges = [0, *[int(x) for x in change], batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)
