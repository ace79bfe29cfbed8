"""What several training-data operators share: words, hashes, written tables, components."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bitmap import BITMAP_BITS, among  # noqa: F401 - used from here
from ..session import delete_scratch, scratch

#: White space that parts words, as a regular expression class: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_MASK = (1 << 64) - 1


#: Setting under which Spark deletes a query's shuffle files once the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings of each write; they are put back after it. Small Arrow batches keep Python workers small. Tables of ids and
#: counts take a hundred times their file's size as a broadcast relation, which the driver builds: only tiny ones are broadcast unasked.
_WRITING = {_CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.autoBroadcastJoinThreshold": "256k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "256k"}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost
    executors recompute nothing before this point, and sizes are known to AQE.

    The shuffle files of the write go when it ends. The table itself goes by
    ``discard`` or, where a returned DataFrame still reads it, when the driver's
    Python ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = {name: spark.conf.get(name, None) for name in _WRITING}
    try:
        for name, value in _WRITING.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` whose results have been written on in their turn."""
    for df in tables:
        delete_scratch(df.sparkSession, df.written_path)


def cuts_below(cuts: Column, value: Column, most: int) -> Column:
    """How many of ``cuts``, a sorted array of up to ``most`` values, are at most ``value``; a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(max(most, 1).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & _MASK, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of all runs of w consecutive elements in one vectorised pass.

    Polynomial hash modulo 2^64 with an odd base, read off prefix sums and moved
    to a common origin with the base's inverse, then mixed.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = odd_powers(1, 1)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up), 4096)
            self._up, self._down = odd_powers(self.base, size), odd_powers(self.inverse, size)
        return self._up, self._down

    def windows(self, values: np.ndarray, w: int) -> np.ndarray:
        n = len(values)
        if n < w:
            return np.empty(0, dtype=U64)
        up, down = self.powers(n)
        prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * up[:n], out=prefix[1:])
        return mix((prefix[w:] - prefix[:-w]) * down[: n - w + 1])


_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_NEXT_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BYTES = Rolling(0xA24BAED4963EE407)
#: Longer words get a BLAKE2b hash: polynomials modulo 2^64 collide for built strings of a thousand bytes.
LONG_WORD = 64


def hash_words(raw: bytes, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the words of a text, in order.

    Read off prefix sums over the bytes, so no word becomes an object; long texts
    go block by block, cut at white space.
    """
    buffer, out, at = np.frombuffer(raw, dtype=np.uint8), [], 0
    while at < len(raw):
        end = at + block
        if end < len(raw):
            gap = _NEXT_GAP.search(raw, end)
            end = gap.start() if gap else len(raw)
        b = buffer[at:end]
        at = end
        gaps = np.ones(len(b) + 2, dtype=np.int8)
        gaps[1:-1] = _GAP[b]
        edges = np.flatnonzero(np.diff(gaps))
        starts, ends = edges[0::2], edges[1::2]
        up, down = _BYTES.powers(len(b))
        prefix = np.zeros(len(b) + 1, dtype=U64)
        np.cumsum((b + U64(1)) * up[: len(b)], out=prefix[1:])
        sizes = ends - starts
        found = mix((prefix[ends] - prefix[starts]) * down[starts] ^ sizes.astype(U64))
        for i in np.flatnonzero(sizes > LONG_WORD):
            found[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]], digest_size=8).digest(), "little")
        out.append(found)
    return out[0] if len(out) == 1 else np.concatenate([np.empty(0, dtype=U64), *out])


def shingle_set(raw: bytes, w: int, roll: Rolling) -> np.ndarray:
    """Sorted distinct hashes of w-word shingles; fewer words: the sequence as one; none: empty."""
    values = hash_words(raw)
    if len(values) < w:
        return roll.windows(values, len(values)) if len(values) else values
    return np.unique(roll.windows(values, w))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(parts: list[np.ndarray], kind):
    """Arrow list column from one NumPy array a row."""
    import pyarrow as pa

    sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


SALTS = 16


def parted_join(many: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, one row a ``key``: copies of the latter go to ``SALTS`` parts, to which
    the hash of ``by`` deals the former, so that one of many rows is not one task's."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", salt).join(copies, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, component = smallest node).

    Alternates large-star and small-star steps (Kiveris et al., 2014): each step
    is a partially aggregated minimum and a join that AQE may split at hubs, so
    no neighbourhood is ever gathered. Every step is written to the shared
    folder. Self-loops keep lone nodes.
    """
    lone = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        total = now.agg(F.count("*").alias("n"), F.sum(F.col("u").cast("decimal(38,0)")).alias("u"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if tuple(total) == mark or total["n"] == 0:
            break
        mark = tuple(total)
        both = now.union(now.select("v", "u"))
        # a hub's neighbours are parted by salt, and its minimum goes to each part
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parted = both.where("v > u").withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        star = parted.join(least.hint("merge"), ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = written(star, "large-star")
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        discard(now)
        moved = star.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(star)
    else:
        raise RuntimeError("connected components did not converge")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = lone.select("node", F.col("node").alias("component"))
    return found.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))


def pieces(batches: Iterator, most_bytes: int = 4 << 20) -> Iterator:
    """Cut Arrow batches by bytes, so that long texts do not pile up in one step."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, batch.num_rows * most_bytes // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
