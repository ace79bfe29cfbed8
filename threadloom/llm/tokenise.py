"""Byte-level BPE: overlapping chunks, stitched where their pre-token boundaries meet again.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own,
as if a text began there, and its boundaries are kept. Two neighbours are
stitched at the first boundary that both found in their overlap: what follows
a boundary does not depend on what came before it, so from there on both agree.
The pieces between boundaries are then encoded; decoding joins their bytes.

Defined results
- null text: the empty text, no ids; empty table: no rows
- repeated rows: each is encoded; extra columns are dropped, so names cannot clash
- very long texts: above ``chunk`` characters, chunks become rows of their own
  and are pre-tokenised by different tasks; a shorter text is one chunk, which has
  nothing to stitch
- ties of rank in a piece: the leftmost pair joins first
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Bytes up to which a piece is merged together with others, a pair of each at a time; longer ones would need more rounds.
PAIRED_PIECE = 48
#: Bytes up to which a piece is merged by scanning its pairs; a heap costs less beyond.
SHORT_PIECE = 200
#: Characters up to which an encoded piece is remembered, and pieces that are looked up together.
REMEMBERED_PIECE, STEP = 64, 1 << 16


class Memory:
    """Encoded pieces by text, of bounded number: those not asked for lately go.

    What is missing of many pieces is encoded together, and pieces are looked up by ``map`` over
    a dictionary, so that a hit runs no Python code.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int):
        self.encode, self.most, self.now, self.older = encode, most, {}, {}

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The encoded pieces of each text, joined."""
        wanted = set().union(*texts)
        fresh = wanted.difference(self.now)
        if len(self.now) + len(fresh) > self.most:
            self.now, self.older, fresh = {}, self.now, wanted
        known = fresh.intersection(self.older)
        self.now.update(zip(known, map(self.older.__getitem__, known), strict=True))
        missing = list(fresh - known)
        self.now.update(zip(missing, self.encode(missing), strict=True))
        out = [b"".join(map(self.now.__getitem__, pieces)) for pieces in texts]
        for piece in missing:
            if len(piece) > REMEMBERED_PIECE:
                del self.now[piece]
        return out


class Bpe:
    """Ranks and pattern of one vocabulary, with a bounded memory of encoded pieces."""

    remembered = 120_000  # in each of two generations, some 200 bytes each

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.memory = Memory(self._encoded, self.remembered)
        self.pairs = Pairs(self.ranks)

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each pre-token."""
        out, short = [], []
        for place, raw in enumerate(map(str.encode, pieces)):
            known = self.ranks.get(raw)
            if known is None and len(raw) <= PAIRED_PIECE:
                short.append((place, raw))
                out.append(b"")
                continue
            ids = [known] if known is not None else (merged if len(raw) <= SHORT_PIECE else merged_long)(self.ranks, raw)
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        for (place, _), ids in zip(short, self.pairs.merged([raw for _, raw in short]), strict=True):
            out[place] = ids
        return out

    def cut(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        """The pre-tokens of a text."""
        if len(text) <= chunk:
            return self.pattern.findall(text)
        cuts = chunk_starts(len(text), chunk)
        parts = [(at, boundaries(self.pattern, text[at : at + chunk + overlap], at, at + chunk + overlap >= len(text))) for at in cuts]
        return between(text, stitch(self.pattern, text, parts))

    def joined(self, pieces: list[str]) -> bytes:
        """Ids of one text's pre-tokens, of any number: some at a time, so that the memory stays bounded."""
        return b"".join(self.memory.join([pieces[at : at + STEP]])[0] for at in range(0, len(pieces), STEP))

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        return self.joined(self.cut(text, chunk, overlap))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Pairs:
    """Merges of many short pre-tokens at once: a round joins one pair of each, the one that ``merged`` would."""

    def __init__(self, ranks: dict[bytes, int]):
        self.top = max(ranks.values()) + 1
        parts = {bytes([i]): self.top + i for i in range(256)} | ranks  # a byte without a rank may still be joined
        self.single = np.array([parts[bytes([i])] for i in range(256)], dtype=np.int64)
        self.width = self.top + 256
        keys = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = parts.get(token[:i]), parts.get(token[i:])
                if left is not None and right is not None:
                    keys[left * self.width + right] = rank
        self.keys = np.array(sorted(keys), dtype=np.int64)
        self.found = np.array([*map(keys.__getitem__, self.keys.tolist()), self.width], dtype=np.int64)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair joins to; ``width`` where it joins to nothing."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.found[at], self.width)

    def merged(self, raws: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each."""
        out: list[bytes] = [b""] * len(raws)
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        places = np.flatnonzero(sizes)
        sizes = sizes[places]
        ids = self.single[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        ends = np.cumsum(sizes)
        rank = np.append(self.ranks(ids[:-1], ids[1:]), self.width) if len(ids) else ids
        rank[ends - 1] = self.width  # a pair's rank stands at its left part
        while len(places):
            starts = ends - sizes
            least = np.minimum.reduceat(rank, starts)
            open_ = least < self.width
            if not open_.all():
                done = np.flatnonzero(~open_)
                owner = np.repeat(open_, sizes)
                left = ids[~owner]
                if (left >= self.top).any():
                    raise KeyError("a byte has no rank")
                raw, till = left.astype("<u4").tobytes(), (np.cumsum(sizes[done]) * 4).tolist()
                for place, a, b in zip(places[done].tolist(), [0, *till[:-1]], till, strict=True):
                    out[place] = raw[a:b]
                ids, rank, places, sizes, least = ids[owner], rank[owner], places[open_], sizes[open_], least[open_]
                ends = np.cumsum(sizes)
                if not len(places):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            at = hits[np.searchsorted(hits, ends - sizes)]  # the leftmost of each
            ids[at] = rank[at]
            stays = np.ones(len(ids), dtype=bool)
            stays[at + 1] = False
            at -= np.arange(len(at))  # its place once the joined parts before it are gone
            ids, rank, sizes = ids[stays], rank[stays], sizes - 1
            ends = np.cumsum(sizes)
            last = np.zeros(len(ids) + 1, dtype=bool)
            last[ends - 1] = True
            rank[at] = self.width
            right, before = at[~last[at]], at[(at > 0) & ~last[at - 1]]
            rank[right] = self.ranks(ids[right], ids[right + 1])
            rank[before - 1] = self.ranks(ids[before - 1], ids[before])
        return out


def merged(ranks: dict[bytes, int], raw: bytes) -> list[int]:
    """Ids of one pre-token: of all neighbours that join to a token, those of the least rank
    join first, the leftmost of several."""
    none = len(ranks) + (1 << 32)
    parts = [raw[i : i + 1] for i in range(len(raw))]
    pair = [ranks.get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
    while pair and (least := min(pair)) < none:
        i = pair.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merged_long(ranks: dict[bytes, int], raw: bytes) -> list[int]:
    """As ``merged`` by a heap of pairs over linked parts, for pieces of any length."""
    n = len(raw)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part by its start; 0 ends a part that was joined
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            last = end[end[i]]
            if (rank := ranks.get(raw[i:last])) is not None:
                heapq.heappush(heap, (rank, i, last))

    while heap:
        _, i, last = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != last or middle == last:
            continue  # one of its parts has changed
        end[i], end[middle] = last, 0
        if last < n:
            before[last] = i
        offer(before[i])
        offer(i)
    out, at = [], 0
    while at < n:
        out.append(ranks[raw[at : end[at]]])
        at = end[at]
    return out


@functools.cache
def bpe(rank_file: str, pattern: str) -> Bpe:
    return Bpe(rank_file, pattern)


def chunk_starts(n: int, chunk: int) -> range:
    return range(0, max(n, 1), chunk)


def boundaries(pattern, part: str, offset: int, last: bool) -> np.ndarray:
    """Ends of the pre-tokens of ``part``, as places in the whole text.

    A match that touches the end of a chunk may look different once more text
    follows, and white space before it too; these ends are left out.
    """
    ends = [m.end() for m in pattern.finditer(part)]
    if not last:
        kept = len(part.rstrip())
        while ends and ends[-1] >= kept:
            ends.pop()
    return np.asarray(ends, dtype=np.int64) + offset


def stitch(pattern, text: str, parts: list[tuple[int, np.ndarray]]) -> list[int]:
    """The whole text's boundaries from those of its chunks (start, ends).

    Neighbours switch at their first common boundary. Where an overlap holds
    none (one pre-token longer than it), matching goes on from the last sure
    boundary until it meets the later chunk.
    """
    sure = parts[0][1]
    for _, later in parts[1:]:
        common = np.intersect1d(sure[np.searchsorted(sure, later[0]) :], later, assume_unique=True) if len(later) and len(sure) else sure[:0]
        if len(common):
            sure = np.concatenate([sure[: np.searchsorted(sure, common[0], "right")], later[np.searchsorted(later, common[0], "right") :]])
            continue
        at, known, found = int(sure[-1]) if len(sure) else 0, set(later.tolist()), []
        stop = int(later[-1]) if len(later) else 0
        while at < stop:
            at = pattern.match(text, at).end()
            found.append(at)
            if at in known:
                break
        sure = np.concatenate([sure, np.asarray(found, dtype=np.int64), later[np.searchsorted(later, at, "right") :]])
    at = int(sure[-1]) if len(sure) else 0
    rest = []
    while at < len(text):
        at = pattern.match(text, at).end()
        rest.append(at)
    return [*sure.tolist(), *rest]


def between(text: str, ends: list[int]) -> list[str]:
    return list(map(text.__getitem__, map(slice, [0, *ends[:-1]], ends)))


KINDS = {"n_tokens": (pa.int64(), "long"), "ids": (pa.list_(pa.int32()), "array<int>"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}
VALUES = {
    "n_tokens": lambda coder, ids: len(ids) // 4,
    "ids": lambda coder, ids: np.frombuffer(ids, dtype="<i4"),
    "ids_sha256": lambda coder, ids: hashlib.sha256(ids).hexdigest(),
    "decoded_sha256": lambda coder, ids: hashlib.sha256(coder.decode(ids)).hexdigest(),
}


def encode(docs: DataFrame, rank_file: str, pattern: str, columns: tuple[str, ...] = ("ids",), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id of every text beside ``columns``: its ids, their number, or the hash of them or of their decoded bytes.

    Texts of up to ``chunk`` characters are encoded where they are read. Longer
    ones are cut into rows natively, dealt out by (document, chunk) for
    pre-tokenising, and meet again by document for stitching.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(c, KINDS[c][0]) for c in columns]])
    ddl = ", ".join(["doc_id long", *[f"{c} {KINDS[c][1]}" for c in columns]])
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def row(coder: Bpe, key, ids: bytes) -> tuple:
        return key, *[VALUES[c](coder, ids) for c in columns]

    # vocabularies are loaded with the first rows, not in workers whose partition is empty
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            coder = bpe(rank_file, pattern)
            ids = coder.memory.join([coder.cut(text.as_py(), chunk, overlap) for text in batch["text"]])
            out = [row(coder, key, own) for key, own in zip(batch["doc_id"].to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts_at = regex.compile(pattern)
        for batch in pieces(batches):
            ends = [boundaries(cuts_at, part.as_py(), at.as_py(), last.as_py()).tolist() for part, at, last in zip(batch["part"], batch["start"], batch["last"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["_row"], batch["doc_id"], batch["_copies"], batch["start"], batch["part"], pa.array(ends, pa.list_(pa.int64()))], names=["_row", "doc_id", "_copies", "start", "part", "ends"])

    def join(group: pa.Table) -> pa.Table:
        coder = bpe(rank_file, pattern)
        group = group.sort_by("start")
        text = "".join(p.as_py()[:chunk] for p in group["part"])
        parts = list(zip(group["start"].to_pylist(), (np.asarray(e.as_py(), dtype=np.int64) for e in group["ends"]), strict=True))
        ids = coder.joined(between(text, stitch(coder.pattern, text, parts)))
        out = [[x] for x in row(coder, group["doc_id"][0].as_py(), ids)]
        values = [pa.array(c, t) for c, t in zip(out, schema.types, strict=True)]
        return pa.Table.from_arrays([group["_copies"][:1].combine_chunks(), *values], names=["_copies", *schema.names])

    length = F.length("text")
    short = rows.where(length <= chunk).mapInArrow(whole, ddl)
    start = F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(chunk)))
    long = (
        rows.where(length > chunk)
        # one document however often its row repeats: copies are counted and put back below
        .groupBy("doc_id", "text").agg(F.count("*").alias("_copies"))
        .withColumn("_n", length).withColumn("_row", F.xxhash64("doc_id", "text"))
        .withColumn("start", start)
        .select("_row", "doc_id", "_copies", F.col("start").cast("long"), F.substring("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("part"), (F.col("start") + chunk + overlap >= F.col("_n")).alias("last"))
    )
    parts = long.repartition("_row", "start").mapInArrow(cut, "_row long, doc_id long, _copies long, start long, part string, ends array<long>")
    joined = parts.groupBy("_row", "doc_id").applyInArrow(join, "_copies long, " + ddl)
    joined = joined.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return short.union(joined.select(*schema.names))


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, raw: binary): the bytes of the ids, joined."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(rank_file, pattern)
        for batch in batches:
            raw = [coder.decode(np.asarray(ids.as_py() or [], dtype="<u4").tobytes()) for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return tokens.select("doc_id", "ids").mapInArrow(back, "doc_id long, raw binary")
