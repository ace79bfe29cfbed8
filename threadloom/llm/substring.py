"""Removal of passages that an earlier document already holds.

A window is ``window`` consecutive words. A word goes if a window that covers it
also starts in a document with a smaller id. Finding all such windows would
mean shuffling every window; difference-cover anchors avoid that:

1. With D a difference cover of the residues modulo ``period``, any two places of
   a pair of documents move to places in D by one common shift below ``period``.
   So two equal windows share an aligned anchor: an equal run of
   window - period + 1 words that starts at places in D of both documents.
   Only those runs are hashed and counted (about |D| / period of all places).
2. Anchors held by two different texts point at the windows around them. Only
   these are extended to whole windows and hashed (128 bits), whose smallest
   document decides. What a text repeats within itself is sent once and found
   again at all its places when the text is next read.
3. Each document drops the words that its judged windows cover.

Documents of equal word sequences are one text: its smallest id keeps what the
windows leave, every other copy of ``window`` words or more loses all. Counts
are taken before joins and rows meet by hash, so a passage of any frequency is
one counted row in (1), (2) and in the deciding join AQE may split it.

Defined results
- null or wordless text: no words, nothing removed, the hash of the empty text
- fewer words than a window: nothing removed
- repeated ids: rows of one id do not judge each other
- null id: later than every other id; stays null
- ties: of equal passages in one document all places are judged alike
- very long texts: hashed block by block, one text at a time
- empty table: no rows; extra columns are dropped by ``deduplicate`` and kept by
  ``without_repeats``, whatever their names
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, U64, Rolling, among, discard, hash_words, list_column, pieces, signed, written

NO_ID = (1 << 63) - 1
_ROLL, _AGAIN = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)


@dataclass(frozen=True)
class Rule:
    """Window length and the cover; (0, 1, 3, 8, 12, 18) is a perfect difference set modulo 31."""

    window: int = 50
    period: int = 31
    cover: tuple[int, ...] = (0, 1, 3, 8, 12, 18)

    def __post_init__(self):
        differences = {(a - b) % self.period for a in self.cover for b in self.cover}
        if len(differences) != self.period or self.anchor < 1:
            raise ValueError("not a difference cover, or longer than the window")

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1

    def places(self, n: int) -> np.ndarray:
        """Anchor places of a text of n words."""
        if n < self.window:
            return np.empty(0, dtype=np.int64)
        at = (np.arange(0, n, self.period)[:, None] + np.array(sorted(self.cover))).ravel()
        return at[at <= n - self.anchor]


def raw(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode()


def sequence_hash(values: np.ndarray) -> int:
    """One 64-bit hash of a whole word sequence. It tells rows of one id apart; copies are told by a SHA-256."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")


def mark(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def outline(docs: DataFrame) -> DataFrame:
    """doc_id, a mark of the text, number of words, sequence hash and the hash of all words, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text in batch["text"]:
                own = raw(text)
                values = hash_words(own)
                rows.append((len(values), sequence_hash(values), hashlib.sha256(b" ".join(own.split())).hexdigest()))
            n, seq, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(n, pa.int64()), pa.array(np.array(seq, dtype=U64).view(np.int64)), pa.array(sha)], names=["doc_id", "mark", "n_words", "seq", "all_sha256"])

    return _keyed(docs).withColumn("mark", mark("text")).mapInArrow(run, "doc_id long, mark long, n_words long, seq long, all_sha256 string")


def anchors(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, seq, h) of every text of at least a window: the hash at each anchor place, null where the text has it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, seqs, hashes = [], [], []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                values = hash_words(raw(text))
                at = rule.places(len(values))
                if len(at):
                    h = _ROLL.windows(values, rule.anchor)[at]
                    again = np.ones(len(h), dtype=bool)
                    again[np.unique(h, return_index=True)[1]] = False
                    ids.append(key.as_py())
                    seqs.append(sequence_hash(values))
                    hashes.append(pa.array(signed(h), mask=again))
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int32)
            flat = pa.concat_arrays(hashes) if hashes else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(seqs, dtype=U64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "seq", "h"])

    return _keyed(docs).mapInArrow(run, "doc_id long, seq long, h array<long>")


def windows(docs: DataFrame, around: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, seq, at, h1, h2): first places and hashes of the distinct windows around shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, seqs, firsts, first, second = [], [], [], [], []
            for key, text, seq, at in zip(*(batch[c] for c in ("doc_id", "text", "seq", "at")), strict=True):
                values = hash_words(raw(text))
                if sequence_hash(values) != seq.as_py() & ((1 << 64) - 1):
                    continue  # another row of this id
                last = len(values) - rule.window
                mark = np.zeros(last + 2, dtype=np.int32)
                places = rule.places(len(values))
                places = places[repeats(_ROLL.windows(values, rule.anchor), places, at.as_py())]
                # windows that contain the anchor begin at most period - 1 words before it
                np.add.at(mark, np.maximum(places - rule.period + 1, 0), 1)
                np.add.at(mark, np.minimum(places, last) + 1, -1)
                chosen = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                one, two = _ROLL.windows(values, rule.window), _AGAIN.windows(values, rule.window)
                _, once = np.unique(one[chosen], return_index=True)
                chosen = chosen[np.sort(once)]
                ids.append(key.as_py())
                seqs.append(seq.as_py())
                firsts.append(chosen.astype(np.int32))
                first.append(signed(one[chosen]))
                second.append(signed(two[chosen]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seqs, pa.int64()), list_column(firsts, pa.int32()), list_column(first, pa.int64()), list_column(second, pa.int64())], names=["doc_id", "seq", "at", "h1", "h2"])

    return _beside(docs, around).mapInArrow(run, "doc_id long, seq long, at array<int>, h1 array<long>, h2 array<long>")


def _beside(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text, seq, at: the texts that ``found`` speaks of; others stay where they are."""
    return among(docs, found.select("doc_id"), "doc_id").join(found.hint("merge"), "doc_id").select("doc_id", "text", "seq", "at")


def repeats(hashes: np.ndarray, places: np.ndarray, chosen: list[int]) -> np.ndarray:
    """Which of ``places`` hold a hash that some chosen place of the same text holds."""
    return np.isin(hashes[places], hashes[np.asarray(chosen, dtype=np.int64)])


def kept_words(words: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """Which words no window that begins at ``starts`` covers."""
    mark = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + window, len(words)), -1)
    return np.cumsum(mark[:-1]) == 0


def without_repeats(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``; rows left without a word go.

    Rows that lose nothing keep their text as it is; the others hold their kept
    words joined by one space. ``n_chars``, where there is one, follows.
    """
    changed = (
        deduplicate(docs, rule, texts=True)
        .where("n_removed > 0")
        .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("mark").alias("_mark"), F.col("kept_text").alias("_kept"))
        .dropDuplicates(["_id", "_mark"])
    )
    own = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_mark", mark("text"))
    joined = own.join(changed, ["_id", "_mark"], "left").where(F.col("_kept").isNull() | (F.col("_kept") != ""))
    values = {"text": F.coalesce("_kept", "text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("_kept").isNotNull(), F.length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns])


def deduplicate(docs: DataFrame, rule: Rule = Rule(), texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``texts`` also kept_text
    (the kept words of rows that lost some, else null) and the text's mark."""
    spark = docs.sparkSession
    base = written(outline(docs), "outline")
    # one text a word sequence, told by its SHA-256: its smallest id
    first = base.where(F.col("n_words") >= rule.window).groupBy("all_sha256").agg(F.min_by("seq", "doc_id").alias("seq"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))

    flat = written(anchors(docs, rule), "anchors")  # read twice: to count, and to find the places of what counts
    one = flat.select("seq", F.explode("h").alias("h")).where("h IS NOT NULL")
    shared = one.groupBy("h").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).where("a <> b").select("h")
    shared = written(shared, "shared-anchors")
    nth = flat.select("doc_id", "seq", F.posexplode("h").alias("nth", "h")).where("h IS NOT NULL")
    cover = F.array(*[F.lit(c) for c in sorted(rule.cover)])
    size = len(rule.cover)
    at = (F.floor(F.col("nth") / size) * rule.period + F.get(cover, F.pmod("nth", F.lit(size)))).cast("int")
    around = nth.join(shared, "h").groupBy("doc_id", "seq").agg(F.collect_set(at).alias("at"))
    # of equal texts only the first is looked at again
    around = written(around.join(first.select("seq", "doc_id"), ["seq", "doc_id"], "left_semi"), "around")
    discard(shared, flat)
    runs = written(windows(_keyed(docs), around, rule), "windows")
    discard(around)

    each = runs.select("doc_id", "seq", F.explode(F.arrays_zip("at", "h1", "h2")).alias("x")).select("doc_id", "seq", "x.at", "x.h1", "x.h2")
    least = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("other")).where("lead < other").drop("other")
    judged = each.join(least, ["h1", "h2"]).where("doc_id > lead").groupBy("doc_id", "seq").agg(F.collect_set("at").alias("at"))
    judged = written(judged, "judged")
    discard(runs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for key, text, seq, at in zip(*(batch[c] for c in ("doc_id", "text", "seq", "at")), strict=True):
                words = raw(text).split()
                values = hash_words(raw(text))
                if sequence_hash(values) != seq.as_py() & ((1 << 64) - 1):
                    continue
                every = _ROLL.windows(values, rule.window)
                starts = np.flatnonzero(repeats(every, np.arange(len(every)), at.as_py()))
                keep = kept_words(words, starts, rule.window)
                left = b" ".join(compress(words, keep.tolist()))
                rows.append((key.as_py(), seq.as_py(), int(len(words) - keep.sum()), hashlib.sha256(left).hexdigest(), left.decode() if texts else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "seq", "removed", "sha", "left"])

    trimmed = _beside(_keyed(docs), judged).mapInArrow(cut, "doc_id long, seq long, removed long, sha string, left string")
    trimmed = written(trimmed.dropDuplicates(["doc_id", "seq"]), "trimmed")
    discard(judged)
    # texts with copies meet their first in parts, so that one of many copies is not one task's
    salt = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int")
    copied = first.where("copies > 1").select("all_sha256", F.col("doc_id").alias("lead"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    own = base.withColumn("_salt", salt).join(copied, ["all_sha256", "_salt"], "left").withColumn("lead", F.coalesce("lead", "doc_id"))
    copy = (F.col("n_words") >= rule.window) & (F.col("doc_id") > F.col("lead"))
    done = own.join(trimmed, ["doc_id", "seq"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    more = [F.when(copy, F.lit("")).otherwise(F.col("left")).alias("kept_text"), F.col("mark")] if texts else []
    return done.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("sha", "all_sha256")).alias("kept_sha256"), *more,
    )
