"""MinHash near-duplicates with min-max hashing.

Each permutation of a document's shingle hashes gives two signature values, its
minimum and its maximum (Ji et al., 2013): half the hash evaluations for as
many values, and agreement stays an unbiased estimate of the Jaccard index with
less variance. Values are banded; documents that share a band meet.

From bands to exact links, without ever listing the pairs of a group:

1. Documents with equal shingle sets are one class; its smallest id stands for it.
2. Band buckets of two or more classes tie each member to the bucket's smallest
   id, its lead. The connected components of these ties are families: every
   banded pair lies within one.
3. A family of up to ``BLOCK`` documents meets in one unit of work: all its
   intersections come from a product of 0/1 matrices over the shingles that at
   least two of its documents hold, and a spanning forest of the links leaves it.
   In a larger family each document goes once, to its least lead, whose followers
   are dealt out in parts; a part streams past the lead and ``REPS``
   representatives that all parts share, and a few of its own. So a family of
   copies costs time in proportion to its size, wherever it lives.
4. Components of the links found so far. What they leave open are the leads whose
   followers lie in several components; their followers are compared pair by
   pair, in pairs of blocks bounded by rows and shingles. Only here, among
   different texts that share bands and yet are not linked, is work quadratic.
5. Components again, then members of the classes.

Every banded pair is either connected or compared on whole sets of 64-bit shingle
hashes, so bands only decide recall: a pair at the threshold escapes all bands
with probability (1 - t^rows)^bands, at most ``MISS``.

Defined results
- null or wordless text: an empty set, linked with nothing, kept
- fewer words than a shingle: the whole sequence is the one shingle
- very long texts: one set at a time in (3), blocks bounded by shingles in (4)
- ties: of a group the smallest id stays
- repeated ids: rows of one id are one document: linked through it, each with its own
  count; ``without_near_duplicates`` keeps the row with the least text, then the least
  other columns
- null id: such a row goes by a number of 2^62 and more that its text decides, and
  stays null in ``doc_id``
- empty table: no rows; extra columns are dropped, so names cannot clash
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U64, Rolling, among, components, discard, list_column, mix, parted_join, pieces, shingle_set, signed, written

BLOCK, SHINGLES = 96, 1_000_000  # most documents of a block, and the shingles it should hold
PART, REPS, OWN_REPS = 192, 8, 8
MISS = 1e-5
_ROLL = Rolling(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Shingle width, link threshold in per cent, and the band plan that follows from it."""

    width: int = 5
    percent: int = 80
    lower: bool = True
    rows: int = 5

    @property
    def bands(self) -> int:
        n = math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** self.rows))
        return n + n % 2  # rows x bands values come from half as many permutations

    def shingles(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        return shingle_set(raw.lower() if self.lower else raw, self.width, _ROLL)


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 64, n, dtype=U64), draw.integers(0, 1 << 64, n, dtype=U64) | U64(1)


def signature(s: np.ndarray, masks: np.ndarray, factors: np.ndarray, block: int = 4096) -> np.ndarray:
    """Minimum and maximum of the set under each permutation: 2 x len(masks) values."""
    low = np.full(len(masks), ~U64(0), dtype=U64)
    high = np.zeros(len(masks), dtype=U64)
    for at in range(0, len(s), block):
        h = (s[at : at + block, None] ^ masks) * factors
        h ^= h >> U64(29)
        np.minimum(low, h.min(axis=0), out=low)
        np.maximum(high, h.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_hashes(values: np.ndarray, rows: int) -> np.ndarray:
    table = values.reshape(-1, rows)
    h = np.arange(len(table), dtype=U64) * U64(0xD1342543DE82EF95)
    for k in range(rows):
        h = mix(h * U64(0x9E3779B97F4A7C15) + table[:, k])
    return h


SIGNED = "doc_id long, nameless boolean, n_shingles long, s1 long, s2 long, bands array<long>"


def number(key: str = "doc_id", text: str = "text") -> Column:
    """The id of a row; one from its text where it has none."""
    own = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return F.coalesce(F.col(key).cast("long"), own)


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, set size, a 128-bit hash of the set, and its band hashes, by one pass over the texts."""
    masks, factors = permutations(rule.bands * rule.rows // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, first, second, bands = [], [], [], []
            for text in batch["text"]:
                s = rule.shingles(text.as_py())
                sizes.append(len(s))
                first.append(int(np.bitwise_xor.reduce(mix(s + U64(1)))) if len(s) else 0)
                second.append(int(mix(s ^ U64(0xA5A5A5A5)).sum(dtype=U64)) if len(s) else 0)
                bands.append(signed(band_hashes(signature(s, masks, factors), rule.rows)) if len(s) else np.empty(0, dtype=np.int64))
            both = [pa.array(np.array(x, dtype=U64).view(np.int64)) for x in (first, second)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["nameless"], pa.array(sizes, pa.int64()), *both, list_column(bands, pa.int64())], names=["doc_id", "nameless", "n_shingles", "s1", "s2", "bands"])

    return docs.select(number().alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), "text").mapInArrow(run, SIGNED)


def ties(classes: DataFrame) -> DataFrame:
    """(node, lead): the classes that share a band bucket with another, tied to its smallest id."""
    rows = classes.select("node", F.posexplode("bands").alias("band", "h"))
    bucket = rows.groupBy("band", "h").agg(F.min("node").alias("lead"), F.max("node").alias("other")).where("lead < other").drop("other")
    return rows.join(bucket, ["band", "h"]).where("node <> lead").select("node", "lead").distinct()


def _grouped(members: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Rows and shingles of every group ``key`` of (key, node)."""
    sizes = classes.groupBy("node").agg(F.sum("n_shingles").alias("n_shingles"))
    return members.join(sizes, "node").groupBy(key).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("mass"))


def _blocks(n: str, rows: int, mass: str, shingles: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / rows), F.ceil(F.col(mass) / shingles)).cast("int")


def _with_number(members: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """(lead, node) with the lead's number, 1 where ``sizes`` says no more; only leads of many are joined."""
    return parted_join(members, sizes.where(F.col(name) > 1), "lead", "node", "left").withColumn(name, F.coalesce(name, F.lit(1)))


def _part(parts: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")


def first_units(tied: DataFrame, family: DataFrame, small: DataFrame, classes: DataFrame) -> DataFrame:
    """(whole, key, part, rep, node): whole small families, and followers of larger ones beside representatives."""
    whole = family.join(small, "component", "left_semi").select(F.lit(True).alias("whole"), F.col("component").alias("key"), F.lit(0).alias("part"), F.lit(False).alias("rep"), "node")
    large = tied.join(family.join(small, "component", "left_anti"), "node", "left_semi").groupBy("node").agg(F.min("lead").alias("lead"))
    sizes = _grouped(large, classes, "lead").select("lead", _blocks("n", PART, "mass", 16 * SHINGLES).alias("parts"))
    followers = _with_number(large, sizes, "parts")
    shared = followers.groupBy("lead", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(REPS))).agg(F.min("node").alias("node")).select("lead", "node")
    reps = shared.union(sizes.select("lead", F.col("lead").alias("node"))).join(sizes, "lead").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = F.lit(False).alias("whole"), F.col("lead").alias("key")
    return whole.union(followers.select(*large, _part("parts").alias("part"), F.lit(False).alias("rep"), "node")).union(reps.select(*large, "part", F.lit(True).alias("rep"), "node"))


def block_pairs(groups: DataFrame, component: DataFrame, classes: DataFrame) -> DataFrame:
    """(lead, i, j, own, comp, node): the followers of every lead, once for each pair of blocks they belong to."""
    sizes = _grouped(groups, classes, "lead").select("lead", _blocks("n", BLOCK, "mass", SHINGLES).alias("blocks"))
    homed = _with_number(groups, sizes, "blocks").join(component, "node").select("lead", "node", F.col("component").alias("comp"), "blocks", _part("blocks").alias("own"))
    return homed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lead", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "comp", "node"
    )


def _with_texts(units: DataFrame, docs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``units`` with the texts of their nodes, each unit in one piece; other texts stay where they are."""
    texts = among(docs.select(number().alias("node"), "text"), units.select("node"), "node")
    return texts.join(units.hint("merge"), "node").repartition(*key).sortWithinPartitions(*key, *order)


def _units(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    for batch in pieces(batches):
        yield from zip(*(batch.column(k).to_pylist() for k in range(columns)), strict=True)


def first_links(docs: DataFrame, units: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) within small families, and between followers and representatives."""
    work = _with_texts(units, docs, ["whole", "key", "part"], [F.col("rep").desc(), F.col("node")]).select("whole", "key", "part", "rep", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, past = None, [], [], None
        for whole, key, part, rep, node, text in _units(batches, 6):
            if (whole, key, part) != now:
                yield from _batch(forest(ids, sets, rule.percent) if ids else past.links if past else [])
                now, ids, sets, past = (whole, key, part), [], [], None if whole else Representatives(rule.percent)
            s = rule.shingles(text)
            if past is not None:
                past.meet(node, s, rep)
            elif len(s):
                ids.append(node)
                sets.append(s)
        yield from _batch(forest(ids, sets, rule.percent) if ids else past.links if past else [])

    return work.mapInArrow(run, "a long, b long")


class Representatives:
    """Sets that others stream past. Linked ones are one component, so of a component only its links' first is noted."""

    def __init__(self, percent: int):
        self.percent, self.links = percent, []
        self.ids, self.sets, self.group, self.own = [], [], [], OWN_REPS

    def meet(self, node: int, s: np.ndarray, rep: bool) -> None:
        if not len(s) or node in self.ids:
            return
        mine = None
        for k, other in enumerate(self.sets):
            if self.group[k] != mine and linked(len(s), len(other), common(s, other), self.percent):
                self.links.append((node, self.ids[k]))
                old, mine = self.group[k], self.group[k] if mine is None else mine
                self.group = [mine if g == old else g for g in self.group]
        if rep or mine is None and self.own:
            self.own -= not rep
            self.ids.append(node)
            self.sets.append(s)
            self.group.append(node if mine is None else mine)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def last_links(docs: DataFrame, units: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that span what is connected between the blocks of each unit."""
    key = ["lead", "i", "j"]
    work = _with_texts(units, docs, key, [F.col("node")]).select(*key, "own", "comp", "node", "text")

    def found(now: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own, comps, ids, sets = zip(*rows, strict=True) if rows else ((), (), (), ())
        if len(set(comps)) > 1:  # else they are connected already
            yield from _batch(forest(ids, sets, rule.percent, own if now[1] != now[2] else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for lead, i, j, own, comp, node, text in _units(batches, 7):
            if (lead, i, j) != now:
                yield from found(now, rows)
                now, rows = (lead, i, j), []
            if len(s := rule.shingles(text)):
                rows.append((own, comp, node, s))
        yield from found(now, rows)

    return work.mapInArrow(run, "a long, b long")


def linked(a: int, b: int, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def _batch(links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if links:
        a, b = zip(*links, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def forest(ids: list[int], sets: list[np.ndarray], percent: int, own: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``; with ``own``, only of those between its two blocks."""
    n = len(ids)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    common = np.zeros((n, n), dtype=np.float32)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(start, len(flat)))
    shared = np.repeat(count > 1, count)
    row, column = row[shared], np.repeat(np.arange(int((count > 1).sum())), count[count > 1])
    step = max(256, (8 << 20) // (4 * n))  # columns of the 0/1 matrix held at once
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        held = np.zeros((n, step), dtype=np.float32)
        held[row[lo:hi], column[lo:hi] - at] = 1
        common += held @ held.T
    both = np.rint(common).astype(np.int64)
    hit = linked(sizes[:, None], sizes[None, :], both, percent)
    if own is not None:
        side = np.array(own)
        hit &= side[:, None] != side[None, :]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        p, q = root(int(x)), root(int(y))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((ids[int(y)], ids[int(x)]))
    return out


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept of every row."""
    judged = _judged(docs, rule)
    return judged.select(F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "n_shingles", "class_id", "component_id", "kept")


def _judged(docs: DataFrame, rule: Rule) -> DataFrame:
    """What ``near_duplicates`` returns, with the numbers that stand for missing ids."""
    same_set = ["n_shingles", "s1", "s2"]
    signed_docs = written(signatures(docs, rule), "signatures")
    kinds = signed_docs.where("n_shingles > 0").groupBy(*same_set).agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"))
    classes = written(kinds, "classes")
    members = written(signed_docs.drop("bands").join(classes.drop("bands").withColumnRenamed("node", "class_id"), same_set, "left").drop("s1", "s2"), "members")
    discard(signed_docs)
    tied = written(ties(classes), "ties")
    classes, every_class = written(classes.select("node", "n_shingles"), "class-sizes"), classes
    discard(every_class)
    family = written(components(tied.select(F.col("node").alias("a"), F.col("lead").alias("b"))), "families")
    sizes = _grouped(family, classes, "component")
    small = written(sizes.where((F.col("n") <= BLOCK) & (F.col("mass") <= SHINGLES)).select("component"), "small-families")
    units = written(first_units(tied, family, small, classes), "first-units")
    # rows of one id are one document, whatever their classes
    wordy = members.where("class_id IS NOT NULL")
    twice = wordy.join(wordy.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("_most")).where("b < _most"), "doc_id")
    links = written(first_links(docs, units, rule).union(twice.where("class_id <> b").select("class_id", "b").distinct()), "first-links")
    discard(units)
    found = written(components(links.union(family.select("node", "node"))), "components")
    discard(links)

    wide = tied.join(family.join(small, "component", "left_anti").select("node"), "node", "left_semi")
    with_leads = wide.union(wide.select("lead", "lead").distinct()).join(found, "node")
    open_leads = with_leads.groupBy("lead").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("lead")
    tied_to_open = parted_join(wide, open_leads, "lead", "node", "left_semi")
    groups = written(tied_to_open.union(tied_to_open.select("lead", "lead").distinct()).select("node", "lead"), "open-groups")
    if groups.limit(1).count():
        named = groups.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        units = written(block_pairs(groups, named, classes), "block-pairs")
        links = written(last_links(docs, units, rule), "last-links")
        more = written(components(links.union(found.select("node", "component"))), "components")
        discard(units, links, found)
        found = more
    discard(tied, classes, family, small, groups)
    result = members.join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id", "doc_id")
    return result.select("doc_id", "nameless", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def without_near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that stand for their group: one of each, all without words."""
    judged = written(_judged(docs, rule).where("kept").groupBy("doc_id").agg(F.count_if(F.col("n_shingles") > 0).alias("_wordy")), "kept")
    kept = docs.withColumn("_id", number()).join(judged.withColumnRenamed("doc_id", "_id").hint("merge"), "_id")
    wordless = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, "")) == ""
    alone = kept.where((F.col("_wordy") < 2) | wordless).select(*docs.columns)
    columns = ["text", *[c for c in docs.columns if c != "text"]]
    one = kept.where((F.col("_wordy") > 1) & ~wordless).groupBy("_id").agg(F.min(F.struct(*columns)).alias("_row"))
    return alone.union(one.select(*[F.col(f"_row.{c}").alias(c) for c in docs.columns]))
