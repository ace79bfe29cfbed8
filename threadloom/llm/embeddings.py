"""Near-duplicate embeddings by NN-descent over balls of vectors.

1. Balls. Vectors that are surely linked with each other become one point: a centre
   and the radius, as an angle, that holds them. Two vectors within half the threshold's
   angle of a centre are within the whole of each other, so a ball's own links need no
   comparison. Points are sorted by a random sign code; each stretch of ``STRETCH`` of them
   forms balls greedily, and balls merge in the next rounds, each with a code of its
   own, so a group of any size shrinks up to ``STRETCH``-fold a round and nothing is keyed by
   a group. Copies are a ball of radius 0.
2. First lists. More such passes give every point its ``NEIGHBOURS`` nearest within a stretch, by the
   gap: the least angle that members of both may have.
3. NN-descent (Dong et al., 2011). A round joins every point's neighbours, in both directions,
   with each other; pairs with something new on one side improve both sides' lists.
   A list keeps its nearest and beside them everything that may be
   linked: a list that links saturate grows until it holds all of them.
4. Audit. A fixed number of points, picked by hash, is compared with all points; links
   that their lists miss are counted and added. Below ``RECALL``, or while new links
   come in, further passes and rounds follow.
5. Threshold edges. Single vectors are linked by their cosine in double precision. A ball
   is linked whole, or not at all, where gap and radii prove it for all members; the
   rest is compared member by member, in blocks of ``BLOCK``, of which only counts leave.
6. Links of a vector are those within its ball, those of its points' whole links, and
   those counted; components run over points.

Work is in proportion to rows and links between points. What stays quadratic are two balls
too near to part and too far to prove, in matrix products without an output of pairs.

Defined results
- null or zero vectors, those with null or non-finite components or of another length than
  most (ties: the longer): no links, a component of their own, kept
- null vec_id: linked like others, but names no component; kept where its component has no id
- repeated rows: each is a vector of its own, linked with the others
- cosines at the threshold are linked; empty table: no rows; extra columns are dropped
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .codebooks import common_length, finite, usable
from .common import components, discard, list_column, parted_join, written

STRETCH, BLOCK = 256, 512
BITS = 62
#: Angles within this of a bound are not taken as proof.
SLACK = 1e-7
NONE, SURE, OPEN = 0, 1, 2  # what two points' links are: none, all, or to be compared


@dataclass(frozen=True)
class Rule:
    """Least cosine of a link, length of a list, passes that fill the first lists, and the audit.

    ``audited`` points at most are compared with all others; from ``recall`` on it is content.
    """

    cosine: float = 0.9
    neighbours: int = 8
    passes: int = 8
    audited: int = 512
    recall: float = 0.99
    most_rounds: int = 12

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)


def unit(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of length 1, in double precision."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    return units(x)


def units(x: np.ndarray) -> np.ndarray:
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # by a power of two, which rounds nothing
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def relation(cosines: np.ndarray, r: np.ndarray, s: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Gap and kind of pairs of points with these radii."""
    wide = r + s
    far = angles(cosines)
    kind = np.where(far + wide <= rule.angle - SLACK, SURE, np.where(far - wide > rule.angle + SLACK, NONE, OPEN))
    return far - wide, np.where(wide == 0, np.where(cosines >= rule.cosine, SURE, NONE), kind).astype(np.int8)


def codes(x: np.ndarray, seed: int) -> np.ndarray:
    """Signs of random projections as the bits of a number, the first the highest."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], BITS))
    return ((x @ planes) >= 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


POINT = "point long, vec array<{kind}>, radius double, n long"


def in_stretches(points: DataFrame, seed: int, work, schema: str) -> DataFrame:
    """``work`` on the points of every stretch of a random order in which near points tend to meet."""
    kind = points.schema["vec"].dataType.elementType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes(unit(batch["vec"]), seed))], names=[*batch.schema.names, "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, STRETCH - n))
                batch, n = batch.slice(STRETCH - n), n + held[-1].num_rows
                if n == STRETCH:
                    yield from work(pa.Table.from_batches(held).combine_chunks())
                    held, n = [], 0
        if n:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    named = points.select("point", "vec", "radius", "n").mapInArrow(mark, POINT.format(kind=kind) + ", code long")
    order = ["code", F.xxhash64("point")]
    return named.repartitionByRange(*order).sortWithinPartitions(*order).drop("code").mapInArrow(run, schema)


def greedy_balls(x: np.ndarray, radius: np.ndarray, half: float) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(members, centre, radius) of balls of two and more of these points, the fullest first."""
    far = angles(x @ x.T) + radius[None, :]
    np.fill_diagonal(far, radius)
    within = far <= half - SLACK
    left = np.ones(len(x), dtype=bool)
    while True:
        cover = (within & left[None, :]).sum(axis=1) * left
        best = int(cover.argmax())
        if cover[best] < 2:
            return
        members = np.flatnonzero(within[best] & left)
        centre = units(x[members].mean(axis=0, keepdims=True))[0]
        reach = float((angles(x[members] @ centre) + radius[members]).max())
        around = float(far[best, members].max())
        yield members, *((centre, reach) if reach < around else (x[best], around))
        left[members] = False


def merge_round(points: DataFrame, seed: int, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The points after one round, and the moves (child, parent) it made."""
    element = points.schema["vec"].dataType.elementType.simpleString()
    kind = pa.float32() if element == "float" else pa.float64()
    to = np.float32 if element == "float" else np.float64

    def work(held: pa.Table) -> Iterator[pa.RecordBatch]:
        raw = held["vec"].combine_chunks()
        x = unit(raw)
        points_, radius, n = (held[c].to_numpy() for c in ("point", "radius", "n"))
        alone = np.ones(len(x), dtype=bool)
        parent = points_.copy()
        centres, reaches = {}, {}
        for members, centre, _ in greedy_balls(x, radius, rule.angle / 2):
            stored = centre.astype(to)  # the radius is that of what is stored
            reach = float((angles(x[members] @ units(stored.astype(np.float64)[None, :])[0]) + radius[members]).max())
            if reach > rule.angle / 2 - SLACK:
                continue
            lead = int(points_[members].min())
            parent[members], alone[members] = lead, False
            centres[lead], reaches[lead] = stored, max(reach, SLACK)  # never taken for a single vector
        vec = [centres.get(p, v) if not a else v for p, a, v in zip(parent.tolist(), alone, np.asarray(raw.flatten()).reshape(len(raw), -1), strict=True)]
        wide = [r if a else reaches[p] for p, a, r in zip(parent.tolist(), alone, radius.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(points_), pa.array(parent), list_column(vec, kind), pa.array(wide, pa.float64()), pa.array(n)], names=["child", "point", "vec", "radius", "n"])

    seen = written(in_stretches(points, seed, work, "child long, " + POINT.format(kind=element)), "balls")
    sums = seen.groupBy("point").agg(F.sum("n").alias("n"))
    after = written(seen.where("child = point").drop("n", "child").join(sums, "point").select("point", "vec", "radius", "n"), "points")
    return after, seen.select("child", F.col("point").alias("parent"))


def balls(points: DataFrame, rule: Rule, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """Points whose balls have stopped merging, and the point of every single vector, as (node, point)."""
    moves, n = [], points.count()
    for seed in range(most):
        points, moved = merge_round(points, 1000 + seed, rule)
        moves.append(moved)
        before, n = n, points.count()
        if seed > 1 and n > 0.98 * before:
            break
    home = None
    for moved in reversed(moves):
        # a parent has at most STRETCH children, so no key is hot
        home = moved if home is None else moved.join(home.select(F.col("child").alias("parent"), F.col("parent").alias("_home")), "parent").select("child", F.col("_home").alias("parent"))
        home = written(home, "homes")
    return points, home.select(F.col("child").alias("node"), F.col("parent").alias("point"))


LIST = "p long, q long, gap double, kind byte"


def _entries(p: np.ndarray, q: np.ndarray, gap: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(gap), pa.array(kind.astype(np.int8))], names=["p", "q", "gap", "kind"])


def first_lists(points: DataFrame, seed: int, rule: Rule) -> DataFrame:
    """Entries of the nearest points of each within its stretch."""

    def work(held: pa.Table) -> Iterator[pa.RecordBatch]:
        x, ids, radius = unit(held["vec"].combine_chunks()), held["point"].to_numpy(), held["radius"].to_numpy()
        if len(x) < 2:
            return
        gap, kind = relation(x @ x.T, radius[:, None], radius[None, :], rule)
        np.fill_diagonal(gap, np.inf)
        np.fill_diagonal(kind, NONE)
        k = min(rule.neighbours, len(x) - 1)
        chosen = kind > NONE
        np.put_along_axis(chosen, np.argpartition(gap, k - 1, axis=1)[:, :k], True, axis=1)
        a, b = np.nonzero(chosen)
        yield _entries(ids[a], ids[b], gap[a, b], kind[a, b])

    return in_stretches(points, seed, work, LIST)


def kept_entries(entries: DataFrame, rule: Rule) -> DataFrame:
    """The lists: of each point its nearest entries, and every entry that may be a link."""
    one = entries.groupBy("p", "q").agg(F.min("gap").alias("gap"), F.max("kind").alias("kind"), F.min("born").alias("born"))
    near = F.row_number().over(Window.partitionBy("p").orderBy("gap", "q"))
    return one.withColumn("_r", near).where((F.col("_r") <= rule.neighbours) | (F.col("kind") > NONE)).drop("_r")


def mirrored(entries: DataFrame) -> DataFrame:
    return entries.union(entries.select(F.col("q").alias("p"), F.col("p").alias("q"), "gap", "kind"))


def local_join(points: DataFrame, lists: DataFrame, now: int, rule: Rule) -> DataFrame:
    """Entries among the neighbours of each point, where one side of the pair is new."""
    most = 2 * rule.neighbours
    element = points.schema["vec"].dataType.elementType.simpleString()
    both = lists.select("p", "q", "born").union(lists.select("q", "p", "born")).groupBy("p", "q").agg(F.max("born").alias("born"))
    # of a long list or a much named point, as many a round as two lists hold: the newest, then others by turns
    turn = Window.partitionBy("p").orderBy(F.col("born").desc(), F.xxhash64("p", "q", F.lit(now)))
    some = both.withColumn("_r", F.row_number().over(turn)).where(F.col("_r") <= most).select("p", F.col("q").alias("point"), (F.col("born") == now).alias("fresh"))
    worst = lists.groupBy("p").agg(F.when(F.count("*") >= rule.neighbours, F.max("gap")).alias("worst")).select(F.col("p").alias("point"), "worst")
    known = points.join(worst, "point", "left").select("point", "vec", "radius", F.coalesce("worst", F.lit(4.0)).alias("worst"))
    met = some.join(known, "point").select("p", "point", "fresh", "radius", "worst", "vec").repartition("p").sortWithinPartitions("p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            key = table["p"].to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield from pairs(table.slice(0, last))
            rest = table.slice(last).combine_chunks().to_batches()
            rest = rest[0] if rest else None
        if rest is not None:
            yield from pairs(pa.Table.from_batches([rest]))

    def pairs(held: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids, fresh, radius, worst = (held[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("p", "point", "fresh", "radius", "worst"))
        x = unit(held["vec"].combine_chunks())
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        row, place = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key)))), np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        width = int(place.max()) + 1
        at = np.full((len(start), width), -1, dtype=np.int64)
        at[row, place] = np.arange(len(key))
        full = x[at] @ x[at].transpose(0, 2, 1)
        new, there = fresh[at], at >= 0
        use = (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :] & ~np.eye(width, dtype=bool)
        g, i, j = np.nonzero(use)
        a, b = at[g, i], at[g, j]
        gap, kind = relation(full[g, i, j], radius[a], radius[b], rule)
        good = (gap < worst[a]) | (kind > NONE)
        if good.any():
            yield _entries(ids[a][good], ids[b][good], gap[good], kind[good])

    found = met.mapInArrow(run, LIST)
    return found.groupBy("p", "q").agg(F.min("gap").alias("gap"), F.max("kind").alias("kind"))


def audit(points: DataFrame, lists: DataFrame, rule: Rule) -> tuple[float, DataFrame]:
    """Share of the audited points' links that lists hold, and all of these links as entries.

    Half of the points are any, half are such with a link; they are compared with all points.
    """
    linked = lists.where(F.col("kind") > NONE).select(F.col("p").alias("point")).distinct()
    some = lambda rows, n: rows.orderBy(F.xxhash64("point"), "point").limit(n)
    picked = some(points.select("point"), rule.audited // 2).union(some(linked, rule.audited // 2)).distinct()
    rows = points.join(F.broadcast(picked), "point").collect()  # ``audited`` at most
    if not rows:
        return 1.0, lists.select("p", "q", "gap", "kind").limit(0)
    shared = points.sparkSession.sparkContext.broadcast((np.array([r["point"] for r in rows]), units(np.array([r["vec"] for r in rows], dtype=np.float64)), np.array([r["radius"] for r in rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, radius = shared.value
        for batch in batches:
            if batch.num_rows:
                mine = batch["point"].to_numpy()
                gap, kind = relation(x @ unit(batch["vec"]).T, radius[:, None], batch["radius"].to_numpy()[None, :], rule)
                a, b = np.nonzero((kind > NONE) & (ids[:, None] != mine[None, :]))
                yield _entries(ids[a], mine[b], gap[a, b], kind[a, b])

    true = written(points.select("point", "vec", "radius").mapInArrow(run, LIST), "audited-links")
    have = mirrored(lists.where(F.col("kind") > NONE).select("p", "q", "gap", "kind")).select("p", "q").distinct()
    n, hit = true.count(), true.join(have, ["p", "q"], "left_semi").count()
    return (hit / n if n else 1.0), true


def links(points: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a < b) of points that are linked whole or must be compared, with their kind."""
    first = None
    for seed in range(rule.passes):
        found = first_lists(points, seed, rule)
        first = found if first is None else first.union(found)
    lists, recall = written(kept_entries(mirrored(first).withColumn("born", F.lit(0)), rule), "lists"), 0.0
    for now in range(rule.most_rounds):
        more = mirrored(local_join(points, lists, now, rule)).withColumn("born", F.lit(now + 1))
        after = written(kept_entries(lists.union(more), rule), "lists")
        discard(lists)
        lists = after
        sums = lists.agg(F.count_if(F.col("kind") > NONE).alias("links"), F.count_if((F.col("kind") > NONE) & (F.col("born") == now + 1)).alias("fresh")).first()
        if sums["fresh"] > 0.001 * sums["links"]:
            continue
        recall, true = audit(points, lists, rule)
        if recall >= rule.recall:
            break
        again = first_lists(points, rule.passes + 2 * now, rule).union(first_lists(points, rule.passes + 2 * now + 1, rule)).union(true)
        after = written(kept_entries(lists.union(mirrored(again).withColumn("born", F.lit(now + 1))), rule), "lists")
        discard(lists, true)
        lists = after
    else:
        warnings.warn(f"the audit found a recall of {recall:.3f} after {rule.most_rounds} rounds", stacklevel=2)
    either = lists.where(F.col("kind") > NONE).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "kind")
    return written(either.groupBy("a", "b").agg(F.max("kind").alias("kind")), "point-links")


def compared(nodes: DataFrame, home: DataFrame, open_pairs: DataFrame, rule: Rule) -> DataFrame:
    """Counts (a, b, node, n) of links between the members of open pairs of points, in blocks of members."""
    sizes = home.groupBy("point").agg(F.count("*").alias("_n")).select("point", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    sized = open_pairs.join(sizes.select(F.col("point").alias("a"), F.col("blocks").alias("na")), "a").join(sizes.select(F.col("point").alias("b"), F.col("blocks").alias("nb")), "b")
    in_pair = home.join(open_pairs.select(F.col("a").alias("point")).union(open_pairs.select("b")).distinct(), "point").join(sizes, "point")
    members = in_pair.select("point", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    members = members.join(nodes.select("node", "vec"), "node")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sized.withColumn("j", all_of("nb")).join(members.withColumnRenamed("point", "a"), "a").select("a", "b", F.col("own").alias("i"), "j", F.lit(0).alias("side"), "node", "vec")
    right = sized.withColumn("i", all_of("na")).join(members.withColumnRenamed("point", "b"), "b").select("a", "b", "i", F.col("own").alias("j"), F.lit(1).alias("side"), "node", "vec")
    units_ = left.union(right).repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("a", "b", "i", "j")), strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != now:
                    yield from count(now, held)
                    now, held = keys[at], []
                held.append(batch.slice(at, end - at))
                at = end
        yield from count(now, held)

    def count(now: tuple | None, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        x, node, side = unit(table["vec"].combine_chunks()), table["node"].to_numpy(), table["side"].to_numpy()
        hit = x[side == 0] @ x[side == 1].T >= rule.cosine
        who = np.concatenate([node[side == 0], node[side == 1]])
        n = np.concatenate([hit.sum(axis=1), hit.sum(axis=0)]).astype(np.int64)
        who, n = who[n > 0], n[n > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), v)) for v in now[:2]] + [pa.array(who), pa.array(n)], names=["a", "b", "node", "n"])

    return units_.mapInArrow(run, "a long, b long, node long, n long")


def near_duplicates(vectors: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    whole = usable(rows).where(F.exists("embedding", lambda x: x != 0))
    length = common_length(whole)
    fit = finite() & (F.size("embedding") == length) & F.exists("embedding", lambda x: x != 0)
    nodes = written(rows.select(F.monotonically_increasing_id().alias("node"), "vec_id", F.when(fit, F.col("embedding")).alias("vec")), "vectors")
    points = nodes.where("vec IS NOT NULL").select(F.col("node").alias("point"), "vec", F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("n"))
    alone = nodes.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if points.isEmpty():
        return alone
    points, home = balls(points, rule)
    linked = links(points, rule)
    whole_links, open_links = linked.where(F.col("kind") == SURE), linked.where(F.col("kind") == OPEN)
    counted = written(compared(nodes, home, open_links, rule), "counted-links")

    edges = whole_links.select("a", "b").union(counted.select("a", "b").distinct()).union(points.select("point", "point"))
    group = written(components(edges).select(F.col("node").alias("point"), "component"), "components")
    n = points.select("point", "n")
    weighed = whole_links.select(F.col("a").alias("p"), F.col("b").alias("point")).union(whole_links.select("b", "a")).join(n, "point").groupBy(F.col("p").alias("point")).agg(F.sum("n").alias("beside"))
    of_point = written(n.join(weighed, "point", "left").join(group, "point").select("point", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("all"), "component"), "point-sums")
    ids = nodes.where("vec IS NOT NULL").select("node", "vec_id").join(home, "node")
    ids = written(parted_join(ids, of_point, "point", "node"), "rows")
    least = written(ids.groupBy("component").agg(F.min("vec_id").alias("component_id")), "least-ids")
    own = counted.groupBy("node").agg(F.sum("n").alias("counted"))
    full = parted_join(ids.join(own, "node", "left"), least, "component", "node")
    result = full.select("vec_id", (F.col("all") + F.coalesce("counted", F.lit(0))).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return written(result, "embedding-links").union(alone)  # written, so that its joins have the settings of a write
