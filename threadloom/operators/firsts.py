"""Keep-first among near-copies for groups of any size: bits or an index of what near items must share, and ordered rounds.

The folds of ``functions.text.keep_first`` compare each item of a row with all kept
ones, which suits tens of items. Here items are rows and a group may hold any share of
them. For ``alike`` all pairs of a group and of like size meet, by bits; for ``told_once`` only items with
a common bucket: heads of 40 and 80 characters.
The results are those of the folds. Both functions take rows (group, place, text):
items with a null or blank text are dropped, null groups are one group, a null place
comes first, items of one place are in order of their text, repeated rows are one
item, other columns are left out; no rows give none.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parity
from ..functions import text as T
from ..functions.bitmap import among
from ..session import delete_scratch, scratch

HEAD, START = 40, 80  # fixed values: what counts as told again
FRONT = 64
TURNS = 16
#: Items of a group that meet as one part, parts that meet all others in a turn, and links that the driver follows at once.
LEAST, MOST, ABREAST, DRIVEN = 4096, 1 << 16, 16, 1 << 20


def alike(rows: DataFrame, group: str, place: str, text: str, threshold: float = 0.55, front: int = 16) -> DataFrame:
    """(group, place, text) of the items that no kept item before repeats to a Jaccard likeness of ``threshold``.

    Texts come back with single spaces. Tokens are compared by 64-bit hashes. An item's
    bits are the parities of its tokens dealt to a power of two of slots, four times as many as
    tokens at least: two items differ in no fewer tokens than bits, so most pairs are told apart
    by their bits alone (``functions.parity``), a few numbers a pair, in any order of frequencies. What the bits leave is compared by tokens.
    Each round gives an undecided item its first ``front`` earlier ones by bits, and the next goes on behind them.
    """
    def load(shown: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(T.content_tokens(shown), lambda t: F.xxhash64(t))))

    items = _items(rows, group, place, text, T.collapse).withColumn("_tokens", load(F.col("_text")))
    key = F.when(F.size("_tokens") == 0, F.concat(F.lit("k"), T.norm_key(F.col("_text")))).otherwise(F.array_join("_tokens", ","))
    items = _classes(items, key, load)
    spare: list[str] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        df, path = _written(df, name)
        if name != "firsts-kept":
            spare.append(path)
        return df

    def compare(both: DataFrame) -> DataFrame:
        loads = items.select("_id", "_g", "_load")
        mine = among(loads, both.select("_id"), "_id")
        theirs = among(loads, both.select(F.col("_id_by").alias("_id")), "_id").select(F.col("_id").alias("_id_by"), F.col("_g").alias("_g_by"), F.col("_load").alias("_load_by"))
        met = both.join(mine, "_id").join(theirs, "_id_by")
        return met.where((F.col("_g") == F.col("_g_by")) & (T.jaccard(F.col("_load_by"), F.col("_load")) >= threshold)).select("_id", "_id_by")

    made = items.where(F.size("_load") > 0).select("_id", F.xxhash64("_g").alias("_bucket"), "_load").mapInArrow(parity.bits, parity.BITS)
    bits = written(made, "firsts-bits")
    most = min(MOST, max(LEAST, -(-bits.count() // 24)))
    large = bits.groupBy("_bucket").agg(F.ceil(F.count("*") / most).cast("int").alias("_of")).where("_of > 1").collect()  # a row for ``most`` items at most
    parts = items.sparkSession.createDataFrame(large, "_bucket long, _of int")
    todo, gone, pending = items.select("_id"), None, None
    ranked = _parted(bits.drop("_bits"), parts).select("_id", "_bucket", "_n", F.lit(0).cast("long").alias("_at"), F.pmod(F.xxhash64("_id"), F.col("_of")).cast("int").alias("_rank"))
    kept: list[DataFrame] = []
    while True:
        done = list(spare[1:])
        ranked = written(ranked, "firsts-ranked")
        pairs = _met(ranked, bits, parts, max([r["_of"] for r in large], default=1), threshold, front, written)
        nth = F.row_number().over(Window.partitionBy("_id").orderBy("_id_by"))
        met = written(pairs.withColumn("_nth", nth).where(F.col("_nth") <= front), "firsts-met")
        links = written(compare(met.select("_id", "_id_by")), "firsts-links")
        links = links if pending is None else links.union(pending)
        more = met.where(F.col("_nth") == front).select("_id", (F.col("_id_by") + 1).alias("_at"))
        waiting = written(links.select("_id").union(more.select("_id")).distinct(), "firsts-waiting")
        kept.append(written(todo.join(waiting, "_id", "left_anti"), "firsts-kept"))
        sure, gone, pending, todo = _decided(links, waiting, more.select("_id"), written)
        kept += sure
        if todo.isEmpty():
            break
        open_ = written(more.join(todo, "_id", "left_semi"), "firsts-open")
        ranked = ranked.drop("_at").join(gone, "_id", "left_anti").join(open_, "_id", "left").select("_id", "_bucket", "_n", "_at", "_rank")
        ranked = ranked.join(ranked.where("_at IS NOT NULL").select("_bucket").distinct(), "_bucket", "left_semi")
        front *= 4
        for path in done:  # what rounds before the last one read
            delete_scratch(items.sparkSession, path)
            spare.remove(path)
    for path in spare:
        delete_scratch(items.sparkSession, path)
    chosen = kept[0]
    for other in kept[1:]:
        chosen = chosen.union(other)
    return items.join(chosen, "_id", "left_semi").select("_group", "_place", "_text").toDF(group, place, text)


def _parted(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """With the number of parts that the row's group is dealt to."""
    return rows.join(F.broadcast(parts), "_bucket", "left").withColumn("_of", F.coalesce("_of", F.lit(1)))


def _met(ranked: DataFrame, bits: DataFrame, parts: DataFrame, most: int, threshold: float, front: int, written: Callable) -> DataFrame:
    """(_id, _id_by): of each open item (one with an ``_at``), at most ``front`` earlier ones a task that are near by their bits, from ``_at`` on.
    A task has two parts of a group; ``ABREAST`` parts meet all others in a turn, so that an item is on disk for as many tasks and no more."""
    spark, pairs = ranked.sparkSession, None
    whole = _parted(ranked, parts).join(bits.select("_id", "_bits"), "_id")
    for turn in range(0, most, ABREAST):
        other = F.explode(F.sequence(F.lit(0), F.col("_of") - 1))
        each = whole.where(F.col("_of") > turn).withColumn("_other", other).withColumn("_lo", F.least("_rank", "_other")).withColumn("_hi", F.greatest("_rank", "_other"))
        each = each.where(F.col("_lo").between(turn, turn + ABREAST - 1)).select("_bucket", "_lo", "_hi", "_id", "_n", "_at", "_rank", "_bits")
        tasks = min(ABREAST, most) * most * 2
        dealt = each.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_bucket", "_lo", "_hi").sortWithinPartitions("_bucket", "_lo", "_hi")
        part = written(dealt.mapInArrow(parity.meeting(threshold, front), "_id long, _id_by long"), "firsts-pairs")
        pairs = part if pairs is None else pairs.union(part)
    return pairs


def _decided(links: DataFrame, waiting: DataFrame, more: DataFrame, written: Callable) -> tuple[list[DataFrame], DataFrame, DataFrame, DataFrame]:
    """(kept, gone, links left, waiting left): an item goes that has a link to a kept one, and is kept once all it has links to are gone,
    unless it has ``more`` to meet. Every item that is linked to and not waiting is kept. Many links are followed a step at a time, few at once by the driver."""
    spark, kept, lost = waiting.sparkSession, [], []
    theirs = lambda df: df.select(F.col("_id").alias("_id_by"))
    while links.count() + waiting.count() > DRIVEN:
        gone = written(links.join(theirs(waiting), "_id_by", "left_anti").select("_id").distinct(), "firsts-gone")
        links = written(links.join(gone, "_id", "left_anti").join(theirs(gone), "_id_by", "left_anti").select("_id", "_id_by"), "firsts-left")
        sure = written(waiting.join(gone, "_id", "left_anti").join(more, "_id", "left_anti").join(links.select("_id"), "_id", "left_anti"), "firsts-kept")
        left = written(waiting.join(gone, "_id", "left_anti").join(sure, "_id", "left_anti"), "firsts-waiting")
        kept.append(sure)
        lost.append(gone)
        still = sure.isEmpty() and gone.isEmpty()
        waiting = left
        if still:
            break
    else:
        own, by = (links.toArrow()[c].to_numpy() for c in ("_id", "_id_by"))  # ``DRIVEN`` rows at most
        mine = waiting.select("_id").toArrow()["_id"].to_numpy()
        sure, gone, left, rest = parity.followed(own, by, mine, set(more.join(waiting, "_id", "left_semi").toArrow()["_id"].to_pylist()))
        table = lambda **columns: spark.createDataFrame(pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()}))
        kept.append(written(table(_id=sure), "firsts-kept"))
        lost.append(written(table(_id=gone), "firsts-gone"))
        waiting = written(table(_id=left), "firsts-waiting")
        links = written(table(_id=own[rest], _id_by=by[rest]), "firsts-left")
    all_gone = lost[0]
    for other in lost[1:]:
        all_gone = all_gone.union(other)
    return kept, all_gone, links, waiting


def told_once(rows: DataFrame, group: str, place: str, text: str, front: int = FRONT) -> DataFrame:
    """(group, place, text) of the items that tell what no kept item before tells, by ``functions.text.overlap_keys``.

    Texts come back as they are. Buckets are the first 80 characters, and every
    window of 40 characters with which an item of the group begins; a bitmap of these
    beginnings keeps most other windows from the join.
    """
    items = _items(rows, group, place, text, lambda c: c)
    items = _classes(items, T.norm_key(F.col("_text")), T.norm_key)
    x = F.col("_load")
    count = F.length(x) - (HEAD - 1)
    windows = F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64("_g", F.substr(x, i, F.lit(HEAD))))))
    heads = items.where(count > 0).select(F.xxhash64("_g", F.substring("_load", 1, HEAD)).alias("_bucket")).distinct()
    inner = among(items.select("_id", F.explode(windows).alias("_bucket")), heads, "_bucket").join(heads, "_bucket", "left_semi")
    start = items.select("_id", F.xxhash64(F.lit("start"), "_g", F.substring("_load", 1, START)).alias("_bucket"))
    members = inner.select("_id", "_bucket").union(start).select("_id", "_bucket")
    return _kept(items, members, T.overlap_keys, front).toDF(group, place, text)


def _items(rows: DataFrame, group: str, place: str, text: str, shown: Callable[[Column], Column]) -> DataFrame:
    of = F.md5(F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("null")))
    return rows.where(~T.blank(F.col(text))).select(F.col(group).alias("_group"), of.alias("_g"), F.col(place).alias("_place"), shown(F.col(text)).alias("_text"))


def _classes(items: DataFrame, key: Column, load: Callable[[Column], Column]) -> DataFrame:
    """The first item of each (group, key), written, with what it is compared by and a number in the order of places and texts.
    Items of one key are near the same others, so that a later one is kept never: either the first is, or what drops it drops both."""
    keyed = items.withColumn("_key", F.unhex(F.md5(F.concat_ws(":", "_g", key))))
    firsts = keyed.groupBy("_key", "_g").agg(F.min(F.struct("_place", "_text", "_group")).alias("_first")).select("_key", "_g", "_first.*")
    order = [F.col("_place").asc_nulls_first(), F.col("_text"), F.col("_key")]
    # the numbers of sorted ranges rise from one to the next
    numbered = firsts.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("_id"), "_g", "_group", "_place", "_text")
    return _written(numbered.withColumn("_load", load(F.col("_text"))), "firsts-items")[0]


#: Settings of each write: shuffle files go when it ends, Python workers get small batches, and the driver builds no large relations.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.autoBroadcastJoinThreshold": "256k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "256k",
}


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def _kept(items: DataFrame, members: DataFrame, near: Callable[[Column, Column], Column], front: int) -> DataFrame:
    """Group, place and text of the items kept.

    Ordered rounds over what is undecided, written each. An item of which every bucket holds at most
    ``front`` earlier ones has met all that could drop it: it is kept where none of
    them is near, and what is near a kept one goes. The first undecided item
    is always such a one, and an item alone in its buckets is kept at once. A round compares at most ``front`` + 1 pairs a member, however
    large a bucket; where a round decides little, the next compares four times as many.
    Pairs are made in ``TURNS`` turns, so that no more than a part of their repeats is on disk.
    Members are (_id, _bucket); buckets of different groups may meet, their items don't.
    """
    spark = items.sparkSession
    loads = items.select("_id", "_g", "_load")
    spare: list[str] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        df, path = _written(df, name)
        if name != "firsts-kept":
            spare.append(path)
        return df

    kept: list[DataFrame] = []
    open_, todo, left = members, items.select("_id"), items.count()
    while left:
        done = list(spare)
        within = Window.partitionBy("_bucket").orderBy("_id")
        placed = open_.withColumn("_rank", F.row_number().over(within)).withColumn("_next", F.lead("_id").over(within))
        ranked = written(placed.where((F.col("_rank") > 1) | F.col("_next").isNotNull()).drop("_next"), "firsts-ranked")
        early = ranked.where(F.col("_rank") <= front + 1).select("_bucket", *[F.col(c).alias(f"{c}_by") for c in ("_id", "_rank")])
        pairs = None
        for turn in range(TURNS):
            own = ranked.where(F.pmod(F.xxhash64("_id"), F.lit(TURNS)) == turn)
            each = own.join(early, "_bucket").where(F.col("_rank_by") < F.col("_rank"))
            part = written(each.select("_id", "_id_by").distinct(), "firsts-pairs")
            pairs = part if pairs is None else pairs.union(part)
        both = pairs.join(loads, "_id").join(loads.select(F.col("_id").alias("_id_by"), F.col("_g").alias("_g_by"), F.col("_load").alias("_load_by")), "_id_by")
        links = written(both.where((F.col("_g") == F.col("_g_by")) & near(F.col("_load_by"), F.col("_load"))).select("_id", "_id_by"), "firsts-links")
        unmet = ranked.where(F.col("_rank") > front + 1).select("_id").distinct()
        met = todo.join(unmet, "_id", "left_anti")
        sure = written(met.join(links.select("_id"), "_id", "left_anti"), "firsts-kept")
        gone = links.join(sure.select(F.col("_id").alias("_id_by")), "_id_by", "left_semi").select("_id").distinct()
        decided = written(sure.union(gone), "firsts-decided")
        kept.append(sure)
        n = decided.count()
        if n * 4 < left:
            front *= 4
        left -= n
        if left:
            open_ = ranked.drop("_rank").join(decided, "_id", "left_anti")
            todo = written(todo.join(decided, "_id", "left_anti"), "firsts-todo")
        for path in done:  # what rounds before the last one read
            delete_scratch(spark, path)
            spare.remove(path)
    for path in spare:
        delete_scratch(spark, path)
    if not kept:
        return items.select("_group", "_place", "_text")
    chosen = kept[0]
    for more in kept[1:]:
        chosen = chosen.union(more)
    return items.join(chosen, "_id", "left_semi").select("_group", "_place", "_text")
