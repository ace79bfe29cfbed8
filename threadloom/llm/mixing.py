"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every source gets a target in words. Complete epochs come first: a source is
taken whole as often as it fits into its target. The rest is a weighted sample
without replacement: documents get exponential keys divided by their quality
weight, are sorted by them within the source and taken while the prefix sum
of their sizes comes nearer to the rest of the target. Where a document is passed
over because it would overshoot, later ones in that order fill what it leaves:
each that brings the sum nearer to the rest.

Defined results
- null source: a source of its own, last in order; null text: size 0
- size 0: such a document is taken 0 words whatever its key
- quality weight that is null, NaN, infinite, zero or negative: counts as 1
- very long texts: one that would overshoot a target is passed over
- ties of keys: by doc_id, then by a hash of the text; repeated rows each count
- empty table: no rows; extra columns are dropped, so names cannot clash
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cuts_below, written

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: The solved targets and cuts of all sources are broadcast up to so many numbers, 16 MB.
BROADCAST_NUMBERS = 2_000_000
#: Rows of a source that one task sorts, and the fewest and most parts of a source.
BIN_ROWS, FEWEST_BINS, MOST_BINS = 100_000, 64, 1 << 16
SOURCE = ["_src", "_null"]
CELL = [*SOURCE, "_bin"]


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> dict[str | None, Fraction]:
    """Words each source is to give. Sources by code point, null last, get ``weights`` in turn
    and share all words; a target stops at ``most`` times its source, and the excess is
    shared anew by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: Fraction(weights[i % len(weights)]) for i, (name, _) in enumerate(order)}
    size = dict(order)
    total, full, out = sum(size.values()), set(), {}
    while True:
        left = total - sum(most * size[n] for n in full)
        open_weight = sum(weight[n] for n in size if n not in full)
        out = {n: Fraction(most * size[n]) if n in full else left * weight[n] / open_weight for n in size}
        above = {n for n in size if n not in full and out[n] > most * size[n]}
        if not above:
            return out
        full |= above


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def unit(*columns) -> Column:
    """A reproducible number in (0, 1) for each row."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def label_weights(labels: DataFrame) -> DataFrame:
    """doc_id and the weight of its label: 2.0 for quality 1, 0.5 for quality 0, else 1."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("quality"))


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, bins: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and epochs of every row, and what ``carry`` names.

    ``quality`` holds weights (doc_id, quality); several of one id are averaged.

    Texts are read once, or twice to carry them. Words are summed by source: one row a
    source goes to the driver, where the targets are solved. Then no source is sorted
    in one task: approximate quantiles of its keys, whatever their weights, cut it
    into ``bins``, whose sums place each bin, and rows are sorted within (source, bin)
    only. What fills a gap is found on sizes alone, by ``fillers``.
    """
    spark = docs.sparkSession
    own = unit(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).alias("_u")
    base = docs.select("doc_id", "source", *carry, own)
    rows = docs.select("doc_id", "source", words().alias("size"), own)
    weight = F.lit(1.0)
    if quality is not None:
        rows = rows.join(quality.groupBy("doc_id").agg(F.avg("quality").alias("_q")), "doc_id", "left")
        weight = F.when((F.col("_q") > 0) & (F.col("_q") < float("inf")) & ~F.isnan("_q"), F.col("_q")).otherwise(1.0)
    rows = rows.withColumn("_key", -F.log("_u") / weight).select("doc_id", "source", "size", "_u", "_key")
    narrow = written(rows, "sizes")  # a few dozen bytes a row
    sums = [(r["source"], int(r["n"]), r["rows"]) for r in narrow.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()]
    goal = targets([(name, size) for name, size, _ in sums], weights, most)
    bins = bins or min(MOST_BINS, max(FEWEST_BINS, max((n for *_, n in sums), default=0) // BIN_ROWS))
    plan = []
    for name, size, _ in sums:
        epochs = int(goal[name] // size) if size else 0
        plan.append((name, size, float(goal[name]), epochs, int(round(goal[name] - epochs * size))))
    solved = spark.createDataFrame(plan, "_s string, source_size long, target double, _epochs int, _rest long")
    shares = [k / bins for k in range(1, bins)] or [0.5]
    cuts = narrow.groupBy("source").agg(F.percentile_approx("_key", shares, max(1_000, 4 * bins)).alias("_cuts"))
    known = written(solved.join(cuts, F.col("source").eqNullSafe(F.col("_s"))).drop("source"), "sources")
    few = F.broadcast if len(plan) * bins <= BROADCAST_NUMBERS else lambda rows: rows  # beyond, a join that AQE may split at hot sources
    known = few(known)

    def keyed(rows: DataFrame) -> DataFrame:
        return (
            rows.join(known, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("_bin", cuts_below(F.col("_cuts"), F.col("_key"), bins))
            .withColumn("_src", F.coalesce("source", F.lit("")))
            .withColumn("_null", F.col("source").isNull())
            .drop("_cuts")
        )

    sizes = keyed(narrow).groupBy(*CELL).agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy(*SOURCE).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*CELL, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))

    def place(rows: DataFrame) -> DataFrame:
        """Rows with their source's plan, and where each begins and stands in the order of keys."""
        within = Window.partitionBy(*CELL).orderBy("_key", "doc_id", "_u")
        summed = keyed(rows).withColumn("_end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", F.row_number().over(within))
        # taken while it brings the sum nearer to the rest: at least half of the row lies before it
        open_ = (F.col("_epochs") < most) & (F.col("size") > 0)
        near = (2 * (F.col("_rest") - F.col("_begin")) >= F.col("size")) & (F.col("_rest") > F.col("_begin"))
        return (
            summed.join(starts, CELL)
            .withColumn("_begin", F.col("_start") + F.col("_end") - F.col("size"))
            .withColumn("_open", open_)
            .withColumn("_chosen", open_ & near)
        )

    more = few(written(fillers(place(narrow), few), "fillers"))  # a few rows a source
    placed = place(narrow).join(more, [*CELL, "_at"], "left")
    chosen = F.col("_chosen") | F.col("_fills").isNotNull()
    least = F.when(F.col("size") > 0, F.col("_epochs")).otherwise(0)
    rows = placed.select("doc_id", "source", "_u", "size", "source_size", "target", least.alias("_least"), ((F.col("size") > 0) & chosen).alias("_more"))
    if carry:
        rows = _beside_texts(rows, base, carry)
    times = F.col("_least") + F.col("_more").cast("int")
    return rows.select("doc_id", "source", *carry, "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.alias("epochs"))


def _beside_texts(decided: DataFrame, base: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """What was decided beside the columns of ``carry``. Texts move once, to the decision on their id, source
    and text; of rows alike in these as many are taken as were chosen, the first by their other columns."""
    key = {"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_no_id": F.col("doc_id").isNull(), "_src": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()}
    names = [*key, "_u"]
    told = [F.first(c).alias(c) for c in ("size", "source_size", "target", "_least")]
    sums = decided.withColumns(key).groupBy(*names).agg(*told, F.count_if("_more").alias("_chosen"))
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(*[c for c in carry if c != "text"] or [F.lit(0)]))
    return base.withColumns(key).join(sums.hint("merge"), names).withColumn("_more", nth <= F.col("_chosen"))


def fillers(placed: DataFrame, few: Callable[[DataFrame], DataFrame] = F.broadcast) -> DataFrame:
    """Places (source, bin, rank) of the rows that fill what a row passed over leaves of its source's rest.

    Later rows are met in order; one of at most twice what is left is taken. Such a
    row was preceded only by taken ones among those of its size or less, so with
    a gap of g words none comes after the first g / size + 1 of its own size. That
    bounds what one task sees of a source by about g log g rows, whatever its size.
    """
    gap = placed.where(F.col("_open") & ~F.col("_chosen") & (F.col("_begin") < F.col("_rest"))).select(*SOURCE, (F.col("_rest") - F.col("_begin")).alias("_gap"))
    able = placed.where(F.col("_open") & (F.col("_begin") >= F.col("_rest"))).select(*CELL, "_at", "size").join(few(gap), SOURCE)
    able = able.where(F.col("size") <= 2 * F.col("_gap"))
    for alike in (Window.partitionBy(*CELL, "size").orderBy("_at"), Window.partitionBy(*SOURCE, "size").orderBy("_bin", "_at")):
        able = able.withColumn("_nth", F.row_number().over(alike)).where(F.col("_nth") <= F.floor(F.col("_gap") / F.col("size")) + 1)

    listed = able.groupBy(*SOURCE).agg(F.first("_gap").alias("_gap"), F.sort_array(F.collect_list(F.struct("_bin", "_at", "size"))).alias("_rows"))

    def meet(state: Column, row: Column) -> Column:
        left, size = state["left"], row["size"]
        taken = F.struct((left - size).alias("left"), F.concat(state["took"], F.array(F.struct(row["_bin"].alias("_bin"), row["_at"].alias("_at")))).alias("took"))
        return F.when((left > 0) & (size <= 2 * left), taken).otherwise(state)

    start = F.struct(F.col("_gap").cast("long").alias("left"), F.array().cast("array<struct<_bin:int,_at:int>>").alias("took"))
    took = listed.select(*SOURCE, F.explode(F.aggregate("_rows", start, meet)["took"]).alias("_t"))
    return took.select(*SOURCE, F.col("_t._bin").alias("_bin"), F.col("_t._at").alias("_at"), F.lit(True).alias("_fills"))
