"""Transcripts to bounded, overlapping chunks. Narrow: one row in, its chunks out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Chunking:
    chunk: int = 6000
    overlap: int = 500
    whole: int = 4500  # up to this length a text stays one chunk
    shorten: bool = False  # whether a line longer than a chunk loses its end; else it is split and nothing is lost


def _pack(items: Column, joiner: str, most: int, cut: bool) -> Column:
    """Greedy packing of items into pieces of at most ``most`` characters, as {done, open}.

    An item longer than that stands alone; with ``cut`` it is shortened to fit.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, item: Column) -> Column:
        joined = F.when(acc["open"] == "", item).otherwise(F.concat(acc["open"], F.lit(joiner), item))
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        alone = F.substring(item, 1, most) if cut else item
        return F.when(F.length(joined) <= most, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(closed.alias("done"), alone.alias("open")))

    return F.aggregate(items, start, step)


def _flush(acc: Column) -> Column:
    return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))


def _split_long(items: Column, most: int) -> Column:
    """Items with those longer than ``most`` characters split into pieces of that length."""
    parts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda i: F.substr(x, i * most + 1, F.lit(most)))
    return F.flatten(F.transform(items, parts))


def paragraph_chunks(text: Column, most: int, shorten: bool = False) -> Column:
    """Paragraphs packed greedily; a paragraph that is too long is packed by lines, on its own,
    and a line that is too long is shortened or split."""
    bare = T.strip(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n"))
    trimmed = lambda parts: F.filter(F.transform(parts, T.strip), lambda p: p != "")
    paragraphs = trimmed(F.split(bare, rf"\n{T.SPACES}*\n+"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        closed = _flush(acc)
        lines = trimmed(F.split(p, "\n"))
        by_line = F.concat(closed, _flush(_pack(lines if shorten else _split_long(lines, most), "\n", most, cut=shorten)))
        return (
            F.when(F.length(joined) <= most, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .when(F.length(p) <= most, F.struct(closed.alias("done"), p.alias("open")))
            .otherwise(F.struct(by_line.alias("done"), F.lit("").alias("open")))
        )

    return F.aggregate(paragraphs, start, step, _flush)


def with_overlap(chunks: Column, overlap: int) -> Column:
    """Each chunk after the tail of the one before it, as that came out; not where it already begins so."""

    def step(out: Column, chunk: Column) -> Column:
        before = F.element_at(out, -1)
        tail = F.when(F.length(before) <= overlap, before).otherwise(T.lstrip(F.right(before, F.lit(overlap))))
        carried = F.when((tail == "") | chunk.startswith(tail), chunk).otherwise(F.concat(tail, F.lit("\n\n"), chunk))
        return F.when(F.size(out) == 0, F.array(chunk)).otherwise(F.concat(out, F.array(carried)))

    return F.aggregate(chunks, F.array().cast("array<string>"), step)


def chunk_transcripts(df: DataFrame, key: str, text: str = "text", options: Chunking = Chunking()) -> DataFrame:
    """(key, chunk_index, chunk_total, strategy, chunk, n_chars, content_hash); no shuffle.

    Texts up to ``options.whole`` are one chunk. The trimmed text is a projection
    of its own, so that it is made once a row.
    """
    bare = F.col("_bare")
    rows = df.select(key, T.strip(F.coalesce(text, F.lit(""))).alias("_bare")).where(bare != "")
    short = F.length(bare) <= options.whole
    chunks = F.when(short, F.array(bare)).otherwise(with_overlap(paragraph_chunks(bare, options.chunk, options.shorten), options.overlap))
    cut = rows.select(key, F.when(short, F.lit("short_circuit")).otherwise(F.lit("paragraph_chunk_overlap")).alias("strategy"), chunks.alias("_c"))
    # the outer form, though no list is empty: the other one gets a filter by size, below which all chunks are cut a second time
    flat = cut.select(key, "strategy", F.size("_c").alias("chunk_total"), F.posexplode_outer("_c").alias("chunk_index", "chunk")).where("chunk IS NOT NULL")
    return flat.select(key, "chunk_index", "chunk_total", "strategy", "chunk", F.length("chunk").alias("n_chars"), T.content_hash(F.col("chunk")).alias("content_hash"))


def merge_sparse(chunks: Column, most: int) -> Column:
    """Non-blank chunks joined into one, or into two halves."""
    kept = F.filter(chunks, lambda c: ~T.blank(c))
    half = F.floor(F.size(kept) / 2).cast("int")
    join = lambda part: F.array_join(part, "\n\n")
    two = F.array(join(F.slice(kept, F.lit(1), half)), join(F.slice(kept, half + 1, F.size(kept))))
    return F.when(F.size(kept) <= most, kept).otherwise(F.array(join(kept)) if most == 1 else two)


def longest_chunk(chunks: Column) -> Column:
    """The longest; the first of equals."""
    placed = F.transform(chunks, lambda c, i: F.struct(F.length(c).alias("n"), (-i).alias("i"), c.alias("c")))
    return F.coalesce(F.array_max(placed)["c"], F.lit(""))
