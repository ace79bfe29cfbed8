"""Source divergence audit: how far apart the sources of a language are, and by which terms.

Plain relational: regular expression matches are exploded and counted once by
(lang, source, term); counts of a language and its kept vocabulary follow from
these counts. Every group meets every kept term of its language, so that absent
terms count as zeros; the dense table joins itself on language and term for pairs of
sources, and the counts of its language for terms. All arithmetic is exact.

A document's terms are sorted first, so that one flag a match tells a term's first
occurrence in its document; so documents and occurrences are counted by the same
shuffle, partly aggregated before it. Nothing is keyed by language or source alone
but sums of a group: terms meet the groups of their language by a broadcast
of the groups, or dealt out in parts where there are more than ``GROUPS``.

Defined results
- null text, lang or source: the empty string
- a text without terms: its group still occurs; a language without kept terms gives pairs of value 0
- one source in a language: no pairs; ties of value: by item; repeated rows: each counts
- empty table: no rows; extra columns are dropped
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, discard, written

#: What parts terms; the matches of the opposite class are what lies between. Splitting takes a sixth of matching's time.
PARTING = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most groups that are broadcast, a few bytes each; more are joined in parts.
GROUPS = 100_000


@dataclass(frozen=True)
class Rule:
    """Fewest documents of a kept term, scale and smoothing of shares, and ranks of terms."""

    documents: int = 10
    scale: int = 1_000_000_000
    smooth: int = 2
    ranks: int = 10


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, in_docs of every group; a null term counts nothing."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    found = F.sort_array(F.split(text, PARTING))
    own = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), found.alias("_found"))
    before = F.slice(F.concat(F.array(F.lit("")), "_found"), F.lit(1), F.size("_found"))
    each = own.select("lang", "source", F.explode(F.arrays_zip(F.col("_found").alias("term"), before.alias("before"))).alias("_t"))
    term = F.when(F.col("_t.term") != "", F.col("_t.term"))  # null before the first and after the last
    counted = each.select("lang", "source", term.alias("term"), (F.col("_t.before") != F.col("_t.term")).cast("int").alias("_first"))
    return counted.groupBy("lang", "source", "term").agg(F.count("term").alias("n"), F.sum("_first").alias("in_docs"))


def share(n: str, total: str, terms: str, rule: Rule):
    """1 + floor(scale * (n + smooth) / (total + smooth * terms)), in decimals of 38 digits."""
    return F.expr(f"1 + (cast({n} + {rule.smooth} as decimal(20,0)) * {rule.scale}) div ({total} + {rule.smooth} * {terms})").cast("long")


def distance(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _with_groups(terms: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Every term beside every group of its language."""
    if few:
        return terms.join(F.broadcast(groups), "lang")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return terms.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "_salt"]).drop("_salt")


def audit(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """lang, source, part, item, value, rank of every group's other sources and foremost terms."""
    counts = written(term_counts(docs), "term-counts")
    by_lang = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("in_docs").alias("_docs"))
    kept = written(by_lang.where(F.col("_docs") >= rule.documents).select("lang", "term", "all_n"), "vocabulary")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total"))
    kept_counts = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-counts")
    totals = kept_counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "all_total", "total"])
    groups = written(groups, "groups")
    few = groups.count() <= GROUPS
    dense = _with_groups(kept.select("lang", "term"), groups.where("terms > 0").select("lang", "source", "terms", "total"), few)
    dense = dense.join(kept_counts, ["lang", "source", "term"], "left").select("lang", "source", "term", share("coalesce(n, 0)", "total", "terms", rule).alias("p"))
    dense = written(dense, "shares")
    discard(counts)

    one, other = dense, dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    pair_sums = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(distance("p", "q")).alias("value"))
    pair_sums = written(pair_sums, "pairs")
    both = pair_sums.union(pair_sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    of_lang = kept.join(F.broadcast(langs) if few else langs, "lang").select("lang", "term", share("all_n", "all_total", "terms", rule).alias("q"))
    present = kept_counts.where("n > 0").select("lang", "source", "term").join(dense, ["lang", "source", "term"]).join(of_lang, ["lang", "term"]).where("p > q")
    terms = present.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(terms).where(F.col("rank") <= rule.ranks))
