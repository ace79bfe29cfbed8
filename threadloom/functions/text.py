"""Scalar text functions as Column expressions.

White space follows the wide definition of text tools (tabs, line and page
breaks, no-break and other Unicode spaces), so trims go through ``strip``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Runs of SPACES but for a single plain space: what collapsing changes. Most texts hold none and are not built anew.
RUNS = rf"[\s\x1c-\x1f\x85\p{{Z}}&&[^ ]]{SPACES}*+| {SPACES}++"


#: The characters of SPACES, for trims that need no regular expression.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def rounded(x: Column | str, places: int) -> Column:
    """A double rounded to decimal places as SQL engines and C do, on the scaled value: ``F.round`` takes the decimal digits
    of a double for exact, so that 0.27595, which is a little less, goes up."""
    return F.round(F.col(x) * 10.0**places if isinstance(x, str) else x * 10.0**places) / F.lit(10.0**places)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE))


def blank(text: Column) -> Column:
    """True where a text is null or holds white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def norm_key(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed: the key of equality."""
    return strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), RUNS, " "))


def collapse(text: Column) -> Column:
    """As ``norm_key``, case kept."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " "))


def token_set(text: Column) -> Column:
    """Distinct lower-cased identifiers of three characters and more."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z][a-zA-Z0-9_+-]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) >= 3), F.lower))


def content_tokens(text: Column, least: int = 3) -> Column:
    """Distinct lower-cased alphanumeric runs of at least ``least`` characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 where either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def near_duplicate(a: Column, b: Column, threshold: float = 0.55) -> Column:
    same = lambda k: F.when((F.size(k["x"]) == 0) | (F.size(k["y"]) == 0), norm_key(a) == norm_key(b)).otherwise(jaccard(k["x"], k["y"]) >= threshold)
    return let(F.struct(content_tokens(a).alias("x"), content_tokens(b).alias("y")), same)


def overlap_keys(x: Column, y: Column) -> Column:
    """Whether two normalised texts tell the same: equal, one of 40 characters and more within
    the other, or alike in their first 80 characters."""
    short = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    long = F.when(F.length(x) <= F.length(y), y).otherwise(x)
    same = (x == y) | ((F.length(short) >= 40) & long.contains(short)) | (F.substring(x, 1, 80) == F.substring(y, 1, 80))
    return (x != "") & (y != "") & same


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed and planned once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def full(text: Column) -> Column:
    """A text, null where it is empty."""
    return let(text, lambda t: F.when(t != "", t))


def sentence_overlap(a: Column, b: Column) -> Column:
    return let(F.struct(norm_key(a).alias("a"), norm_key(b).alias("b")), lambda k: overlap_keys(k["a"], k["b"]))


def sentences(text: Column) -> Column:
    parts = F.split(strip(F.coalesce(text, F.lit(""))), rf"(?<=[.!?]){SPACES}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{SPACES}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def keep_first(items: Column, same) -> Column:
    """Items that ``same`` finds in no item kept before; order is kept.

    Compared are whole items with the kept ones, so the result depends on order
    and no self-join can state it: an ordered fold.
    """
    empty = F.filter(items, lambda x: F.lit(False))
    return F.aggregate(items, empty, lambda kept, x: F.when(F.exists(kept, lambda k: same(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def told_once(items: Column) -> Column:
    """Items that tell (``overlap_keys``) what none before tells; each is made a key once, with its length and head."""

    def keyed(x: Column) -> Column:
        return let(norm_key(x), lambda k: F.struct(k.alias("k"), F.length(k).alias("n"), F.substring(k, 1, 80).alias("h"), x.alias("v")))

    def same(a: Column, b: Column) -> Column:
        within = F.when(a["n"] <= b["n"], (a["n"] >= 40) & b["k"].contains(a["k"])).otherwise((b["n"] >= 40) & a["k"].contains(b["k"]))
        return (a["n"] > 0) & (b["n"] > 0) & ((a["h"] == b["h"]) | within)

    return F.transform(keep_first(F.transform(items, keyed), same), lambda p: p["v"])


def distinct_by_key(items: Column, limit: int | None = None) -> Column:
    """Trimmed items with distinct ``norm_key``; the first of each stays."""
    keyed = F.transform(F.filter(items, lambda x: ~blank(x)), lambda x: F.struct(norm_key(x).alias("k"), strip(x).alias("v")))
    kept = F.transform(keep_first(keyed, lambda a, b: a["k"] == b["k"]), lambda p: p["v"])
    return kept if limit is None else F.slice(kept, 1, limit)


def transcript_hash(text: Column) -> Column:
    return F.sha2(strip(F.coalesce(text, F.lit(""))), 256)


def content_hash(text: Column) -> Column:
    return F.substring(transcript_hash(text), 1, 16)


def checkpoint_id(project: Column, created_at: Column, sha: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", project, created_at, sha), 256), 1, 8)


def slug(text: Column, default: str = "conversation", most: int = 64) -> Column:
    named = F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), r"(?U)[^\w-]+", "-")
    cut = F.substring(F.regexp_replace(F.regexp_replace(named, "-{2,}", "-"), "^-+|-+$", ""), 1, most)
    return F.when(cut == "", F.lit(default)).otherwise(cut)


def append_only(prior: Column, new: Column) -> Column:
    """Whether ``new`` only continues ``prior``; from nothing, any text does."""
    p, n = F.coalesce(prior, F.lit("")), F.coalesce(new, F.lit(""))
    return F.when(p == "", n != "").otherwise(n.startswith(p) & (F.length(n) > F.length(p)))


def delta(prior: Column, new: Column) -> Column:
    p, n = F.coalesce(prior, F.lit("")), F.coalesce(new, F.lit(""))
    return F.when(append_only(p, n), lstrip(F.substr(n, F.length(p) + 1))).otherwise(n)


def grown(text: Column, ratio: float = 0.2) -> Column:
    """A text with its last part written once more, as growth for tests."""
    bare = strip(F.coalesce(text, F.lit("")))
    last = F.right(bare, F.greatest(F.lit(1), F.floor(F.length(bare) * ratio)).cast("int"))
    more = F.when(bare == "", F.lit("Additional follow-up messages appended for incremental benchmark.")).otherwise(strip(last))
    return F.concat(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACES}+\z", ""), F.lit("\n\n"), more)


def sanitized_error(message: Column) -> Column:
    """A message without model files, home paths and library names."""
    out = F.regexp_replace(message, r"/[^\s:]+\.(safetensors|json|txt)", "[model]")
    out = F.regexp_replace(out, r"/Users/[^\s]+", "[path]")
    out = F.regexp_replace(out, r"(?i)(adapter|checkpoint|lora|mlx|transformers|huggingface)[^\s]*", "")
    out = strip(F.regexp_replace(out, rf"{SPACES}{{2,}}", " "))
    return F.when(out == "", F.lit("Something went wrong. Try again with --verbose for details.")).otherwise(out)


def first_repeat(items: Column) -> Column:
    """Place (from 0) of the first item whose key occurred before; -1 if there is none.

    Keys with their places and the same keys without repeats agree up to the first repeat.
    """
    keyed = F.filter(F.transform(items, lambda x, i: F.struct(norm_key(x).alias("k"), i.alias("i"))), lambda p: p["k"] != "")

    def place(told: Column) -> Column:
        keys = F.transform(told, lambda p: p["k"])
        differ = F.zip_with(keys, F.array_distinct(keys), lambda a, b: ~a.eqNullSafe(b))
        return F.coalesce(F.get(told, (F.array_position(differ, F.lit(True)) - 1).cast("int"))["i"], F.lit(-1))

    return F.when(items.isNotNull(), let(keyed, place)).cast("int")


def sections(text: Column, headers: tuple[str, ...]) -> Column:
    """A rendered text as a map from header to body; a header is a whole line ``Name:``."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<struct<h:string,l:string>>").alias("rows"))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)

    def step(acc: Column, line: Column) -> Column:
        name = F.regexp_replace(line, ":\\z", "")
        is_header = line.endswith(":") & name.isin(*headers)
        row = F.struct(acc["now"].alias("h"), line.alias("l"))
        grown_rows = F.when((acc["now"] != "") & (line != ""), F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"])
        return F.struct(F.when(is_header, name).otherwise(acc["now"]).alias("now"), F.when(is_header, acc["rows"]).otherwise(grown_rows).alias("rows"))

    rows = F.aggregate(lines, start, step, lambda a: a["rows"])
    names = F.array_distinct(F.transform(rows, lambda r: r["h"]))
    body = lambda h: F.array_join(F.transform(F.filter(rows, lambda r: r["h"] == h), lambda r: r["l"]), "\n")
    return F.map_from_arrays(names, F.transform(names, body))


def clip_words(text: Column, most: int) -> Column:
    own = words(text)
    return F.when(F.size(own) <= most, F.array_join(own, " ")).otherwise(F.concat(F.array_join(F.slice(own, 1, most), " "), F.lit("…")))


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return let(text, lambda t: reduce(lambda a, b: a | b, [t.contains(n) for n in needles]))
