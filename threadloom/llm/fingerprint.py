"""Document fingerprints: one-permutation MinHash, optimally densified, packed to a few bits.

DataFrame functions only. A text's five-word shingles are hashed once. The top
bits of a hash name its bin, and each bin keeps its smallest hash. An empty
bin borrows from a filled one that a sequence of hashes of (bin, attempt) hits
first (optimal densification; Shrivastava, 2017); after ``ATTEMPTS`` misses it
borrows from the filled bin with the smallest hash of (bin, filled bin), which
is the same uniform choice and always ends. The low ``BITS`` bits of each bin's
minimum, rehashed with the bin's number, are packed into a hexadecimal string. Two fingerprints' share of equal bins,
corrected for chance agreement of so few bits, estimates the Jaccard index.

Defined results
- null text: the empty text; no words: the fingerprint is the empty string,
  alike only to itself
- fewer than five words: the whole sequence is the one shingle
- repeated rows: equal texts have equal fingerprints
- ties of doc_id: the next document follows by a hash of the text; repeated rows of
  one id and text lie in one bucket, however many they are
- very long texts: one array of shingle hashes a row, 8 bytes a word
- empty table: no rows; extra columns are dropped
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cuts_below

BINS, BITS, WIDTH, ATTEMPTS = 256, 4, 5, 12
_SHIFT = 64 - BINS.bit_length() + 1


def word_array(text: Column) -> Column:
    """The words of a text; empty pieces beside leading and trailing white space go."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


_MARKS = [((b << _SHIFT) + (1 << 63)) % (1 << 64) - (1 << 63) for b in range(BINS)]


def _is_mark(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << _SHIFT) - 1)) == 0


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the fingerprint of column ``text``.

    The least number of every bin is sorted in among the shingle hashes as a
    mark; what follows a mark, unless it is the next mark, is the bin's minimum.
    Each step is a projection of its own whose arrays the next step reads by
    index more than once, so that Catalyst keeps them apart and computes each
    array once a row.
    """
    n = F.size("_w")
    word = lambda i: F.get("_w", i)
    shingles = F.when(n == 0, F.array().cast("array<long>")).when(n < WIDTH, F.array(F.xxhash64(F.array_join("_w", " ")))).otherwise(
        F.transform(F.slice("_w", 1, F.greatest(n - WIDTH + 1, F.lit(1))), lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2), word(i + 3), word(i + 4)))
    )
    marks = F.array(*[F.lit(m).cast("long") for m in _MARKS])
    follower = lambda i: F.get("_s", i + 1)
    places = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: _is_mark(F.get("_s", i)))
    minima = F.transform(places, lambda i: F.when(~_is_mark(follower(i)), follower(i)))
    filled = F.filter(F.transform("_b", lambda b, j: F.struct(j.alias("j"), b.alias("b"))), lambda p: p["b"].isNotNull())
    tries = [lambda i, k=k: F.get("_b", F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(ATTEMPTS)]

    def fill(donors: Column) -> Column:
        last = lambda i: F.array_min(F.transform(donors, lambda d: F.struct(F.xxhash64(i, d["j"]).alias("a"), d["b"].alias("b"))))["b"]
        return F.transform("_b", lambda b, i: F.coalesce(b, *[t(i) for t in tries], last(i)))

    # rehashed with the bin, so that bins that borrow one minimum agree by chance independently
    digit = lambda h, i: F.substring(F.lit("0123456789abcdef"), (F.xxhash64(h, i).bitwiseAND(F.lit(15)) + 1).cast("int"), F.lit(1))
    dense = F.get(F.transform(F.array(filled), fill), F.lit(0))
    return (
        df.withColumn("_w", word_array(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_s", F.sort_array(F.concat(shingles, marks)))
        .drop("_w")
        .withColumn("_b", minima)
        .withColumn("_n", F.size("_s") - BINS)
        .drop("_s")
        .withColumn(out, F.when(F.col("_n") == 0, F.lit("")).otherwise(F.array_join(F.transform(dense, digit), "")))
        .drop("_b", "_n")
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard index of two fingerprints, 0 to 1.

    Bins agree by chance with probability 2^-BITS, so a share c of equal bins
    stands for (c - 2^-BITS) / (1 - 2^-BITS).
    """
    chance = 2.0**-BITS
    same = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] == p["y"])) / F.lit(float(BINS))
    estimate = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(estimate)


#: Rows a bucket should have, and the most buckets: beyond their product buckets grow.
BUCKET_ROWS, MOST_BUCKETS = 1000, 1 << 16


def _lookup(docs: DataFrame, rows: list[tuple], ddl: str) -> DataFrame:
    return F.broadcast(docs.sparkSession.createDataFrame(rows, ddl))  # a row a bucket: 2 x MOST_BUCKETS of 40 bytes at most


def _buckets(docs: DataFrame) -> DataFrame:
    """``docs`` with _h, _bucket, non-decreasing in (doc_id, _h), and _ghost copies.

    Buckets lie between approximate quantiles of the ids, wherever these lie. An id
    that alone fills more than a bucket, a missing one say, is parted by the hash
    of its texts. What the driver sees are cuts and counts, a row a bucket. The
    first row of each bucket is also sent to the bucket before it as a ghost, and
    that of the first bucket to the last one.
    """
    total = docs.count()
    rows = max(BUCKET_ROWS, -(-total // MOST_BUCKETS))
    n = max(1, -(-total // rows))
    shares = [k / n for k in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * n)).alias("c")).first()["c"] if shares else []
    found = found or []
    own = {a + 1 for a, b in zip(found, found[1:], strict=False) if a == b and a < (1 << 63) - 1}  # ids that fill buckets by themselves
    cuts = sorted({*found, *own})
    listed = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    cell = F.when(F.col("doc_id").isNull(), 0).otherwise(cuts_below(listed, F.col("doc_id"), len(cuts)) + 1)
    held = docs.withColumn("_h", F.xxhash64("text")).withColumn("_cell", cell)
    plan, base = [], 0
    for r in sorted(held.groupBy("_cell").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()):
        parts = -(-r["n"] // rows) if r["lo"] == r["hi"] else 1
        plan.append((r["_cell"], base, parts))
        base += parts
    share = F.col("_h").cast("double") / 2.0**64 + 0.5
    bucket = F.col("_base") + F.least(F.col("_parts") - 1, F.floor(share * F.col("_parts"))).cast("int")
    held = held.join(_lookup(docs, plan, "_cell int, _base int, _parts int"), "_cell").withColumn("_bucket", bucket).drop("_cell", "_base", "_parts")
    row = F.struct(F.col("doc_id").isNotNull().alias("n"), F.col("doc_id").alias("id"), F.col("_h").alias("h"))
    firsts = sorted(held.groupBy("_bucket").agg(F.min(row).alias("f")).collect())
    before = [(r["_bucket"], r["f"]["id"], r["f"]["h"], firsts[i - 1]["_bucket"]) for i, r in enumerate(firsts)]
    home = lambda b, ghost: F.struct(F.col(b).alias("b"), F.lit(ghost).alias("g"))
    is_first = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_first"))
    homes = F.when(is_first, F.array(home("_bucket", False), home("_before", True))).otherwise(F.array(home("_bucket", False)))
    dealt = held.join(_lookup(docs, before, "_bucket int, _id long, _first long, _before int"), "_bucket").withColumn("_home", F.explode(homes))
    return dealt.withColumn("_bucket", F.col("_home.b")).withColumn("_ghost", F.col("_home.g")).drop("_home", "_id", "_first", "_before")


def pair_with_next(docs: DataFrame) -> DataFrame:
    """Every row beside the text and fingerprint of the next in ascending doc_id (null first;
    ties by text hash; after the last, the first). Texts move once, by bucket."""
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "_h")
    return (
        _buckets(docs)
        .select("*", F.lead("text").over(order).alias("_next_text"), F.lead("fingerprint").over(order).alias("_next_fingerprint"))
        .where(~F.col("_ghost"))
        .drop("_bucket", "_ghost", "_h")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness; see ``queries``."""
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    paired = pair_with_next(with_fingerprint(base, "text", "fingerprint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = (
        paired.withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("_edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("_next_text", F.lit(1), half)))
        .drop("text", "_next_text")
    )
    done = with_fingerprint(edited.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256)), "_edited", "edited_fingerprint")
    return done.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_fingerprint")).alias("near_next"),
    )
