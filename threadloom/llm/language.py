"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over its last ``order`` bytes. A byte unseen
in the longest context escapes to the next shorter one (method C: the escape
weighs as many counts as the context has distinct followers), down to a
uniform distribution. The statistics are frozen after fitting; a text's score
under a language is its exact code length in bits, and the shortest wins.

Fitting reads a bounded sample: of the ``MOST_LANGUAGES`` most frequent languages about
``rows`` labelled rows each, picked by a hash of their id and text, and of these
whole texts up to ``most_bytes`` bytes, or one longer text where it comes first; all
languages share ``SAMPLE_BYTES``. So the model is bounded whatever the corpus, and its
size is checked before it is broadcast. Everything else sees every row and every byte.

Defined results
- null text, or one without a letter (empty too): ``und`` with score 0
- equally short codes: the language first by code point
- repeated rows: each is judged; extra columns pass through ``identify`` as they are,
  but for ``lang_pred`` and ``score``, which it replaces
- very long texts: scored block by block
- no labelled row at all: every text is ``und``; empty table: no rows
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

ORDER = 3
#: Bits by which plain bytes must be shorter than every language's code to speak against all of them.
FOREIGN_ODDS = 64.0
#: The sample: rows and bytes of a language, bytes of all, and languages, the most frequent first.
ROWS_PER_LANGUAGE, BYTES_PER_LANGUAGE, SAMPLE_BYTES, MOST_LANGUAGES = 600, 1_500_000, 48_000_000, 256
MOST_MODEL_BYTES = 1 << 30


@dataclass(frozen=True)
class Model:
    """Frozen trees, tabulated: the longest known context of three symbols, and for each
    language the code lengths of every next symbol in the contexts that language has seen.

    A language's table grows with its own contexts alone; one number a context tells
    which of its rows, that of the longest suffix it knows, stands for it.
    """

    languages: tuple[str, ...]
    symbol: np.ndarray  # byte -> symbol; 0 stands for bytes that no sample has
    context: np.ndarray  # three symbols, read as one number -> context
    rows: tuple[np.ndarray, ...]  # a language: context -> row of its bits
    bits: tuple[np.ndarray, ...]  # a language: [row, symbol]

    @property
    def width(self) -> int:
        return int(self.symbol.max(initial=0)) + 1

    @property
    def nbytes(self) -> int:
        return self.context.nbytes + sum(x.nbytes for x in (*self.rows, *self.bits))


def fit(samples: dict[str, list[bytes]]) -> Model:
    """Count each language's trees and tabulate code lengths for the contexts of all trees."""
    languages = tuple(sorted(samples))
    present = sorted(set().union(*(set(text) for texts in samples.values() for text in texts)) if samples else ())
    symbol = np.zeros(256, dtype=np.int32)
    symbol[present] = np.arange(1, len(present) + 1)
    width = len(present) + 1
    trees = []
    for language in languages:
        tree: list[dict[int, dict[int, int]]] = [defaultdict(dict) for _ in range(ORDER + 1)]
        for order in range(ORDER + 1):
            grams = []
            for text in samples[language]:
                s = symbol[np.frombuffer(text, dtype=np.uint8)].astype(np.int64)
                if len(s) > order:
                    g = s[order:].copy()
                    for back in range(1, order + 1):
                        g += s[order - back : len(s) - back] * width**back
                    grams.append(g)
            if grams:
                gram, count = np.unique(np.concatenate(grams), return_counts=True)
                for g, c in zip(gram.tolist(), count.tolist(), strict=True):
                    tree[order][g // width][g % width] = c
        trees.append(tree)
    known = sorted({(order, c) for tree in trees for order in range(ORDER + 1) for c in tree[order]} | {(0, 0)})
    place = {key: i for i, key in enumerate(known)}
    above = [place[_shorter(order, c, width, place)] if order else 0 for order, c in known]
    all_rows, all_bits = [], []
    for tree in trees:
        rows, table = np.zeros(len(known), dtype=np.int32), []
        for i, (order, c) in enumerate(known):  # shorter contexts come first
            below = table[rows[above[i]]] if order else np.full(width, np.log2(256.0), dtype=np.float32)
            followers = tree[order].get(c)
            if not followers and order:
                rows[i] = rows[above[i]]
                continue
            rows[i] = len(table)
            if followers:
                total = sum(followers.values()) + len(followers)
                own = below + np.float32(np.log2(total / len(followers)))
                own[list(followers)] = np.log2(total / np.fromiter(followers.values(), dtype=np.float64))
                below = own
            table.append(below)
        all_rows.append(rows)
        all_bits.append(np.stack(table))
    context = np.zeros(width**ORDER, dtype=np.int32)
    all_contexts = np.arange(width**ORDER)
    for order in range(1, ORDER + 1):
        row = np.full(width**order, -1, dtype=np.int32)
        for (o, c), i in place.items():
            if o == order:
                row[c] = i
        found = row[all_contexts % width**order]
        context[found >= 0] = found[found >= 0]
    model = Model(languages, symbol, context, tuple(all_rows), tuple(all_bits))
    if model.nbytes > MOST_MODEL_BYTES:
        raise ValueError(f"a model of {model.nbytes} bytes is too large to broadcast; fit on a smaller sample")
    return model


def _shorter(order: int, c: int, width: int, place: dict) -> tuple[int, int]:
    while order:
        order -= 1
        c %= width**order
        if (order, c) in place:
            return order, c
    return 0, 0


def code_lengths(model: Model, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
    """[text, language]: exact code lengths in bits, by the whole of every text.

    Texts are scored in blocks of bounded size, each text after ``ORDER`` absent symbols.
    """
    out = np.zeros((len(texts), len(model.languages)), dtype=np.float64)
    w = model.width
    for i, text in enumerate(texts):
        s = np.zeros(len(text) + ORDER, dtype=np.int32)
        s[ORDER:] = model.symbol[np.frombuffer(text, dtype=np.uint8)]
        for at in range(0, len(text), block):
            part = s[at : at + block + ORDER]
            n = len(part) - ORDER
            c = model.context[(part[:n] * w + part[1 : n + 1]) * w + part[2 : n + 2]]
            for k, (rows, bits) in enumerate(zip(model.rows, model.bits, strict=True)):
                out[i, k] += bits.ravel()[rows[c] * w + part[ORDER:]].sum(dtype=np.float64)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text: the shortest code, and its share of 2^-length among all."""
    raw = [(t or "").encode() for t in texts]
    lettered = [has_letter(t) for t in texts]
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    bits = code_lengths(model, [r if ok else b"" for r, ok in zip(raw, lettered, strict=True)])
    best = bits.argmin(axis=1)
    share = 1 / np.exp2(np.minimum(0, bits.min(axis=1)[:, None] - bits)).sum(axis=1)
    return (
        [model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)],
        [float(x) if ok else 0.0 for x, ok in zip(share, lettered, strict=True)],
    )


def sample(docs: DataFrame, learnable, rows: int = ROWS_PER_LANGUAGE, most_bytes: int = BYTES_PER_LANGUAGE) -> dict[str, list[bytes]]:
    """The bounded sample of each language.

    Counts by language set the share of the id-hash range to take; one scan then
    brings about ``rows`` rows of each, in the order of that hash.
    """
    labelled = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return {}
    most_bytes = min(most_bytes, SAMPLE_BYTES // len(counts))
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30))
    limits = docs.sparkSession.createDataFrame([(r["lang"], int((1 << 30) * min(1.0, rows / r["n"]))) for r in counts], "lang string, _limit long")
    labelled = labelled.join(F.broadcast(limits), "lang").where(hashed < F.col("_limit"))  # MOST_LANGUAGES rows
    found: dict[str, list[bytes]] = defaultdict(list)
    taken: dict[str, int] = defaultdict(int)
    for row in labelled.select("lang", "text", hashed.alias("h")).orderBy("h", "text").toLocalIterator():
        text = row["text"].encode()
        if taken[row["lang"]] + len(text) <= most_bytes or not found[row["lang"]]:
            found[row["lang"]].append(text)
            taken[row["lang"]] += len(text)
    return {k: v for k, v in found.items() if v}


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: every column) with lang_pred and score beside it; one pass, no shuffle."""
    spark = docs.sparkSession
    frozen = spark.sparkContext.broadcast(model)
    names = [n for n in (docs.columns if keep is None else keep) if n not in ("lang_pred", "score")]
    fields = [f for f in docs.schema.fields if f.name in names]
    schema = docs.select(*[f.name for f in fields]).schema.add("lang_pred", "string").add("score", "double")
    source = docs.select(*[f.name for f in fields], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            languages, scores = judge(frozen.value, batch["__text"].to_pylist())
            kept = [batch.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def in_a_language(docs: DataFrame, model: Model, odds: float = FOREIGN_ODDS) -> DataFrame:
    """Documents in a language, with lang_pred beside their columns; one pass, no shuffle.

    Text without a letter is in none. Nor is text whose shortest code is ``odds``
    bits longer than its plain bytes, so that the model speaks against every
    language it knows; a label of a language it doesn't know stands. A model of no
    language predicts null and rejects by letters alone.
    """
    spark = docs.sparkSession
    frozen = spark.sparkContext.broadcast(model)
    schema = docs.select("*").schema.add("lang_pred", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = frozen.value
        for batch in pieces(batches):
            texts = batch["text"].to_pylist()
            kept, best = [has_letter(t) for t in texts], [None] * len(texts)
            if model.languages:
                raw = [t.encode() if ok else b"" for t, ok in zip(texts, kept, strict=True)]
                bits = code_lengths(model, raw)
                best = [model.languages[i] for i in bits.argmin(axis=1)]
                over = bits.min(axis=1) - 8 * np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
                unknown = [lang is not None and lang not in model.languages for lang in batch["lang"].to_pylist()]
                kept = [ok and (x < odds or u) for ok, x, u in zip(kept, over, unknown, strict=True)]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string())], names=schema.names)
            yield out.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2
