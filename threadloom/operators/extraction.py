"""Structured extraction from chunks: a pluggable extractor, and its raw JSON made regular.

An extractor adds a column ``raw`` (JSON text) to chunk rows. The deterministic
``mock`` one is pure Columns; a model is an iterator UDF of the same shape, to
which only selected chunks are sent. A failure is a row, not an exception.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Field names of the extraction record.
LISTS = ("important_facts", "goals", "decisions", "next_steps", "open_questions", "objective", "completed_work", "active_problems", "resolved_problems", "constraints")
SCALARS = ("topic", "summary", "current_state", "continuation_context")
#: Names that older extractors use for a field; taken only where the field itself is empty.
ALIASES = {
    "important_facts": ("important_facts_discussed", "key_entities"),
    "goals": ("current_goals", "current_goal"),
    "open_questions": ("current_blocker",),
    "decisions": ("attempted_solutions",),
    "topic": ("active_issue",),
}

Extractor = Callable[[DataFrame], DataFrame]


def mock(chunks: DataFrame) -> DataFrame:
    """Chunk rows (conv, chunk_index, chunk_total, chunk) with a deterministic ``raw``."""
    total = F.col("chunk_total")
    i = (F.col("chunk_index") + 2).cast("string")
    say = lambda what: F.array(F.concat(F.lit(f"mock {what}"), i))
    record = F.struct(
        F.concat(F.lit("mock conversation topic (chunk "), i, F.lit("/"), total, F.lit(")")).alias("topic"),
        F.concat(F.lit("mock summary for chunk "), i, F.lit(" of "), total, F.lit(".")).alias("summary"),
        say("fact from chunk ").alias("important_facts"), say("goal chunk ").alias("current_goals"), say("decision chunk ").alias("decisions"),
        say("question chunk ").alias("open_questions"), say("next step chunk ").alias("next_steps"),
    )
    return chunks.withColumn("raw", F.to_json(record))


def json_body(raw: Column) -> Column:
    """The object within a model's answer: out of a code fence, first to last brace, without trailing commas."""
    whole = F.coalesce(raw, F.lit(""))
    inner = F.coalesce(F.when(whole.contains("```"), T.full(F.regexp_extract(whole, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))), whole)
    cut = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(cut, r",\s*([}\]])", "$1")


def parse(raw: Column) -> Column:
    """A VARIANT of the object, null where there is none."""
    return T.let(F.try_parse_json(json_body(raw)), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def _string_at(raw: Column, name: str) -> Column:
    """The value of a complete string field of possibly cut JSON, unescaped; null if not complete."""
    found = F.regexp_extract(raw, rf'(?s)"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    complete = raw.rlike(rf'(?s)"{name}"\s*:\s*"(?:[^"\\]|\\.)*"')
    return F.when(complete, unescape(found))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def _items_at(raw: Column, name: str) -> Column:
    """The closed string items of a list field of possibly cut JSON."""
    inside = F.regexp_extract(raw, rf'(?s)"{name}"\s*:\s*\[((?:\s*,?\s*"(?:[^"\\]|\\.)*")*)', 1)
    return F.transform(F.regexp_extract_all(inside, F.lit(r'(?s)"((?:[^"\\]|\\.)*)"'), F.lit(1)), unescape)


def repaired(raw: Column) -> Column:
    """Cut JSON made whole: closed items and scalars stay. Null unless topic and summary are complete."""
    whole = F.coalesce(raw, F.lit(""))
    topic, summary = _string_at(whole, "topic"), _string_at(whole, "summary")
    lists = [_items_at(whole, n).alias(n) for n in LISTS]
    record = F.struct(topic.alias("topic"), summary.alias("summary"), *lists, *[_string_at(whole, n).alias(n) for n in SCALARS[2:]])
    return F.when(topic.isNotNull() & summary.isNotNull(), F.to_json(record))


def _list(value: Column, name: str) -> Column:
    """Trimmed non-blank strings of a field that may be null, a scalar or a list."""
    many = F.try_variant_get(value, f"$.{name}", "array<string>")
    one = F.try_variant_get(value, f"$.{name}", "string")
    items = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    return F.filter(F.transform(items, T.strip), lambda x: x.isNotNull() & (x != ""))


def _scalar(value: Column, name: str) -> Column:
    return T.strip(F.coalesce(F.try_variant_get(value, f"$.{name}", "string"), F.lit("")))


def _first_full(options: list[Column], empty: Callable[[Column], Column]) -> Column:
    """The first option that is not empty, else the first; each is made once, and only if those before it are empty."""
    first, *rest = options
    later = lambda left: T.let(left[0], lambda o: F.when(~empty(o), o).otherwise(later(left[1:]))) if left else F.lit(None)
    return T.let(first, lambda o: F.when(~empty(o), o).otherwise(F.coalesce(later(rest), o))) if rest else first


def normalised(value: Column) -> dict[str, Column]:
    """Every field of the record, with older names as fallbacks and exact repeats of list items removed."""
    out = {n: _first_full([_scalar(value, x) for x in (n, *ALIASES.get(n, ()))], lambda c: c == "") for n in SCALARS}
    for n in LISTS:
        out[n] = F.array_distinct(_first_full([_list(value, x) for x in (n, *ALIASES.get(n, ()))], lambda c: F.size(c) == 0))
    return out


def regular(extracted: DataFrame) -> DataFrame:
    """Rows with ``raw`` to rows with the record's columns and parse_ok: parsed, else repaired and
    parsed; ok means that it names a topic or a summary."""
    parsed = extracted.withColumn("_v", F.coalesce(parse(F.col("raw")), parse(repaired(F.col("raw")))))
    out = parsed.withColumns(normalised(F.col("_v")))
    ok = F.col("_v").isNotNull() & ((F.col("topic") != "") | (F.col("summary") != ""))
    return out.withColumn("parse_ok", ok).withColumn("error", F.when(~ok, F.lit("no topic or summary"))).drop("_v", "raw")


def extract(chunks: DataFrame, selected: DataFrame | None = None, extractor: Extractor = mock) -> DataFrame:
    """The records of the selected (conv, chunk_index); the choice is made below the extractor.

    chunk_total counts all chunks of a conversation, selected or not; where chunk
    rows lack it, a window adds it.
    """
    if "chunk_total" not in chunks.columns:
        chunks = chunks.withColumn("chunk_total", F.count("*").over(Window.partitionBy("conv")))
    wanted = chunks if selected is None else chunks.join(selected.select("conv", "chunk_index").distinct(), ["conv", "chunk_index"], "left_semi")
    sized = wanted.withColumn("input_chars", F.length("chunk")).withColumn("content_hash", T.content_hash(F.col("chunk")))
    return regular(extractor(sized)).drop("chunk", "chunk_total")


def prompted(text: Column, rules: str = "", instruction: str = "") -> Column:
    """What a model reads: rules, instruction and the chunk; with rules alone the chunk is named."""
    bare = T.strip(F.coalesce(text, F.lit("")))
    if instruction:
        return F.concat(F.lit(rules + instruction), bare)
    return F.concat(F.lit(rules + "Transcript:\n"), bare) if rules else bare


def model_extractor(generate: Callable[[list[str]], list[str]], rules: str = "", instruction: str = "") -> Extractor:
    """An extractor from a function of prompts to answers, called batch by batch on the executors.

    A batch that fails is tried prompt by prompt; a prompt that fails leaves a null
    ``raw``, which becomes a row that is not ok. ``generate`` may load its model on
    its first call and keep it for the worker's life.
    """

    def extract_raw(chunks: DataFrame) -> DataFrame:
        def answers(prompts: pd.Series) -> pd.Series:
            try:
                return pd.Series(generate(prompts.tolist()))
            except Exception:  # one bad chunk must not fail its neighbours
                return pd.Series([_one(generate, p) for p in prompts])

        udf = F.pandas_udf(answers, "string")
        return chunks.withColumn("raw", udf(prompted(F.col("chunk"), rules, instruction)))

    return extract_raw


FACTS = re.compile(r'"important_facts"\s*:\s*\[')
PENDING = re.compile(r'"important_facts"\s*:?\s*\Z')
FACT = re.compile(r'\s*,?\s*"((?:[^"\\]|\\.)*)"', re.S)


def until_repeat(stream: Iterable[str], least_facts: int = 8, least_tokens: int = 256) -> str:
    """The text of a stream of generated tokens, ended where a fact is told twice: for a ``generate``
    whose model falls into a loop. Only after so many facts and tokens. Takes time in proportion to the text."""
    told, rest, open_, seen, facts, again = [], "", False, set(), 0, False
    for token in stream:
        told.append(token)
        rest += token
        if '"' not in token and "[" not in token:
            continue
        if not open_:  # what can't become the list's head any more is not read again
            head = FACTS.search(rest)
            name = rest.rfind('"important_facts"')
            pending = name >= 0 and PENDING.match(rest, name)
            open_ = head is not None
            rest = rest[head.end() if head else name if pending else max(0, len(rest) - len('"important_facts"')) :]
        while open_ and (fact := FACT.match(rest)):  # an item is read once, when its end has come
            rest, facts, key = rest[fact.end() :], facts + 1, " ".join(fact[1].lower().split())
            again = again or key in seen
            seen.add(key)
        if len(told) >= least_tokens and '"' in token and facts >= least_facts and again:
            break
    return "".join(told)


def _one(generate: Callable[[list[str]], list[str]], prompt: str) -> str | None:
    try:
        return generate([prompt])[0]
    except Exception:
        return None


def repaired_audit(raw: Column) -> Column:
    """{topic_complete, summary_complete, last_complete, repairable} of a possibly cut answer."""
    whole = F.coalesce(raw, F.lit(""))
    done = {n: _string_at(whole, n).isNotNull() for n in SCALARS} | {n: whole.rlike(rf'(?s)"{n}"\s*:\s*\[(?:\s*,?\s*"(?:[^"\\]|\\.)*")*\s*\]') for n in LISTS}
    places = F.array(*[F.struct(F.when(ok, F.locate(f'"{n}"', whole)).otherwise(F.lit(0)).alias("at"), F.lit(n).alias("name")) for n, ok in done.items()])
    last = F.array_max(places)
    return F.struct(done["topic"].alias("topic_complete"), done["summary"].alias("summary_complete"), F.when(last["at"] > 0, last["name"]).alias("last_complete"), (done["topic"] & done["summary"]).alias("repairable"))
