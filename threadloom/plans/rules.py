"""Queries of the text rules, the smaller rubrics, model calls, and streams."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import voice as V
from ..operators import chunking, extraction, quality, state
from ..session import scratch, table
from ..streaming import growth
from . import told
from .conversations import TURNS, turns
from .told import SOURCES, STATES, key, q, strip

HEADERS = ("Objective", "Current Position", "Completed Work", "Active Problems", "Constraints", "Next Action")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn beside a second text: itself in upper case, longer, cut, or the turn before."""
    own = Window.partitionBy("conv").orderBy("idx")
    a, kind = F.col("text"), F.pmod(F.col("conv") + F.col("idx"), F.lit(4))
    other = F.when(kind == 0, F.coalesce(F.lag("text").over(own), F.lit(""))).when(kind == 1, F.upper(a)).when(kind == 2, F.concat(a, F.lit(" and some more"))).otherwise(F.substr(a, F.lit(1), F.floor(F.length(a) / 2).cast("int")))
    return turns(spark, sf_dir).select("conv", F.col("idx").cast("long").alias("idx"), "text", other.alias("other"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two texts are near-duplicates, tell the same, continue each other, or name one action."""
    a, b = F.col("text"), F.col("other")
    return _variants(spark, sf_dir).select("conv", "idx", T.near_duplicate(a, b).alias("near"), T.sentence_overlap(a, b).alias("same"), T.append_only(a, b).alias("continues"), F.sha2(T.delta(a, b), 256).alias("delta"), quality.same_action(a, b).alias("one_action"))


def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, ids, error texts, first repeats and grown texts of every turn."""
    words = T.words(F.col("text"))
    at = lambda i: F.coalesce(F.get("_w", F.lit(i)), F.lit("x"))
    error = F.concat(F.lit("Failed: /Users/"), at(0), F.lit("/run  Adapter_"), at(1), F.lit(" at /data/"), at(2), F.lit(".json, then /m/a.safetensors mlx"))
    rows = turns(spark, sf_dir).withColumn("_w", words).withColumn("_slug", T.slug(F.array_join(F.slice("_w", 1, 12), " ")))
    return rows.select(
        "conv", F.col("idx").cast("long").alias("idx"), F.col("_slug").alias("slug"), T.checkpoint_id(F.col("_slug"), F.lit("now"), T.transcript_hash(F.col("text"))).alias("id"),
        T.sanitized_error(error).alias("error"), T.first_repeat(F.col("_w")).cast("long").alias("repeat"), F.sha2(T.grown(F.col("text")), 256).alias("grown"),
    )


def _spoken() -> Column:
    part = lambda a, n: F.array_join(F.slice("_w", a, n), " ")
    return F.concat(F.lit("The participant is being asked about "), part(1, 4), F.lit(". The slice discusses "), part(2, 6), F.lit("!  Participants were debating "), part(3, 2), F.lit(". Next: "), part(4, 5), F.lit(". The slice discusses "), part(2, 6), F.lit("!"))


def voice_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observer phrases of built sentences said anew, told once, and what they say comes next."""
    rows = turns(spark, sf_dir).withColumn("_w", T.words(F.col("text"))).withColumn("_s", _spoken())
    s, lines = F.col("_s"), F.concat(F.col("_s"), F.lit("\n\nThe slice covers  "), F.element_at("_w", 1))
    return rows.select(
        "conv", F.col("idx").cast("long").alias("idx"), V.clean_lines(lines).alias("lines"), V.clean_summary(s).alias("summary"), F.array_join(V.distinct_sentences(T.sentences(s)), "|").alias("sentences"),
        V.next_from_text(s).alias("next"), V.position(s, F.lit(""), F.lit(""), F.lit("")).alias("place"),
    )


def briefing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every briefing parsed back into its sections."""
    rows = state.build(told.records(spark, sf_dir), told.sources(spark, sf_dir)).withColumn("briefing", state.briefing())
    return rows.select("conv", F.explode(T.sections(F.col("briefing"), HEADERS)).alias("header", "body"))


RULES, INSTRUCTION = "Answer in JSON.\n", "Read this:\n"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model reads of every turn, under rules, an instruction, both, or neither."""
    forms = F.array(*[F.struct(F.lit(n).alias("form"), extraction.prompted(F.col("text"), r, i).alias("prompt")) for n, r, i in (("bare", "", ""), ("rules", RULES, ""), ("instruction", "", INSTRUCTION), ("both", RULES, INSTRUCTION))])
    return turns(spark, sf_dir).select("conv", F.col("idx").cast("long").alias("idx"), F.inline(forms)).withColumn("prompt", F.sha2("prompt", 256))


def _answers(batch: list[str]) -> list[str]:
    """A stand-in for a model: tells a prompt's length, and fails on every seventh."""
    if any(len(p) % 7 == 3 for p in batch):
        raise RuntimeError("cannot answer")
    return [json.dumps({"topic": f"length {len(p)}", "summary": p[-9:].strip()}) for p in batch]


def model_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a model that fails on some chunks, for the last chunk of each conversation only."""
    rows = turns(spark, sf_dir).select("conv", F.col("idx").cast("int").alias("chunk_index"), F.col("text").alias("chunk"))
    last = rows.groupBy("conv").agg(F.max("chunk_index").alias("chunk_index"))
    out = extraction.extract(rows, last, extraction.model_extractor(_answers, RULES))
    return out.select("conv", F.col("chunk_index").cast("long").alias("chunk_index"), "topic", "parse_ok")


def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns joined to one or two pieces, and its longest turn."""
    rows = turns(spark, sf_dir).groupBy("conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda t: t["text"]).alias("c"))
    one, two = (chunking.merge_sparse(F.col("c"), n) for n in (1, 2))
    hashed = lambda x: F.sha2(F.array_join(x, "|"), 256)
    return rows.select("conv", hashed(one).alias("one"), hashed(two).alias("two"), F.size(two).cast("long").alias("n"), F.sha2(chunking.longest_chunk(F.col("c")), 256).alias("longest"))


def proxy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores guessed from transcripts alone; every other one ends in a question."""
    rows = told.sources(spark, sf_dir).withColumn("path", F.concat(F.lit("/x/"), "archetype", F.lit("/t.txt")))
    text = F.concat("conversation", F.when(F.col("conv") % 2 == 0, F.lit("\nIs it so?")).otherwise(F.lit(" todo")))
    out = quality.proxy_analysed(rows.withColumn("text", text).drop("archetype"))
    return out.select("conv", "archetype", F.col("usefulness").cast("long").alias("usefulness"), "tier", F.col("next_action_score").cast("long").alias("next_action_score"), F.col("active_problems_score").cast("long").alias("active_problems_score"), "duplication_rate")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of events by hour and type."""
    out = growth.event_counts(table(spark, sf_dir, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", T.rounded("total", 4).alias("total"))


def streamed_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of conversations, turn by turn, as a stream with state: what each adds, or that it was edited."""
    own = Window.partitionBy("conv").orderBy("idx")
    rows = turns(spark, sf_dir).withColumn("t", F.array_join(F.collect_list("text").over(own), "\n\n"))
    text = F.when((F.col("conv") % 5 == 4) & (F.col("idx") == 2), F.concat(F.lit("Edited. "), "t")).otherwise(F.col("t"))
    path = scratch(spark, "stream")
    rows.select("conv", F.col("idx").cast("long").alias("version"), text.alias("text")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("conv long, version long, text string").parquet(f"{path}/in")
    query = growth.growth(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(growth.ROWS).parquet(f"{path}/out").select("conv", "version", "accepted", F.sha2("delta", 256).alias("delta"), "chars_added", "char_count")


QUERIES = [text_pairs, text_shapes, voice_rules, briefing_sections, prompts, model_extraction, merged_chunks, proxy_scores, event_windows, streamed_growth]

# ---- the same results in SQL ----


def _tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}'))"


def _likeness(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))"


_SPACES = r"'\s+'"
_WORDS = r"regexp_extract_all(text, '\S+')"
_PARTS = {n: f"array_to_string(w[{a}:{a + n_ - 1}], ' ')" for n, a, n_ in (("p1", 1, 4), ("p2", 2, 6), ("p3", 3, 2), ("p4", 4, 5))}
_SAID = f"'The participant is being asked about ' || {_PARTS['p1']} || '. The slice discusses ' || {_PARTS['p2']} || '!  Participants were debating ' || {_PARTS['p3']} || '. Next: ' || {_PARTS['p4']} || '. The slice discusses ' || {_PARTS['p2']} || '!'"
_SHUT = r"(adapter|checkpoint|lora|mlx|transformers|huggingface)"
_BODIES = {"Objective": "objective_display", "Current Position": "current_state", "Completed Work": told.bullets("completed_work"), "Active Problems": told.bullets("active_problems"), "Constraints": told.bullets("constraints"), "Next Action": "next_action"}


def _archetype_by_path() -> str:
    return "CASE archetype WHEN 'tutorial' THEN 'tutorial' WHEN 'journal' THEN 'journal' WHEN 'research' THEN 'research' WHEN 'debugging' THEN 'coding' WHEN 'github' THEN 'coding' WHEN 'reddit' THEN 'casual_chat' ELSE " + (
        "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in quality.CONTENT) + " ELSE 'other' END END"
    )


SQL = {
    "text_pairs": f"""
WITH {TURNS},
v AS (SELECT conv, idx, text AS a, CASE (conv + idx) % 4 WHEN 0 THEN coalesce(lag(text) OVER (PARTITION BY conv ORDER BY idx), '') WHEN 1 THEN {told.upper('text')} WHEN 2 THEN text || ' and some more' ELSE left(text, length(text) // 2) END AS b FROM turns),
w AS (SELECT *, {_tokens('a')} AS ta, {_tokens('b')} AS tb, list_distinct(regexp_extract_all(lower({strip('a')}), '\\S+')) AS wa, list_distinct(regexp_extract_all(lower({strip('b')}), '\\S+')) AS wb,
      CASE WHEN a = '' THEN b <> '' ELSE starts_with(b, a) AND length(b) > length(a) END AS continues FROM v)
SELECT conv, idx, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN {key('a')} = {key('b')} ELSE {_likeness('ta', 'tb')} >= 0.55 END AS near, {told.told_alike('a', 'b')} AS same, continues,
       sha256(CASE WHEN continues THEN ltrim(substr(b, length(a) + 1), ' ' || chr(10)) ELSE b END) AS delta,
       lower({strip('a')}) = lower({strip('b')}) OR (len(wa) > 0 AND len(wb) > 0 AND {_likeness('wa', 'wb')} >= 0.95) AS one_action FROM w
""",
    "text_shapes": rf"""
WITH {TURNS}, w AS (SELECT conv, idx, text, {_WORDS} AS w FROM turns),
s AS (SELECT *, regexp_replace(lower(trim(array_to_string(w[1:12], ' '))), '[^\p{{L}}\p{{N}}_-]+', '-', 'g') AS s0, list_transform(w, lambda x: lower(x)) AS k,
      'Failed: /Users/' || coalesce(w[1], 'x') || '/run  Adapter_' || coalesce(w[2], 'x') || ' at /data/' || coalesce(w[3], 'x') || '.json, then /m/a.safetensors mlx' AS m, {strip('text')} AS bare FROM w),
r AS (SELECT *, coalesce(nullif(left(regexp_replace(regexp_replace(s0, '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g'), 64), ''), 'conversation') AS slug,
      trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '/[^\s:]+\.(safetensors|json|txt)', '[model]', 'g'), '/Users/[^\s]+', '[path]', 'g'), '(?i){_SHUT}[^\s]*', '', 'g'), '\s{{2,}}', ' ', 'g')) AS error FROM s)
SELECT conv, idx, slug, left(sha256(slug || ':now:' || sha256(bare)), 8) AS id, error, coalesce(list_min(list_filter(range(0, len(k)), lambda i: list_position(k, k[i + 1]) <= i)), -1) AS repeat,
       sha256(rtrim(text, ' ' || chr(10)) || chr(10) || chr(10) || {strip("right(bare, greatest(1, floor(length(bare) * 0.2::DOUBLE))::BIGINT)")}) AS grown FROM r
""",
    "voice_rules": f"""
WITH {TURNS}, w AS (SELECT conv, idx, {_WORDS} AS w FROM turns),
s AS (SELECT conv, idx, {_SAID} AS s, {_SAID} || chr(10) || chr(10) || 'The slice covers  ' || w[1] AS l FROM w)
SELECT conv, idx, {strip(f"array_to_string(list_transform(string_split(l, chr(10)), lambda x: {told.voice('x')}), chr(10))")} AS lines, {told.clean_summary('s')} AS summary,
       array_to_string({told.distinct_sentences(told.sentences('s'))}, '|') AS sentences, {told.next_from_text('s')} AS next, array_to_string({told.distinct_sentences(told.sentences('s'))}, ' ') AS place FROM s
""",
    "briefing_sections": f"""
WITH {STATES},
u AS (SELECT conv, unnest([{', '.join(f"{{'h': {q(h)}, 'b': {b}}}" for h, b in _BODIES.items())}], recursive := true) FROM bf)
SELECT conv, h AS header, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), chr(10)) AS body FROM u
""",
    "prompts": f"""
WITH {TURNS}, p AS (SELECT conv, idx, {strip('text')} AS t FROM turns)
SELECT conv, idx, form, sha256(CASE form WHEN 'bare' THEN t WHEN 'rules' THEN {q(RULES)} || 'Transcript:' || chr(10) || t WHEN 'instruction' THEN {q(INSTRUCTION)} || t ELSE {q(RULES + INSTRUCTION)} || t END) AS prompt
FROM p, (VALUES ('bare'), ('rules'), ('instruction'), ('both')) x(form)
""",
    "model_extraction": f"""
WITH {TURNS}, p AS (SELECT conv, idx, length({strip('text')}) + {len(RULES) + 12} AS n, row_number() OVER (PARTITION BY conv ORDER BY idx DESC) AS r FROM turns)
SELECT conv, idx AS chunk_index, CASE WHEN n % 7 = 3 THEN '' ELSE 'length ' || n END AS topic, n % 7 <> 3 AS parse_ok FROM p WHERE r = 1
""",
    "merged_chunks": f"""
WITH {TURNS}, c AS (SELECT conv, list(text ORDER BY idx) AS c, arg_max(text, (length(text), -idx)) AS longest FROM turns GROUP BY conv),
d AS (SELECT *, CASE WHEN len(c) <= 2 THEN c ELSE [array_to_string(c[1:len(c) // 2], chr(10) || chr(10)), array_to_string(c[len(c) // 2 + 1:], chr(10) || chr(10))] END AS two FROM c)
SELECT conv, sha256(array_to_string(c, chr(10) || chr(10))) AS one, sha256(array_to_string(two, '|')) AS two, len(two) AS n, sha256(longest) AS longest FROM d
""",
    "proxy_scores": f"""
WITH {SOURCES}, t AS (SELECT conv, archetype, conversation || CASE WHEN conv % 2 = 0 THEN chr(10) || 'Is it so?' ELSE ' todo' END AS text FROM src),
g AS (SELECT *, {_archetype_by_path()} AS kind, regexp_matches(lower(text), '\\b(done|completed|finished|next step|blocker|todo|implement)\\b') AS g,
      regexp_matches(text, '(?m)\\?\\s*$') OR length(text) - length(replace(text, '?', '')) > 8 AS asking FROM t),
l AS (SELECT *, asking AND NOT g AS loose FROM g),
n AS (SELECT *, CASE WHEN g THEN 2 WHEN loose THEN 1 ELSE 2 END AS na, CASE WHEN g THEN 3 ELSE 2 END AS ap, CASE WHEN loose THEN 0.35 ELSE 0.1 END::DOUBLE AS dup FROM l),
u AS (SELECT *, greatest(0, CASE WHEN g OR NOT loose THEN 2 ELSE 0 END + CASE WHEN length(text) > 500 THEN 2 ELSE 0 END + CASE WHEN g THEN 1 ELSE 0 END + least(2, na // 2) + least(1, ap // 3) - floor(dup * 3)::INT) AS pts, loose AND kind IN ('medical', 'informational_QA', 'casual_chat') AS low FROM n)
SELECT conv, kind AS archetype, CASE WHEN low THEN least(pts, 3) ELSE pts END::BIGINT AS usefulness, CASE WHEN low THEN 'low' WHEN pts >= 7 THEN 'high' WHEN pts >= 4 THEN 'medium' ELSE 'low' END AS tier, na::BIGINT AS next_action_score, ap::BIGINT AS active_problems_score, dup AS duplication_rate FROM u
""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "streamed_growth": f"""
WITH RECURSIVE {TURNS},
sn AS (SELECT conv, idx, CASE WHEN conv % 5 = 4 AND idx = 2 THEN 'Edited. ' ELSE '' END || string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv ORDER BY idx) AS t FROM turns),
st(conv, idx, held, ok, t) AS (
  SELECT conv, idx, t, true, t FROM sn WHERE idx = 0
  UNION ALL
  SELECT sn.conv, sn.idx, CASE WHEN starts_with(sn.t, held) AND length(sn.t) > length(held) THEN sn.t ELSE held END, starts_with(sn.t, held) AND length(sn.t) > length(held), sn.t FROM st JOIN sn ON sn.conv = st.conv AND sn.idx = st.idx + 1
),
pr AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY conv ORDER BY idx), '') AS prior FROM st)
SELECT conv, idx AS version, ok AS accepted, sha256(CASE WHEN ok THEN ltrim(substr(t, length(prior) + 1), ' ' || chr(10)) ELSE '' END) AS delta, CASE WHEN ok THEN length(t) - length(prior) ELSE 0 END AS chars_added, length(t) AS char_count FROM pr
""",
}
