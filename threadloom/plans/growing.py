"""Queries of conversations that grow: streamed updates, merged partial states, the versioned store, refreshed records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checkpoint, compare, firsts, measured, partial, pipeline
from ..session import scratch, table
from ..sources.store import Store
from ..streaming import updates as stream
from . import told
from .conversations import TURNS, turns
from .stores import _once, _states

SNAPSHOTS = "conv long, version long, text string, pieces array<struct<place:int,chunk:string>>"


def answer(chunk: str, place: int, total: int) -> str:
    """A stand-in for a model: the chunk's first 80 characters as its summary."""
    return json.dumps({"summary": chunk[:80], "place": place, "of": total})


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four versions of every transcript: its first half, the whole, the whole with its first turn edited,
    and the whole with its first turn once more at the end."""
    rows = turns(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("conv")))
    edit = F.when(F.col("idx") == 0, F.concat(F.lit("Edited. "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    first = rows.where("idx = 0")
    each = (
        rows.where("2 * idx < n").select("conv", F.lit(1).alias("version"), F.col("idx").alias("place"), F.col("text").alias("chunk"))
        .union(rows.select("conv", F.lit(2), "idx", "text"))
        .union(rows.select("conv", F.lit(3), "idx", edit))
        .union(rows.select("conv", F.lit(4), "idx", "text"))
        .union(first.select("conv", F.lit(4), "n", "text"))
    )
    pieces = F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.coalesce("chunk", F.lit("")).alias("chunk"))))
    whole = each.groupBy("conv", F.col("version").cast("long").alias("version")).agg(pieces.alias("pieces"))
    return whole.select("conv", "version", F.array_join(F.transform("pieces", lambda p: p["chunk"]), "\n\n").alias("text"), "pieces")


def streamed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of the transcripts as a stream: what is reused, extracted and rejected. The second
    version arrives twice, and the stream is stopped and restarted after it."""
    path = scratch(spark, "snapshots")
    rows = snapshots(spark, sf_dir)

    def run() -> None:
        arrived = spark.readStream.schema(SNAPSHOTS).parquet(f"{path}/in")
        query = stream.updates(arrived, answer).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
        query.awaitTermination()

    with stream.rocks_db(spark):
        for versions in ((1, 2), (2, 3, 4)):
            for v in versions:
                rows.where(F.col("version") == v).write.mode("append").parquet(f"{path}/in")
            run()
    out = spark.read.schema(stream.UPDATES).parquet(f"{path}/out")
    return out.select("conv", "version", "kind", F.coalesce("place", F.lit(-1)).alias("place"), F.coalesce("hash", F.lit("")).alias("hash"), F.coalesce(F.get_json_object("record", "$.summary"), F.lit("")).alias("summary"))


def merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States from partials of a third of the records each, merged out of order and twice over."""
    records = told.records(spark, sf_dir)
    a, b, c = (partial.partials(records.where(F.pmod(F.col("conv") + F.col("chunk_index"), F.lit(3)) == i)) for i in range(3))
    merged = partial.merge(partial.merge(c, a), partial.merge(b, a))
    out = partial.build(merged, told.sources(spark, sf_dir))
    joined = lambda c: F.array_join(c, "\n").alias(c)
    return out.select("conv", "current_state", "next_action", joined("completed_work"), joined("active_problems"), joined("constraints"), "objective_display")


STORED = "project string, text string, turns long"


def versioned_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after appends, a repeated append, compaction, deletions and a further append."""
    store = Store(spark, scratch(spark, "store"), STORED, buckets=16)
    rows = turns(spark, sf_dir).groupBy("conv").agg(F.min_by("text", "idx").alias("text"), F.count("*").alias("turns"))
    named = rows.select("conv", F.concat(F.lit("p"), "conv").alias("project"), F.coalesce("text", F.lit("")).alias("text"), "turns")
    store.append(named, 1)
    for _ in range(2):  # the second time changes nothing
        store.append(named.where("conv % 3 = 0").withColumn("text", F.concat(F.lit("Second. "), "text")), 2)
    store.compact()
    store.vacuum()
    store.append(named.where("conv % 5 = 0").withColumn("text", F.concat(F.lit("Third. "), "text")), 3, deleted=F.col("turns") % 2 == 0)
    return store.view().select("project", F.sha2("text", 256).alias("text"), "turns", "version")


def refreshed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records of which one is looked up and resumed as it is, and one is run anew and appended."""
    made = checkpoint.records(_states(spark, sf_dir), told.sources(spark, sf_dir)).where("project <> 'conversation'")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)
    store = Store(spark, scratch(spark, "records"), schema, buckets=16)
    store.append(made, 1)
    checkpoint.refreshed(store, "conversation 2", 2, "2024-03-03T00:00:00+00:00")
    view = store.view()
    return view.select("conv", "version", F.length("source.transcript_snapshot").cast("long").alias("chars"), F.substring("updated_at", 1, 10).alias("day"), (T.word_count(F.col("cached_exports.briefing")) > 0).alias("told"))


def _other(records: DataFrame) -> DataFrame:
    """What a second extractor might give: fails on some chunks, lacks others, tells some fields otherwise."""
    broken = (F.col("conv") + F.col("chunk_index")) % 5 == 1
    none = F.array().cast("array<string>")
    rows = records.where((F.col("conv") + 2 * F.col("chunk_index")) % 7 != 3)
    changed = {
        "objective": F.reverse("objective"),
        "decisions": F.when(F.size("decisions") > 0, F.slice("decisions", 2, 100)).otherwise(F.col("decisions")),
        "current_state": F.when(F.col("chunk_index") % 2 == 0, F.lit("")).when(F.col("conv") % 2 == 0, F.col("current_state")).otherwise(F.concat(F.lit("So "), "current_state")),
        "goals": F.concat("goals", F.array(F.lit("One more goal"))),
    }
    for n in compare.FIELDS:
        empty = F.lit("") if n in ("topic", "summary", "current_state", "continuation_context") else none
        rows = rows.withColumn(n, F.when(broken, empty).otherwise(changed.get(n, F.col(n))))
    return rows.withColumn("parse_ok", F.col("parse_ok") & ~broken)


def compared_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two extractors merged by chunk: outcome, and the verdict on four fields."""
    records = told.records(spark, sf_dir)
    rows = compare.compared(compare.merged(records, _other(records)))
    of = lambda n: F.get(F.col("fields"), compare.FIELDS.index(n))["verdict"].alias(n)
    return rows.select("conv", F.col("chunk_index").cast("long").alias("chunk_index"), "outcome", *map(of, ("objective", "decisions", "current_state", "goals")))


def long_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations long enough to be ranked: 25 documents after one another, whole, in paragraphs of at most 3,000 characters."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    bare = T.strip(F.coalesce("text", F.lit("")))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 3000).cast("int")), lambda i: F.substr(F.col("text"), i * 3000 + 1, F.lit(3000)))
    placed = docs.select((F.col("doc_id") / 25).cast("long").alias("conv"), "doc_id", bare.alias("text")).withColumn("text", F.array_join(parts, "\n\n"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda d: d["text"])
    return placed.groupBy("conv").agg(F.array_join(texts, "\n\n").alias("conversation")).select("conv", "conversation", F.concat(F.lit("long "), "conv").alias("label"), F.lit("mixed").alias("archetype"))


def observed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was observed while transcripts of documents were run: rows of each stage, characters cut, chunks chosen
    by rank, records parsed. Times are measured too and not compared."""
    run = measured.full(long_transcripts(spark, sf_dir), texts=False)
    rows = run.rows(spark)
    return rows.where("ms > 0").select("stage", F.col("position").cast("long").alias("position"), "rows", "measure")


def incremental_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, full and incremental runs over transcripts of documents that grow by a fifth, all chunks extracted:
    calls of the extractor, and how the two results of each grown transcript compare."""
    everything = pipeline.Options(budget=1 << 30)
    rows, _, _ = measured.compared(_once(spark, long_transcripts(spark, sf_dir), "long"), everything)
    return rows.select("conv", "calls_full", "calls_incremental", "quality_ratio", "completed_work", "active_problems", "constraints", "same_action")


def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no kept one of their language before repeats by half and more of its words."""
    kept = firsts.alike(table(spark, sf_dir, "documents"), "lang", "doc_id", "text")
    return kept.select("lang", "doc_id", F.sha2("text", 256).alias("text"))


def distinct_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a role that tell what none before it told, by conversation, turn and place."""
    spoken = turns(spark, sf_dir).select("conv", "idx", "role", F.posexplode(T.sentences(F.col("text"))).alias("nth", "sentence"))
    kept = firsts.told_once(spoken.withColumn("place", F.struct("conv", "idx", "nth")), "role", "place", "sentence")
    return kept.select("role", "place.conv", "place.idx", F.col("place.nth").cast("long").alias("nth"), "sentence")


QUERIES = [streamed_updates, merged_states, versioned_store, refreshed_records, compared_extractors, observed_run, incremental_benchmark, distinct_documents, distinct_statements]

# ---- the same results in SQL ----

_LONG = f"""src AS (
  SELECT doc_id // 25 AS conv, array_to_string(list(array_to_string(list_transform(range(0, length(t) // 3000 + 1), lambda i: substr(t, i * 3000 + 1, 3000)), chr(10) || chr(10)) ORDER BY doc_id), chr(10) || chr(10)) AS conversation
  FROM (SELECT doc_id, {told.strip("coalesce(text, '')")} AS t FROM documents WHERE doc_id IS NOT NULL) GROUP BY conv
)"""

SQL = {
    "distinct_documents": f"""
WITH d AS (SELECT lang, doc_id, {told.collapse("coalesce(text, '')")} AS t FROM documents),
k AS (SELECT lang, doc_id, t, lower(t) AS k, list_distinct(regexp_extract_all(lower(t), '[a-z0-9]{{3,}}')) AS w FROM d WHERE t <> ''),
l AS (SELECT lang, list([{{'id': doc_id, 't': t, 'k': k, 'w': w}}] ORDER BY doc_id NULLS FIRST, t) AS items FROM k GROUP BY lang),
f AS (SELECT lang, list_reduce(items, lambda a, b: CASE WHEN len(list_filter(a, lambda x: CASE WHEN len(x.w) = 0 OR len(b[1].w) = 0 THEN x.k = b[1].k WHEN least(len(x.w), len(b[1].w)) < 0.55 * greatest(len(x.w), len(b[1].w)) THEN false ELSE len(list_intersect(x.w, b[1].w)) / (len(x.w) + len(b[1].w) - len(list_intersect(x.w, b[1].w))) >= 0.55::DOUBLE END)) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM l),
o AS (SELECT lang, unnest(kept) AS x FROM f)
SELECT lang, x.id AS doc_id, sha256(x.t) AS text FROM o""",
    "distinct_statements": f"""
WITH {TURNS},
s AS (SELECT conv, idx, role, {told.sentences("coalesce(text, '')")} AS ss FROM turns),
e AS (SELECT conv, idx, role, unnest(ss) AS sentence, unnest(range(len(ss))) AS nth FROM s),
k AS (SELECT *, {told.key("sentence")} AS k FROM e),
l AS (SELECT role, list([{{'conv': conv, 'idx': idx, 'nth': nth, 's': sentence, 'k': k, 'h': substr(k, 1, 80), 'n': length(k)}}] ORDER BY conv NULLS FIRST, idx, nth) AS items FROM k WHERE k <> '' GROUP BY role),
f AS (SELECT role, list_reduce(items, lambda a, b: CASE WHEN len(list_filter(a, lambda x: x.h = b[1].h OR (x.n <= b[1].n AND x.n >= 40 AND contains(b[1].k, x.k)) OR (b[1].n <= x.n AND b[1].n >= 40 AND contains(x.k, b[1].k)))) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM l),
o AS (SELECT role, unnest(kept) AS x FROM f)
SELECT role, x.conv AS conv, x.idx AS idx, x.nth AS nth, x.s AS sentence FROM o""",
    "streamed_updates": f"""
WITH {TURNS},
t AS (SELECT conv, idx, coalesce(text, '') AS text, count(*) OVER (PARTITION BY conv) AS n FROM turns),
p AS (
  SELECT conv, 1 AS version, idx AS place, text AS chunk FROM t WHERE 2 * idx < n
  UNION ALL SELECT conv, 2, idx, text FROM t
  UNION ALL SELECT conv, 3, idx, CASE WHEN idx = 0 THEN 'Edited. ' || text ELSE text END FROM t
  UNION ALL SELECT conv, 4, idx, text FROM t UNION ALL SELECT conv, 4, n, text FROM t WHERE idx = 0
),
h AS (SELECT *, left(sha256({told.strip('chunk')}), 16) AS hash FROM p),
x AS (SELECT conv, version, {told.strip("string_agg(chunk, chr(10) || chr(10) ORDER BY place)")} AS text FROM p GROUP BY conv, version),
w AS (SELECT conv, max(text) FILTER (WHERE version = 1) AS t1, max(text) FILTER (WHERE version = 2) AS t2, max(text) FILTER (WHERE version = 3) AS t3, max(text) FILTER (WHERE version = 4) AS t4 FROM x GROUP BY conv),
a1 AS (SELECT *, CASE WHEN t1 <> '' THEN 1 ELSE 0 END AS l1, CASE WHEN t1 <> '' THEN t1 ELSE '' END AS b1 FROM w),
a2 AS (SELECT *, CASE WHEN starts_with(t2, b1) AND length(t2) > length(b1) THEN 2 ELSE l1 END AS l2, CASE WHEN starts_with(t2, b1) AND length(t2) > length(b1) THEN t2 ELSE b1 END AS b2 FROM a1),
a3 AS (SELECT *, CASE WHEN starts_with(t3, b2) AND length(t3) > length(b2) THEN 3 ELSE l2 END AS l3, CASE WHEN starts_with(t3, b2) AND length(t3) > length(b2) THEN t3 ELSE b2 END AS b3 FROM a2),
a4 AS (SELECT *, CASE WHEN starts_with(t4, b3) AND length(t4) > length(b3) THEN 4 ELSE l3 END AS l4 FROM a3),
v AS (SELECT conv, 1 AS version, 0 AS base, l1 AS now FROM a4 UNION ALL SELECT conv, 2, l1, l2 FROM a4 UNION ALL SELECT conv, 3, l2, l3 FROM a4 UNION ALL SELECT conv, 4, l3, l4 FROM a4)
SELECT v.conv, v.version::BIGINT AS version, CASE WHEN o.hash IS NULL THEN 'extracted' ELSE 'reused' END AS kind, h.place::INT AS place, h.hash, left(h.chunk, 80) AS summary
FROM v JOIN h ON h.conv = v.conv AND h.version = v.version LEFT JOIN h o ON o.conv = v.conv AND o.version = v.base AND o.place = h.place AND o.hash = h.hash WHERE v.now = v.version
UNION ALL SELECT conv, version, 'rejected', -1, '', '' FROM v WHERE now <> version
""",
    "merged_states": f"""
WITH {told.STATES}
SELECT conv, current_state, next_action, array_to_string(completed_work, chr(10)) AS completed_work, array_to_string(active_problems, chr(10)) AS active_problems,
       array_to_string(constraints, chr(10)) AS constraints, objective_display FROM bf
""",
    "versioned_store": f"""
WITH {TURNS},
t AS (SELECT conv, coalesce(arg_min(text, idx), '') AS text, count(*) AS turns FROM turns GROUP BY conv)
SELECT 'p' || conv AS project, sha256(CASE WHEN conv % 5 = 0 THEN 'Third. ' WHEN conv % 3 = 0 THEN 'Second. ' ELSE '' END || text) AS text, turns,
       (CASE WHEN conv % 5 = 0 THEN 3 WHEN conv % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS version
FROM t WHERE conv % 5 <> 0 OR turns % 2 = 1
""",
    "refreshed_records": f"""
WITH {told.SOURCES}
SELECT conv, (CASE WHEN label = 'conversation 2' THEN 2 ELSE 1 END)::BIGINT AS version, length(conversation)::BIGINT AS chars,
       CASE WHEN label = 'conversation 2' THEN '2024-03-03' ELSE '{told.CREATED[:10]}' END AS day, true AS told FROM src WHERE label <> ''
""",
    "compared_extractors": f"""
WITH {told.RECORDS},
k AS (
  SELECT conv, i, topic <> '' OR summary <> '' AS ok, list_transform(list_filter(objective, lambda x: trim(x) <> ''), lambda x: {told.key('x')}) AS o, decisions AS d, current_state AS s, goals AS g,
         (conv + i) % 5 = 1 AS broken, (conv + 2 * i) % 7 = 3 AS lacking FROM rec
),
v AS (
  SELECT conv, i, ok AS a, ok AND NOT broken AND NOT lacking AS b, broken OR lacking AS none,
         list_distinct(o) AS oa, list_distinct(list_transform(d, lambda x: {told.key('x')})) AS da, list_distinct(list_transform(d[2:], lambda x: {told.key('x')})) AS db,
         {told.key('s')} AS sa, CASE WHEN i % 2 = 0 THEN '' WHEN conv % 2 = 0 THEN {told.key('s')} ELSE {told.key("'So ' || s")} END AS sb, list_distinct(list_transform(g, lambda x: {told.key('x')})) AS ga FROM k
)
SELECT conv, i AS chunk_index, CASE WHEN a AND b THEN 'both' WHEN a THEN 'left' WHEN b THEN 'right' ELSE 'none' END AS outcome,
  CASE WHEN len(oa) = 0 THEN 'empty' WHEN none THEN 'left' ELSE 'same' END AS objective,
  CASE WHEN len(da) = 0 THEN 'empty' WHEN none OR len(db) = 0 THEN 'left' WHEN len(db) = len(da) THEN 'same' ELSE 'differ' END AS decisions,
  CASE WHEN sa = '' AND (none OR sb = '') THEN 'empty' WHEN none OR sb = '' THEN 'left' WHEN sa = sb THEN 'same' WHEN sa = '' THEN 'right' ELSE 'differ' END AS current_state,
  CASE WHEN none AND len(ga) = 0 THEN 'empty' WHEN none THEN 'left' WHEN len(ga) = 0 THEN 'right' WHEN list_contains(ga, 'one more goal') THEN 'same' ELSE 'differ' END AS goals
FROM v
""",
    "observed_run": f"""
WITH RECURSIVE {_LONG},
{told.chunks_sql('ch', "(SELECT conv, conversation AS t FROM src)")},
c AS (SELECT conv, count(*) AS n, sum(length(chunk)) AS chars FROM ch GROUP BY conv),
k AS (SELECT *, CASE WHEN n <= 0 THEN 0 ELSE least(n, greatest(3, least(8, ceil(n / 5.0)))) END AS k FROM c)
SELECT 'chunks' AS stage, 0 AS position, sum(n)::BIGINT AS rows, sum(chars)::BIGINT AS measure FROM k
UNION ALL SELECT 'ranked', 1, count(*), sum(k)::BIGINT FROM k
UNION ALL SELECT 'records', 2, sum(k)::BIGINT, sum(k)::BIGINT FROM k
""",
    "incremental_benchmark": f"""
WITH RECURSIVE {_LONG},
g AS (SELECT conv, conversation, {told.strip('conversation')} AS bare FROM src),
more AS (SELECT conv, bare, bare || chr(10) || chr(10) || {told.strip("right(bare, greatest(1, floor(length(bare) * 0.2)::INT))")} AS grown FROM g),
{told.chunks_sql('old', "(SELECT conv, conversation AS t FROM src)")},
{told.chunks_sql('new', "(SELECT conv, grown AS t FROM more)")},
h AS (SELECT new.conv, new.i, {told.strip('new.chunk')} AS c, {told.strip('old.chunk')} AS o, starts_with(grown, bare) AND length(grown) > length(bare) AS ok
      FROM new JOIN more ON more.conv = new.conv LEFT JOIN old ON old.conv = new.conv AND old.i = new.i)
SELECT conv, count(*) AS calls_full, count(*) FILTER (WHERE NOT ok OR o IS NULL OR o <> c) AS calls_incremental, 1.0::DOUBLE AS quality_ratio,
       1.0::DOUBLE AS completed_work, 1.0::DOUBLE AS active_problems, 1.0::DOUBLE AS constraints, true AS same_action FROM h GROUP BY conv
""",
}
