"""Queries of the chunking, scoring, ranking and selection operators over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import saliency as S
from ..functions import text as T
from ..operators import chunking, embedding, ranking, selection
from ..session import table

GROUP = 20  # embeddings of one conversation


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a chunk of its conversation: conv, idx from 0, role, text."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), (F.row_number().over(own) - 1).alias("idx"), "role", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select((F.col("vec_id") / GROUP).cast("long").alias("conv"), (F.col("vec_id") % GROUP).cast("int").alias("idx"), ranking.unit(F.col("embedding")).alias("embedding"), F.col("label").alias("cluster"))


def r6(*names: str):
    return [(T.rounded(n, 6) + F.lit(0.0)).alias(n) for n in names]


def chunk_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole documents: a line longer than a chunk is split."""
    return _chunks(spark, sf_dir, chunking.Chunking())


def chunk_transcripts_shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker's first form, in which a line longer than a chunk loses its end."""
    return _chunks(spark, sf_dir, chunking.Chunking(shorten=True))


def _chunks(spark: SparkSession, sf_dir: str, options: chunking.Chunking) -> DataFrame:
    rows = chunking.chunk_transcripts(table(spark, sf_dir, "documents"), "doc_id", options=options)
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "strategy", F.col("n_chars").cast("long").alias("n_chars"), "content_hash")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole transcripts from turns, with their hash."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("t"))
    text = F.array_join(F.transform("t", lambda t: t["text"]), "\n\n")
    return rows.select("conv_id", text.alias("text")).select("conv_id", F.length("text").cast("long").alias("char_count"), T.transcript_hash(F.col("text")).alias("sha256"))


def turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap of every turn with the one before."""
    own = Window.partitionBy("conv").orderBy("idx")
    rows = turns(spark, sf_dir).withColumn("tok", T.token_set(F.col("text"))).withColumn("prev", F.lag("tok").over(own)).where("prev IS NOT NULL")
    return rows.select("conv", F.col("idx").cast("long").alias("idx"), *[T.rounded(x, 6).alias(n) for n, x in (("jaccard", T.jaccard(F.col("tok"), F.col("prev"))), ("containment", T.containment(F.col("tok"), F.col("prev"))))])


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, word and sentence counts, slug and hashes of every turn."""
    text = F.col("text")
    return turns(spark, sf_dir).select(
        "conv", F.col("idx").cast("long").alias("idx"), T.norm_key(text).alias("norm"), T.word_count(text).cast("long").alias("n_words"),
        F.size(T.sentences(text)).cast("long").alias("n_sentences"), T.content_hash(text).alias("hash"), T.clip_words(text, 8).alias("clipped"),
    )


SCORES = [*S.COGNITIVE, "user_initiative", "unresolved_pressure", "constraint_binding", "transition", "novelty", "redundancy", "trajectory_delta", "conceptual_gravity", "saliency"]


def saliency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.scores(turns(spark, sf_dir).select("conv", "idx", "text")).select("conv", F.col("idx").cast("long").alias("idx"), *SCORES)


def evolution_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.evolution(selection.scores(turns(spark, sf_dir).select("conv", "idx", "text")))


def head_tail_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.coverage(selection.head_tail(turns(spark, sf_dir), most=4))
    return out.select("conv", *[F.col(c).cast("long").alias(c) for c in ("chunks", "chosen", "chars", "chars_chosen")], "coverage_ratio", "continuity")


def dropped_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.dropped_ranges(selection.head_tail(turns(spark, sf_dir), most=3))
    return out.select("conv", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def adaptive_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.scores(turns(spark, sf_dir).select("conv", "idx", "text")).withColumn("pos", F.col("idx"))
    return selection.adaptive(rows, most=7).select("conv", F.col("n").cast("long").alias("n"), F.array_join(F.transform("selected", lambda i: i.cast("string")), ",").alias("selected"))


def selection_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each strategy of the dispatcher selects."""
    rows = turns(spark, sf_dir).select("conv", "idx", "text")
    made = [selection.choose(rows, 7, s).withColumn("asked", F.lit(s)) for s in ("adaptive", "head_tail", "head")]
    return made[0].union(made[1]).union(made[2]).select("conv", "asked", F.col("n").cast("long").alias("n"), "strategy", F.array_join(F.transform("selected", lambda i: i.cast("string")), ",").alias("selected"))


def cluster_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk nearest to the mean of each cluster."""
    rows = embedding.nearest_to_centre(vectors(spark, sf_dir).select("conv", "idx", "embedding", "cluster"))
    return rows.select("conv", F.col("cluster").cast("long").alias("cluster"), F.col("centroid").cast("long").alias("centroid"))


def displacement_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.features(vectors(spark, sf_dir))
    return out.select("conv", F.col("idx").cast("long").alias("idx"), *r6("delta", "kappa", "z_delta", "z_kappa", "mass", "recency"), "cluster_start", "representative", "peak_delta", "peak_kappa")


def cluster_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.cluster_head_tail(vectors(spark, sf_dir), most=8)
    return out.select("conv", F.col("idx").cast("long").alias("idx"), F.col("cluster").cast("long").alias("cluster"), F.col("cluster_size").cast("long").alias("cluster_size"), "score", F.col("place").cast("long").alias("place"))


def rank_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.rank(vectors(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return out.select("conv", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), "strategy", text("selected"), text("cuts"))


QUERIES = [chunk_transcripts, chunk_transcripts_shortened, transcripts, turn_overlap, text_measures, saliency_scores, evolution_likelihood, head_tail_selection, dropped_ranges, adaptive_selection, selection_strategies, displacement_series, cluster_head_tail, cluster_centres, rank_chunks]

# ---- the same results in SQL ----

TURNS = "turns AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text FROM conversations)"
TOKENS = "list_distinct(list_transform(list_filter(regexp_extract_all({0}, '[a-zA-Z][a-zA-Z0-9_+-]+'), lambda t: len(t) >= 3), lambda t: lower(t)))"


def _hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '(?i){pattern.replace(chr(39), chr(39) * 2)}'))"


def _clamp(x: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


def _score_sql() -> str:
    parts = {
        "user_initiative": f"round({_clamp(f'0.6::DOUBLE * {_clamp(_hits('low', S.INITIATIVE) + ' / 4.0::DOUBLE')} + 0.4::DOUBLE * (1.0::DOUBLE - {_clamp(_hits('low', S.ELABORATION) + ' / 5.0::DOUBLE')})')}, 4)",
        "unresolved_pressure": f"round({_clamp(_hits('low', S.UNRESOLVED) + ' / 5.0::DOUBLE')}, 4)",
        "constraint_binding": f"round({_clamp(_hits('low', S.CONSTRAINT) + ' / 4.0::DOUBLE')}, 4)",
        "transition": f"round({_clamp(f'({_hits('text', S.PIVOT)} + {_hits('text', S.STRUCTURE)}) / 5.0::DOUBLE')}, 4)",
        "g1": f"least(4, {_hits('low', S.METHODOLOGY)})", "g2": f"least(4, {_hits('low', S.STRUCTURE)})", "g3": f"least(4, {_hits('low', S.PIVOT)})",
    }
    for name, (pattern, weight) in S.COGNITIVE.items():
        parts[name] = f"round({_clamp(f'({weight}::DOUBLE * least(10, {_hits('low', pattern)}) + 0.02::DOUBLE) * norm')}, 4)"
    own = ", ".join(f"{v} AS {k}" for k, v in parts.items())
    recent = "string_agg(text, chr(10)) OVER (PARTITION BY conv ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    return f"""
{TURNS},
base AS (SELECT conv, idx, text, lower(text) AS low, greatest(0.45::DOUBLE, least(1.0::DOUBLE, sqrt(length(trim(text))) / 22.0::DOUBLE)) AS norm,
         {TOKENS.format('text')} AS tok, coalesce({recent}, '') AS rec FROM turns),
tok AS (SELECT *, {TOKENS.format('rec')} AS rtok FROM base),
ovl AS (SELECT *, CASE WHEN len(tok) = 0 OR len(rtok) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(tok, rtok))::DOUBLE / len(list_distinct(list_concat(tok, rtok))) END AS o FROM tok),
part AS (SELECT *, {own}, round(1.0::DOUBLE - o, 4) AS novelty, round(o, 4) AS redundancy, round(1.0::DOUBLE - o, 4) AS trajectory_delta FROM ovl),
grav AS (SELECT *, round({_clamp('(0.052::DOUBLE * g1 + 0.04::DOUBLE * g2 + 0.035::DOUBLE * g3 + least(0.22::DOUBLE, 0.08::DOUBLE * architecture + 0.07::DOUBLE * failure + 0.06::DOUBLE * reasoning_shift + 0.05::DOUBLE * tradeoff)) * 2.8::DOUBLE')}, 4) AS conceptual_gravity FROM part),
scored AS (SELECT *, round({_clamp('0.18::DOUBLE * trajectory_delta + 0.16::DOUBLE * unresolved_pressure + 0.10::DOUBLE * novelty - 0.08::DOUBLE * redundancy + 0.14::DOUBLE * reasoning_shift + 0.12::DOUBLE * architecture + 0.08::DOUBLE * failure + 0.08::DOUBLE * operational + 0.10::DOUBLE * conceptual_gravity + 0.10::DOUBLE * transition + 0.06::DOUBLE * constraint_binding')}, 4) AS saliency FROM grav)"""


FEATURES = f"""
v AS (SELECT vec_id // {GROUP} AS conv, vec_id % {GROUP} AS idx, label AS cluster, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT conv, idx, cluster, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
p AS (SELECT *, lag(e) OVER w AS q, count(*) OVER (PARTITION BY conv) AS n, row_number() OVER w AS rn,
      count(*) OVER (PARTITION BY conv, cluster) AS cluster_size, min(idx) OVER (PARTITION BY conv, cluster) AS lo, max(idx) OVER (PARTITION BY conv, cluster) AS hi,
      coalesce(cluster <> lag(cluster) OVER w, false) AS cluster_start FROM u WINDOW w AS (PARTITION BY conv ORDER BY idx)),
d AS (SELECT *, CASE WHEN q IS NULL THEN 0.0 ELSE 1.0 - list_sum(list_transform(list_zip(e, q), lambda z: z[1] * z[2])) END AS delta,
      cluster_size::DOUBLE / max(cluster_size) OVER (PARTITION BY conv) AS mass, (idx + 1)::DOUBLE / n AS recency, idx = hi OR (idx = lo AND cluster_size >= 3) AS representative FROM p),
k AS (SELECT *, CASE WHEN n < 3 OR rn < 3 THEN 0.0 ELSE delta - lag(delta) OVER (PARTITION BY conv ORDER BY idx) END AS kappa FROM d),
c AS (SELECT *, delta - median(delta) OVER (PARTITION BY conv) AS cd, kappa - median(kappa) OVER (PARTITION BY conv) AS ck FROM k),
m AS (SELECT *, median(abs(cd)) OVER (PARTITION BY conv) AS md, median(abs(ck)) OVER (PARTITION BY conv) AS mk FROM c),
z AS (SELECT *, cd / CASE WHEN md > 1e-12 THEN 1.4826 * md ELSE 1.0 END AS z_delta, ck / CASE WHEN mk > 1e-12 THEN 1.4826 * mk ELSE 1.0 END AS z_kappa FROM m)"""


def _peak(v: str) -> str:
    w = "OVER (PARTITION BY conv ORDER BY idx)"
    return f"coalesce({v} >= lag({v}) {w} AND {v} > lead({v}) {w} AND z_{v} >= 1.0, false) AS peak_{v}"


def _selected(most: int, head: int) -> str:
    return f"""{TURNS},
s AS (SELECT conv, idx AS pos, text, count(*) OVER (PARTITION BY conv) AS n FROM turns),
h AS (SELECT *, n <= {most} OR pos < {head} OR pos >= n - {most - head} AS selected FROM s)"""


def _chunks_sql(shorten: bool) -> str:
    lines = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    split = lines if shorten else f"flatten(list_transform({lines}, lambda x: list_transform(range(0, (length(x) - 1) // 6000 + 1), lambda k: substr(x, k * 6000 + 1, 6000))))"
    return """
WITH RECURSIVE d AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM documents),
long AS (SELECT doc_id, t, {split} AS l FROM d WHERE length(t) > 6000),
pack(doc_id, l, i, open, done) AS (
  SELECT doc_id, l, 1, '', []::VARCHAR[] FROM long
  UNION ALL
  SELECT doc_id, l, i + 1,
    CASE WHEN open = '' AND length(l[i]) <= 6000 THEN l[i] WHEN open <> '' AND length(open) + 1 + length(l[i]) <= 6000 THEN open || chr(10) || l[i] ELSE left(l[i], 6000) END,
    CASE WHEN open <> '' AND length(open) + 1 + length(l[i]) > 6000 THEN list_append(done, open) ELSE done END
  FROM pack WHERE i <= len(l)
),
base AS (
  SELECT doc_id, CASE WHEN open = '' THEN done ELSE list_append(done, open) END AS c FROM pack WHERE i = len(l) + 1
  UNION ALL SELECT doc_id, [t] FROM d WHERE length(t) BETWEEN 1 AND 6000
),
lap(doc_id, c, i, chunk) AS (
  SELECT doc_id, c, 1, c[1] FROM base
  UNION ALL
  SELECT doc_id, c, i + 1, CASE WHEN starts_with(c[i + 1], tail) THEN c[i + 1] ELSE tail || chr(10) || chr(10) || c[i + 1] END
  FROM (SELECT *, CASE WHEN length(chunk) <= 500 THEN chunk ELSE ltrim(right(chunk, 500), ' ' || chr(10)) END AS tail FROM lap) WHERE i < len(c)
)
SELECT doc_id, (i - 1)::BIGINT AS chunk_index, CASE WHEN length(t) <= 4500 THEN 'short_circuit' ELSE 'paragraph_chunk_overlap' END AS strategy,
       length(chunk) AS n_chars, left(sha256(trim(chunk, ' ' || chr(10) || chr(9))), 16) AS content_hash
FROM lap JOIN d USING (doc_id)
""".replace("{split}", split)


def _greedy_sql(most: int) -> str:
    """CTE ad: conv, n and the places of the adaptive selection."""
    head, middle, tail = selection.slots(most)
    jac = "(CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END)"
    near = "(abs(x[1].pos - acc[-1].pos) <= 1 AND x[1].s < 1.08 * acc[-1].s)"
    alike = f"(x[1].s < 0.52 AND len(list_filter(acc, lambda k: {jac.format('k.tok', 'x[1].tok')} >= 0.72)) > 0)"
    fold = lambda start, refuse: f"list_reduce(list_transform(ranked, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) >= {middle} OR {refuse} THEN acc ELSE list_concat(acc, x) END, {start})"
    kind = "STRUCT(pos BIGINT, s DOUBLE, tok VARCHAR[])[]"
    return f"""{_score_sql()},
ag AS (SELECT conv, count(*) AS n, list({{'pos': idx, 's': saliency, 'tok': tok}} ORDER BY saliency DESC, idx) AS items FROM scored GROUP BY conv),
ai AS (SELECT conv, n, coalesce(list_filter(items, lambda c: c.pos >= {head} AND c.pos < n - {tail}), [])::{kind} AS ranked FROM ag),
ah AS (SELECT *, {fold(f'[]::{kind}', f'(len(acc) > 0 AND ({near} OR {alike}))')} AS taken FROM ai),
au AS (SELECT *, {fold('taken', 'len(list_filter(acc, lambda k: k.pos = x[1].pos)) > 0')} AS chosen FROM ah),
ad AS (SELECT conv, n, CASE WHEN n <= {most} THEN range(0, n) ELSE list_sort(list_concat(list_filter(range(0, n), lambda p: p < {head} OR p >= n - {tail}), list_transform(chosen, lambda c: c.pos))) END AS selected FROM au)"""


def _rank_sql() -> str:
    nearest = "coalesce(list_max(list_transform(picked, lambda p: list_sum(list_transform(list_zip(c.e, p.e), lambda z: z[1] * z[2])))), 0.0)"
    option = "greatest(q[e + 2] - q[st + 1] - (s[e + 2] - s[st + 1]) * (s[e + 2] - s[st + 1]) / (e + 1 - st), 0.0)"
    return f"""
WITH RECURSIVE {FEATURES},
pk AS (SELECT *, {_peak('delta')}, {_peak('kappa')} FROM z),
ser AS (SELECT conv, any_value(n) AS n, list(delta ORDER BY idx) AS x, {ranking.PENALTY}::DOUBLE * ln(greatest(any_value(n), 2)) AS p FROM pk GROUP BY conv),
pre AS (SELECT conv, n, p, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(x[1:i]), 0.0)) AS s, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(list_transform(x[1:i], lambda y: y * y)), 0.0)) AS q FROM ser),
dp(conv, n, p, s, q, e, cost, cut) AS (
  SELECT conv, n, p, s, q, 0::BIGINT, [0.0::DOUBLE], [0::BIGINT] FROM pre
  UNION ALL
  SELECT conv, n, p, s, q, e + 1, list_append(cost, b.c), list_append(cut, b.k)
  FROM (SELECT *, list_sort(list_transform(range(0, e + 1), lambda st: {{'c': round(cost[st + 1] + {option} + p, 12), 'k': st}}))[1] AS b FROM dp WHERE e < n)
),
bk(conv, cut, place, cuts) AS (
  SELECT conv, cut, cut[n + 1], []::BIGINT[] FROM dp WHERE e = n
  UNION ALL
  SELECT conv, cut, cut[place + 1], list_concat([place], cuts) FROM bk WHERE place > 0
),
cp AS (SELECT bk.conv, CASE WHEN ser.n < 4 THEN [] ELSE cuts END AS cuts FROM bk JOIN ser USING (conv) WHERE place = 0),
bd AS (SELECT pk.*, cuts, list_contains(cuts, idx) OR list_contains(cuts, idx - 1) OR peak_delta OR peak_kappa OR cluster_start OR representative AS boundary, idx = n - 1 OR (n > 15 AND idx = n - 2) AS locked FROM pk JOIN cp USING (conv)),
sc AS (SELECT *, {ranking.WEIGHT_SHIFT}::DOUBLE * z_delta + {ranking.WEIGHT_RECENCY}::DOUBLE * recency + {ranking.WEIGHT_MASS}::DOUBLE * mass + {ranking.WEIGHT_BOUNDARY}::DOUBLE * boundary::INT AS score FROM bd),
it AS (SELECT conv, any_value(n) AS n, any_value(cuts) AS cuts, least(any_value(n), greatest(3, least(8, ceil(any_value(n) / 5.0))))::BIGINT AS k, list({{'i': idx, 'score': score, 'e': e}} ORDER BY score DESC, idx DESC) AS items,
       coalesce(list({{'i': idx, 'score': score, 'e': e}} ORDER BY idx) FILTER (WHERE locked), []) AS locks, coalesce(list({{'i': idx, 'score': score, 'e': e}} ORDER BY idx) FILTER (WHERE boundary AND NOT locked), []) AS pool FROM sc GROUP BY conv),
mm(conv, k, picked, pool) AS (
  SELECT conv, k, locks, pool FROM it
  UNION ALL
  SELECT conv, k, list_append(picked, best), list_filter(pool, lambda c: c.i <> best.i)
  FROM (SELECT *, list_sort(list_transform(pool, lambda c: {{'w': -round({ranking.MMR_LAMBDA}::DOUBLE * c.score - {1 - ranking.MMR_LAMBDA}::DOUBLE * {nearest}, 12), 'i': c.i, 'c': c}}))[1].c AS best FROM mm WHERE len(picked) < k AND len(pool) > 0)
),
dn AS (SELECT conv, arg_max(picked, len(picked)) AS picked FROM mm GROUP BY conv)
SELECT conv, n, k, CASE WHEN n <= k THEN 'full' ELSE 'ranked' END AS strategy,
       array_to_string(CASE WHEN n <= k THEN range(0, n) ELSE list_sort(list_concat(list_transform(picked, lambda c: c.i), list_transform(list_filter(items, lambda c: NOT list_contains(list_transform(picked, lambda p: p.i), c.i)), lambda c: c.i))[1:greatest(k, len(picked))]) END, ',') AS selected,
       array_to_string(cuts, ',') AS cuts FROM it JOIN dn USING (conv)
"""


_HEAD_TAIL_7 = "CASE WHEN n <= 7 THEN range(0, n) ELSE list_filter(range(0, n), lambda p: p < 5 OR p >= n - 2) END"

SQL = {
    "chunk_transcripts": _chunks_sql(False),
    "chunk_transcripts_shortened": _chunks_sql(True),
    "adaptive_selection": f"WITH {_greedy_sql(7)} SELECT conv, n, array_to_string(selected, ',') AS selected FROM ad",
    "selection_strategies": f"""
WITH {_greedy_sql(7)}, s AS (
  SELECT conv, 'adaptive' AS asked, n, selected FROM ad UNION ALL SELECT conv, 'head_tail', n, {_HEAD_TAIL_7} FROM ad UNION ALL SELECT conv, 'head', n, range(0, least(n, 7)) FROM ad)
SELECT conv, asked, n, CASE WHEN n <= 3 THEN 'full' ELSE asked END AS strategy, array_to_string(CASE WHEN n <= 3 THEN range(0, n) ELSE selected END, ',') AS selected FROM s
""",
    "rank_chunks": _rank_sql(),
    "cluster_centres": f"""
WITH {FEATURES},
x AS (SELECT conv, idx, cluster, unnest(e) AS v, generate_subscripts(e, 1) AS d FROM u),
mean AS (SELECT conv, cluster, d, avg(v) AS m FROM x GROUP BY ALL),
far AS (SELECT conv, cluster, idx, round(sum((v - m) * (v - m)), 12) AS f FROM x JOIN mean USING (conv, cluster, d) GROUP BY ALL)
SELECT conv, cluster::BIGINT AS cluster, arg_min(idx, (f, idx)) AS centroid FROM far GROUP BY conv, cluster
""",
    "transcripts": "SELECT conv_id, length(t) AS char_count, sha256(trim(t, ' ' || chr(10))) AS sha256 FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)",
    "turn_overlap": f"""
WITH {TURNS}, t AS (SELECT conv, idx, {TOKENS.format('text')} AS tok FROM turns),
p AS (SELECT *, lag(tok) OVER (PARTITION BY conv ORDER BY idx) AS prev FROM t)
SELECT conv, idx, CASE WHEN len(tok) = 0 OR len(prev) = 0 THEN 0.0 ELSE round(len(list_intersect(tok, prev))::DOUBLE / len(list_distinct(list_concat(tok, prev))), 6) END AS jaccard,
       CASE WHEN len(tok) = 0 OR len(prev) = 0 THEN 0.0 ELSE round(len(list_intersect(tok, prev))::DOUBLE / least(len(tok), len(prev)), 6) END AS containment
FROM p WHERE prev IS NOT NULL
""",
    "text_measures": rf"""
WITH {TURNS}, w AS (SELECT conv, idx, text, regexp_extract_all(text, '\S+') AS w FROM turns)
SELECT conv, idx, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm, len(w) AS n_words,
       (len(regexp_extract_all(trim(text), '[.!?]\s+')) + 1)::BIGINT AS n_sentences, left(sha256(trim(text)), 16) AS hash,
       CASE WHEN len(w) <= 8 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:8], ' ') || '…' END AS clipped
FROM w
""",
    "saliency_scores": f"WITH {_score_sql()} SELECT conv, idx, {', '.join(SCORES)} FROM scored",
    "evolution_likelihood": f"""
WITH {_score_sql()},
e AS (SELECT conv, failure, CASE WHEN transition > 0.35 AND failure < 0.12 THEN greatest(failure * 1.1::DOUBLE, operational * 0.5::DOUBLE, 0.22::DOUBLE)
      ELSE greatest(failure * 1.15::DOUBLE, reasoning_shift * 0.9::DOUBLE, operational * 0.85::DOUBLE, transition * 0.45::DOUBLE) END AS v FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY conv) AS n FROM e),
a AS (SELECT conv, avg(v) FILTER (WHERE r <= greatest(2, n // 2)) AS m, any_value(n) AS n, count(*) FILTER (WHERE failure >= 0.2) AS f FROM r GROUP BY conv)
SELECT conv, round(least(1.0::DOUBLE, CASE WHEN n >= 2 AND f < 2 THEN least(m, 0.36::DOUBLE) ELSE m END), 4) AS evolution FROM a
""",
    "head_tail_selection": f"""
WITH {_selected(4, 3)}
SELECT conv, count(*) AS chunks, count(*) FILTER (WHERE selected) AS chosen, sum(length(text))::BIGINT AS chars, sum(length(text)) FILTER (WHERE selected)::BIGINT AS chars_chosen,
       round((sum(length(text)) FILTER (WHERE selected))::DOUBLE / greatest(sum(length(text)), 1), 4) AS coverage_ratio,
       round((max(pos) FILTER (WHERE selected) - min(pos) FILTER (WHERE selected) + 1)::DOUBLE / count(*), 4) AS continuity
FROM h GROUP BY conv
""",
    "dropped_ranges": f"""
WITH {_selected(3, 2)}
SELECT conv, min(pos) AS first, max(pos) AS last FROM (SELECT conv, pos, pos - row_number() OVER (PARTITION BY conv ORDER BY pos) AS g FROM h WHERE NOT selected) GROUP BY conv, g
""",
    "displacement_series": f"""
WITH {FEATURES}
SELECT conv, idx, round(delta, 6) + 0.0 AS delta, round(kappa, 6) + 0.0 AS kappa, round(z_delta, 6) + 0.0 AS z_delta, round(z_kappa, 6) + 0.0 AS z_kappa, round(mass, 6) AS mass, round(recency, 6) AS recency,
       cluster_start, representative, {_peak('delta')}, {_peak('kappa')} FROM z
""",
    "cluster_head_tail": f"""
WITH {FEATURES},
s AS (SELECT *, round(0.6::DOUBLE * (idx::DOUBLE / greatest(n - 1, 1)) + 0.4::DOUBLE * mass, 6) AS score FROM z WHERE representative),
r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY score DESC, idx DESC) AS place FROM s)
SELECT conv, idx, cluster::BIGINT AS cluster, cluster_size, score, place FROM r WHERE place <= 8
""",
}
