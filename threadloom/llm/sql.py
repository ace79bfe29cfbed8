"""DuckDB SQL that states the same results, where SQL can."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
least AS (SELECT h, min(doc_id) AS lead FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN least USING (h) WHERE lead < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, (SELECT unnest(range(0, 50)) AS k)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""

OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)
),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(x, y) AS (SELECT a, b FROM edge UNION SELECT r.x, e.b FROM reach r JOIN edge e ON r.y = e.a),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low.y, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = d.doc_id
"""

OP3 = """
WITH t AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations GROUP BY conv_id
),
c AS (SELECT conv_id, turns, len(turns) AS n FROM t),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)),
one AS (SELECT min(conv_id) AS conv_id, turns, any_value(n) AS n FROM c GROUP BY turns)
SELECT conv_id, n AS n_turns,
       array_to_string(list_transform(turns, lambda x:
         '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '<|im_end|>'), chr(10)) AS prompt
FROM one ANTI JOIN p USING (turns)
"""

OP9 = """
WITH v AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '')::BIT AS code
  FROM embeddings
)
SELECT query_id, rank, vec_id, distance FROM (
  SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.code, v.code))::BIGINT AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, v.code)), v.vec_id) AS rank
  FROM v q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
) WHERE rank <= 10
"""

#: CRC-32 by its table, byte by byte, and jump hashing by recursion.
OP2 = """
WITH RECURSIVE
step(v, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT v, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY v) AS t FROM step WHERE k = 8),
hexed AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
byte AS MATERIALIZED (SELECT doc_id, size, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT) AS y FROM hexed),
row_ AS MATERIALIZED (
  SELECT doc_id, size, xor(list_reduce(y, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS text_crc32,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, 'null')), 15))::BIGINT AS h FROM byte, tab
),
jump(h, shards, key, landed, done) AS (
  SELECT DISTINCT h, shards, h::UHUGEINT, 0::BIGINT, false FROM row_, (VALUES (24), (25)) n(shards)
  UNION ALL
  SELECT h, shards, s, CASE WHEN nx < shards THEN nx ELSE landed END, nx >= shards
  FROM (SELECT *, floor((landed + 1) * (2147483648.0::DOUBLE / ((s >> 33)::DOUBLE + 1.0)))::BIGINT AS nx FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT AS s FROM jump WHERE NOT done))
),
home AS (SELECT h, max(landed) FILTER (WHERE shards = 24)::INT AS shard, max(landed) FILTER (WHERE shards = 25)::INT AS grown_shard FROM jump WHERE done GROUP BY h)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY (h >> 40) % greatest(16, (SELECT count(*) FROM row_) // 2400000), h, doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM row_ JOIN home USING (h)
"""

#: Shares and distances in whole numbers, over every group and kept term.
OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
vocabulary AS (SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n,
         (1 + (1000000000 * (coalesce(n, 0)::HUGEINT + 2)) // (coalesce(total, 0) + 2 * v))::BIGINT AS p,
         (1 + (1000000000 * (all_n::HUGEINT + 2)) // (all_total + 2 * v))::BIGINT AS q
  FROM g JOIN kept USING (lang) JOIN vocabulary USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN total USING (lang, source)
),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
ranked AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN far ON far.lang = g.lang AND far.source = g.source AND far.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM dense WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 10
"""


def product_codebooks(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """Learning and encoding, one pair of common table expressions a round."""
    far = "list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT n, p, min(d * {entries} + e) AS best FROM (SELECT n, x.p, e, {far} AS d FROM x JOIN b{r} b ON x.p = b.p) GROUP BY n, p)")
        if r < rounds:
            steps.append(
                f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(fresh, c) AS c FROM b{r} b LEFT JOIN (SELECT p, e, list((s - ((s % m) + m) % m) // m ORDER BY i) AS fresh FROM ("
                f"SELECT p, e, i, sum(v) AS s, count(*) AS m FROM (SELECT x.p, best % {entries} AS e, unnest(y) AS v, unnest(range(len(y))) AS i FROM x JOIN a{r} USING (n, p)) GROUP BY p, e, i) GROUP BY p, e) f ON f.p = b.p AND f.e = b.e)"
            )
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS z
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
x AS MATERIALIZED (SELECT n, p, z[p * len(z) // {parts} + 1:(p + 1) * len(z) // {parts}] AS y FROM v, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS e, y AS c FROM x WHERE n <= {entries}),
{', '.join(steps)},
coded AS (SELECT n, string_agg(printf('%02x', (best % {entries})::INT), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY n),
book AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c)::BIGINT AS c, unnest(range(len(c))) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (n), book
"""


OP13 = product_codebooks()

BY_QUERY = {"op1_substring": OP1, "op2_sharding": OP2, "op3_chat": OP3, "op7_neardup": OP7, "op9_hamming": OP9, "op12_divergence": OP12, "op13_codebooks": OP13}
