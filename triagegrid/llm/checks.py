"""DuckDB SQL for the queries that SQL can express."""
from __future__ import annotations

from triagegrid.llm import line_chunks
from triagegrid.llm.chat import CONTROL, END, TURN

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def near_copies(k: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least({k}, len(w)) - 1], ' ') AS g
      FROM d, unnest(range(1, len(w) - least({k}, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""


def contamination(window: int) -> str:
    words = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({window}, len(w)) AS m, array_to_string(w[i : i + least({window}, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, len(w) - m + 2)) AS t(i)),
f AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, g)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM f, unnest(range(i, i + m)) AS t(j) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM f) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)"""


TOP_K = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)])::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest, min(page_id) OVER (PARTITION BY b) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to
FROM q"""


def line_dedup() -> str:
    own, above, further = line_chunks.ROLL
    return f"""
WITH d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
e AS (SELECT doc_id, i, len(l) AS n, l[i] AS line, ('0x' || substr(md5(l[i]), 1, 8))::BIGINT AS h FROM d, unnest(range(1, len(l) + 1)) AS t(i) WHERE text <> ''),
m AS (SELECT *, ({own} * h + {above} * coalesce(lag(h, 1) OVER w, 0) + {further} * coalesce(lag(h, 2) OVER w, 0)) % {line_chunks.SPREAD} = 0 AS ends
      FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM m),
k AS (SELECT doc_id, chunk, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY ALL),
g AS (SELECT doc_id, chunk, lines FROM k WHERE lines >= {line_chunks.LEAST_LINES} QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1),
r AS (SELECT doc_id, sum(lines)::BIGINT AS n_removed_lines, count(*) AS n_removed_chunks FROM g GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) AS kept FROM c ANTI JOIN g USING (doc_id, chunk) GROUP BY doc_id)
SELECT doc_id, len(l) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_chunks, 0) AS n_removed_chunks, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)"""


def chat_digests() -> str:
    marks = "|".join("".join(f"\\{c}" if c in "[]|<>/_" else c for c in x) for x in sorted(CONTROL, key=len, reverse=True)).replace("\\_", "_").replace("\\<", "<").replace("\\>", ">").replace("\\/", "/")
    extra = len(TURN) + len(END) + 1
    return rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({extra} + length(role) + length(replace(text, '\', '\\')) + len(regexp_extract_all(text, {_quoted(marks)})))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


#: z.r: the table of CRC-32 by bytes.
CRC_TABLE = """z AS (SELECT list(c ORDER BY i) AS r FROM (SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) t(i)))"""


def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, in the presence of z."""
    hexes = f"hex(encode({text}))"
    step = "lambda a, b: xor(a >> 8, r[1 + (xor(a, b) & 255)])"
    return f"xor(list_reduce([4294967295::BIGINT] || [('0x' || substr({hexes}, 2 * j + 1, 2))::BIGINT FOR j IN range(strlen({text}))], {step}), 4294967295)"


def prefix_trie() -> str:
    return f"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT conv_id, list({{'k': md5(coalesce(role, '') || chr(0) || coalesce(text, '')), 'n': coalesce(length(text), 0)}} ORDER BY turn NULLS FIRST) AS t
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT o.*, {_crc32('conv_id::VARCHAR')} % 6 AS h FROM o, z),
b AS (SELECT x.conv_id, coalesce(y.t[1:x.h], []) || x.t[x.h + 1:] AS t FROM h x LEFT JOIN o y ON y.conv_id = x.conv_id - x.conv_id % 100),
p AS (SELECT conv_id, d, len(t) AS m, array_to_string([u.k FOR u IN t[1:d]], '') AS k, CASE WHEN d > 0 THEN t[d].n ELSE 0 END AS n FROM b, unnest(range(0, len(t) + 1)) AS s(d)),
v AS (SELECT d, k, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (m = d), '')) AS ends_sha256 FROM p GROUP BY d, k),
c AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN c USING (k)),
s AS (SELECT left(k, 32 * a) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens FROM w, unnest(range(0, d + 1)) AS t(a) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM w JOIN s USING (k) LEFT JOIN v q ON w.d > 0 AND q.k = left(w.k, 32 * (w.d - 1))"""


def resample(percent: int, least_words: int) -> str:
    words = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
f AS (SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS g, count(*) AS n FROM d, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL),
h AS (SELECT array_to_string(w[i : i + k - 1], ' ') AS g, count(*) AS n FROM b, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL),
k AS (SELECT g, {_crc32('g')} % 10000 AS bucket FROM (SELECT g FROM f UNION SELECT g FROM h), z),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM f JOIN k USING (g) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS n FROM h JOIN k USING (g) GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
q AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (a.s + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * (a.t + 10000))))::BIGINT AS gain
      FROM s FULL JOIN t USING (bucket), a),
v AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN k USING (g) JOIN q USING (bucket) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN v USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM c WHERE n_words >= {least_words})
SELECT c.doc_id, n_features, weight, score, CASE WHEN r <= n * {percent} // 100 THEN r END AS rank FROM c LEFT JOIN r USING (doc_id)"""


ORACLES = {
    "op2_jaccard_join": near_copies(4, 85),
    "op3_decontaminate": contamination(10),
    "op5_top_k": TOP_K,
    "op6_warc": WARC,
    "op8_line_chunks": line_dedup(),
    "op9_chat": chat_digests(),
    "op11_prefix_trie": prefix_trie(),
    "op12_resample": resample(5, 20),
}
