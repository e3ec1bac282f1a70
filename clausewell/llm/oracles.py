"""The DuckDB SQL of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
hit AS (SELECT rid, i, dw.n, id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) t(p) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT id)), ',')) AS sha FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

EMBEDDINGS = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM e
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.v, b.v) / a.size / b.size >= 0.93),
met AS (SELECT a, b FROM link UNION SELECT met.a, link.b FROM met JOIN link ON met.b = link.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY 1), low AS (SELECT a, min(b) AS low FROM met GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""


#: Backslashes after the first character of a control string, one more each.
ESCAPED = r"""regexp_replace(regexp_replace({0}, '(<)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|\|eot_id\|>|\|begin_of_text\|>|\|start_header_id\|>|\|end_header_id\|>|s>|/s>|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'),
       '(\[)(\\*)(INST\]|/INST\])', '\1\\\2\3', 'g')"""
CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM unnest([0, 1]) u(k)),
e AS (SELECT *, {ESCAPED.format("replace(replace(r, '\', '\\'), chr(10), '\n')")} AS er, {ESCAPED.format("x")} AS ex FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(er) + length(ex)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: One byte of crc32: eight shifts.
CRC_BITS = "list_reduce(range(8), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)), {0})"
TRIE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY 1),
tab AS (SELECT list_transform(range(256), lambda b: {CRC_BITS.format("b")}) AS tab),
ids AS (SELECT c, c - c % 5 AS b, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ord(y) AS BIGINT)), lambda s, y: xor(s >> 8, tab[(xor(s, y) & 255) + 1]), 4294967295), 4294967295) % 9 AS h FROM n, tab),
w AS (SELECT ids.c, p + 1 AS d, r, x FROM ids JOIN t ON t.c = ids.b AND p < h
      UNION ALL SELECT ids.c, p + 1 - h + least(h, coalesce(n.n, 0)), r, x FROM ids JOIN t ON t.c = ids.c AND p >= h LEFT JOIN n ON n.c = ids.b),
k AS (SELECT c, d, octet_length(encode(x)) AS bytes, string_agg(sha256(octet_length(encode(r)) || ':' || r || x), ',') OVER (PARTITION BY c ORDER BY d) AS k FROM w
      UNION ALL SELECT c, 0, 0, '' FROM ids),
m AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS last FROM k),
v AS (SELECT k, d, min(c) AS c, count(*) AS n_convs, any_value(up) AS up, (count(*) - 1) * any_value(bytes) AS saved,
      sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT m.k, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum(saved) AS saved FROM v LEFT JOIN kids USING (k) JOIN m ON m.c = v.c AND m.d <= v.d GROUP BY 1)
SELECT v.c AS conv_id, v.d AS depth, o.c AS parent_conv_id, v.n_convs, coalesce(kids.n, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (k) LEFT JOIN kids USING (k) LEFT JOIN v o ON o.k = v.up
"""

GAIN = "CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(ts + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT)"
RESAMPLING = f"""
WITH RECURSIVE w AS (SELECT 0 AS side, row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents UNION ALL SELECT 1, 0, NULL, {WORDS} FROM benchmark),
f AS (SELECT side, rid, array_to_string(w[i : i + n - 1], ' ') AS f FROM w, unnest([1, 2, 3]) u(n), unnest(range(1, len(w) - n + 2)) v(i)),
c AS (SELECT side, rid, f, count(*) AS n FROM f GROUP BY ALL),
tab AS (SELECT list_transform(range(256), lambda b: {CRC_BITS.format("b")}) AS tab),
step AS (SELECT f, hex(encode(f)) AS x, 0 AS i, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT f FROM c)
         UNION ALL SELECT f, x, i + 1, xor(crc >> 8, tab[(xor(crc, 16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1) & 255) + 1]) FROM step, tab WHERE 2 * i < length(x)),
b AS (SELECT f, xor(crc, 4294967295) % 10000 AS b FROM step WHERE 2 * i = length(x)),
q AS (SELECT b, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM c JOIN b USING (f) GROUP BY 1),
g AS (SELECT b, {GAIN} AS g FROM q, (SELECT sum(s) AS ts, sum(t) AS tt FROM q)),
d AS (SELECT rid, sum(n) AS n, sum(n * g) AS weight FROM c JOIN b USING (f) JOIN g USING (b) WHERE side = 0 GROUP BY 1),
z AS (SELECT doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
      CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (rid) WHERE side = 0),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS rk, count(*) FILTER (words >= 20) OVER () * 5 // 100 AS k FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND rk <= k THEN rk END AS rank FROM r
"""
