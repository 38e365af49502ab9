"""DuckDB SQL for the registered queries that SQL can express.

The others (op3, op9: trained scores; op4, op8: a tokenizer; op5: a sample drawn in rounds; op7: mined rules) are held
against brute force in tests/llm.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """WITH RECURSIVE bits AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits),
bytes AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
d AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS crc FROM bytes, tab),
s(doc_id, key, hi, b, j) AS (SELECT DISTINCT doc_id, coalesce(doc_id, 0)::HUGEINT, NULL::HUGEINT, -1, 0::BIGINT FROM d
UNION ALL SELECT doc_id, k, coalesce(hi, k >> 32), j, CAST(floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k >> 33) + 1)::DOUBLE)) AS BIGINT) FROM (SELECT doc_id, hi, j, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k FROM s WHERE j < 24)),
p AS (SELECT d.doc_id, size, crc, CAST(b AS INTEGER) AS shard, CASE WHEN j = 24 THEN 24 ELSE CAST(b AS INTEGER) END AS grown_shard, CAST((hi + coalesce(crc, 0)) % greatest(1, (SELECT (count(*) + 99999) // 100000 FROM documents)) AS BIGINT) AS block FROM d JOIN s ON s.doc_id IS NOT DISTINCT FROM d.doc_id WHERE j >= 24)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, size, crc NULLS FIRST) - 1 AS slot, grown_shard FROM p"""

OP2 = r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size, first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k"""

OP10 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 85 * (a.n + b.n - c)), u AS (SELECT i, j FROM l UNION SELECT j, i FROM l),
cc(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.j, cc.root FROM cc JOIN u ON u.i = cc.id)
SELECT id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM cc LEFT JOIN n ON n.doc_id = id GROUP BY id"""

OP11 = """WITH bits AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits),
ids AS (SELECT DISTINCT conv_id, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) % 6 AS h FROM ids, tab),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT c.conv_id, 0 AS own, j, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND j <= h UNION ALL SELECT conv_id, 1, j, role, text FROM c JOIN o USING (conv_id) WHERE j > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, j) AS d, text, length(role) || ':' || role || text AS t FROM u),
x AS (SELECT conv_id, d, text, list(t) OVER (PARTITION BY conv_id ORDER BY d) AS p FROM r UNION ALL SELECT conv_id, 0, '', NULL FROM c),
m AS (SELECT conv_id, d, text, min(conv_id) OVER (PARTITION BY d, p) AS node, max(d) OVER (PARTITION BY conv_id) AS last FROM x),
n AS (SELECT node, d, count(*) AS n_convs, (count(*) - 1) * max(length(text)) AS saved, coalesce(string_agg(CASE WHEN d = last THEN conv_id END, ',' ORDER BY conv_id), '') AS ends FROM m GROUP BY ALL),
f AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.d = n.d - 1),
k AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM f WHERE d > 0 GROUP BY ALL),
s AS (SELECT m.node, m.d, sum(n.saved) AS saved, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS leaves FROM n LEFT JOIN k USING (node, d) JOIN m ON m.conv_id = n.node AND m.d <= n.d GROUP BY ALL)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256 FROM f LEFT JOIN k USING (node, d) JOIN s USING (node, d)"""

ORACLES: dict[str, str] = {"op1_sharding": OP1, "op2_exact_dedup": OP2, "op10_ngram_join": OP10, "op11_prefix_trie": OP11}
