"""SQL for DuckDB of the queries that SQL can express. DuckDB has no crc32: it is worked out byte by byte."""

from __future__ import annotations

# the table of crc32 by its rule, and the checksum of a list of bytes
_TABLE = """crc_table AS (
  SELECT list(entry ORDER BY i) AS entries FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
    FROM range(256) r(i)))"""


def _crc32(of_bytes: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {of_bytes}), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295)"


_DIGITS = _crc32("list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)")
_BYTES = _crc32("list_transform(range(octet_length(encode(word))), lambda k: "
                "16 * (instr('0123456789ABCDEF', hex(encode(word))[2 * k + 1]) - 1) + instr('0123456789ABCDEF', hex(encode(word))[2 * k + 2]) - 1)")

PREFIX_TRIE = f"""
WITH {_TABLE},
turns AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 100 AS b, {_DIGITS} % 6 AS h FROM (SELECT DISTINCT c FROM turns), crc_table),
opening AS (SELECT ids.c, turns.i AS d, r, t FROM ids JOIN turns ON turns.c = ids.b AND turns.i <= ids.h),
opened AS (SELECT ids.c, h, count(opening.d) AS k FROM ids LEFT JOIN opening USING (c) GROUP BY ids.c, h),
rebuilt AS (SELECT c, d, r, t FROM opening UNION ALL SELECT turns.c, i - h + k, r, t FROM turns JOIN opened USING (c) WHERE i > h),
prefixes AS (SELECT c, d, t, string_agg(md5(r) || md5(t), '') OVER (PARTITION BY c ORDER BY d) AS prefix FROM rebuilt
             UNION ALL SELECT c, 0, '', '' FROM ids),
sized AS (SELECT *, max(d) OVER (PARTITION BY c) AS n FROM prefixes),
nodes AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, any_value(length(t)) AS chars,
                 coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '') AS ends FROM sized GROUP BY prefix, d),
below AS (SELECT substr(prefix, 1, length(prefix) - 64) AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
valued AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN below USING (prefix)),
subtrees AS (SELECT p.prefix, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars)::BIGINT AS saved_tokens
             FROM valued u JOIN prefixes p ON p.c = u.conv_id AND p.d <= u.d GROUP BY p.prefix)
SELECT v.conv_id, v.d::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN subtrees s USING (prefix) LEFT JOIN valued up ON v.d > 0 AND up.prefix = substr(v.prefix, 1, length(v.prefix) - 64)
"""

_WORDS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
RESAMPLING = f"""
WITH {_TABLE},
numbered AS (SELECT row_number() OVER () AS i, doc_id, text FROM documents),
words AS (SELECT i, {_WORDS} AS word FROM numbered),
targets AS (SELECT {_WORDS} AS word FROM benchmark),
hashed AS (SELECT word, {_BYTES} % 10000 AS bucket FROM (SELECT word FROM words UNION SELECT word FROM targets), crc_table),
s AS (SELECT bucket, count(*) AS s FROM words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM targets JOIN hashed USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0)::DOUBLE * ((SELECT count(*) FROM words) + 10000)::DOUBLE
                               / ((s + 1.0)::DOUBLE * ((SELECT count(*) FROM targets) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT i, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY i),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
                  + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
           FROM numbered LEFT JOIN weights USING (i)),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM ranked
"""
