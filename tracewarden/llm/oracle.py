"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_BLANKS = "[ \\t\\n\\x0b\\x0c\\r]"
_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_BLANKS}+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

# The template is not read back here: what SQL can tell is what every exact template must give.
OP3 = """
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (
  SELECT *, length(text) + length(regexp_extract_all(text,
    '[<\\[]\\\\*(\\|(start|turn|end|im_start|im_end|endoftext|startoftext)\\||/?s>|/?INST\\]|/?SYS>>)')) AS n,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AS joins
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN joins THEN 8 ELSE 9 + length(role) + 1 + 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP5 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\x0c\\r]+')) AS size FROM documents
),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source
),
-- Sources by the level at which they fill up; the first few are full, the others share what is left.
o AS (
  SELECT *, coalesce(sum(2 * source_size) OVER below, 0.0) AS full_sum,
         sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         1.5 * sum(source_size) OVER () AS wanted
  FROM s WINDOW below AS (ORDER BY 2 * source_size / weight, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
l AS (
  SELECT full_sum, open_weight, wanted FROM o
  WHERE 2 * source_size * open_weight >= weight * (wanted - full_sum) ORDER BY full_sum LIMIT 1
),
r AS (
  SELECT source, source_size,
         CASE WHEN 2 * source_size * l.open_weight < weight * (l.wanted - l.full_sum) THEN 2 * source_size
              ELSE weight * (l.wanted - l.full_sum) / l.open_weight END AS target
  FROM s, l
),
m AS (
  SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT)
           / 281474976710656.0 AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m
"""

_LINES = f"""
l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {{docs}}
),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_CHARS})")} AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
x AS (
  SELECT k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key
)"""

OP7 = f"""
WITH {_LINES.format(docs="documents")}
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""


OP11 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS told
  FROM documents
),
h AS (
  SELECT *, len(units) AS n, ('0x' || substr(told, 1, 8))::BIGINT AS h1, ('0x' || substr(told, 9, 8))::BIGINT AS h2,
         ('0x' || substr(told, 25, 8))::BIGINT AS h4
  FROM d
),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS first, greatest(h1 % (n + 1), h2 % (n + 1)) AS last,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
),
p AS (
  SELECT *, array_to_string(units[1:first], '') AS prefix, array_to_string(units[first + 1:last], '') AS middle,
         array_to_string(units[last + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.vector, b.vector)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


ORACLES = {
    "op2_exact_dedup": OP2, "op3_chat_format": OP3, "op5_mixing": OP5, "op7_line_dedup": OP7, "op11_fill_middle": OP11,
    "op13_hard_negatives": OP13,
}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
