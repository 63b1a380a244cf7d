"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_OP3 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

_OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h,
         CASE WHEN coalesce(text, '') = '' THEN 0
              ELSE length(text) - length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) + 1 END AS tokens
  FROM documents
),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(tokens) > 0),
total AS (SELECT sum(tokens)::BIGINT AS t, count(*) AS n FROM s),
steps AS (
  SELECT 0 AS i, 0.0::DOUBLE AS e_lo, 1.0::DOUBLE AS e_hi, 0.0::DOUBLE AS r_lo, 1.0::DOUBLE AS r_hi
  UNION ALL
  SELECT i + 1,
         CASE WHEN e_ok THEN e_lo ELSE e_mid END, CASE WHEN e_ok THEN e_mid ELSE e_hi END,
         CASE WHEN r_ok THEN r_lo ELSE r_mid END, CASE WHEN r_ok THEN r_mid ELSE r_hi END
  FROM (
    SELECT i, e_lo, e_hi, r_lo, r_hi, e_mid, r_mid,
           ln(sum(pow(p, e_mid))) - sum(pow(p, e_mid) * ln(pow(p, e_mid))) / sum(pow(p, e_mid)) < 0.95 * ln(any_value(n)) AS e_ok,
           max(pow(p, r_mid - 1)) / sum(pow(p, r_mid)) <= 4.0 AS r_ok
    FROM (SELECT *, (e_lo + e_hi) / 2 AS e_mid, (r_lo + r_hi) / 2 AS r_mid FROM steps WHERE i < 40),
         (SELECT tokens::DOUBLE / t AS p, n FROM s, total)
    GROUP BY ALL
  )
),
ends AS (
  SELECT ln(sum(pow(p, 0.0))) < 0.95 * ln(any_value(n)) AS e_zero,
         max(pow(p, -1.0)) / sum(pow(p, 0.0)) <= 4.0 AS r_zero
  FROM (SELECT tokens::DOUBLE / t AS p, n FROM s, total)
),
x AS (
  SELECT greatest(CASE WHEN e_zero THEN 0.0 ELSE e_hi END, CASE WHEN r_zero THEN 0.0 ELSE r_hi END)::DOUBLE AS exponent
  FROM steps, ends WHERE i = 40
),
z AS (SELECT sum(pow(tokens::DOUBLE / t, exponent)) AS z FROM s, total, x),
q AS (
  SELECT source, tokens AS all_tokens,
         floor(pow(tokens::DOUBLE / t, exponent) / z * t)::BIGINT AS quota
  FROM s, total, x, z
),
p AS (SELECT source, quota // all_tokens AS passes, quota % all_tokens AS rest FROM q),
b AS (
  SELECT d.*, passes, rest, unnest(range(passes + 1)) AS block
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
),
k AS (
  SELECT *, ('0x' || substr(md5(block || ':' || coalesce(doc_id::VARCHAR, '') || ':' || h), 1, 15))::BIGINT AS place FROM b
),
c AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, block ORDER BY place
                                       RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k
)
SELECT doc_id, source, block, place, tokens::BIGINT AS tokens FROM c WHERE block < passes OR before < rest
"""

_OP6 = r"""
WITH said AS (
  SELECT conv_id, turn, CASE WHEN role IS NULL THEN 'unknown' WHEN role = 'unknown' THEN '%75nknown'
           ELSE replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '>', '%3E') END AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
seen AS (
  SELECT said.conv_id, perspective, turn, speaker, text,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said JOIN views ON said.conv_id IS NOT DISTINCT FROM views.conv_id
),
headed AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
         '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
  FROM seen
),
placed AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered,
         coalesce(sum(length(head) + length(text) + 11) OVER (
           PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM headed
)
SELECT conv_id, perspective, turn, role, name, rendered, role = 'assistant' AS trained, "offset",
       CASE WHEN role = 'assistant' THEN "offset" + length(head) END AS mask_start,
       CASE WHEN role = 'assistant' THEN "offset" + length(head) + length(text) + 10 END AS mask_end
FROM placed
"""

_OP9 = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
s AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.r ORDER BY list_dot_product(q.e, v.e) DESC, v.vec_id) AS rank
  FROM v AS q JOIN v ON q.r <> v.r AND len(q.e) = len(v.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM s WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": _OP3, "op5_mixing": _OP5, "op6_perspectives": _OP6, "op9_top_k": _OP9}
