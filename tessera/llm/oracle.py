"""DuckDB SQL for the results of queries.py, where SQL can express them."""

OP1 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS z
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY z) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(z) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY z ORDER BY n DESC, doc_id NULLS LAST)
"""

OP3 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
first_ AS (SELECT payload, min(page_id) AS first FROM p WHERE octet_length(payload) >= 100 GROUP BY payload)
SELECT page_id, octet_length(p.payload)::BIGINT AS payload_bytes, sha256(p.payload) AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN first_ ON p.payload = first_.payload
"""

OP5 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS window_ FROM starts
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY window_) AS first FROM windows) WHERE doc_id > first
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM later
), lists AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
         CASE WHEN gone IS NULL THEN words
              ELSE [words[i] for i in range(1, len(words) + 1) if NOT list_contains(gone, i)] END AS words
  FROM w LEFT JOIN lists ON w.doc_id = lists.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
"""

OP8 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3) AS bucket
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW f AS (ORDER BY cap / weight, source NULLS LAST)
), water AS (
  SELECT max(level) FILTER (level * weight < cap) AS level FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN water.level IS NULL THEN cap ELSE least(weight * water.level, cap) END AS target
  FROM levels, water
), ranked AS (
  SELECT doc_id, size, source_size, target, sized.source,
         row_number() OVER (PARTITION BY sized.source ORDER BY size, bucket, doc_id NULLS FIRST) AS r
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), drawn AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each,
         ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM ranked
)
SELECT doc_id, size, source_size, target,
       ((floor(each * r + u) - floor(each * (r - 1) + u))::BIGINT * size)::BIGINT AS taken
FROM drawn
"""

OP9 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), talks AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\/')) + 1
             + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11)::BIGINT AS formatted_chars
  FROM rows_ GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM talks
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op3_warc": OP3, "op5_substring_dedup": OP5, "op8_mix_sources": OP8, "op9_chat_format": OP9}
