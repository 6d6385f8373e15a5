"""DuckDB oracle SQL for batching, request and report queries."""

from .oracle_text import seg_cte

DOC_SEG = seg_cte()
CONV_SEG = seg_cte("SELECT conv_id * 100000 + turn AS tid, role AS lang, left(text, 2048) AS text FROM conversations")
EVENT_SEG = seg_cte("SELECT event_id AS tid, user_id % 4 AS lang, props AS text FROM events")

ROWS = "SELECT row_number() OVER () AS tid, doc_id, source, lang, text FROM documents"

BATCHED = f"""
WITH RECURSIVE rws AS MATERIALIZED ({ROWS}),
{seg_cte("SELECT tid, lang, text FROM rws").lstrip()},
b AS (
  SELECT r.doc_id, r.source, CAST(CASE WHEN r.text IS NULL THEN 0 ELSE coalesce(len(e.ids), 2) END AS BIGINT) AS n_tokens,
         coalesce(e.n_body, 0) AS n_body,
         row_number() OVER (PARTITION BY r.source ORDER BY r.doc_id NULLS FIRST, coalesce(e.n_body, 0)) - 1 AS idx
  FROM rws r LEFT JOIN enc e ON e.tid = r.tid
), bb AS (
  SELECT *, idx // 8 AS batch_no, idx % 8 AS idx_in_batch FROM b
)"""

RANKED_EVENTS = """
SELECT {key} AS k, value, row_number() OVER (PARTITION BY {key} ORDER BY value, event_id) - 1 AS rk,
       count(*) OVER (PARTITION BY {key}) AS n, avg(value) OVER (PARTITION BY {key}) AS mean
FROM events"""


def _summary(key: str, name: str) -> str:
    return f"""
SELECT CAST(k AS {'VARCHAR' if name == 'event_type' else 'BIGINT'}) AS {name}, CAST(n AS BIGINT) AS n,
       round(mean, 6) AS mean,
       max(value) FILTER (WHERE rk = n // 2) AS p50,
       max(value) FILTER (WHERE rk = least(CAST(floor(n * 0.99::DOUBLE) AS BIGINT), n - 1)) AS p99
FROM ({RANKED_EVENTS.format(key=key)}) GROUP BY k, n, mean"""


SQL = {
    "f2_fixed_batches": """
SELECT doc_id, source, CAST(idx // 8 AS BIGINT) AS batch_no, CAST(idx % 8 AS BIGINT) AS idx_in_batch
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)""",

    "f1_ragged_offsets": BATCHED + """
SELECT doc_id, source, CAST(batch_no AS BIGINT) AS batch_no,
       CAST(coalesce(sum(n_tokens) OVER (PARTITION BY source, batch_no ORDER BY idx_in_batch
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       n_tokens
FROM bb""",

    "f3_batch_tokens": BATCHED + """
SELECT source, CAST(batch_no AS BIGINT) AS batch_no, CAST(sum(n_tokens) AS BIGINT) AS batch_tokens
FROM bb GROUP BY source, batch_no""",

    "f4_length_buckets": f"""
WITH RECURSIVE {DOC_SEG}
SELECT CAST(len(ids) // 64 AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS n_docs,
       CAST(sum(len(ids)) AS BIGINT) AS n_tokens
FROM enc GROUP BY 1""",

    "f4_cost_placement": f"""
WITH RECURSIVE {DOC_SEG},
c AS (
  SELECT doc_id, len(ids) AS n, len(ids) * len(ids) AS cost,
         coalesce(sum(len(ids) * len(ids)) OVER (ORDER BY len(ids), doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(len(ids) * len(ids)) OVER () AS total
  FROM enc
)
SELECT CAST(least(15, (2 * before + cost) * 16 // (2 * total)) AS BIGINT) AS cost_group, CAST(count(*) AS BIGINT) AS n_docs,
       CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(cost) AS BIGINT) AS cost
FROM c GROUP BY 1""",

    "b7_batch_reject": BATCHED + """
SELECT doc_id, source, CAST(batch_no AS BIGINT) AS batch_no,
       CASE WHEN bad THEN 'rejected' ELSE 'ok' END AS batch_status,
       CASE WHEN bad AND n_body <= 510 THEN 'batch_member_over_length' WHEN bad THEN 'over_length' END AS batch_reason
FROM (SELECT *, max(CASE WHEN n_body > 510 THEN 1 ELSE 0 END) OVER (PARTITION BY source, batch_no) > 0 AS bad FROM bb)""",

    "a2_request_explode": """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS "index",
       'bge-small-zh-v1.5' AS model, text
FROM conversations""",

    "b1_empty_request": """
SELECT conv_id, CAST(CASE WHEN conv_id % 7 = 0 THEN 0 ELSE n END AS BIGINT) AS n_inputs,
       CASE WHEN conv_id % 7 = 0 THEN 'rejected' ELSE 'ok' END AS status,
       CASE WHEN conv_id % 7 = 0 THEN 'input must not be empty' END AS reason
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)""",

    "e1_usage_totals": f"""
WITH RECURSIVE {CONV_SEG}
SELECT CAST(tid // 100000 AS BIGINT) AS conv_id,
       CAST(sum(len(ids)) AS BIGINT) AS total_tokens, CAST(sum(len(ids)) AS BIGINT) AS prompt_tokens
FROM enc GROUP BY 1""",

    "s2_restore_order": """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS "index",
       CAST(length(text) AS BIGINT) AS text_chars
FROM conversations""",

    "e3_latency_summary": _summary("event_type", "event_type"),
    "e4_latency_by_class": f"""
WITH RECURSIVE {EVENT_SEG},
s AS ({_summary("user_id % 4", "text_class")})
SELECT s.*, (SELECT CAST(max(len(e.ids)) AS BIGINT) FROM enc e WHERE e.lang = s.text_class) AS n_tokens FROM s""",

    "e5_throughput_by_level": f"""
WITH s AS ({_summary('user_id % 6', 'level')}),
w AS (SELECT user_id % 6 AS level,
             (max(epoch_us(ts) + value * 1000.0) - min(epoch_us(ts))) / 1e6 AS wall_s
      FROM events GROUP BY 1)
SELECT s.level, s.n, round(s.n / w.wall_s, 6) AS throughput, s.p50, s.p99
FROM s JOIN w ON w.level = s.level""",

    "e6_batch_throughput": """
SELECT CAST(batch_size AS BIGINT) AS batch_size, CAST(rounds AS BIGINT) AS rounds,
       round(batch_size * rounds / total_s, 6) AS sentences_per_s,
       round(total_s / rounds * 1000.0, 6) AS ms_per_batch
FROM (SELECT user_id % 5 + 1 AS batch_size, count(*) AS rounds, sum(value) / 1000.0 AS total_s
      FROM events GROUP BY 1)""",

    "s1_sorted_latencies": """
SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS BIGINT) AS rank,
       event_id, value
FROM events""",
}

SQL["h2_size_or_time_batches"] = """
WITH RECURSIVE ev AS (
  SELECT user_id, event_id, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events
), nx AS (
  SELECT a.user_id, a.i, a.n,
         least(a.i + 8, (SELECT count(*) FROM ev b WHERE b.user_id = a.user_id AND b.t < a.t + 10800000000)) AS e
  FROM ev a
), chain(user_id, s, e, b) AS (
  SELECT user_id, i, e, 0 FROM nx WHERE i = 0
  UNION ALL
  SELECT c.user_id, x.i, x.e, c.b + 1 FROM chain c JOIN nx x ON x.user_id = c.user_id AND x.i = c.e
)
SELECT ev.user_id, ev.event_id, CAST(c.b AS BIGINT) AS batch_no, CAST(ev.i - c.s AS BIGINT) AS pos_in_batch
FROM ev JOIN chain c ON c.user_id = ev.user_id AND ev.i >= c.s AND ev.i < c.e"""

SQL["h2_handover"] = SQL["h2_size_or_time_batches"]
