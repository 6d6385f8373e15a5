"""DuckDB oracle SQL for the token-embedding lookup and response structure."""

from .oracle_service import CONV_SEG
from .oracle_text import SEG_CTE
from .oracle_vectors import _fmt, _norm

TOKVEC = f"""
WITH RECURSIVE {SEG_CTE},
tt AS (SELECT doc_id, unnest(ids) AS token_id, unnest(generate_series(0, len(ids) - 1)) AS pos FROM enc),
tv AS (SELECT doc_id, pos, token_id,
              list_transform(range(0, 8), lambda k: (((token_id * 31 + k * 17) % 97) / 97.0 - 0.5)
                                                    + (((pos * 13 + k * 7) % 89) / 890.0) + k / 1000.0) AS x
       FROM tt)"""

RESULTS = """numbered AS (
  SELECT CAST(tid // 100000 AS BIGINT) AS conv_id, len(ids) AS n,
         row_number() OVER (PARTITION BY tid // 100000 ORDER BY tid) - 1 AS rn
  FROM enc
), results AS (
  SELECT x.conv_id, x.n, x.rn, e.embedding
  FROM numbered x JOIN embeddings e
    ON e.vec_id = (x.conv_id * 31 + x.rn * 7) % (SELECT count(*) FROM embeddings)
)"""

SQL = {
    "j2_token_embeddings": TOKVEC + f"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(token_id AS BIGINT) AS token_id, {_fmt('x')} AS x FROM tv""",

    "d3_first_token_pool": f"""
SELECT sentence, {_fmt('list_transform(x, lambda v: CASE WHEN n > 0 THEN v / n ELSE v END)')} AS pooled
FROM (SELECT CAST(vec_id // 8 AS BIGINT) AS sentence, CAST(embedding AS DOUBLE[]) AS x,
             {_norm('CAST(embedding AS DOUBLE[])')} AS n
      FROM embeddings WHERE vec_id % 8 = 0)""",

    "e2_response_assembly": f"""
WITH RECURSIVE {CONV_SEG}, {RESULTS}
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_data,
       string_agg(CAST(rn AS VARCHAR), ',' ORDER BY rn) AS indexes,
       string_agg(CAST(len(embedding) AS VARCHAR), ',' ORDER BY rn) AS dims,
       string_agg({_fmt('CAST(embedding AS DOUBLE[])[1:4]')}, ';' ORDER BY rn) AS vectors,
       CAST(sum(n) AS BIGINT) AS total_tokens
FROM results GROUP BY conv_id""",

    "a7_response_json": f"""
WITH RECURSIVE {CONV_SEG}, {RESULTS}
SELECT conv_id, 'list' AS object, 'bge-small-zh-v1.5' AS model, CAST(count(*) AS BIGINT) AS n_data,
       'embedding' AS first_object, CAST(arg_min(len(embedding), rn) AS BIGINT) AS dim,
       CAST(max(rn) AS BIGINT) AS last_index,
       arg_max({_fmt('CAST(embedding AS DOUBLE[])[1:4]')}, rn) AS last_vector,
       CAST(sum(n) AS BIGINT) AS prompt_tokens, CAST(sum(n) AS BIGINT) AS total_tokens
FROM results GROUP BY conv_id""",
}
