"""DuckDB oracle SQL for the vector queries (same arithmetic order: sequential
left folds in double, fixed-decimal text output)."""

SUM = "lambda a, b: a + b"


def _fmt(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: printf('%.6f', x::DOUBLE)), ',')"


def _norm(v: str) -> str:
    return f"sqrt(list_reduce(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE), {SUM}))"


def _dot(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(generate_series(1, len({a})), "
            f"lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE), {SUM})")


# Q8_0 blocks of 32: list of struct(scale FLOAT, codes INTEGER[])
def _q8(v: str) -> str:
    return f"""list_transform(range(0, len({v}) // 32), lambda b:
      {{'scale': CAST(list_max(list_transform({v}[b * 32 + 1 : b * 32 + 32], lambda x: abs(x::DOUBLE))) / 127.0 AS FLOAT),
        'codes': list_transform({v}[b * 32 + 1 : b * 32 + 32], lambda x:
           CASE WHEN list_max(list_transform({v}[b * 32 + 1 : b * 32 + 32], lambda y: abs(y::DOUBLE))) / 127.0 > 0
                THEN CAST(round(x::DOUBLE / (list_max(list_transform({v}[b * 32 + 1 : b * 32 + 32], lambda y: abs(y::DOUBLE))) / 127.0)) AS INTEGER)
                ELSE 0 END)}})"""


def _deq(q: str) -> str:
    return f"flatten(list_transform({q}, lambda blk: list_transform(blk.codes, lambda c: c::DOUBLE * blk.scale::DOUBLE)))"


GAMMA = "list_transform(range(0, 64), lambda i: 1 + (i % 5) / 10)"
BETA = "list_transform(range(0, 64), lambda i: (i % 3) / 10 - 0.1)"
PROJ_W = "list_transform(range(0, 8), lambda r: list_transform(range(0, 64), lambda c: ((r * 7 + c * 3) % 11 - 5) / 10))"
PROJ_B = "list_transform(range(0, 8), lambda r: r / 10)"

SQL = {
    "b9_vector_health": f"""
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim,
       list_bool_and(list_transform(embedding, lambda x: isfinite(x::DOUBLE))) AS finite,
       CASE WHEN len(embedding) = 64
             AND list_bool_and(list_transform(embedding, lambda x: isfinite(x::DOUBLE)))
             AND abs({_norm('embedding')} - 1) < 0.001 THEN 'PASS' ELSE 'FAIL' END AS status
FROM embeddings""",

    "d4_l2_normalize": f"""
SELECT vec_id, round(n, 6) AS norm_in,
       {_fmt('list_transform(embedding, lambda x: CASE WHEN n > 0 THEN x::DOUBLE / n ELSE x::DOUBLE END)')} AS vec
FROM (SELECT vec_id, embedding, {_norm('embedding')} AS n FROM embeddings)""",

    "d5_layer_norm": f"""
SELECT vec_id,
  {_fmt('list_transform(generate_series(1, len(embedding)), lambda i: ((embedding[i]::DOUBLE - m) * inv) * g[i] + b[i])')} AS vec
FROM (
  SELECT vec_id, embedding, m, g, b,
         1.0 / sqrt(list_reduce(list_transform(embedding, lambda x: (x::DOUBLE - m) * (x::DOUBLE - m)), {SUM}) / len(embedding) + 1e-12) AS inv
  FROM (SELECT vec_id, embedding, {GAMMA} AS g, {BETA} AS b,
               list_reduce(list_transform(embedding, lambda x: x::DOUBLE), {SUM}) / len(embedding) AS m
        FROM embeddings))""",

    "d6_linear_projection": f"""
SELECT vec_id,
  {_fmt('list_transform(generate_series(1, 8), lambda r: ' + _dot('w[r]', 'embedding') + ' + pb[r])')} AS z
FROM (SELECT vec_id, embedding, {PROJ_W} AS w, {PROJ_B} AS pb FROM embeddings)""",

    "d7_q8_quantize": f"""
SELECT vec_id, CAST(len(q) AS BIGINT) AS n_blocks,
       CAST(list_reduce(list_transform(flatten(list_transform(q, lambda b: b.codes)), lambda c: c::BIGINT * c), {SUM}) AS BIGINT) AS sum_sq_codes,
       array_to_string(flatten(list_transform(q, lambda b: b.codes)), ',') AS codes,
       {_fmt('list_transform(q, lambda b: b.scale)')} AS scales
FROM (SELECT vec_id, {_q8('embedding')} AS q FROM embeddings)""",

    "d8_parity_report": f"""
SELECT vec_id, round(err, 6) AS max_abs_err, CAST(n_over AS BIGINT) AS n_over_tol,
       CASE WHEN n_over = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (
  SELECT vec_id,
    list_max(list_transform(generate_series(1, len(embedding)), lambda i: abs(embedding[i]::DOUBLE - d[i]))) AS err,
    len(list_filter(list_transform(generate_series(1, len(embedding)), lambda i: abs(embedding[i]::DOUBLE - d[i])), lambda x: x > 1e-05)) AS n_over
  FROM (SELECT vec_id, embedding, {_deq(_q8('embedding'))} AS d FROM embeddings))""",

    "d9_pair_cosine_drift": f"""
WITH b AS (SELECT vec_id, embedding AS v, {_deq(_q8('embedding'))} AS dq FROM embeddings),
p AS (SELECT a.vec_id, c.vec_id AS next_id,
             {_dot('a.v', 'c.v')} / ({_norm('a.v')} * {_norm('c.v')}) AS c32,
             {_dot('a.dq', 'c.dq')} / ({_norm('a.dq')} * {_norm('c.dq')}) AS c8
      FROM b a JOIN b c ON c.vec_id = a.vec_id + 1)
SELECT vec_id, next_id, round(c32, 6) AS cos_f32, round(c8, 6) AS cos_q8, round(abs(c32 - c8), 6) AS drift FROM p""",

    "s3_vector_head": f"""
SELECT vec_id, {_fmt('embedding[1:8]')} AS head8 FROM embeddings""",
}

SQL["j3_baseline_join"] = f"""
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim_a, CAST(len(d) AS BIGINT) AS dim_b,
       round({_dot('embedding', 'd')}, 6) AS dot
FROM (SELECT vec_id, embedding, {_deq(_q8('embedding'))} AS d FROM embeddings)"""

SQL["a6_embedding_sink"] = SQL["d8_parity_report"]

SQL["d6_projection_by_table"] = """
WITH cells AS (
  SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS c FROM embeddings
), w AS (
  SELECT label, c, avg(x::DOUBLE) AS w, dense_rank() OVER (ORDER BY label) - 1 AS r FROM cells GROUP BY label, c
), z AS (
  SELECT v.vec_id, w.r, sum(v.x::DOUBLE * w.w) AS z FROM cells v JOIN w ON w.c = v.c GROUP BY v.vec_id, w.r
)
SELECT vec_id, string_agg(printf('%.4f', z), ',' ORDER BY r) AS z FROM z GROUP BY vec_id"""
