"""Registered queries over ``embeddings``: B9, D4-D9, J3, S3."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PARITY_TOLERANCE
from ..functions import vectors as V
from ..operators.vectors import (bucketed_sink, pair_drift, parity_report,
                                 project_by_table, quantize_table)
from ..session import scratch_path
from .context import table

DIM = 64
PROJ_OUT = 8

# Deterministic parameters (exact in binary floating point in every engine).
GAMMA = [1 + (i % 5) / 10 for i in range(DIM)]
BETA = [(i % 3) / 10 - 0.1 for i in range(DIM)]
PROJ_W = [[((r * 7 + c * 3) % 11 - 5) / 10 for c in range(DIM)] for r in range(PROJ_OUT)]
PROJ_B = [r / 10 for r in range(PROJ_OUT)]


def _emb(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def b9_vector_health(spark, sf):
    e = _emb(spark, sf)
    ok = V.healthy("embedding", DIM)
    return e.select("vec_id", F.size("embedding").cast("long").alias("dim"),
                    V.is_finite_vector("embedding").alias("finite"),
                    F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def d4_l2_normalize(spark, sf):
    e = _emb(spark, sf)
    return e.select("vec_id", F.round(V.norm("embedding"), 6).alias("norm_in"),
                    V.fmt(V.l2_normalize("embedding")).alias("vec"))


def d5_layer_norm(spark, sf):
    e = _emb(spark, sf)
    return e.select("vec_id", V.fmt(V.layer_norm("embedding", GAMMA, BETA, 1e-12)).alias("vec"))


def d6_linear_projection(spark, sf):
    e = _emb(spark, sf)
    z = V.mat_vec(PROJ_W, V.as_double("embedding"),
                  F.array(*[F.lit(float(b)) for b in PROJ_B]))
    return e.select("vec_id", V.fmt(z).alias("z"))


def d6_projection_by_table(spark, sf):
    """D6 with a W that is data: row r holds the means of the r-th label's vectors,
    so z tells how near a vector is to every label."""
    e = _emb(spark, sf).select("vec_id", "embedding", "label")
    cells = e.select("label", F.posexplode("embedding").alias("c", "x"))
    means = cells.groupBy("label", "c").agg(F.avg(F.col("x").cast("decimal(30,20)")).cast("double").alias("w"))
    labels = means.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("r"))
    w = means.join(labels, "label").select("r", "c", "w")
    z = project_by_table(e.select("vec_id", "embedding"), w)
    return z.select("vec_id", V.fmt("z", 4).alias("z"))


def a6_embedding_sink(spark, sf):
    """Vectors and their quantised form in two sinks, read back and joined on
    their id (J3, D8) without an exchange."""
    e = _emb(spark, sf)
    name, path = f"wl_{uuid.uuid4().hex[:12]}", scratch_path(spark, "embedding-sink")
    given = bucketed_sink(e.select("vec_id", F.col("embedding").alias("vec")), f"{name}_f32", f"{path}/f32")
    coded = bucketed_sink(quantize_table(e).select("vec_id", V.q8_dequantize("q8").alias("vec")), f"{name}_q8", f"{path}/q8")
    rep = parity_report(given, coded, "vec_id", PARITY_TOLERANCE)
    return rep.select("vec_id", F.round("max_abs_err", 6).alias("max_abs_err"),
                      F.col("n_over_tol").cast("long").alias("n_over_tol"), "status")


def d7_q8_quantize(spark, sf):
    q = quantize_table(_emb(spark, sf))
    codes = F.flatten(F.transform("q8", lambda b: b["codes"]))
    return q.select(
        "vec_id", F.size("q8").cast("long").alias("n_blocks"),
        F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c.cast("long")).alias("sum_sq_codes"),
        F.array_join(codes, ",").alias("codes"),
        V.fmt(F.transform("q8", lambda b: b["scale"])).alias("scales"))


def d8_parity_report(spark, sf):
    e = _emb(spark, sf)
    q = quantize_table(e).select("vec_id", V.q8_dequantize("q8").alias("deq"))
    rep = parity_report(e.select("vec_id", F.col("embedding").alias("vec")),
                        q.select("vec_id", F.col("deq").alias("vec")), "vec_id", PARITY_TOLERANCE)
    return rep.select("vec_id", F.round("max_abs_err", 6).alias("max_abs_err"),
                      F.col("n_over_tol").cast("long").alias("n_over_tol"), "status")


def d9_pair_cosine_drift(spark, sf):
    e = _emb(spark, sf)
    out = pair_drift(e, "vec_id", "embedding")
    return out.select("vec_id", "next_id", F.round("cos_f32", 6).alias("cos_f32"),
                      F.round("cos_q8", 6).alias("cos_q8"), F.round("drift", 6).alias("drift"))


def s3_vector_head(spark, sf):
    e = _emb(spark, sf)
    return e.select("vec_id", V.fmt(V.head("embedding", 8)).alias("head8"))


def j3_baseline_join(spark, sf):
    """Vectors joined to their baseline (here: their Q8_0 round trip) by id,
    component-wise dot product and lengths on both sides."""
    e = _emb(spark, sf)
    base = quantize_table(e).select("vec_id", V.q8_dequantize("q8").alias("b"))
    j = e.select("vec_id", F.col("embedding").alias("a")).join(base, "vec_id")
    return j.select("vec_id", F.size("a").cast("long").alias("dim_a"), F.size("b").cast("long").alias("dim_b"),
                    F.round(V.dot("a", "b"), 6).alias("dot"))
