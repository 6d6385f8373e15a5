"""Table-level vector operators: D3 pooling, D7 quantisation table, D8 parity
report (J3 join), D9 pair cosine drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PARITY_TOLERANCE
from ..functions import vectors as V


def first_token_pool(token_vectors: DataFrame, id_col: str = "doc_id",
                     pos_col: str = "pos", vec_col: str = "x") -> DataFrame:
    """D3: the row at position 0 of each sentence (a filter, pushed to the
    scan when the token vectors come from parquet)."""
    return token_vectors.where(F.col(pos_col) == 0).select(id_col, F.col(vec_col).alias("pooled"))


def quantize_table(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """D7 as a table job: adds ``q8`` = array<struct<scale, codes>>."""
    return df.withColumn("q8", V.q8_quantize(vec_col))


def parity_report(a: DataFrame, b: DataFrame, key: str = "vec_id",
                  tol: float = PARITY_TOLERANCE) -> DataFrame:
    """D8 + J3: equi-join two vector tables on ``key`` (full outer, so a row
    missing on one side is reported), per-row max abs error, number of
    components over ``tol``; a null, missing or length mismatch is FAIL."""
    j = (a.select(key, F.col("vec").alias("_a"))
         .join(b.select(key, F.col("vec").alias("_b")), key, "full_outer"))
    comparable = F.col("_a").isNotNull() & F.col("_b").isNotNull() & \
        (F.size("_a") == F.size("_b"))
    err = F.when(comparable, V.max_abs_diff("_a", "_b"))
    over = F.when(comparable, V.count_over("_a", "_b", tol))
    return j.select(key, err.alias("max_abs_err"), over.alias("n_over_tol"),
                    F.when(comparable & (over == 0), "PASS").otherwise("FAIL").alias("status"))


def pair_drift(df: DataFrame, key: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Cosine of each vector with its successor (key + 1) before and after
    Q8_0 round trip, and the drift between the two.  Pairs are formed by an
    equi-join on a unique key, so the pair count is linear in the rows."""
    base = df.select(key, F.col(vec_col).alias("v"),
                     V.q8_dequantize(V.q8_quantize(vec_col)).alias("dq"))
    nxt = base.select((F.col(key) - 1).alias(key), F.col(key).alias("next_id"),
                      F.col("v").alias("v2"), F.col("dq").alias("dq2"))
    j = base.join(nxt, key)
    c32 = V.cosine("v", "v2")
    c8 = V.cosine("dq", "dq2")
    return j.select(key, "next_id", c32.alias("cos_f32"), c8.alias("cos_q8"),
                    F.abs(c32 - c8).alias("drift"))


BLOCK = 16          # columns per block of a projection
ROW_BLOCK = 64      # rows of W per block


def project_by_table(vectors: DataFrame, w: DataFrame, key: str = "vec_id", vec_col: str = "embedding",
                     block: int = BLOCK, row_block: int = ROW_BLOCK, spread: int | None = None) -> DataFrame:
    """D6 for a W that is a table: ``(key, z array<double>)``, z = W x.

    ``w``: (r, c, w) with r and c from 0; entries that are missing are zero.  Both
    sides are cut into blocks of columns; a vector's block meets W's blocks of the
    same columns (one per ``row_block`` rows) by a join on (column block, row block,
    salt), gives partial sums for those rows, and the partial sums of a (vector,
    row block) are added in column order.  W is repeated ``spread`` times so that a
    block is not one task, however many vectors there are.  A row of z is the sum over
    the vector's components that W knows; a null or empty vector has a null z.
    """
    n = vectors.sparkSession.sparkContext.defaultParallelism
    size = w.agg(F.coalesce(F.max("r") + 1, F.lit(0)).alias("rows"), F.coalesce(F.max("c") + 1, F.lit(0)).alias("cols")).first()
    row_blocks, col_blocks = -(-size["rows"] // row_block), -(-size["cols"] // block)
    spread = spread or max(1, -(-n // max(1, row_blocks * col_blocks)))
    cells = w.select(F.floor(F.col("r") / row_block).alias("rb"), F.floor(F.col("c") / block).alias("cb"), (F.col("r") % row_block)
                     .cast("int").alias("i"), (F.col("c") % block).cast("int").alias("j"), F.col("w").cast("double").alias("w"))
    cells = (cells.groupBy("rb", "cb", "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("m"))
             .select("rb", "cb", "i", F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda j: F.coalesce(
                 F.element_at("m", j), F.lit(0.0))).alias("row")))
    blocks = (cells.groupBy("rb", "cb").agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("rows"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))))
    x = V.as_double(vec_col)
    last = F.least(F.floor((F.size(vec_col) - 1) / block), F.lit(max(col_blocks - 1, 0))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.struct(
        b.cast("long").alias("cb"), F.slice(x, b * block + 1, F.lit(block)).alias("x")))
    some = vectors.where((F.size(vec_col) > 0) & F.lit(row_blocks > 0)).select(
        key, F.pmod(F.xxhash64(key), F.lit(spread)).cast("int").alias("salt"), F.explode(parts).alias("p"))
    sided = some.select(key, "salt", "p.cb", "p.x", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(max(row_blocks - 1, 0)).cast("long"))).alias("rb"))
    partial = F.transform("rows", lambda r: F.struct(r["i"].alias("i"), V.dot(F.slice(r["row"], F.lit(1), F.size("x")), F.col("x"))
                                                     .alias("s")))
    summed = (sided.join(blocks, ["cb", "rb", "salt"]).select(key, "rb", "cb", F.explode(partial).alias("p"))
              .groupBy(key, "rb", F.col("p.i").alias("i")).agg(F.array_sort(F.collect_list(F.struct("cb", "p.s"))).alias("s")))
    z = summed.select(key, (F.col("rb") * row_block + F.col("i")).alias("r"), V.vsum(F.transform("s", lambda e: e["s"])).alias("s"))
    by_key = z.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("r", "s"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max(size["rows"] - 1, 0)).cast("long")),
                        lambda r: F.coalesce(F.element_at("m", r), F.lit(0.0)))
    return vectors.select(key).join(by_key, key, "left").select(key, F.when(F.col("m").isNotNull(), whole).alias("z"))


def bucketed_sink(df: DataFrame, table: str, path: str, key: str = "vec_id", buckets: int = 16) -> DataFrame:
    """One row per input, written as a table of ``buckets`` files' worth of
    rows by a hash of ``key``, each sorted by it: two such tables join on the key
    without an exchange.  The table's files lie under ``path``."""
    spark = df.sparkSession
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path)
     .mode("overwrite").saveAsTable(table))
    return spark.table(table)
