"""Layer-norm / matmul / quantisation goldens, baseline-vector read, the rank
rule, distributed row numbering on a hot key, fixed batches."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wordloom.functions import vectors as V
from wordloom.operators.batching import assign_fixed_batches, batch_tokens, ragged_offsets
from wordloom.operators.embed import token_embeddings
from wordloom.operators.ordering import ordered_index
from wordloom.operators.reports import rank_summary
from wordloom.operators.vectors import parity_report
from wordloom.sources.corpus import read_baseline_vectors


def test_layer_norm_goldens(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    plain = df.select(V.layer_norm("x", eps=1e-5).alias("y")).first()["y"]
    affine = df.select(V.layer_norm("x", [2.0] * 4, [1.0] * 4, 1e-5).alias("y")).first()["y"]
    assert np.allclose(plain, [-1.341641, -0.447214, 0.447214, 1.341641], atol=1e-3)
    assert np.allclose(affine, [-1.683282, 0.105573, 1.894427, 3.683282], atol=1e-3)


def test_matmul_goldens(spark):
    df = spark.createDataFrame([([5.0, 6.0], [1.0, 1.0])], "x array<double>, y array<double>")
    r = df.select(V.mat_vec([[1, 2], [3, 4]], F.col("x")).alias("a"),
                  V.mat_vec([[1, 2], [3, 4], [5, 6]], F.col("y")).alias("b")).first()
    assert list(r["a"]) == [17.0, 39.0] and list(r["b"]) == [3.0, 7.0, 11.0]


def test_l2_and_zero_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "x array<double>")
    got = [list(r[0]) for r in df.select(V.l2_normalize("x")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_q8_roundtrip_and_zero_block(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal(64).tolist()
    df = spark.createDataFrame([(1, v), (2, [0.0] * 32)], "id long, v array<double>")
    q = df.select("id", V.q8_quantize("v").alias("q")).withColumn("d", V.q8_dequantize("q"))
    rows = {r["id"]: r for r in q.collect()}
    blk = rows[1]["q"][0]
    assert max(abs(c) for c in blk["codes"]) == 127
    assert np.max(np.abs(np.array(rows[1]["d"]) - np.array(v))) <= max(abs(x) for x in v) / 127
    assert rows[2]["q"][0]["scale"] == 0.0 and set(rows[2]["q"][0]["codes"]) == {0}
    bad = spark.createDataFrame([([1.0] * 33,)], "v array<double>")
    assert bad.select(V.q8_quantize("v")).first()[0] is None


def test_parity_report_missing_and_mismatch(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [0.0])], "vec_id long, vec array<double>")
    b = spark.createDataFrame([(1, [1.0, 2.000001]), (2, [1.0, 2.0])], "vec_id long, vec array<double>")
    got = {r["vec_id"]: r["status"] for r in parity_report(a, b).collect()}
    assert got == {1: "PASS", 2: "FAIL", 3: "FAIL"}


def test_baseline_vector_read(spark, scratch):
    with open(f"{scratch}/ref.txt", "w") as f:
        f.write("0.25\n-1.5\n3\n\n")
    r = read_baseline_vectors(spark, f"{scratch}/ref.txt").first()
    assert list(r["vec"]) == [0.25, -1.5, 3.0]


def test_rank_rule(spark):
    df = spark.createDataFrame([("a", float(v), i) for i, v in enumerate([4, 1, 3, 2])],
                               "g string, ms double, id long")
    r = rank_summary(df, ["g"], "ms").first()
    assert (r["n"], r["p50"], r["p99"], r["mean"]) == (4, 3.0, 4.0, 2.5)


def test_ordered_index_hot_key(spark):
    # one key holds most rows: numbering must equal row_number and span partitions
    rows = [(0 if i % 10 else i % 7 + 1, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = ordered_index(df, ["k"], ["v"], name="idx", num_partitions=6)
    ref = df.withColumn("idx", F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1)

    def canon(rows):
        return sorted((r["k"] is None, r["k"] or 0, r["v"], r["idx"]) for r in rows)
    assert canon(got.collect()) == canon(ref.select("k", "v", "idx").collect())
    glob = ordered_index(df, [], ["v"], name="g", num_partitions=5)
    assert sorted(r["g"] for r in glob.collect()) == list(range(5000))


def test_fixed_batches_and_offsets(spark):
    df = spark.createDataFrame([("s", i, 10 + i) for i in range(20)], "src string, id long, n long")
    b = ragged_offsets(assign_fixed_batches(df, ["src"], ["id"], size=8), ["src"], "n")
    rows = {r["id"]: r for r in b.collect()}
    assert rows[8]["batch_no"] == 1 and rows[8]["offset"] == 0
    assert rows[10]["offset"] == 18 + 19 and rows[19]["batch_no"] == 2
    totals = {r["batch_no"]: r["batch_tokens"] for r in
              batch_tokens(assign_fixed_batches(df, ["src"], ["id"], size=8), ["src"], "n").collect()}
    assert totals[0] == sum(10 + i for i in range(8)) and len(totals) == 3


def test_ordered_index_null_keys(spark):
    rows = [(None if i % 3 == 0 else i % 2, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = ordered_index(df, ["k"], ["v"], name="idx", num_partitions=4)
    ref = df.withColumn("idx", F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1)

    def canon(rows):
        return sorted((r["k"] is None, r["k"] or 0, r["v"], r["idx"]) for r in rows)
    assert canon(got.collect()) == canon(ref.select("k", "v", "idx").collect())


def test_ordered_index_keeps_large_integers_hot_keys_and_gaps(spark):
    """Null keys beside 2**53 + 1, one key with most rows, empty partitions."""
    rows = [(None if i % 9 == 0 else 2**53 + 1 if i % 9 < 7 else 2**53 + 3, i * 7 % 500, 2**53 + i) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    ref = df.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("o", "v")) - 1)
    want = sorted(((r["k"] or -1), r["v"], r["i"]) for r in ref.collect())
    for n in (1, 7, 64):
        got = ordered_index(df, ["k"], ["o", "v"], name="i", num_partitions=n, count="n").collect()
        assert sorted(((r["k"] or -1), r["v"], r["i"]) for r in got) == want
        assert {(r["k"], r["n"]) for r in got} == {(None, 100), (2**53 + 1, 600), (2**53 + 3, 200)}
    assert ordered_index(df.limit(0), ["k"], ["o"]).count() == 0


def test_rank_summary_keeps_the_null_group(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("a", 2.0, 3)], "g string, v double, id long")
    got = {r["g"]: (r["n"], r["mean"], r["p50"], r["p99"]) for r in rank_summary(df, ["g"], "v").collect()}
    assert got == {None: (2, 2.0, 3.0, 3.0), "a": (1, 2.0, 2.0, 2.0)}


def test_a_token_without_an_embedding_fails_the_job(spark):
    toks = spark.createDataFrame([(1, 0, 5), (1, 1, 100)], "doc_id long, pos int, token_id int")
    word = spark.createDataFrame([(5, [1.0, 2.0])], "token_id int, w array<double>")
    pos = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.0, 1.0])], "pos int, p array<double>")
    ok = token_embeddings(toks.where("token_id = 5"), word, pos, [0.0, 1.0]).first()
    assert ok["x"] == [1.5, 3.5]
    with pytest.raises(Exception, match="no embedding for token 100"):
        token_embeddings(toks, word, pos, [0.0, 1.0]).collect()


def test_vectors_as_text_in_batches(spark):
    """``fmt_batches`` is ``fmt``: signs, ties, large and special numbers, nulls."""
    rows = [(0, [0.1, -0.5, 1.0, 0.0000005, -0.0000004, -0.0, 99999.9999995, 1e5, -123456789.125]),
            (1, [float("nan"), float("inf"), float("-inf"), 1e22, 2.5e-7, 1.0000015, -1.0000025]),
            (2, [0.25, None, -3.0]), (3, []), (4, None), (5, [(k * 31 % 97) / 97.0 - 0.5 for k in range(64)])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = df.select("id", V.fmt_batches("v").alias("a"), V.fmt("v").alias("b")).collect()
    assert {r["id"]: r["a"] for r in got} == {r["id"]: r["b"] for r in got}
