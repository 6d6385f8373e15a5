"""Rank selection by digits, cost placement, projection by table, bucketed sink."""

import contextlib
import io
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from wordloom.operators.batching import cost_groups, place_by_cost
from wordloom.operators.ordering import running_total
from wordloom.operators.selection import ordered_bits, select_ranks
from wordloom.operators.vectors import bucketed_sink, project_by_table


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _odd_doubles():
    rng = random.Random(3)
    out = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 2.0 ** -1022 - 5e-324, math.inf, -math.inf, 1.7976931348623157e308]
    out += [s * math.nextafter(2.0 ** e, d) for e in (-1000, -3, 0, 1, 52, 900) for d in (0, math.inf) for s in (1, -1)]
    out += [s * 2.0 ** e for e in range(-1074, 1024, 37) for s in (1, -1)]
    return out + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(500)]


def test_ordered_bits_are_the_bits(spark):
    xs = [x for x in _odd_doubles() if not math.isnan(x)]
    got = [r[1] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
           .select("i", ordered_bits("x")).orderBy("i").collect()]
    want = [struct.unpack("<q", struct.pack("<d", abs(x)))[0] * (-1 if x < 0 else 1) for x in xs]
    assert got == want


def test_ranks_of_odd_samples(spark):
    """Every rank of a group of odd values, nulls first and NaN last."""
    xs = [x for x in _odd_doubles() if not math.isnan(x)][:60] + [math.nan, math.nan, None, 1.5, 1.5, 1.5]
    df = spark.createDataFrame([(None, x) for x in xs] + [(1, 7.0)], "g int, x double")
    n = len(xs)
    at = [0, 1, 2, n // 3, n // 2, n - 3, n - 2, n - 1]
    got = {r["g"]: r for r in select_ranks(df, ["g"], "x", {f"r{a}": F.least(F.lit(a), F.col("n") - 1) for a in at},
                                           also=[F.max("g").alias("m")]).collect()}
    want = sorted(xs, key=lambda v: (v is not None, v is not None and math.isnan(v), v or 0.0))
    for a in at:
        assert got[1][f"r{a}"] == 7.0
        assert repr(got[None][f"r{a}"]).lstrip("-") == repr(want[a]).lstrip("-") or got[None][f"r{a}"] == want[a]
    assert got[None]["n"] == n and got[1]["m"] == 1


def test_ranks_need_no_sort_of_the_samples(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id * 7919 % 1000 as double) as x")
    out = select_ranks(df, ["g"], "x", {"p50": F.floor(F.col("n") / 2)})
    assert "rangepartitioning" not in _plan(out) and "Python" not in _plan(out)
    want = {g: sorted(i * 7919 % 1000 for i in range(1000) if i % 3 == g)[(334 if g == 0 else 333) // 2] for g in range(3)}
    assert {r["g"]: r["p50"] for r in out.collect()} == want
    assert select_ranks(df.limit(0), ["g"], "x", {"p50": F.floor(F.col("n") / 2)}).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_running_total(spark, parts):
    df = spark.range(200).selectExpr("id", "id * 31 % 17 as w")
    got, total = running_total(df, ["w", "id"], F.col("w"), "before", num_partitions=parts)
    rows = sorted((r["w"], r["id"], r["before"]) for r in got.collect())
    acc = 0
    for w, _i, before in rows:
        assert before == acc
        acc += w
    assert total == acc and len(rows) == 200


def test_cost_groups_are_even(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 511 + 2).cast("int").alias("n"))
    placed = cost_groups(df, "n", ["id"], 16)
    cost = {r["cost_group"]: (r["c"], r["lo"], r["hi"]) for r in placed.groupBy("cost_group").agg(
        F.sum(F.col("n") * F.col("n")).alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi")).collect()}
    assert set(cost) == set(range(16)) and placed.count() == 3000
    mean = sum(c for c, _, _ in cost.values()) / 16
    assert max(c for c, _, _ in cost.values()) <= 1.1 * mean
    assert all(cost[g][2] <= cost[g + 1][1] for g in range(15))          # like lengths together
    parts = place_by_cost(placed, 16, len_col="n").select(F.spark_partition_id().alias("p"), "cost_group").distinct().collect()
    assert sorted((r["p"], r["cost_group"]) for r in parts) == [(g, g) for g in range(16)]
    assert cost_groups(df.limit(0), "n", ["id"], 4).count() == 0


@pytest.mark.parametrize("block,row_block,spread", [(16, 64, None), (3, 2, 4), (100, 1, 1)])
def test_projection_by_table(spark, block, row_block, spread):
    rng = np.random.default_rng(7)
    w = rng.normal(size=(7, 10))
    w[2, 3] = 0.0
    x = rng.normal(size=(40, 10))
    cells = [(r, c, float(w[r, c])) for r in range(7) for c in range(10) if (r, c) != (2, 3)]
    vectors = [(i, [float(v) for v in x[i]]) for i in range(40)] + [(90, None), (91, [])]
    got = {r["vec_id"]: r["z"] for r in project_by_table(
        spark.createDataFrame(vectors, "vec_id long, embedding array<double>"),
        spark.createDataFrame(cells, "r int, c int, w double"), block=block, row_block=row_block, spread=spread).collect()}
    assert set(got) == {i for i, _ in vectors} and got[90] is None and got[91] is None
    for i in range(40):
        assert np.allclose(got[i], w @ x[i], atol=1e-12)


def test_projection_goldens(spark):
    v = spark.createDataFrame([(1, [5.0, 6.0])], "vec_id long, embedding array<double>")
    w = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "r int, c int, w double")
    assert project_by_table(v, w).first()["z"] == [17.0, 39.0]


def test_bucketed_sinks_join_without_an_exchange(spark, scratch):
    import uuid

    e = spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    name = f"t_{uuid.uuid4().hex[:8]}"
    a = bucketed_sink(e, f"{name}_a", f"{scratch}/a", buckets=4)
    b = bucketed_sink(e.withColumnRenamed("vec", "vec2"), f"{name}_b", f"{scratch}/b", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = a.join(b, "vec_id", "full_outer")
        assert "Exchange" not in _plan(j) and j.where("vec = vec2").count() == e.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"drop table {name}_a")
        spark.sql(f"drop table {name}_b")
