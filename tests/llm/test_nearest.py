import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import nearest as N
from wordloom.llm import queries


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault((i, tuple(np.float32(v).tolist())), 1)
    ids = np.array([i for i, _ in ok])
    x = np.array([v for _, v in ok], dtype=np.float64)
    out = {}
    for r in np.flatnonzero(ids % every == 0):
        s = (x * x[r]).sum(axis=1)
        order = [o for o in np.lexsort((ids, -s)) if ids[o] != ids[r]][:k]
        out[int(ids[r])] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def run(spark, df, k=5, every=5, **kw):
    got = {}
    for r in N.nearest(df, df.where(F.col("vec_id") % every == 0), k=k, **kw).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(i, s) for _r, i, s in sorted(x)] for q, x in got.items()}


def test_hot_vector_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(120)]
    rows += [(i, [9.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(120, 220)]            # one vector, a third and more of all rows
    rows += [(130, [9.0, 0.0, 0.0, 0.0, 0.0, 0.0])]                                   # a repeated row
    rows += [(300, None), (305, [0.0] * 6), (310, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (315, [float("nan")] + [1.0] * 5),
             (320, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (325, [1.0, 2.0])]
    got = run(spark, table(spark, rows))
    want = brute([r for r in rows if r[0] != 325], 5, 5)
    assert set(got) == set(want)
    for q, w in want.items():
        assert [s for _i, s in got[q]] == pytest.approx([s for _i, s in w])
    assert got[120] == [(i, 81.0) for i in (121, 122, 123, 124, 125)]
    assert [i for i, _ in got[215]] == [120, 121, 122, 123, 124]


def test_fewer_candidates_than_k_and_empty(spark):
    df = table(spark, [(0, [1.0, 2.0]), (5, [2.0, 1.0]), (6, [0.5, 0.5])])
    assert [i for i, _ in run(spark, df)[0]] == [5, 6]
    assert run(spark, table(spark, [(0, [1.0, 2.0])])) == {}
    assert N.nearest(df.limit(0), df.limit(0)).count() == 0
    one = table(spark, [(i, [float(i + 1)]) for i in range(8)])             # a single component: one half only
    assert [i for i, _ in run(spark, one, k=3)[5]] == [7, 6, 4]


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(1)
    index = N.MultiIndex(rng.normal(size=(9, 3)), rng.normal(size=(7, 3)))
    index.set_counts(np.arange(63), np.ones(63, dtype=np.int64))
    q = rng.normal(size=6)
    order = index.visit(q, 63)
    d = [((q[:3] - index.first[c // 7]) ** 2).sum() + ((q[3:] - index.second[c % 7]) ** 2).sum() for c in order]
    assert sorted(order) == list(range(63)) and np.all(np.diff(d) >= -1e-9)
    assert len(index.visit(q, 10)) == 10


def test_blocks_split_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 32)
    monkeypatch.setattr(N, "CHUNK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * (0.01 if i < 200 else 1) + 1).tolist()) for i in range(400)]
    got, want = run(spark, table(spark, rows), share=1.0), brute(rows, 5, 5)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20)
    got = {}
    for r in queries.op3_nearest(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hit = sum(len(set(got[q]) & {i for i, _ in w}) for q, w in want.items())
    assert set(got) == set(want) and hit >= 0.9 * sum(map(len, want.values()))
    assert all(got[q][i] == pytest.approx(s, abs=1e-12) for q, w in want.items() for i, s in w if i in got[q])


def test_recall_of_a_partial_visit(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 20)
    got = run(spark, df, k=20, every=20, share=0.6)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("norms", ["unit", "few long", "log-normal"])
def test_recall_at_the_production_share_whatever_the_norms(spark, monkeypatch, norms):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "few long":
        x[rng.choice(len(x), 40, replace=False)] *= 5
    elif norms == "log-normal":
        x *= rng.lognormal(0, 0.5, size=(len(x), 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = run(spark, table(spark, rows), k=20, every=20), brute(rows, 20, 20)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))
