from collections import Counter

import pytest

from wordloom.llm import queries, sharding
from tests.llm.conftest import rows


def check_law(got, n, shards):
    by = Counter(r["shard"] for r in got)
    sizes = [by.get(s, 0) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    for s in by:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s]))
    assert sorted(r["position"] for r in got) == list(range(n))


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 20_000, 100])
def test_rows_law_slots_and_content(spark, edge_docs, bucket_bytes):
    got = sharding.external_shuffle(edge_docs, 4, bucket_bytes=bucket_bytes).collect()
    check_law(got, len(rows()), 4)
    assert Counter((r["doc_id"], r["text"], r["ids"]) for r in got) == Counter((r[0], r[1], r[5]) for r in rows())


def test_a_function_of_data_and_seed(spark):
    df = spark.range(500).selectExpr("id as doc_id", "concat('t', id % 7) as text")
    def place(d, seed):
        return {r["doc_id"]: r["position"] for r in sharding.external_shuffle(d, 16, seed, bucket_bytes=300).collect()}
    one = place(df, 1)
    assert one == place(df.orderBy("text", "doc_id").repartition(5), 1)
    assert one != place(df, 2)


def test_uniform(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "cast(null as string) as text")
    got = sharding.external_shuffle(df, 4, bucket_bytes=200).collect()
    # each quarter of the ids spreads evenly over the shards
    for q in range(4):
        n = Counter(r["shard"] for r in got if r["doc_id"] // 1000 == q)
        assert all(180 < n[s] < 320 for s in range(4)), n


def test_fewer_rows_than_shards_and_empty(spark, no_docs):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    check_law(sharding.external_shuffle(df, 16).collect(), 2, 16)
    assert sharding.external_shuffle(no_docs, 16).count() == 0


def test_written_shards_keep_the_order(spark, scratch):
    df = spark.range(300).selectExpr("id as doc_id", "concat('t', id) as text")
    sharding.write_shards(sharding.external_shuffle(df, 3, bucket_bytes=400), f"{scratch}/s")
    back = spark.read.parquet(f"{scratch}/s")
    assert back.count() == 300 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}
    import glob

    import pyarrow.parquet as pq
    for f in glob.glob(f"{scratch}/s/shard=*/*.parquet"):
        slots = pq.ParquetFile(f).read(columns=["slot"]).column("slot").to_pylist()
        assert slots == sorted(slots)


def test_query(spark):
    import zlib

    got = queries.op10_external_shuffle(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    by = Counter(r["shard"] for r in got)
    assert len(got) == len(docs) and max(by.values()) - min(by.get(s, 0) for s in range(16)) <= 1
    for r in got:
        t = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "rows", None)
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by.get(s, 0)))


def test_a_third_of_all_rows_alike(spark):
    """Rows that agree in key and text do not fill one bucket."""
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) as text")
    rows_ = sharding.external_shuffle(df, 4, bucket_bytes=1000).collect()
    check_law(rows_, 3000, 4)
    by = Counter(r["bucket"] for r in rows_)
    assert max(by.values()) < 500 and len([b for b in by if any(r["text"] == "same text" for r in rows_ if r["bucket"] == b)]) > 5
    alike = [r for r in rows_ if r["text"] == "same text"]
    assert len(alike) == 1000 and all(150 < n < 350 for n in Counter(r["shard"] for r in alike).values())


def test_fisher_yates_is_recomputed(spark):
    """The order of a bucket: canonical rows in the order that a plain Fisher-Yates draws."""
    import numpy as np
    from pyspark.sql import functions as F

    df = spark.range(200).selectExpr("id as doc_id", "concat('t', id) as text")
    rows_ = sharding.external_shuffle(df, 3, seed=5, bucket_bytes=300).withColumn(
        "h", sharding.scatter_hash(F.col("doc_id"), F.col("text"), 5)).collect()
    for b in {r["bucket"] for r in rows_}:
        part = sorted((r for r in rows_ if r["bucket"] == b), key=lambda r: (r["h"], r["doc_id"]))
        order = list(range(len(part)))
        np.random.Generator(np.random.PCG64([5, b])).shuffle(order)
        got = [r["doc_id"] for r in sorted(part, key=lambda r: r["bucket_slot"])]
        assert got == [part[i]["doc_id"] for i in order]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, 7, "x")], "doc_id long, text string, _h int, _size int, slot int, own string")
    r = sharding.external_shuffle(df, 2).first()
    assert (r["_h"], r["_size"], r["slot"], r["own"]) == (5, 6, 0, "x")
