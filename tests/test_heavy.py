"""Heavy-hitter joins: same rows as a plain left join, heavy keys never shuffled."""

import pytest
from pyspark.sql import functions as F

from wordloom.operators import wordpiece as W
from wordloom.operators.embed import token_embeddings
from wordloom.operators.heavy import heavy_join, heavy_keys


def _skewed(spark, n=4000):
    return spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("int").alias("pos"), F.when(
        F.col("id") % 2 == 0, 1).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 997 + 2).cast("long").alias("k"))


@pytest.mark.parametrize("support", [1e-4, 0.01, 0.6])
def test_equals_a_left_join(spark, support):
    left = _skewed(spark)
    right = spark.range(1, 700).select(F.col("id").alias("k"), (F.col("id") * 3).alias("w"))
    cols = ["doc_id", "pos", "k", "w"]
    got = heavy_join(left, right, "k", support).select(*cols)
    want = left.join(right, "k", "left").select(*cols)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_heavy_keys_are_bounded(spark):
    counts = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    assert heavy_keys(counts, "k", support=1e-3).count() == 0
    assert heavy_keys(counts.unionByName(spark.createDataFrame([(5000, 9000), (None, 9000)], "k long, n int")), "k",
                      support=1e-3).count() == 1


def test_half_of_all_tokens_are_not_one_task(spark):
    """What is left for the shuffled join is spread evenly, and no row is lost."""
    emb = spark.range(0, 1000).select(F.col("id").alias("token_id"), F.array(F.col("id") * 1.0).alias("w"))
    pos = spark.range(0, 7).select(F.col("id").cast("int").alias("pos"), F.array(F.col("id") * 1.0).alias("p"))
    tokens = _skewed(spark).where("k is not null").withColumnRenamed("k", "token_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        x = token_embeddings(tokens, emb, pos, [0.5])
        tasks = x.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == tokens.count()
        sizes = sorted(r["count"] for r in tasks)
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
        assert x.where("x[0] <> token_id + pos + 0.5").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(Exception, match="no embedding"):
        token_embeddings(tokens, emb.where("token_id <> 1"), pos, [0.5]).collect()


def test_tokens_of_heavy_words_are_the_same(spark, monkeypatch):
    rows = [(0, "hot"), (1, "cold"), (2, "##er"), (100, "[UNK]")]
    vocab = spark.createDataFrame(rows, "id int, token string")
    docs = spark.range(300).selectExpr("id as doc_id", "concat(repeat('hot ', 40), if(id % 7 = 0, 'colder x', '')) as text")
    docs = docs.unionByName(spark.createDataFrame([(900, ""), (901, None)], "doc_id long, text string"))

    def out():
        return sorted((r["doc_id"], tuple(r["body_tokens"] or ()), tuple(r["body_ids"] or ()), r["text_error"])
                      for r in W.tokenize(docs, vocab).collect())

    plain = out()
    monkeypatch.setattr(W, "PLAIN_JOIN_ROWS", 0)
    monkeypatch.setattr(W, "SUPPORT", 0.05)
    assert out() == plain and len(plain) == 302


def test_texts_in_blocks_give_the_same_bodies(spark, monkeypatch):
    """Many occurrences: none is shuffled, texts meet the pieces of their words by block."""
    vocab = spark.createDataFrame([(0, "hot"), (1, "cold"), (2, "##er"), (3, "."), (100, "[UNK]")], "id int, token string")
    docs = spark.range(400).selectExpr("id % 50 as doc_id", "id as lang", "concat(repeat('hot. ', id % 9), 'colder x', id) as text")
    odd = [(None, 1000, "hot"), (None, 1001, "hot"), (7, 1002, ""), (7, 1003, None), (8, 1004, " \t"), (8, 1005, "\0hot")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, lang long, text string"))
    docs = docs.selectExpr("doc_id", "lang", "cast(text as binary) as text").unionByName(
        spark.createDataFrame([(9, 1006, bytearray(b"hot\xff"))], "doc_id long, lang long, text binary"))

    def out(df):
        return sorted(((r["doc_id"], r["lang"], r["body_tokens"], r["body_ids"], r["text_error"]) for r in df.collect()), key=str)

    for with_tokens in (True, False):
        def tokenized():
            return W.tokenize(docs.repartition(3), vocab, carry=["lang"], with_tokens=with_tokens)

        monkeypatch.setattr(W, "PLAIN_JOIN_ROWS", 2_000_000)
        plain = out(tokenized())
        monkeypatch.setattr(W, "PLAIN_JOIN_ROWS", 0)
        monkeypatch.setattr(W, "BLOCK_BYTES", 500)
        by_blocks = tokenized()
        assert out(by_blocks) == plain and len(plain) == 407
        assert "CoGroups" in by_blocks._jdf.queryExecution().toString()
