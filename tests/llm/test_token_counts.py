import sentencepiece
from pyspark.sql import functions as F

from wordloom.llm import queries, token_counts
from tests.llm.conftest import rows

PATH = queries.tokenizer_path("piece_bpe_32k.model")


def counter():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return lambda t: len(model.encode(t or ""))


def test_edge_rows(spark, edge_docs, scratch):
    count = counter()
    out = token_counts.token_counts(edge_docs, PATH, f"{scratch}/cache")
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in out.collect())
    assert got == sorted((r[0] or -1, len((r[1] or "").encode()), count(r[1])) for r in rows())


def test_only_distinct_misses_are_encoded_and_appended(spark, scratch):
    cache = f"{scratch}/cache"
    first = spark.createDataFrame([(i, "same text") for i in range(50)] + [(50, "other")], "doc_id long, text string")
    assert token_counts.token_counts(first, PATH, cache).count() == 51
    assert token_counts.read_cache(spark, cache).count() == 2
    # a stored count is used as it stands: plant a wrong one and see it come back
    digest = token_counts.load_model(PATH)[0]
    planted = spark.createDataFrame([("planted",)], "t string").select(
        F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("content_sha256"),
        F.lit(digest).alias("tokenizer_sha256"), F.lit(12345).cast("long").alias("n_tokens"))
    planted.write.mode("append").parquet(cache)
    more = spark.createDataFrame([(1, "planted"), (2, "same text"), (3, "new one")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(more, PATH, cache).collect()}
    count = counter()
    assert got == {1: 12345, 2: count("same text"), 3: count("new one")}
    assert token_counts.read_cache(spark, cache).count() == 4


def test_another_tokenizer_does_not_read_the_counts(spark, scratch):
    cache = f"{scratch}/cache"
    df = spark.createDataFrame([(1, "Hello wörld, it's <|endoftext|>")], "doc_id long, text string")
    a = token_counts.token_counts(df, PATH, cache).first()["n_tokens"]
    b = token_counts.token_counts(df, queries.tokenizer_path("byte_bpe_50k.json"), cache).first()["n_tokens"]
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    assert a == counter()("Hello wörld, it's <|endoftext|>")
    assert b == len(tok.encode("Hello wörld, it's <|endoftext|>", add_special_tokens=False).ids)


def test_empty_table(spark, no_docs, scratch):
    assert token_counts.token_counts(no_docs, PATH, f"{scratch}/cache").count() == 0


def test_query(spark):
    count = counter()
    out = {r["doc_id"]: r for r in queries.op9_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for r in docs:
        n = count(r["text"])
        assert (out[r["doc_id"]]["n_tokens"], out[r["doc_id"]]["over_limit"]) == (n, n > 4096)


def test_repeated_keys_are_encoded_once_per_text(spark, scratch, monkeypatch):
    """A third of all rows share one key (and two texts); nulls keys repeat texts."""
    from wordloom.llm import token_counts as TC

    df = spark.range(600).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end as doc_id",
                                     "concat('some text ', id % 2) as text")
    seen = []
    plain = TC.count_texts
    monkeypatch.setattr(TC, "count_texts", lambda d, *a, **k: seen.append(d.count()) or plain(d, *a, **k))
    path = queries.tokenizer_path("piece_bpe_32k.model")
    one = TC.token_counts(df, path, f"{scratch}/cache").collect()
    two = TC.token_counts(df, path, f"{scratch}/cache").collect()      # all stored now
    assert seen == [2, 0] and len(one) == len(two) == 600
    assert sorted(map(str, one)) == sorted(map(str, two)) and {r["n_tokens"] for r in one} == {one[0]["n_tokens"]}


def test_the_query_over_one_cache_twice(spark, scratch, monkeypatch):
    from wordloom.llm import token_counts as TC

    path = f"{scratch}/kept"
    monkeypatch.setattr(queries, "scratch_path", lambda _s, _n: path)
    seen = []
    plain = TC.count_texts
    monkeypatch.setattr(TC, "count_texts", lambda d, *a, **k: seen.append(d.count()) or plain(d, *a, **k))
    runs = [sorted(map(tuple, queries.op9_token_counts(spark, "/root/testdata/sf0.001").collect())) for _ in range(2)]
    assert runs[0] == runs[1] and seen[0] > 100 and seen[1] == 0
