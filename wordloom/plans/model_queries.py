"""Registered queries that run the encoder or the token-embedding lookup:
D1, D2, D3, J2, E2, A7.  The encoder uses seeded weights (the published
weights are not available offline) sized to the fixture vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_SEQ, MAX_TEXT_CHARS
from ..functions import vectors as V
from ..operators.embed import Model, embed, seeded_model, seeded_words, token_embeddings, with_vocabulary
from ..operators.encoder_math import ModelConfig
from ..operators.requests import assemble_responses, explode_requests, response_json
from ..operators.vectors import first_token_pool
from ..operators.wordpiece import encode, token_table, tokenize, validate_ids
from ..session import ship_package
from .context import table, vocab
from .service_queries import _requests
from .text_queries import encoded_docs

_MODELS: dict[tuple[str, str], Model] = {}
J2_DIM = 8


def tiny_model(spark: SparkSession, sf: str) -> Model:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _, info = vocab(spark, sf)
        cfg = ModelConfig(vocab_size=info.max_id + 1, hidden=32, layers=2, heads=4,
                          max_seq=MAX_SEQ, ffn=128)
        _MODELS[key] = seeded_model(spark, cfg, seed=0)
    return _MODELS[key]


def published_shape_model(spark: SparkSession, vocab_rows: int = 0) -> Model:
    """The published configuration (512-dim, 4 layers, 8 heads, ffn 2048,
    vocabulary 21128) with seeded weights: same work per token as the real
    model, so its throughput is comparable; its vectors are not.

    The fixture vocabulary grows with the documents: beyond 21128 the word
    embeddings go on for ``vocab_rows`` ids.  They are a table; the rest is one
    broadcast for all vocabularies."""
    cfg, key = ModelConfig(), (spark.sparkContext.applicationId, "published-shape")
    if key not in _MODELS:
        _MODELS[key] = seeded_model(spark, cfg, seed=0, with_words=False)
    rows = max(cfg.vocab_size, vocab_rows)
    return with_vocabulary(_MODELS[key], seeded_words(spark, cfg, rows, seed=0), rows)


def d1_embed_benchmark(spark, sf):
    """D1 over the whole ``benchmark`` table through the published model shape."""
    v, info = vocab(spark, sf)
    tok = tokenize(table(spark, sf, "benchmark"), v, id_col="item_id", info=info, with_tokens=False)
    enc = encode(tok, info, MAX_SEQ, "truncate")
    model = published_shape_model(spark, info.max_id + 1)
    return embed(enc.select("item_id", "ids"), model, id_col="item_id")


def d1_embed_documents(spark, sf):
    enc = encoded_docs(spark, sf, carry=())
    return embed(enc.select("doc_id", "ids"), tiny_model(spark, sf))


def d2_embed_ids(spark, sf):
    v, info = vocab(spark, sf)
    enc = encoded_docs(spark, sf, carry=())
    checked = validate_ids(enc.select("doc_id", "ids"), info.max_id + 1)
    return embed(checked.where(F.col("status") == "ok"), tiny_model(spark, sf))


def _weights_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[float]]:
    """Deterministic embedding tables (exact in binary floating point)."""
    v, _ = vocab(spark, sf)
    d = F.sequence(F.lit(0), F.lit(J2_DIM - 1))
    word = v.select(F.col("id").alias("token_id"), F.transform(
        d, lambda k: ((F.col("id") * 31 + k * 17) % 97) / F.lit(97.0) - F.lit(0.5)).alias("w"))
    pos = spark.range(MAX_SEQ).select(F.col("id").cast("int").alias("pos"), F.transform(
        d, lambda k: ((F.col("id") * 13 + k * 7) % 89) / F.lit(890.0)).alias("p"))
    typ = [k / 1000.0 for k in range(J2_DIM)]
    return word, pos, typ


def _token_vectors(spark, sf):
    enc = encoded_docs(spark, sf, carry=())
    toks = token_table(enc).select("doc_id", F.col("pos").cast("int").alias("pos"), "token_id")
    word, pos, typ = _weights_tables(spark, sf)
    return token_embeddings(toks, word, pos, typ)


def j2_token_embeddings(spark, sf):
    ship_package(spark)
    x = _token_vectors(spark, sf)
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"),
                    F.col("token_id").cast("long").alias("token_id"), V.fmt_batches("x").alias("x"))


def d3_first_token_pool(spark, sf):
    """Pooling over sentences of vectors whose first vectors differ: each group of
    eight ``embeddings`` rows is a sentence, in id order."""
    rows = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("sentence"), (F.col("vec_id") % 8).cast("int").alias("pos"),
        F.col("embedding").alias("x"))
    pooled = first_token_pool(rows, id_col="sentence")
    return pooled.select("sentence", V.fmt(V.l2_normalize("pooled")).alias("pooled"))


def _responses(spark, sf):
    """Each text of a request takes the vector whose id is a hash-like mix of its
    place, out of the given ``embeddings`` (ids 0..n-1): results arrive in any
    order and are put back by request and index."""
    texts, _ = explode_requests(_requests(spark, sf), ["conv_id"])
    v, info = vocab(spark, sf)
    keys = ["conv_id", "index"]
    tok = tokenize(texts, v, id_col=keys, carry=["model"], clip=MAX_TEXT_CHARS, info=info, with_tokens=False)
    enc = encode(tok, info, MAX_SEQ, "truncate")
    vectors = table(spark, sf, "embeddings")
    n = vectors.count()
    given = (F.col("conv_id") * 31 + F.col("index") * 7) % n
    res = enc.select(*keys, "model", "n_tokens", given.cast("long").alias("vec_id")).join(
        vectors.select("vec_id", "embedding"), "vec_id")
    return assemble_responses(res, ["conv_id"])


def e2_response_assembly(spark, sf):
    r = _responses(spark, sf)
    vecs = F.transform("data", lambda d: V.fmt(V.head(d["embedding"], 4)))
    return r.select("conv_id", F.size("data").cast("long").alias("n_data"),
                    F.array_join(F.transform("data", lambda d: d["index"]), ",").alias("indexes"),
                    F.array_join(F.transform("data", lambda d: F.size(d["embedding"])), ",").alias("dims"),
                    F.array_join(vecs, ";").alias("vectors"), "total_tokens")


def a7_response_json(spark, sf):
    doc = response_json(_responses(spark, sf), ["conv_id"])
    j = F.col("response")
    last = F.from_json(F.get_json_object(j, "$.data"), "array<struct<index:bigint,embedding:array<float>>>")
    return doc.withColumn("_last", F.element_at(last, -1)).select(
        "conv_id",
        F.get_json_object(j, "$.object").alias("object"),
        F.get_json_object(j, "$.model").alias("model"),
        F.json_array_length(F.get_json_object(j, "$.data")).cast("long").alias("n_data"),
        F.get_json_object(j, "$.data[0].object").alias("first_object"),
        F.json_array_length(F.get_json_object(j, "$.data[0].embedding")).cast("long").alias("dim"),
        F.col("_last.index").alias("last_index"),
        V.fmt(V.head("_last.embedding", 4)).alias("last_vector"),
        F.get_json_object(j, "$.usage.prompt_tokens").cast("long").alias("prompt_tokens"),
        F.get_json_object(j, "$.usage.total_tokens").cast("long").alias("total_tokens"))
