"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, n_tokens) in
a shared folder.  Counting a corpus takes four steps:

1. one scan reduces every document to its key, size and content digest;
2. rows whose digest is stored already are left out;
3. the rest is grouped by digest, with map-side combine: a text held by a third of
   all rows, with whatever keys, is one row per task and then one.  It is encoded
   in Arrow batches and appended to the cache;
4. every document takes its count from the cache by a join on the digest
   (the stored side is unique; a hot digest is split by adaptive execution).

The digest covers the text as the tokenizer sees it (null counts as empty), and
the tokenizer digest covers the model file, so another model or model version
never reads old counts.  Concurrent or repeated appends may store a digest
twice with the same count; readers group by digest.

Nulls: a null text counts as empty (0 bytes, 0 tokens).  Null or repeated
document keys keep their rows; very long texts are encoded whole; an empty table
gives an empty result.  Columns of the input other than key and text are
ignored, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_sizes, map_arrow, row_chunks, stored, text_or_empty, utf8_size

MAX_MODEL_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20

CACHE_SCHEMA = "content_sha256 binary, tokenizer_sha256 string, n_tokens bigint"


def load_model(path: str) -> tuple[str, bytes, str]:
    """(digest, bytes, kind) of a tokenizer file; the size bounds the broadcast."""
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"tokenizer file above {MAX_MODEL_BYTES} bytes: {path}")
    with open(path, "rb") as f:
        data = f.read()
    kind = "tokenizers" if path.endswith(".json") else "sentencepiece"
    return hashlib.sha256(kind.encode() + b"\0" + data).hexdigest(), data, kind


def _counter(data: bytes, kind: str):
    if kind == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, out_type=int, num_threads=1,
                                                           add_bos=False, add_eos=False)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(data.decode("utf-8"))
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


_WORKER: dict[str, object] = {}


def _worker_counter(key: str, shared, kind: str):
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = _counter(shared.value, kind)
    return _WORKER[key]


def count_texts(df: DataFrame, model_path: str, text_col: str, keep: list[str],
                out_col: str = "n_tokens") -> DataFrame:
    """``keep`` columns and the token count of every row's whole text."""
    key, data, kind = load_model(model_path)
    shared = df.sparkSession.sparkContext.broadcast(data)

    def make():
        count = _worker_counter(key, shared, kind)

        def run(batch: pa.RecordBatch):
            col = batch.column(batch.num_columns - 1)
            for lo, hi in row_chunks(byte_sizes(col), CHUNK_BYTES):
                texts = [t or b"" for t in col.slice(lo, hi - lo).to_pylist()]
                part = [t.decode("utf-8", "replace") for t in texts]
                yield lo, hi, [pa.array(np.array(count(part), dtype=np.int64))]
        return run

    src = "_count_bytes"
    return map_arrow(df.withColumn(src, F.col(text_col).cast("string").cast("binary")), keep,
                     [T.StructField(out_col, T.LongType(), False)], make, [src])


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts (an empty table when nothing was stored yet)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(conf).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def token_counts(df: DataFrame, model_path: str, cache_path: str, key_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(key, n_bytes, content_sha256, n_tokens) for every row of ``df``; texts
    the cache lacks are encoded once each and appended to it."""
    spark = df.sparkSession
    tok_digest, _data, _kind = load_model(model_path)
    keyed = stored(df.select(
        F.col(key_col).alias("_key"), utf8_size(text_col).alias("n_bytes"),
        F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)).alias("content_sha256")),
        "token-keys")

    known = (read_cache(spark, cache_path).where(F.col("tokenizer_sha256") == tok_digest)
             .select("content_sha256").distinct())
    digest = F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)).alias("content_sha256")
    texts = df.select(digest, text_or_empty(text_col).alias("_text"))
    if not known.isEmpty():
        texts = texts.join(known, "content_sha256", "left_anti")
    distinct = texts.groupBy("content_sha256").agg(F.first("_text").alias("_text"))
    counted = count_texts(distinct, model_path, "_text", ["content_sha256"])
    (counted.select("content_sha256", F.lit(tok_digest).alias("tokenizer_sha256"), "n_tokens")
     .write.mode("append").parquet(cache_path))

    # written, so that the join below reads both sides from exchanges and a hot digest can be split
    counts = stored(read_cache(spark, cache_path).where(F.col("tokenizer_sha256") == tok_digest)
                    .groupBy("content_sha256").agg(F.min("n_tokens").alias("n_tokens")), "token-counts")
    return (keyed.join(counts, "content_sha256", "left")
            .select(F.col("_key").alias(key_col), "n_bytes", "content_sha256", "n_tokens"))
