"""Registered queries over ``documents``: text preparation and tokenisation
(A1, A3, B2, B3, B5, B6, B8, C1-C6, J1) and the flagship."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_CHUNKS, MAX_SEQ, MAX_TEXT_CHARS
from ..functions.text import (CJK_RE, PUNCT_RE, SPACE_RE, basic_tokenize,
                              clip_chars, count_class, cut_at_nul, utf8_faults)
from ..operators.wordpiece import (chunk_table, encode, segment_words,
                                   token_table, tokenize, validate_ids)
from ..session import scratch_path, spread
from ..sources.corpus import read_corpus
from ..streaming.pipeline import read_document_stream
from .context import table, vocab


def _docs(spark, sf):
    return table(spark, sf, "documents")


def encoded_docs(spark: SparkSession, sf: str, policy: str = "truncate",
                 carry=("lang",), with_tokens: bool = False) -> DataFrame:
    """Library path: basic tokenise (512 chunks) -> WordPiece -> encode."""
    v, info = vocab(spark, sf)
    tok = tokenize(_docs(spark, sf), v, carry=list(carry), info=info, with_tokens=with_tokens)
    return encode(tok, info, MAX_SEQ, policy)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids, token count and truncation per document; tokens per language.
    ``max_body`` is the longest whole text in tokens (no chunk cap)."""
    v, info = vocab(spark, sf)
    tok = tokenize(_docs(spark, sf), v, carry=["lang"], info=info, max_chunks=None, with_tokens=False)
    enc = encode(tok, info, MAX_SEQ, "truncate")
    return enc.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("truncated").cast("long")).alias("n_truncated"),
        F.max("n_body").cast("long").alias("max_body"))


def a1_corpus(spark, sf):
    d = read_corpus(spark, f"{sf}/documents.parquet")
    return d.select("doc_id", "lang", "source", "n_chars",
                    F.length("text").cast("long").alias("text_chars"))


def a3_fixture_vocab(spark, sf):
    v, _ = vocab(spark, sf)
    return v.select("id", "token")


def b2_clip(spark, sf):
    d = _docs(spark, sf)
    clipped = clip_chars("text", MAX_TEXT_CHARS)
    return d.select("doc_id", F.length(clipped).cast("long").alias("clipped_chars"),
                    (F.length("text") > MAX_TEXT_CHARS).alias("was_clipped"))


def b3_nul_cut(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.length(cut_at_nul("text")).cast("long").alias("chars_before_nul"))


def document_stream(spark, sf, **options):
    """The ``documents`` table as a stream, be it one file or a folder of files: as a
    pattern (that fits this one name) the path may be either."""
    reader = spark.readStream.schema(table(spark, sf, "documents").schema).options(**options)
    return reader.parquet(f"{sf.rstrip('/')}/documents.parque[t]")


def with_bytes_put_in(more):
    """All bytes of a text with those of ``more`` put in after (doc_id * 7919 + 13)
    mod (bytes + 1) of them: anywhere in the text, also inside a character."""
    raw = F.col("text").cast("binary")
    at = ((F.col("doc_id") * 7919 + 13) % (F.octet_length(raw) + 1)).cast("int")
    return F.concat(F.substring(raw, F.lit(1), at), more, F.substring(raw, at + 1, F.octet_length(raw)))


# fixed test bytes: nothing, a lone lead byte, no lead byte at all, a lead byte that lacks one byte, two stray ones
DAMAGE = (b"", b"\xc3", b"\xff", b"\xe4\xb8", b"\x80\x80")


def b4_invalid_utf8(spark, sf):
    """Whole texts with bytes put in; the bad ones are refused, with a reason,
    the place of the first bad byte and their number."""
    v, info = vocab(spark, sf)
    kinds = F.array(*[F.lit(bytearray(x)) for x in DAMAGE])
    more = F.element_at(kinds, (F.col("doc_id") % len(DAMAGE) + 1).cast("int"))
    docs = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 9 != 0, with_bytes_put_in(more)).alias("text"))
    docs = spread(docs).withColumn("faults", utf8_faults("text"))
    enc = encode(tokenize(docs, v, carry=["faults"], info=info, with_tokens=False), info)
    return enc.select("doc_id", "status", "reason", "faults.first_bad", "faults.n_bad")


def h4_dead_letters(spark, sf):
    """H4: rows that a stream refuses, by reason, beside the rows it accepts."""
    from ..streaming.pipeline import start_tokenize_stream
    v, info = vocab(spark, sf)
    stream = document_stream(spark, sf)
    stream = stream.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.lit(None))
                               .when(F.col("doc_id") % 9 == 1, with_bytes_put_in(F.lit(bytearray(DAMAGE[1]))))
                               .otherwise(F.col("text").cast("binary")))
    out, dead, ck = (scratch_path(spark, n) for n in ("h4-out", "h4-dead", "h4-ckpt"))
    run_to_end(start_tokenize_stream(stream, v, info, out, dead, ck, policy="reject"))
    ok = spark.read.parquet(out).select("doc_id", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    return ok.unionByName(spark.read.parquet(dead).select("doc_id", "status", "reason"))


def h3_admission(spark, sf):
    """H3: the corpus as 8 files, one admitted per trigger; rows per micro-batch."""
    files = scratch_path(spark, "h3-files")
    docs = _docs(spark, sf).select("doc_id", "text", "lang", "source", "n_chars")
    docs.repartition(8).write.parquet(files)
    counts = scratch_path(spark, "h3-counts")

    def count(batch: DataFrame, epoch: int) -> None:
        (batch.agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("file").alias("n_files"))
         .write.mode("overwrite").parquet(f"{counts}/epoch={epoch}"))

    stream = read_document_stream(spark, files, max_files=1).withColumn("file", F.input_file_name())
    q = (stream.writeStream.foreachBatch(count)
         .option("checkpointLocation", scratch_path(spark, "h3-ckpt")).trigger(availableNow=True).start())
    run_to_end(q)
    rows = spark.read.parquet(counts)
    return rows.agg(F.sum("n_docs").alias("n_docs"), F.max("n_files").alias("most_files_at_once"))


def run_to_end(q) -> None:
    q.awaitTermination()               # availableNow ends by itself
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def b5_char_classes(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id",
                    count_class("text", CJK_RE).cast("long").alias("n_cjk"),
                    count_class("text", PUNCT_RE).cast("long").alias("n_punct"),
                    count_class("text", SPACE_RE).cast("long").alias("n_space"))


def c1_basic_tokenize(spark, sf):
    d = _docs(spark, sf)
    all_chunks = basic_tokenize("text")
    capped = F.slice(all_chunks, 1, MAX_CHUNKS)
    return d.select("doc_id",
                    F.size(all_chunks).cast("long").alias("n_chunks_all"),
                    F.size(capped).cast("long").alias("n_chunks"),
                    F.array_join(capped, " ").alias("chunks"))


def c2_wordpiece(spark, sf):
    v, info = vocab(spark, sf)
    words = (chunk_table(spread(_docs(spark, sf).select("doc_id", "text")))
             .where(F.col("word").isNotNull()).select("word").distinct())
    seg = segment_words(words, v, info)
    return seg.select("word", F.array_join("pieces", " ").alias("pieces"),
                      F.array_join("piece_ids", ",").alias("piece_ids"),
                      F.size("pieces").cast("long").alias("n_pieces"))


def c3_tokenize(spark, sf):
    v, info = vocab(spark, sf)
    tok = tokenize(_docs(spark, sf), v, info=info)
    return tok.select("doc_id", F.size("body_tokens").cast("long").alias("n_body"),
                      F.array_join("body_tokens", " ").alias("body"))


def c4_token_table(spark, sf):
    enc = encoded_docs(spark, sf, carry=(), with_tokens=True)
    return token_table(enc).select("doc_id", F.col("pos").cast("long").alias("pos"),
                                   "token", F.col("token_id").cast("long").alias("token_id"))


def u3_token_rows(spark, sf):
    """The token table out of a table function over the encoded documents."""
    from ..functions.udfs import make_token_rows
    from ..session import ship_package
    ship_package(spark)
    spark.udtf.register("token_rows", make_token_rows())
    enc = encoded_docs(spark, sf, carry=(), with_tokens=True)
    buckets = F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("bucket")
    name = f"wl_encoded_{uuid.uuid4().hex[:12]}"
    enc.select("doc_id", "tokens", "ids", buckets).createOrReplaceTempView(name)
    rows = spark.sql(f"SELECT * FROM token_rows(TABLE({name}) PARTITION BY bucket)")
    spark.catalog.dropTempView(name)
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "token", F.col("id").cast("long").alias("token_id"))


def c5_encode(spark, sf):
    enc = encoded_docs(spark, sf, carry=())
    return enc.select("doc_id", F.array_join("ids", ",").alias("ids"), "truncated")


def c6_token_count(spark, sf):
    enc = encoded_docs(spark, sf, carry=())
    return enc.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


def b6_reject_policy(spark, sf):
    enc = encoded_docs(spark, sf, policy="reject", carry=())
    return enc.select("doc_id", "status", "reason", F.col("n_tokens").cast("long").alias("n_tokens"))


def b8_validate_ids(spark, sf):
    v, info = vocab(spark, sf)
    enc = encoded_docs(spark, sf, carry=())
    # the id entry point takes ids as given; check them against the vocabulary
    # one id of every tenth document is moved out of range
    given = F.when(F.col("doc_id") % 10 == 0, F.concat(F.array(F.lit(info.max_id + 1)), F.slice(
        "ids", 2, MAX_SEQ))).otherwise(F.col("ids"))
    checked = validate_ids(enc.select("doc_id", given.alias("ids")), info.max_id + 1)
    return checked.select("doc_id", "status", "reason")


def j1_vocab_lookup(spark, sf):
    """Whole-chunk lookup with the UNK fallback (left join, broadcast by size)."""
    v, info = vocab(spark, sf)
    words = (chunk_table(spread(_docs(spark, sf).select("doc_id", "text")))
             .where(F.col("word").isNotNull()).select("word").distinct())
    side = v.select(F.col("token").alias("word"), F.col("id"))
    return words.join(side, "word", "left").select(
        "word", F.coalesce(F.col("id"), F.lit(info.unk_id)).cast("long").alias("token_id"))


def h1_stream_tokenize(spark, sf):
    """H1: the documents file read as a stream (one file per trigger), the
    same tokenise/encode per micro-batch, written to the shared folder."""
    from ..streaming.pipeline import start_tokenize_stream
    v, info = vocab(spark, sf)
    stream = document_stream(spark, sf, maxFilesPerTrigger=1)
    out, dead, ck = (scratch_path(spark, n) for n in ("h1-out", "h1-dead", "h1-ckpt"))
    q = start_tokenize_stream(stream, v, info, out, dead, ck, policy="truncate")
    run_to_end(q)
    return spark.read.parquet(out).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
