"""H1, H3, H4: the same tokenise/encode/embed transformations on a stream.

The distinct-word WordPiece plan aggregates, so it runs per micro-batch in
``foreachBatch`` (each micro-batch is a bounded DataFrame; its result is the
batch result restricted to those rows).  Sinks are idempotent per epoch: each
micro-batch writes to its own ``epoch=N`` folder with overwrite, so a
replayed epoch after a failure replaces its earlier attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_SEQ, MAX_TEXT_CHARS
from ..operators.embed import Model, embed
from ..operators.wordpiece import VocabInfo, encode, tokenize
from ..session import scratch_scope, stored
from ..sources.corpus import DOCUMENT_SCHEMA


def read_document_stream(spark: SparkSession, path: str, max_files: int | None = 1,
                         max_bytes: int | None = None) -> DataFrame:
    """H1 source with H3 admission control: at most ``max_files`` files (or
    about ``max_bytes`` bytes of files, a positive integer) enter one
    micro-batch, the streaming analogue of the reference's bounded queue."""
    r = spark.readStream.schema(DOCUMENT_SCHEMA)
    if max_files is not None:
        r = r.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        r = r.option("maxBytesPerTrigger", int(max_bytes))
    return r.parquet(path)


def tokenize_microbatch(batch: DataFrame, vocab: DataFrame, info: VocabInfo,
                        policy: str = "reject") -> DataFrame:
    tok = tokenize(batch, vocab, carry=["lang"], clip=MAX_TEXT_CHARS, info=info)
    return encode(tok, info, MAX_SEQ, policy)


def start_tokenize_stream(stream: DataFrame, vocab: DataFrame, info: VocabInfo, out_dir: str,
                          dead_letter_dir: str, checkpoint_dir: str, model: Model | None = None,
                          policy: str = "reject", available_now: bool = True):
    """H1 + H4: accepted rows -> ``out_dir`` (ids, counts and, with a model,
    embeddings); rejected rows with their ``reason`` -> ``dead_letter_dir``.
    A bad row (null text, invalid UTF-8, over-length) never fails its neighbours
    (per-row status instead of a batch-wide exception).  What a micro-batch
    writes in between is deleted when it is done."""

    def per_batch(batch: DataFrame, epoch: int) -> None:
        with scratch_scope(batch.sparkSession):
            enc = stored(tokenize_microbatch(batch, vocab, info, policy), "microbatch")
            ok = enc.where(F.col("status") == "ok")
            if model is not None:
                vecs = embed(ok.select("doc_id", "ids"), model)
                ok = ok.join(vecs.drop("n_tokens"), "doc_id")
            ok.drop("status", "reason").write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
            (enc.where(F.col("status") != "ok").select("doc_id", "lang", "status", "reason", "n_body")
                .write.mode("overwrite").parquet(f"{dead_letter_dir}/epoch={epoch}"))

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
