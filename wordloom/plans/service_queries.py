"""Registered queries for batching (F1-F4, B7 on documents), requests and
responses (A2, B1, E1, S2 on conversations) and reports (E3-E6, S1 on events)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_SEQ, MAX_TEXT_CHARS
from ..operators.batching import (assign_fixed_batches, batch_reject,
                                  batch_tokens, cost_groups, length_bucket, ragged_offsets)
from ..operators.ordering import ordered_index
from ..operators.reports import (batch_throughput, micros_since_epoch,
                                 rank_summary, throughput_by_level,
                                 usage_totals)
from ..operators.requests import (explode_requests, parse_request,
                                  request_bodies, restore_order)
from ..operators.wordpiece import encode, tokenize
from ..session import stored
from .context import table, vocab
from .text_queries import encoded_docs

# ---------------------------------------------------------------- batching


def batched_tokens(docs: DataFrame, v: DataFrame, info, policy: str = "truncate") -> DataFrame:
    """Every row of ``docs`` with its token counts, put into batches by source: a
    member is its place in the batch, so null and repeated ids are rows like
    others.  Tokenising gives one row per row, and the places are numbered after
    it: no join, and texts are not sorted."""
    tok = tokenize(docs, v, carry=["source"], info=info, with_tokens=False)
    enc = encode(tok, info, MAX_SEQ, policy).select("doc_id", "source", "n_tokens", "over_length", "n_body")
    # written before it is sorted: a range exchange reads its input twice
    return assign_fixed_batches(stored(enc, "batched"), ["source"], ["doc_id", "n_body"])


def _batched_docs(spark, sf, policy="truncate") -> DataFrame:
    return batched_tokens(table(spark, sf, "documents"), *vocab(spark, sf), policy)


def f2_fixed_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    b = assign_fixed_batches(d, ["source"], ["doc_id"])
    return b.select("doc_id", "source", "batch_no", F.col("idx_in_batch").cast("long").alias("idx_in_batch"))


def f1_ragged_offsets(spark, sf):
    b = ragged_offsets(_batched_docs(spark, sf), ["source"])
    return b.select("doc_id", "source", "batch_no", "offset",
                    F.col("n_tokens").cast("long").alias("n_tokens"))


def f3_batch_tokens(spark, sf):
    return batch_tokens(_batched_docs(spark, sf), ["source"])


def f4_length_buckets(spark, sf):
    enc = encoded_docs(spark, sf, carry=())
    return enc.groupBy(length_bucket("n_tokens", 64).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))


COST_GROUPS = 16


def f4_cost_placement(spark, sf):
    """Documents in groups of like cost: rows, tokens and cost of every group."""
    # written before it is sorted: a range exchange reads its input twice
    enc = stored(encoded_docs(spark, sf, carry=()).select("doc_id", "n_tokens"), "lengths")
    placed = cost_groups(enc, "n_tokens", ["doc_id"], COST_GROUPS)
    cost = F.col("n_tokens").cast("long") * F.col("n_tokens")
    return placed.groupBy(F.col("cost_group").cast("long").alias("cost_group")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.sum(cost).alias("cost"))


def b7_batch_reject(spark, sf):
    # truncation off: the over-length flag comes from the untruncated body
    b = batch_reject(_batched_docs(spark, sf, policy="reject"), ["source"])
    return b.select("doc_id", "source", "batch_no", "batch_status", "batch_reason")


# ---------------------------------------------------------------- requests

def _requests(spark, sf):
    conv = table(spark, sf, "conversations")
    return request_bodies(conv, ["conv_id"], "turn")


def a2_request_explode(spark, sf):
    texts, _ = explode_requests(_requests(spark, sf), ["conv_id"])
    return texts.select("conv_id", F.col("index").cast("long").alias("index"), "model", "text")


def b1_empty_request(spark, sf):
    """All turns as requests; every seventh conversation sends an empty list."""
    bodies = _requests(spark, sf).select("conv_id", F.when(
        F.col("conv_id") % 7 == 0, F.lit('{"input": [], "model": "m"}')).otherwise(F.col("body")).alias("body"))
    r = parse_request(F.col("body"))
    return bodies.select("conv_id", r.alias("r")).select(
        "conv_id",
        F.when(F.col("r.error").isNull(), F.size("r.inputs")).otherwise(0).cast("long").alias("n_inputs"),
        F.when(F.col("r.error").isNull(), "ok").otherwise("rejected").alias("status"),
        F.col("r.error").alias("reason"))


def _request_tokens(spark, sf):
    texts, _ = explode_requests(_requests(spark, sf), ["conv_id"])
    v, info = vocab(spark, sf)
    tok = tokenize(texts, v, id_col=["conv_id", "index"], clip=MAX_TEXT_CHARS, info=info,
                   with_tokens=False)
    return encode(tok, info, MAX_SEQ, "truncate")


def e1_usage_totals(spark, sf):
    enc = _request_tokens(spark, sf)
    return usage_totals(enc, ["conv_id"])


def s2_restore_order(spark, sf):
    texts, _ = explode_requests(_requests(spark, sf), ["conv_id"])
    return restore_order(texts, ["conv_id"]).select(
        "conv_id", F.col("index").cast("long").alias("index"),
        F.length("text").cast("long").alias("text_chars"))


# ---------------------------------------------------------------- reports

def _events(spark, sf):
    return table(spark, sf, "events")


def e3_latency_summary(spark, sf):
    ev = _events(spark, sf).select("event_type", "value", "event_id")
    s = rank_summary(ev, ["event_type"], "value")
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), "p50", "p99")


def e4_latency_by_class(spark, sf):
    """Latency per text class, with the class's largest token count (the
    props of an event stand for its text)."""
    v, info = vocab(spark, sf)
    ev = _events(spark, sf).withColumn("text_class", (F.col("user_id") % 4).cast("long"))
    tok = tokenize(ev, v, text_col="props", id_col="event_id", carry=["text_class", "value"], info=info,
                   with_tokens=False)
    enc = encode(tok, info, MAX_SEQ, "truncate").select("event_id", "text_class", "value", "n_tokens")
    s = rank_summary(enc, ["text_class"], "value",
                     also=[F.max("n_tokens").cast("long").alias("n_tokens")])
    return s.select("text_class", "n", F.round("mean", 6).alias("mean"), "p50", "p99", "n_tokens")


def e5_throughput_by_level(spark, sf):
    ev = _events(spark, sf).withColumn("level", (F.col("user_id") % 6).cast("long"))
    start = micros_since_epoch("ts")
    ev = ev.select("level", "value", "event_id", start.alias("_start"),
                   (start + F.col("value") * F.lit(1000.0)).alias("_end"))
    t = throughput_by_level(ev, "level", "_start", "_end", "value")
    return t.select("level", "n", F.round("throughput", 6).alias("throughput"), "p50", "p99")


def e6_batch_throughput(spark, sf):
    ev = _events(spark, sf).withColumn("batch_size", (F.col("user_id") % 5 + 1).cast("long"))
    t = batch_throughput(ev, "batch_size", "value")
    return t.select("batch_size", "rounds", F.round("sentences_per_s", 6).alias("sentences_per_s"),
                    F.round("ms_per_batch", 6).alias("ms_per_batch"))


def s1_sorted_latencies(spark, sf):
    ev = _events(spark, sf).select("event_type", "value", "event_id")
    r = ordered_index(ev, ["event_type"], ["value", "event_id"], name="rank")
    return r.select("event_type", F.col("rank").cast("long").alias("rank"), "event_id", "value")


# ---------------------------------------------------------------- streaming batcher

H2_WAIT_US = 3 * 3600 * 1_000_000   # 3 hours between events of a user
H2_SIZE = 8


def h2_size_or_time_batches(spark, sf):
    from ..streaming.batcher import assign_batches
    b = assign_batches(_events(spark, sf), "user_id", "event_id", "ts", H2_WAIT_US, H2_SIZE)
    return b.select(F.col("key").alias("user_id"), F.col("item_id").alias("event_id"),
                    "batch_no", F.col("pos_in_batch").cast("long").alias("pos_in_batch"))


def h2_handover(spark, sf):
    """The first half of the time as a batch run, the rest as a stream that goes on
    from its open batches; a far later item of another key moves event time on."""
    import datetime

    from ..session import scratch_path
    from ..streaming.batcher import batch_stream, handover
    from .text_queries import run_to_end
    ev = _events(spark, sf).select("user_id", "event_id", "ts")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    cut = F.lit(lo + (hi - lo) / 2)
    over, state = handover(ev.where(F.col("ts") < cut), "user_id", "event_id", "ts", H2_WAIT_US, H2_SIZE)
    path, out = scratch_path(spark, "h2-rest"), scratch_path(spark, "h2-stream")
    end = spark.createDataFrame([(-1, -1, hi + datetime.timedelta(days=3650))], ev.schema)
    ev.where(F.col("ts") >= cut).unionByName(end).write.parquet(path)
    stream = batch_stream(spark.readStream.schema(ev.schema).parquet(path), "user_id", "event_id", "ts", H2_WAIT_US, H2_SIZE,
                          idle="4000 days", initial=state)
    run_to_end(stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "h2-ckpt"))
               .outputMode("append").trigger(availableNow=True).start(out))
    every = over.unionByName(spark.read.schema(over.schema).parquet(out).where("key <> -1"))
    return every.select(F.col("key").alias("user_id"), F.col("item_id").alias("event_id"), "batch_no",
                        F.col("pos_in_batch").cast("long").alias("pos_in_batch"))
