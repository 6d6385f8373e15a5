"""Sharding by a two-pass external shuffle.

Pass 1 scatters whole records uniformly into memory-sized buckets by a seeded
hash (one Spark exchange; its files on disk are the buckets).  Pass 2 loads one
bucket at a time, puts it into a canonical order, applies a Fisher-Yates
shuffle driven by (seed, bucket) and writes it.  The buckets one after another
are a uniform random permutation of the table; shard ``s`` of ``S`` is the
``s``-th run of it, so row counts differ by at most one (law ``rows``).

The number of buckets comes from the bytes of the table, so a bucket fits in a
task's memory (32 MB each up to 32 TB; beyond, 2**20 larger ones).  Where a bucket starts in the permutation comes
from bucket counts, summed in two levels (within blocks of buckets, then over
the blocks), never over all buckets in one task, and reaches the tasks as a
broadcast of at most 2**20 rows.

Rows that agree in key and text have one hash.  Where they alone would fill a
bucket (counted; at most one such group per bucket), they are numbered, and
every run of them that fits into a share of a bucket gets a hash of its own.

Everything is a function of the data and the seed: a lost task is recomputed
with the same buckets and the same order.  Rows that agree in key and text are
interchangeable.  Null keys and texts are hashed as such and keep their rows;
empty and very long texts are rows like others (a text above a bucket's size is
a bucket by itself); an empty table gives an empty result.  Input columns may have
any name; those named like the result's (bucket, bucket_slot, position, shard,
slot) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import ordered_index
from .common import ship_package, stored, utf8_size

BUCKET_BYTES = 32 << 20
MAX_BUCKETS = 1 << 20      # bounds the table of bucket starts that every task gets
BLOCK = 1024
OUT_BYTES = 4 << 20
RESULT = ("bucket", "bucket_slot", "position", "shard", "slot")


def scatter_hash(key: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key, text)


def _fisher_yates(seed: int, bucket: int, n: int) -> np.ndarray:
    """A seeded uniform permutation of ``n`` rows (numpy's in-place
    Fisher-Yates shuffle)."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def _shuffle_buckets(seed: int, size_at: int, bucket_at: int):
    """Reads a partition sorted by bucket, emits every bucket permuted."""

    def emit(parts: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        n = table.num_rows
        order = _fisher_yates(seed, bucket, n)
        sizes = np.asarray(table.column(size_at).combine_chunks(), dtype=np.int64)[order]
        step = max(1, int(OUT_BYTES * n / max(int(sizes.sum()), 1)))
        for lo in range(0, n, step):
            pick = order[lo:lo + step]
            part = table.take(pa.array(pick)).combine_chunks()
            slots = pa.array(np.arange(lo, lo + len(pick), dtype=np.int64))
            cols = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in part.columns]
            yield pa.RecordBatch.from_arrays(cols + [slots],
                                             names=[*table.column_names, "bucket_slot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            ids = np.asarray(batch.column(bucket_at), dtype=np.int64)
            starts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)).tolist() if len(ids) else []
            for lo, hi in zip(starts, starts[1:] + [len(ids)]):
                bucket = int(ids[lo])
                if current is not None and bucket != current:
                    yield from emit(held, current)
                    held = []
                current = bucket
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from emit(held, current)

    return run


def external_shuffle(df: DataFrame, shards: int = 16, seed: int = 42, key_col: str = "doc_id",
                     text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``df`` with bucket, bucket_slot, position (in the whole
    permutation), shard and slot."""
    spark = df.sparkSession
    ship_package(spark)
    named = [c for c in df.columns if c not in RESULT]
    # the carried columns travel as one struct, so their names cannot clash
    rows = df.select(F.struct(*[F.col(c) for c in named]).alias("own"), (utf8_size(text_col) + 1).alias("_size"),
                     scatter_hash(F.col(key_col), F.col(text_col), seed).alias("_h"))

    slim = stored(rows.select("_h", "_size"), "shard-keys")
    n, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    alike = slim.groupBy("_h").agg(F.sum("_size").alias("_b"), F.count(F.lit(1)).alias("_c"))
    hot = stored(alike.where((F.col("_b") > bucket_bytes) & (F.col("_c") > 1)), "shard-hot")
    if not hot.isEmpty():
        rows = _spread_alike(rows, hot, seed, bucket_bytes)
        slim = rows.select("_h", "_size")
    buckets = min(MAX_BUCKETS, max(1, -(-int(total) // bucket_bytes)))
    bucket = F.pmod(F.col("_h"), F.lit(buckets))

    # where each bucket starts: counts, summed within blocks and over blocks
    counts = (slim.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_block", F.floor(F.col("bucket") / BLOCK)))
    within = Window.partitionBy("_block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_bn"))
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    block_start = blocks.select("_block", F.coalesce(F.sum("_bn").over(over), F.lit(0)).alias("_bs"))
    starts = (counts.join(block_start, "_block")
              .select("bucket", (F.col("_bs") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_start")))

    # pass 1: scatter; pass 2: shuffle each bucket
    scattered = (rows.withColumn("bucket", bucket).repartitionById(buckets, F.col("bucket").cast("int"))
                 .sortWithinPartitions("bucket", "_h", F.col(f"own.`{key_col}`")))
    schema = T.StructType([*scattered.schema.fields, T.StructField("bucket_slot", T.LongType(), False)])
    shuffled = scattered.mapInArrow(
        _shuffle_buckets(seed, scattered.columns.index("_size"), scattered.columns.index("bucket")), schema)

    placed = (shuffled.join(F.broadcast(starts), "bucket")
              .withColumn("position", F.col("_start") + F.col("bucket_slot")))
    big, small = n % shards, n // shards     # the first ``big`` shards hold one row more
    edge = big * (small + 1)
    p = F.col("position")
    shard = (F.when(p < edge, F.floor(p / (small + 1)))
             .otherwise(big + F.floor((p - edge) / max(small, 1))))
    first = (F.when(F.col("shard") <= big, F.col("shard") * (small + 1))
             .otherwise(edge + (F.col("shard") - big) * small))
    return (placed.withColumn("shard", shard.cast("int"))
            .withColumn("slot", (p - first).cast("long"))
            .select(*[F.col("own")[c].alias(c) for c in named], *RESULT))


def _spread_alike(rows: DataFrame, hot: DataFrame, seed: int, bucket_bytes: int) -> DataFrame:
    """Rows of ``hot`` hashes (at most one per bucket) numbered, and hashed again with
    their number in steps of an eighth of a bucket."""
    near = F.broadcast(hot.select("_h", F.greatest(F.floor(F.lit(bucket_bytes / 8) * F.col("_c") / F.col("_b")), F.lit(1))
                                  .alias("_step")))
    some = rows.join(near, "_h").withColumn("_row", F.monotonically_increasing_id())
    some = ordered_index(some, ["_h"], ["_row"], "_nth")
    again = F.xxhash64(F.lit(seed), F.col("_h"), F.floor(F.col("_nth") / F.col("_step")))
    rest = rows.join(F.broadcast(hot.select("_h")), "_h", "left_anti")
    return rest.select("own", "_size", "_h").unionByName(some.select("own", "_size", again.alias("_h")))


def write_shards(df: DataFrame, path: str) -> None:
    """Write the records as Parquet files under ``shard=<n>`` folders, each
    file in permutation order (a bucket may lie across two shards)."""
    df.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
