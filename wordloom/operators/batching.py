"""Batch assignment and per-batch accounting.

Batches hold at most ``size`` rows, so every window below is partitioned by a
batch (a bounded group); the only unbounded ordering -- the position of a row
inside its source -- comes from ``ordered_index`` (range-partitioned, no
single task per key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import BATCH_MAX_ITEMS
from .ordering import ordered_index, running_total


def assign_fixed_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                         size: int = BATCH_MAX_ITEMS) -> DataFrame:
    """``batch_no = floor(position / size)`` inside each key group; adds
    ``idx`` (position in the group), ``batch_no`` and ``idx_in_batch``."""
    indexed = ordered_index(df, keys, order, name="idx")
    return (indexed.withColumn("batch_no", F.floor(F.col("idx") / size).cast("long"))
                   .withColumn("idx_in_batch", (F.col("idx") % size).cast("int")))


def _batch_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, "batch_no")


def ragged_offsets(batched: DataFrame, keys: Sequence[str], len_col: str = "n_tokens") -> DataFrame:
    """start of each sentence in its batch's concatenated id buffer."""
    before = _batch_window(keys).orderBy("idx_in_batch").rowsBetween(Window.unboundedPreceding, -1)
    return batched.withColumn("offset", F.coalesce(F.sum(len_col).over(before), F.lit(0)).cast("long"))


def batch_tokens(batched: DataFrame, keys: Sequence[str], len_col: str = "n_tokens") -> DataFrame:
    """total tokens of each batch (a plain aggregate)."""
    return batched.groupBy(*keys, "batch_no").agg(F.sum(len_col).cast("long").alias("batch_tokens"))


def batch_reject(batched: DataFrame, keys: Sequence[str], over_col: str = "over_length") -> DataFrame:
    """With truncation off one over-length text fails its whole batch."""
    w = _batch_window(keys)
    bad = F.max(F.col(over_col).cast("int")).over(w) > 0
    return (batched.withColumn("batch_status", F.when(bad, "rejected").otherwise("ok"))
                   .withColumn("batch_reason", F.when(bad & ~F.col(over_col), "batch_member_over_length")
                               .when(bad, "over_length")))


def length_bucket(len_col: str = "n_tokens", width: int = 64):
    """cost bucket = tokens div width."""
    return F.floor(F.col(len_col) / width).cast("int")


def cost_groups(df: DataFrame, len_col: str, key_cols: Sequence[str], groups: int) -> DataFrame:
    """``cost_group`` 0..groups-1 of each row so that groups cost about the same.

    A batch costs the square of its lengths.  Rows sorted by (length, keys) have a
    running total of squared lengths; the group is the one of ``groups`` equal
    shares of the total in which the middle of a row's own share lies.  So rows of
    a group are of like length, and a group is off by one row's cost at most.
    Null lengths cost nothing.
    """
    n = F.coalesce(F.col(len_col).cast("long"), F.lit(0).cast("long"))
    rows, total = running_total(df, [len_col, *key_cols], n * n, "_before")
    middle = (2 * F.col("_before") + n * n) * groups
    share = F.floor(middle / F.lit(2 * max(total, 1)))
    return (rows.withColumn("cost_group", F.least(F.lit(groups - 1), share).cast("int")).drop("_before"))


def place_by_cost(df: DataFrame, groups: int, group_col: str = "cost_group", len_col: str = "n_tokens") -> DataFrame:
    """One partition per cost group, sorted by length."""
    return df.repartitionById(groups, F.col(group_col)).sortWithinPartitions(len_col)


def encoder_partitions(spark: SparkSession) -> int:
    """Partitions for the encoder: at least two tasks per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def balance_by_length(df: DataFrame, len_col: str = "n_tokens", key_cols: Sequence[str] = (),
                      num_partitions: int | None = None) -> DataFrame:
    """cost-balanced placement for the encoder.

    Attention cost grows with the square of the length, so partitions must not
    specialise in long sentences: rows are spread by a hash of all ``key_cols``
    (of the whole row when absent) over an explicit partition count -- never
    coalesced by AQE, at least two tasks per core -- so every partition holds
    a like mix of lengths.  Inside each partition rows are sorted by length,
    so the encoder's token-budgeted batches hold sentences of similar length
    and equal lengths share attention groups.
    """
    n = num_partitions or encoder_partitions(df.sparkSession)
    spread_by = F.xxhash64(*[F.col(c) for c in (key_cols or df.columns)])
    return (df.withColumn("_spread", spread_by)
              .repartition(n, "_spread")
              .sortWithinPartitions(len_col)
              .drop("_spread"))
