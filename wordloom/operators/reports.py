"""Accounting and latency reports.

Percentiles follow the reference's rank rule, not SQL's percentile functions:
on the ascending list of n samples, p50 is element ``n div 2`` and p99 is
element ``min(int(n * 0.99), n - 1)`` (0-based).  They come from counting passes over
the digits of the values (``selection``): no sort, and a large group is never
gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import select_ranks


def micros_since_epoch(ts_col: str) -> Column:
    """Microseconds of a TIMESTAMP_NTZ (independent of the session time zone)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts_col})")


def rank_summary(samples: DataFrame, keys: Sequence[str], value_col: str, also: Sequence[Column] = ()) -> DataFrame:
    """Per group n, mean, p50, p99 (rank rule above) and the ``also``
    aggregates (over columns of ``samples``).  Null keys are a group."""
    n = F.col("n")
    return select_ranks(samples, keys, value_col, {
        "p50": F.floor(n / 2), "p99": F.least(F.floor(n.cast("double") * F.lit(0.99)), n - 1)},
        also=[F.avg(value_col).alias("mean"), *also])


def usage_totals(per_text: DataFrame, request_key: Sequence[str], tokens_col: str = "n_tokens") -> DataFrame:
    """Per request total tokens; prompt_tokens equals total_tokens."""
    return per_text.groupBy(*request_key).agg(
        F.sum(tokens_col).cast("long").alias("total_tokens")
    ).withColumn("prompt_tokens", F.col("total_tokens"))


def throughput_by_level(samples: DataFrame, level_col: str, start_col: str, end_col: str,
                        value_col: str) -> DataFrame:
    """E5: n / wall seconds (max end - min start) per concurrency level, with
    p50/p99 of the latency samples."""
    wall = ((F.max(end_col) - F.min(start_col)) / F.lit(1e6)).alias("wall_s")
    return (rank_summary(samples, [level_col], value_col, also=[wall])
            .withColumn("throughput", F.col("n") / F.col("wall_s")))


def batch_throughput(samples: DataFrame, batch_col: str, value_ms_col: str) -> DataFrame:
    """``b * rounds / total_s`` and ms per batch = ``total_s / rounds * 1000``."""
    return samples.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("rounds"),
        (F.sum(value_ms_col) / F.lit(1000.0)).alias("total_s")
    ).withColumn("sentences_per_s", F.col(batch_col) * F.col("rounds") / F.col("total_s")) \
     .withColumn("ms_per_batch", F.col("total_s") / F.col("rounds") * F.lit(1000.0))
