"""Joins whose left keys are unevenly frequent.

A key that many rows share is joined where the rows are, by a broadcast of its
(one) right row; only the rest is shuffled.  A key is heavy when it holds more
than ``SUPPORT`` of all rows, so there are at most 1 / SUPPORT heavy keys
whatever the data, and no key of the shuffled rest can fill a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORT = 1e-4


def heavy_keys(counts: DataFrame, key: str, n_col: str = "n", support: float = SUPPORT) -> DataFrame:
    """Keys with more than ``support`` of all rows, out of their counts: at most
    1 / support of them, as the counts of all add up to one."""
    total = counts.agg(F.coalesce(F.sum(n_col), F.lit(0))).first()[0]
    return counts.where(F.col(key).isNotNull() & (F.col(n_col) > support * float(total)))


def split_join(left: DataFrame, right: DataFrame, key: str, heavy: Column) -> DataFrame:
    """``left`` left-joined with ``right`` (one row per key).  ``heavy`` says which
    right rows are broadcast; the caller bounds their number and size."""
    near = right.where(heavy)
    some = left.join(F.broadcast(near), key)
    rest = (left.join(F.broadcast(near.select(key)), key, "left_anti")
            .join(right.where(~heavy), key, "left"))
    return some.unionByName(rest)


def heavy_join(left: DataFrame, right: DataFrame, key: str, support: float = SUPPORT) -> DataFrame:
    """``left`` left-joined with ``right``, which has one row of bounded size per
    key: heavy keys of ``left`` (counted with map-side combine) by broadcast, the
    rest by a join that Spark chooses.  ``left`` is read three times."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = heavy_keys(counts, key, "_n", support).select(key, F.lit(True).alias("_hot"))
    marked = right.join(F.broadcast(hot), key, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    return split_join(left, marked, key, F.col("_hot")).drop("_hot")
