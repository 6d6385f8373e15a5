"""Exact per-key row numbers without putting a whole key into one task.

``row_number() over (partition by key order by ...)`` sends every row of a key
to one task; one key may hold a third of the data.  ``ordered_index`` instead
range-partitions on ``(key, order)``, so a hot key is spread over many tasks,
and numbers rows with built-in expressions only:

* the sorted partitions are written once; ``monotonically_increasing_id`` gives
  each row its partition and its place in it,
* one aggregate gives, per (partition, key), the first place and the row count,
* a window over that small table (per key at most one row per partition) gives
  the rows of the key in earlier partitions,
* position = place - first place + rows in earlier partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_AT, _PID = "_wl_at", "_wl_pid"
_PLACE_BITS = 33           # monotonically_increasing_id: partition above, place below


def _sorted_parts(df: DataFrame, sort_cols: Sequence[str], num_partitions: int | None) -> DataFrame:
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)
    at = F.monotonically_increasing_id()
    return stored(staged.withColumn(_AT, at), "ordered")


def _same_keys(keys: Sequence[str], left: str, right: str) -> Column:
    cond = F.col(f"{left}.{_PID}") == F.col(f"{right}.{_PID}")
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx",
                  num_partitions: int | None = None, count: str | None = None) -> DataFrame:
    """Append ``name`` = 0-based position of each row inside its ``keys`` group
    in ``order`` (ascending, nulls first; ``order`` must make rows unique within
    a key, else equal rows are numbered in any order), and, if named, ``count``
    = rows of the group.

    Equal to ``row_number() over (partition by keys order by order) - 1``; null
    keys are a group.
    """
    keys, order = list(keys), list(order)
    parts = _sorted_parts(df, keys + order, num_partitions)
    pid = F.shiftright(F.col(_AT), _PLACE_BITS)
    place = F.col(_AT).bitwiseAND((1 << _PLACE_BITS) - 1)
    runs = parts.groupBy(pid.alias(_PID), *keys).agg(F.min(place).alias("_wl_first"),
                                                     F.count(F.lit(1)).alias("_wl_rows"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_wl_rows").over(before), F.lit(0)) - F.col("_wl_first")
    runs = runs.withColumn("_wl_shift", shift)
    extra = []
    if count is not None:
        runs = runs.withColumn("_wl_count", F.sum("_wl_rows").over(group))
        extra = [F.col("r._wl_count").alias(count)]
    rows = parts.withColumn(_PID, pid).withColumn("_wl_place", place)
    joined = rows.alias("l").join(runs.alias("r"), _same_keys(keys, "l", "r"))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns],
                         (F.col("l._wl_place") + F.col("r._wl_shift")).alias(name), *extra)


def running_total(df: DataFrame, order: Sequence[str], weight: Column, name: str = "before",
                  num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """(``df`` with ``name`` = sum of ``weight`` over the rows before each row in
    ``order``, total of all weights).  Rows are sorted in range partitions; each is
    summed by itself, and the partitions' totals are few."""
    parts = _sorted_parts(df.withColumn("_wl_w", weight.cast("long")), list(order), num_partitions)
    parts = parts.withColumn(_PID, F.shiftright(F.col(_AT), _PLACE_BITS))
    sums = parts.groupBy(_PID).agg(F.sum("_wl_w").alias("_wl_sum"))
    upto = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    starts = sums.select(_PID, F.coalesce(F.sum("_wl_sum").over(upto), F.lit(0)).alias("_wl_start"))
    inside = Window.partitionBy(_PID).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("_wl_inside", F.coalesce(F.sum("_wl_w").over(inside), F.lit(0)))
    total = sums.agg(F.coalesce(F.sum("_wl_sum"), F.lit(0))).first()[0]
    return rows.join(starts, _PID).select(*df.columns, (F.col("_wl_start") + F.col("_wl_inside")).alias(name)), int(total)
