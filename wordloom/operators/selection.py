"""Exact ranks by radix selection: elements of given ranks without sorting.

A value's bits are made an integer of the same order.  Four counting passes of
16 bits each narrow a rank down: a pass counts the next digit of the values that
still fit (map-side combine, at most 65,536 counts per group and rank), the running
sum of the counts says in which digit the rank lies, and the next pass looks
inside that digit.  No sort and no range exchange of the samples, and a group
of any size is only ever counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

DIGIT_BITS = 16
_LEAST = -(1 << 63)


def ordered_bits(value: str | Column) -> Column:
    """A double as a long of the same order (nulls first, NaN last; -0.0 equals 0.0):
    exponent and mantissa of its magnitude, negated for negative values."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = F.abs(x)
    # log2 may be off by one next to a power of two; dividing by the power is exact
    guess = F.floor(F.log2(size)).cast("int")
    part = size / F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(part >= 2, 1).when(part < 1, -1).otherwise(0)
    mantissa = ((size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(float(1 << 52))).cast("long")
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + mantissa
    # below the least normal number the bits are a multiple of the least number
    tiny = (size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
    special = F.lit(0x7FF << 52).cast("long")
    bits = (F.when(F.isnan(x), special + 1).when(size == F.lit(float("inf")), special)
            .when(size < F.lit(2.0 ** -1022), tiny).otherwise(normal))
    return F.when(x.isNull(), F.lit(_LEAST).cast("long")).when(F.isnan(x), bits).when(x < 0, -bits).otherwise(bits)


def _alike(left: str, right: str, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def select_ranks(samples: DataFrame, keys: Sequence[str], value_col: str, ranks: Mapping[str, Column],
                 also: Sequence[Column] = ()) -> DataFrame:
    """Per group ``n``, the ``also`` aggregates and, for every name in ``ranks``, the
    element of that 0-based rank in ascending order (nulls first).  ``ranks`` are
    expressions of ``n``.  Null keys are a group.  ``samples`` are written once."""
    keys = list(keys)
    own = [f"_k{i}" for i in range(len(keys))]
    rows = stored(samples.withColumns({"_b": ordered_bits(value_col), **{o: F.col(k) for o, k in zip(own, keys)}}), "samples")
    groups = stored(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), *also), "groups")
    which = F.explode(F.array(*[F.struct(F.lit(name).alias("which"), r.cast("long").alias("r")) for name, r in ranks.items()]))
    wanted = groups.select(*own, which.alias("x")).select(*own, "x.which", "x.r", F.lit(None).cast("long").alias("high"))
    slim = rows.select(*own, "_b", F.col(value_col).alias("_v"))
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        high, first = F.shiftright("s._b", shift), shift == 64 - DIGIT_BITS
        inside = _alike("s", "w", own)
        if not first:
            inside = inside & (F.shiftright("s._b", shift + DIGIT_BITS) == F.col("w.high"))
        left = (slim if not first else slim.groupBy(*own, F.shiftright("_b", shift).alias("_top"))
                .agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_v")))
        if first:       # the first digits are counted once for all ranks of a group
            counts = left.alias("s").join(wanted.alias("w"), inside).select(
                *[F.col(f"w.{o}").alias(o) for o in own], "w.which", "w.r", F.col("s._top").alias("high"), "s._c", "s._v")
        else:
            counts = (left.alias("s").join(wanted.alias("w"), inside)
                      .groupBy(*[F.col(f"w.{o}").alias(o) for o in own], "w.which", "w.r", high.alias("high"))
                      .agg(F.count(F.lit(1)).alias("_c"), F.max("s._v").alias("_v")))
        before = (Window.partitionBy(*own, "which").orderBy("high").rowsBetween(Window.unboundedPreceding, -1))
        cum = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        wanted = (cum.where((F.col("_before") <= F.col("r")) & (F.col("r") < F.col("_before") + F.col("_c")))
                  .select(*own, "which", (F.col("r") - F.col("_before")).alias("r"), "high", "_v"))
    found = wanted.groupBy(*own).agg(*[F.max(F.when(F.col("which") == name, F.col("_v"))).alias(name) for name in ranks])
    others = [c for c in groups.columns if c not in own]
    return groups.alias("g").join(found.alias("f"), _alike("g", "f", own), "left").select(
        *[F.col(f"g.{o}").alias(k) for o, k in zip(own, keys)], *[F.col(f"g.{c}") for c in others],
        *[F.col(f"f.{name}") for name in ranks])
