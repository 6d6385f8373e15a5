"""Connected components of an edge table by alternating large-star and
small-star steps, as DataFrame joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_on, scratch_scope, stored

MAX_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands its larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours move to the least of them (u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (edges.join(least, "u").where(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex but the least of its component.  ``edges``
    has long columns u, v; loops and repeated or reversed edges are fine.

    Groups are only ever reduced to their minimum, so no neighbourhood is
    gathered in a task; each round is written to the shared folder."""
    with scratch_scope(edges.sparkSession) as scratch:
        now = (edges.where("u != v")
               .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = stored(now, "cc-edges")
        state = None
        for _ in range(MAX_ROUNDS):
            row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if row[0] == 0 or tuple(row) == state:
                hand_on(scratch)
                return now.select("u", F.col("v").alias("root"))
            state = tuple(row)
            now = stored(_small_star(_large_star(now)), "cc-edges")
    raise RuntimeError("components did not settle")
