"""Exact duplicates by composable polynomial fingerprints.

The bytes of a normalised text are the coefficients of a polynomial in 256,
evaluated modulo two random 61-bit primes.  Fingerprints compose: a text cut
into chunks has the sum of its chunks' fingerprints, each shifted by 256 to the
bytes that follow the chunk.  So chunks are hashed anywhere, in any order.

1. One scan normalises every text (runs of ASCII white space become one blank;
   null counts as empty) and hashes texts of up to one chunk where they are read.
2. Longer texts are cut into chunks, which are dealt over all tasks by
   (row, chunk), hashed there and summed per row: one huge text is many tasks' work.
3. Narrow rows are grouped by (fingerprint, length) with map-side combine: size
   and first row of each group.
4. Texts of equal fingerprint are compared chunk by chunk: a group's chunk at
   one place is a running least and greatest value; the members are equal exactly
   where both agree.  The fold runs before the shuffle too, so of a text held by
   a third of all rows two copies per task travel, never the group.  Texts
   whose fingerprint nobody shares stay out of it while the table of shared
   fingerprints is at most ``BROADCAST_GROUPS`` rows (counted first); beyond
   that all texts take part, with the same result.
5. Groups with a differing chunk (a collision) are grouped again by their texts.

Every step's input is a table in the shared folder, so a lost executor repeats tasks only.

Results for odd input: null and empty texts are one group (of all texts that
are empty; a text of white space only is a single blank, another group).  Of
equal texts the row with the smallest key stays, null keys after all others;
of rows that repeat key and text one stays.  Very long texts are read whole.  An
empty table gives an empty result.  Carried columns may have any name but
those of the result.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package, small_batches, stored, text_or_empty

CHUNK_BYTES = 64 << 10
BROADCAST_GROUPS = 1_000_000     # about 40 bytes each
PRIME_BITS = 61
RESULT = ("keep_id", "group_size", "kept", "text_sha256")
_WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)    # decide primality below 2**64


def _is_prime(n: int) -> bool:
    if n < 2 or any(n % p == 0 for p in _WITNESSES):
        return n in _WITNESSES
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for w in _WITNESSES:
        x = pow(w, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def moduli(seed: int = 42) -> tuple[int, int]:
    """Two different random primes of ``PRIME_BITS`` bits."""
    rng, found = random.Random(seed), []
    while len(found) < 2:
        n = rng.getrandbits(PRIME_BITS - 1) | 1 << (PRIME_BITS - 1) | 1
        if n not in found and _is_prime(n):
            found.append(n)
    return found[0], found[1]


def shifted(chunk: bytes, after: int, modulus: int) -> int:
    """What a chunk adds to the fingerprint of a text with ``after`` bytes behind it."""
    return int.from_bytes(chunk, "big") % modulus * pow(256, after, modulus) % modulus


def normalised(text_col: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " ")


def _hash_udf(primes: tuple[int, int]):
    p, q = primes

    def run(chunks: pa.Array, after: pa.Array) -> pa.Array:
        both = [None if c is None else shifted(c, n, p * q)
                for c, n in zip(chunks.to_pylist(), after.to_pylist())]
        return pa.StructArray.from_arrays(
            [pa.array([None if x is None else x % m for x in both], pa.int64()) for m in (p, q)], ["a", "b"])

    run.__annotations__ = {"chunks": pa.Array, "after": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "a long, b long")


def _chunks(size: int) -> Column:
    """(place, bytes) of each chunk of ``body``; an empty body has one."""
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_bytes") / size) - 1).cast("int"))
    return F.explode(F.transform(places, lambda i: F.struct(
        i.alias("place"), F.substring(F.col("body"), i * size + 1, F.lit(size)).alias("chunk"))))


def fingerprints(df: DataFrame, key_col: str, text_col: str, carry: Sequence[str], primes: tuple[int, int],
                 chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows, long): every row with ``row`` (a number of its own), ``key``,
    ``own`` (struct of the carried columns), ``body``, ``n_bytes``, ``sha`` and the
    fingerprint a, b; for texts above one chunk a and b stand in ``long``."""
    spark = df.sparkSession
    ship_package(spark)
    small_batches(spark)
    hashed = _hash_udf(primes)
    own = F.struct(*[F.col(c) for c in carry], F.lit(True).alias("_"))
    base = (df.select(F.col(key_col).alias("key"), own.alias("own"), normalised(text_col).cast("binary").alias("body"))
            .withColumn("n_bytes", F.octet_length("body").cast("long"))
            .withColumn("sha", F.unhex(F.sha2("body", 256)))
            .withColumn("row", F.monotonically_increasing_id()))
    one = F.when(F.col("n_bytes") <= chunk_bytes, F.col("body"))
    rows = stored(base.withColumn("fp", hashed(one, F.lit(0).cast("long")))
                  .select("row", "key", "own", "body", "n_bytes", "sha", F.col("fp.a").alias("a"),
                          F.col("fp.b").alias("b")), "exact-rows")

    cut = (rows.where(F.col("n_bytes") > chunk_bytes).select("row", "n_bytes", _chunks(chunk_bytes).alias("c"))
           .select("row", "n_bytes", "c.place", "c.chunk").repartition("row", "place"))
    after = F.greatest(F.col("n_bytes") - (F.col("place") + 1).cast("long") * chunk_bytes, F.lit(0).cast("long"))
    parts = cut.select("row", hashed("chunk", after).alias("fp"))
    total = [(F.sum(F.col(f"fp.{c}").cast("decimal(20,0)")) % F.lit(m).cast("decimal(20,0)")).cast("long").alias(c)
             for c, m in zip("ab", primes)]
    return rows, stored(parts.groupBy("row").agg(*total), "exact-long")


SAME = ("a", "b", "n_bytes")


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def _differing(rows: DataFrame, long: DataFrame, shared: DataFrame, chunk_bytes: int) -> DataFrame:
    """Shared fingerprints whose texts differ in some chunk."""
    n = shared.count()
    few = F.broadcast(shared.select(*SAME)) if n <= BROADCAST_GROUPS else None

    def members(df: DataFrame) -> DataFrame:
        return df if few is None else df.join(few, list(SAME), "left_semi")

    short = members(rows.where(F.col("a").isNotNull()).select(*SAME, "body"))
    whole = (rows.where(F.col("a").isNull()).select("row", "n_bytes", "body")
             .join(_small(long), "row").select(*SAME, "body"))
    pieces = (short.select(*SAME, F.lit(0).alias("place"), F.col("body").alias("chunk"))
              .unionByName(members(whole).select(*SAME, _chunks(chunk_bytes).alias("c"))
                           .select(*SAME, "c.place", "c.chunk")))
    return (pieces.groupBy(*SAME, "place").agg((F.min("chunk") != F.max("chunk")).alias("differs"))
            .where("differs").select(*SAME).distinct())


def _first(name: str = "first") -> Column:
    return F.min(F.struct(F.col("key").isNull().alias("nokey"), "key", "row")).alias(name)


def exact_duplicates(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
                     chunk_bytes: int = CHUNK_BYTES, primes: tuple[int, int] | None = None) -> DataFrame:
    """One row per row of ``df``: ``key_col``, the ``carry`` columns, keep_id
    (key of the row of the group that stays), group_size, kept, text_sha256 (of the
    normalised text)."""
    clash = [c for c in (*carry, key_col) if c in RESULT] + [c for c in carry if c == key_col]
    if clash:
        raise ValueError(f"columns named like those of the result: {clash}")
    rows, long = fingerprints(df, key_col, text_col, carry, primes or moduli(), chunk_bytes)
    joined = (rows.drop("body").alias("r")
              .join(_small(long).alias("l"), F.col("r.row") == F.col("l.row"), "left"))
    prints = stored(joined.select("r.row", "r.key", "r.own", "r.sha", "r.n_bytes", F.coalesce("r.a", "l.a").alias("a"),
                                  F.coalesce("r.b", "l.b").alias("b")), "exact-prints")
    shared = stored(prints.groupBy(*SAME).agg(F.count(F.lit(1)).alias("n"), _first()).where("n > 1"), "exact-groups")
    collided = stored(_differing(rows, long, shared, chunk_bytes), "exact-collided")
    if collided.isEmpty():
        found = prints.join(_small(shared), list(SAME), "left")
    else:
        sure = shared.join(collided, list(SAME), "left_anti")
        odd = prints.join(collided, list(SAME), "left_semi").select("row", "key")
        texts = stored(rows.select("row", "body").join(odd, "row"), "exact-odd")
        classes = stored(texts.groupBy("body").agg(F.count(F.lit(1)).alias("n2"), _first("first2")), "exact-classes")
        answers = stored(texts.select("row", "body").join(classes, "body").select("row", "n2", "first2"),
                         "exact-answers")
        found = (prints.join(stored(sure, "exact-sure"), list(SAME), "left").join(answers, "row", "left")
                 .withColumn("n", F.coalesce("n2", "n")).withColumn("first", F.coalesce("first2", "first")))
    return found.select(F.col("key").alias(key_col), *[F.col(f"own.{c}").alias(c) for c in carry],
                        F.when(F.col("first").isNull(), F.col("key")).otherwise(F.col("first.key")).alias("keep_id"),
                        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"))
