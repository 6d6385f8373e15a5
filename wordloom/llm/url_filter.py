"""URL filter by a Bloom filter cascade.

The keys of the corpus form a universe U, the listed keys a part L of it.
Level 1 is a Bloom filter of L; level 2 holds the keys of U outside L that
level 1 lets through (its false positives), level 3 the keys of L that level 2
lets through, and so on until a level has no false positives.  A key of U is
listed exactly when the first level that does not hold it is an even one (or
the last level that exists is odd).  Over the complete universe the answer is
exact, and looking a key up needs no join: rows are judged while scanning.

Building takes grouped passes over the distinct keys: each level's bits are
set by a grouped bitwise OR, and the survivors of a level are written as a
table in the shared folder.  The size of a level follows from the number of its
keys; together the levels take a few bits per listed key, not per key of the
universe.  Filters go to the tasks in slices of at most ``SLICE_BITS`` bits
each: a larger list is split by key hash into several cascades, and one slice at a
time is built, sent to the tasks, used to judge the rows whose key falls into it
(their verdicts are written) and dropped.

``judge`` applies host/path rules first.  A rule ``host/path`` fits its host and
all subdomains if the path starts with the rule's; the longest fitting rule
wins (rules are keys, so the cascade finds them too).  Other URLs are blocked
when their host and path is listed, and allowed otherwise.

Null URLs and URLs without ``://`` have empty host and path, fit no rule and are
never listed.  Repeated URLs and null ids keep their rows; very long URLs are keys
like others; empty tables on either side are fine.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, hand_on, scratch_scope, ship_package, stored

SLICE_BITS = 1 << 27          # 16 MB of filter per slice and level at most
MIN_BITS = 64
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    """``host/path`` with its verdict (allow or block)."""

    rule: str
    verdict: str

    @property
    def path(self) -> str:
        return self.rule[self.rule.index("/"):]


# --- URL parts ------------------------------------------------------------------

def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    h = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(h, ASCII_UPPER, ASCII_LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


# --- cascade ----------------------------------------------------------------------

@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray                     # uint64

    def holds(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        out = np.ones(len(h1), dtype=bool)
        for i in range(self.hashes):
            p = positions(h1, h2, level, i) % np.uint64(self.bits)
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)) == 1
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: every bit of the result depends on all of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(h1: np.ndarray, h2: np.ndarray, level: int, i: int) -> np.ndarray:
    """The i-th place of a key under a level (double hashing, salted per level)."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return _mix(h1 ^ salt) + np.uint64(i) * (_mix(h2 + salt) | np.uint64(1))


@dataclass
class Cascade:
    """Levels per slice; a key's slice follows from its first hash."""

    slices: list[list[Level]] = field(default_factory=list)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact membership of keys of the universe."""
        a, b = h1.view(np.uint64), h2.view(np.uint64)
        out = np.zeros(len(a), dtype=bool)
        part = (a >> np.uint64(32)) % np.uint64(max(len(self.slices), 1))
        for s, levels in enumerate(self.slices):
            open_ = np.flatnonzero(part == s)
            for n, level in enumerate(levels):
                inside = level.holds(a[open_], b[open_], n)
                out[open_[~inside]] = n % 2 == 1       # left out by an even level: not listed
                open_ = open_[inside]
            out[open_] = len(levels) % 2 == 1
        return out


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


def _level(keys: DataFrame, n: int, fpp: float, level: int) -> Level:
    """A Bloom filter of ``keys`` (h1, h2): bits are set by a grouped OR of
    64-bit words; only the words come to the driver (bounded per slice)."""
    bits = max(MIN_BITS, math.ceil(n * -math.log(fpp) / math.log(2) ** 2))
    hashes = max(1, round(bits / max(n, 1) * math.log(2)))
    bits = -(-bits // 64) * 64

    def places(h1, h2):
        import pandas as pd

        a, b = h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)
        p = np.stack([positions(a, b, level, i) % np.uint64(bits) for i in range(hashes)], axis=1)
        return pd.Series(list(p.astype(np.int64)))

    place = F.pandas_udf(places, "array<bigint>")
    words = (keys.select(F.explode(place("h1", "h2")).alias("p"))
             .groupBy(F.expr("p div 64").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toPandas())
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return Level(bits, hashes, out)


def build_cascade(universe: DataFrame, listed: str = "listed", slice_bits: int = SLICE_BITS) -> Cascade:
    """Cascade over distinct keys (h1, h2, ``listed`` boolean), all slices of it."""
    with scratch_scope(universe.sparkSession):
        return Cascade([levels for _s, _n, levels in cascade_slices(universe, listed, slice_bits)])


def cascade_slices(universe: DataFrame, listed: str, slice_bits: int) -> Iterator[tuple[int, int, list[Level]]]:
    """(slice, number of slices, its levels), built one after another; a key's slice
    follows from its first hash."""
    spark = universe.sparkSession
    ship_package(spark)
    keys = stored(universe.select("h1", "h2", F.col(listed).alias("listed")), "url-keys")
    n_in, n_out = keys.agg(F.count(F.when(F.col("listed"), 1)), F.count(F.when(~F.col("listed"), 1))).first()
    if not n_in:
        yield 0, 1, []
        return
    fpp = min(0.5, max(n_in / max(n_out, 1) / math.sqrt(2), 1e-6))
    n_slices = max(1, math.ceil(n_in * -math.log(fpp) / math.log(2) ** 2 / slice_bits))
    for s in range(n_slices):
        inside = keys.where(slice_of(F.col("h1"), n_slices) == s) if n_slices > 1 else keys
        hold, rest = inside.where("listed"), inside.where("not listed")
        n = hold.count()
        levels: list[Level] = []
        p = fpp
        while n:
            if len(levels) == MAX_LEVELS:
                raise RuntimeError("keys that agree in both hashes cannot be told apart")
            level = _level(hold, n, p, len(levels))
            shared = spark.sparkContext.broadcast(level)
            number = len(levels)

            def test(h1, h2, shared=shared, number=number):
                import pandas as pd

                return pd.Series(shared.value.holds(h1.to_numpy().view(np.uint64),
                                                    h2.to_numpy().view(np.uint64), number))

            levels.append(level)
            false = stored(rest.where(F.pandas_udf(test, "boolean")("h1", "h2")), "url-level")
            hold, rest = false, hold
            n, p = hold.count(), 0.5
        yield s, n_slices, levels


def slice_of(h1: Column, n: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h1, 32), F.lit(n))


def member(cascade: Cascade, key: Column, spark) -> Column:
    """Whether a key of the universe is listed."""
    shared = spark.sparkContext.broadcast(cascade)

    def test(h1, h2):
        import pandas as pd

        return pd.Series(shared.value.contains(h1.to_numpy(), h2.to_numpy()))

    return F.pandas_udf(test, "boolean")(*key_hashes(key))


# --- rules and verdicts ---------------------------------------------------------

def candidates(host_col: Column, path_col: Column, lengths: Sequence[int]) -> Column:
    """All keys that a rule for this URL could have: every suffix of the host's
    labels with every path prefix of the given lengths."""
    labels = F.split(host_col, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length(path_col) >= n, F.substring(path_col, 1, n)) for n in lengths])
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(
        F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(s, p))))
    return F.when(host_col != "", F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def _universe(keys: DataFrame, listed: Column) -> DataFrame:
    """Distinct keys with hashes; pre-aggregated, so a host with a third of all
    rows sends each of its keys once per task."""
    h1, h2 = key_hashes(F.col("key"))
    return (keys.groupBy("key").agg(F.max(listed).alias("listed"))
            .select(h1.alias("h1"), h2.alias("h2"), "listed"))


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, id_col: str = "page_id",
          url_col: str = "url", slice_bits: int = SLICE_BITS) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.  ``listed``
    has one column ``key`` of host + path to block where no rule fits."""
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path"))
    lengths = sorted({len(r.path) for r in rules})
    verdict = {r.rule: r.verdict for r in rules}

    own = rows.where("host != ''").select(F.concat("host", "path").alias("key"))
    asked = own.groupBy("key").agg(F.lit(False).alias("listed"))
    on_list = listed.select("key").where("key is not null").groupBy("key").agg(F.lit(True).alias("listed"))
    url_keys = asked.unionByName(on_list)
    hosts = rows.where("host != ''").groupBy("host", "path").agg(F.lit(1).alias("_one"))
    could = hosts.select(F.explode(candidates(F.col("host"), F.col("path"), lengths)).alias("key"))
    rule_cascade = build_cascade(_universe(could, F.col("key").isin(sorted(verdict))))

    tried = rows.withColumn("_keys", candidates(F.col("host"), F.col("path"), lengths))
    shared = spark.sparkContext.broadcast(rule_cascade)

    def fitting(h1s, h2s):
        import pandas as pd

        sizes = [len(x) for x in h1s]
        if not sum(sizes):
            return pd.Series([[] for _ in sizes])
        hit = shared.value.contains(np.concatenate([np.asarray(x, np.int64) for x in h1s]),
                                    np.concatenate([np.asarray(x, np.int64) for x in h2s]))
        ends = np.cumsum(sizes)
        return pd.Series([hit[e - n:e].tolist() for n, e in zip(sizes, ends)])

    flags = F.pandas_udf(fitting, "array<boolean>")(
        F.transform("_keys", lambda k: F.xxhash64(k)),
        F.transform("_keys", lambda k: F.xxhash64(k, F.lit("second"))))
    found = F.filter(F.arrays_zip(F.col("_keys").alias("k"), F.col("_flags").alias("f")), lambda x: x["f"])
    longest = F.array_max(F.transform(found, lambda x: F.struct(F.length(x["k"]).alias("n"), x["k"].alias("k"))))
    by_rule = F.create_map(*[F.lit(x) for r in sorted(verdict) for x in (r, verdict[r])])
    own_key = F.concat("host", "path")

    def judged(some: DataFrame, levels: list[Level]) -> DataFrame:
        on_list = member(Cascade([levels]), own_key, spark) & (F.col("host") != "")
        return (some.withColumn("_flags", flags).withColumn("_listed", on_list).withColumn("rule", longest["k"])
                .select(id_col, "host", "path", "rule", F.coalesce(by_rule[F.col("rule")], F.when(
                    F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")))

    out = None
    with scratch_scope(spark) as scratch:
        for s, n, levels in cascade_slices(_universe(url_keys, F.col("listed")), "listed", slice_bits):
            if n == 1:
                return judged(tried, levels)
            here = slice_of(key_hashes(own_key)[0], n) == s
            part = stored(judged(tried.where(here), levels), "url-judged")
            hand_on(scratch)                      # part of the result
            out = part if out is None else out.unionByName(part)
    return out
