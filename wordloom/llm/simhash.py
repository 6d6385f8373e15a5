"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 bits, bit set when it is set in over half of the XXH64 values
of the text's word shingles (repeats count).  Documents with at most
``max_bits`` differing bits are linked; a component is a set of linked
documents, named after its smallest key.

Search.  Copies share a fingerprint, so only distinct fingerprints are indexed.

* Upper nodes: two fingerprints that differ in at most k bits agree on one of
  k+1 blocks of bits.  Every fingerprint is filed under k+1 masked patterns;
  a pattern is stored once, as the node that all its fingerprints share.  Nodes
  are what Spark partitions by.  A node with too many fingerprints is split by
  masking further blocks of its free bits (the same argument holds inside it),
  so a hot pattern spreads over tasks and no link is lost.
* Lower nodes: inside a node, fingerprints are sorted by Gray rank, so
  neighbours share most bits.  Runs of them form groups, groups form larger
  groups; each keeps the mask of bits all members share and their pattern.
  The differences of two patterns on their common mask, summed down the
  hierarchy, bound the distance of all their members from below: pairs of
  groups beyond ``max_bits`` are pruned whole.  Groups already known to be in
  one component are skipped.

A node emits a spanning forest of its links, never all pairs, and components
are closed over the forests (see ``graph``).  Nothing is collected.

Null and empty texts have fingerprint zero, linked like any other.  Null keys
are kept and get the smallest key of their component (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_sizes, map_arrow, row_chunks, hand_on, scratch_scope, ship_package, stored
from .graph import components

SEED = 42
BITS = 64
CHUNK_BYTES = 1 << 20
SUM_ROWS = 1 << 16
NODE_LIMIT = 20_000       # fingerprints of a node before its free bits are masked further
MAX_SPLITS = 3
SMALL_NODE = 24
FANOUT = 32
PAIR_CHUNK = 2048


# --- fingerprints ---------------------------------------------------------

def fingerprint(text: bytes, shingle: int, hash64) -> int:
    """Unsigned fingerprint of one text (UTF-8)."""
    words = text.lower().split()          # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [hash64(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        end = (start + size)[shingle - 1:].tolist()
        hashes = [hash64(line[s:e], SEED) for s, e in zip(start.tolist(), end)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(h), SUM_ROWS):
        part = h[lo:lo + SUM_ROWS]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                 shingle: int = 3, out_col: str = "fp") -> DataFrame:
    """``keep`` columns (default all) and the fingerprint as a signed long."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out_col]

    def make():
        import xxhash

        def run(batch: pa.RecordBatch):
            col = batch.column(batch.num_columns - 1)
            for lo, hi in row_chunks(byte_sizes(col), CHUNK_BYTES):
                texts = [t or b"" for t in col.slice(lo, hi - lo).to_pylist()]
                fps = np.array([fingerprint(t, shingle, xxhash.xxh64_intdigest) for t in texts],
                               dtype=np.uint64)
                yield lo, hi, [pa.array(fps.view(np.int64))]
        return run

    src = "_simhash_bytes"
    return map_arrow(df.withColumn(src, F.col(text_col).cast("string").cast("binary")), keep,
                     [T.StructField(out_col, T.LongType(), False)], make, [src])


# --- upper nodes ----------------------------------------------------------

def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_masks(mask: int, parts: int) -> list[int]:
    """``mask`` extended by each of ``parts`` nearly equal blocks of its free bits."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _gray_rank(fp: Column) -> Column:
    """Place of the fingerprint in the Gray sequence (prefix exclusive-or)."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def _file_under(fps: DataFrame, masks: list[int]) -> DataFrame:
    return (fps.withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])))
            .withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))))


def upper_nodes(fps: DataFrame, max_bits: int, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(fp, mask, pattern): every distinct fingerprint under the masked
    patterns it shares, hot nodes split by further masks."""
    masks = block_masks(0, max_bits + 1)
    level = _file_under(fps.select("fp"), masks)
    done = None
    for _ in range(MAX_SPLITS):
        level = stored(level, "simhash-nodes")
        hot = level.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("_n")).where(
            F.col("_n") > node_limit).select("mask", "pattern")
        hot = stored(hot, "simhash-hot")
        hot_masks = [r[0] for r in hot.select("mask").distinct().collect()]   # at most (k+1)**depth masks
        cool = level.join(hot, ["mask", "pattern"], "left_anti")
        done = cool if done is None else done.unionByName(cool)
        if not hot_masks:
            return done
        deeper = None
        for m in hot_masks:
            inside = level.where(F.col("mask") == m).join(hot, ["mask", "pattern"], "left_semi").select("fp")
            part = _file_under(inside, block_masks(m % (1 << 64), max_bits + 1))
            deeper = part if deeper is None else deeper.unionByName(part)
        level = deeper
    return done.unionByName(level)


# --- lower nodes ----------------------------------------------------------

class Forest:
    """Union-find over array positions with vectorised minimum labels."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def _hierarchy(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared mask, shared pattern) of the groups of each level, from single
    fingerprints (all bits shared) up to at most FANOUT groups."""
    full = np.full(len(fps), np.uint64(0xFFFFFFFFFFFFFFFF))
    levels = [(full, fps)]
    while len(levels[-1][0]) > FANOUT:
        mask, pattern = levels[-1]
        at = np.arange(0, len(mask), FANOUT)
        both = np.bitwise_and.reduceat(mask, at)
        ones = np.bitwise_and.reduceat(pattern, at)          # set in all members
        any_ = np.bitwise_or.reduceat(pattern, at)           # set in any member
        shared = both & ~(ones ^ any_)
        levels.append((shared, ones & shared))
    return levels


def _link_large(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Roots of the fingerprints (in Gray order) of one large node."""
    n = len(fps)
    forest = Forest(n)
    # a few hubs first: near copies of one text mostly touch the same fingerprint
    for _ in range(8):
        own = np.flatnonzero(forest.root == np.arange(n))
        if len(own) < 2:
            break
        hub = own[len(own) // 2]
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[hub]) <= max_bits)
        forest.add(near, np.full(len(near), hub))
    levels = _hierarchy(fps)

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs (a, b), a <= b, of groups of ``level`` that may hold links."""
        if level == 0:
            forest.add(a, b)
            return
        width = FANOUT ** level
        for lo in range(0, len(a), PAIR_CHUNK):
            pa_, pb = a[lo:lo + PAIR_CHUNK], b[lo:lo + PAIR_CHUNK]
            if level == 1:
                first = np.minimum(np.arange(0, n, width), n - 1)
                low = np.minimum.reduceat(forest.root, first)
                high = np.maximum.reduceat(forest.root, first)
                whole = (low[pa_] == high[pa_]) & (low[pb] == high[pb]) & (low[pa_] == low[pb])
                pa_, pb = pa_[~whole], pb[~whole]
            mask, pattern = levels[level - 1]
            m = len(mask)
            kids = np.arange(FANOUT)
            ca = np.repeat(pa_[:, None] * FANOUT + kids, FANOUT, axis=1).reshape(-1)
            cb = np.tile(pb[:, None] * FANOUT + kids, (1, FANOUT)).reshape(-1)
            # below the same group only ordered pairs; equal groups stay above level 1
            ok = (ca < m) & (cb < m) & ((ca < cb) if level == 1 else (ca <= cb))
            ca, cb = ca[ok], cb[ok]
            apart = np.bitwise_count((pattern[ca] ^ pattern[cb]) & mask[ca] & mask[cb])
            ok = apart <= max_bits
            descend(level - 1, ca[ok], cb[ok])

    top = len(levels) - 1
    if top == 0:
        a, b = np.triu_indices(n, 1)
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        forest.add(a[ok], b[ok])
    else:
        g = len(levels[top][0])
        a, b = np.triu_indices(g)
        mask, pattern = levels[top]
        ok = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= max_bits
        descend(top, a[ok], b[ok])
    return forest.root


def link_sorted(node: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (fingerprint, root) of a run of whole nodes; ``node`` is
    non-decreasing and ``fps`` are in Gray order inside a node."""
    n = len(fps)
    starts = np.flatnonzero(np.diff(node, prepend=node[:1] - 1))
    sizes = np.diff(np.append(starts, n))
    size = np.repeat(sizes, sizes)
    forest = Forest(n)
    small = size <= SMALL_NODE
    for lag in range(1, int(size[small].max(initial=1))):
        i = np.flatnonzero(small[:-lag] & (node[:-lag] == node[lag:])) if lag < n else np.empty(0, int)
        if not len(i):
            break
        near = np.bitwise_count(fps[i] ^ fps[i + lag]) <= max_bits
        forest.add(i[near], i[near] + lag)
    for s, k in zip(starts[sizes > SMALL_NODE], sizes[sizes > SMALL_NODE]):
        forest.root[s:s + k] = _link_large(fps[s:s + k], max_bits) + s
    linked = np.flatnonzero(forest.root != np.arange(n))
    return fps[linked], fps[forest.root[linked]]


def _link_partition(max_bits: int, flush: int = 1 << 18):
    def out(node: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
        u, v = link_sorted(np.concatenate(node), np.concatenate(fps), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))],
                                          names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node_no, last = 0, None
        nodes: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, mask, pattern = (np.asarray(batch.column(i), dtype=np.int64) for i in range(3))
            new = np.ones(len(fp), dtype=bool)
            new[1:] = (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])
            new[0] = last is not None and last != (mask[0], pattern[0])
            node = node_no + np.cumsum(new)
            node_no, last = int(node[-1]), (mask[-1], pattern[-1])
            nodes.append(node)
            fps.append(fp.view(np.uint64))
            if sum(map(len, nodes)) >= flush:      # whole nodes only; the open one waits
                at, fp_all = np.concatenate(nodes), np.concatenate(fps)
                whole = int(np.searchsorted(at, node_no))
                if whole:
                    yield out([at[:whole]], [fp_all[:whole]])
                    nodes, fps = [at[whole:]], [fp_all[whole:]]
        if fps:
            yield out(nodes, fps)

    return run


def fingerprint_components(fps: DataFrame, max_bits: int = 3, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(fp, root) for every distinct fingerprint that is linked to a smaller
    one; ``root`` names its component."""
    ship_package(fps.sparkSession)
    nodes = upper_nodes(fps.select("fp").distinct(), max_bits, node_limit)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (nodes.repartition(n, "mask", "pattern")
              .sortWithinPartitions("mask", "pattern", _gray_rank(F.col("fp")))
              .select("fp", "mask", "pattern"))
    edges = placed.mapInArrow(_link_partition(max_bits), "u long, v long")
    return components(edges).select(F.col("u").alias("fp"), "root")


def near_duplicates(df: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 3, node_limit: int = NODE_LIMIT,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry columns, fp, root, component_id) for every row of ``df``:
    ``root`` is a fingerprint that names the component."""
    with scratch_scope(df.sparkSession) as scratch:
        prints = stored(fingerprints(df, text_col, [key_col, *carry], shingle, "fp"), "simhash-prints")
        classes = prints.groupBy("fp").agg(F.min(key_col).alias("_least"))
        roots = fingerprint_components(classes, max_bits, node_limit)
        named = stored(classes.join(roots, "fp", "left")
                       .select("fp", "_least", F.coalesce("root", "fp").alias("root")), "simhash-classes")
        # written, so that a component with many fingerprints can be split in the join on its root
        least = stored(named.groupBy("root").agg(F.min("_least").alias("component_id")), "simhash-least")
        by_fp = named.select("fp", "root").join(least, "root")
        out = stored(prints.join(by_fp, "fp").select(key_col, *carry, "fp", "root", "component_id"), "simhash")
        hand_on(scratch)
    return out


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
