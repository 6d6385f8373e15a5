"""Prefix trie of conversations by van Emde Boas recursion.

A node is a distinct sequence of first turns; its name is its depth and the
smallest conversation that starts with it.  The trie of height H (a power of
two) is cut at half its depth: the prefixes up to the cut are named, then the
upper trie and all lower forests are built in the same way, one round of the
recursion for all of them at once:

1. Turns are named by the SHA-256 of role and text; aligned segments of
   s = 1, 2, 4, .. turns by that of their two halves (texts stay in the scan).
2. Round s = H/2, H/4, .., 1: every depth that is an odd multiple of s is a cut.
   The prefix that ends there is its part up to the cut above (named already)
   and one segment of s turns; equal pairs get the smallest conversation as name.
3. Totals are grafted upward in the opposite order, s = 1, 2, .., H/2: each cut
   node hands what its lower trie of height s holds to its s ancestors in the
   upper trie.  A conversation lends its path to a node for which it stands, so
   a round moves at most as many rows as there are turns.

log2(H) rounds in all, each a fixed number of joins and grouped sums on narrow
rows keyed by (conversation, depth) or by node; every one is written to the
shared folder.  No conversation, node or chain is gathered in a task: a
conversation with a third of all rows is many rows with keys of their own, and
a node with a third of all conversations is a grouped minimum and sum with
map-side combine (its join back is one that Spark can split).  The digest of the
conversations that end at a node is over ids in order: ids are sorted in ranges,
joined to pieces of at most 64 KB there, and the pieces of a node streamed
through one hash.

Results for odd input: rows without a conversation id belong to no conversation
and take no part.  A null role or text is empty; a null turn number comes first;
turns of equal number are ordered by their SHA-256 (rows that repeat all of it are
turns of their own).  A conversation without turns is a member of the root.  An
empty table has no conversation and no node.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ordered_index
from .common import ship_package, stored, text_or_empty

HEAD_MOD = 9        # turns taken over from another conversation: crc32 mod 9
FAMILY = 5          # conversations c - c mod 5 .. share their first turns
PIECE_BYTES = 64 << 10
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def named_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """(c, pos, t, bytes): each turn's place in its conversation, name and size of its text."""
    role, text = text_or_empty(role_col).cast("binary"), text_or_empty(text_col).cast("binary")
    size = F.concat(F.octet_length(role).cast("string"), F.lit(":")).cast("binary")
    turns = (df.where(F.col(conv_col).isNotNull())
             .select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"),
                     _sha(size, role, text).alias("t"), F.octet_length(text).cast("long").alias("bytes")))
    return ordered_index(turns, ["c"], ["turn", "t"], "pos").select("c", F.col("pos").cast("long").alias("pos"),
                                                                    "t", "bytes")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of the rebuilt conversations: the first h turns of c - c mod 5,
    then c's own turns after its first h (h = crc32 of c mod 9)."""
    counts = numbered.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    head = F.crc32(F.col("c").cast("string").cast("binary")) % HEAD_MOD
    own = counts.select("c", "n", head.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("base"))
    base = counts.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    convs = (own.join(base, "base", "left")
             .withColumn("taken", F.least(F.col("h"), F.coalesce("base_n", F.lit(0).cast("long")))))
    convs = stored(convs.select("c", "base", "h", "taken", (F.col("taken") + F.greatest(
        F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("len")), "trie-convs")
    heads = numbered.where(F.col("pos") < HEAD_MOD - 1).withColumnRenamed("c", "base")
    first = (convs.where("h > 0").select("c", "base", "h").join(heads, "base").where("pos < h")
             .select("c", (F.col("pos") + 1).alias("d"), "t", "bytes"))
    rest = (numbered.join(convs.select("c", "h", "taken"), "c").where("pos >= h")
            .select("c", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("d"), "t", "bytes"))
    return stored(first.unionByName(rest), "trie-turns"), convs.select("c", "len")


def _segments(turns: DataFrame, height: int) -> dict[int, DataFrame]:
    """s -> (c, i, seg): names of the segments i*s+1 .. i*s+s."""
    out = {1: turns.select("c", (F.col("d") - 1).alias("i"), F.col("t").alias("seg"))}
    s = 1
    while 2 * s < height:
        half = F.col("i") % 2
        pairs = (out[s].groupBy("c", F.floor(F.col("i") / 2).alias("i"))
                 .agg(F.max(F.when(half == 0, F.col("seg"))).alias("l"), F.max(F.when(half == 1, F.col("seg"))).alias("r"))
                 .where("l is not null and r is not null"))
        s *= 2
        out[s] = stored(pairs.select("c", "i", _sha(F.col("l"), F.col("r")).alias("seg")), "trie-segments")
    return out


def _named(turns: DataFrame, convs: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """(path, nodes): path (c, d, name) says at which node conversation c is at
    depth d; nodes (d, name, n_convs)."""
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("c").alias("name"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    nodes = stored(root.select(zero.alias("d"), "name", "n_convs"), "trie-root")
    least = nodes.select("name").first()
    path = convs.select("c", zero.alias("d"), F.lit(None if least is None else least[0]).cast("long").alias("name"))
    segments = _segments(turns, height)
    s = height // 2
    while s:
        above = path.where(F.col("d") % (2 * s) == 0).select("c", (F.col("d") / s).cast("long").alias("i"),
                                                            F.col("name").alias("up"))
        cut = (segments[s].where("i % 2 = 0").join(above, ["c", "i"])
               .select("c", ((F.col("i") + 1) * s).alias("d"), "up", "seg"))
        cut = stored(cut, "trie-cut")
        keys = ["d", "up", "seg"]
        names = stored(cut.groupBy(*keys).agg(F.min("c").alias("name"), F.count(F.lit(1)).alias("n_convs")), "trie-names")
        path = path.unionByName(stored(cut.join(names, keys).select("c", "d", "name"), "trie-path"))
        nodes = nodes.unionByName(names.select("d", "name", "n_convs"))
        s //= 2
    return path, nodes


def _grafted(totals: DataFrame, path: DataFrame, height: int, sums: list[str]) -> DataFrame:
    """``totals`` (d, name, own values) with every value summed over the subtree."""
    s = 1
    while s < height:
        low = totals.where(F.col("d") % (2 * s) == s).withColumnRenamed("name", "c")
        low = low.withColumn("block", (F.floor(F.col("d") / s) - 1).cast("long")).drop("d")
        block = F.floor(F.col("d") / s).cast("long")
        up = path.where(block % 2 == 0).withColumn("block", block)
        given = (low.join(up, ["c", "block"]).groupBy("d", "name").agg(*[F.sum(x).alias(f"more_{x}") for x in sums]))
        totals = stored(totals.join(given, ["d", "name"], "left").select(
            "d", "name", *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0).cast("long"))).alias(x) for x in sums]),
            "trie-totals")
        s *= 2
    return totals


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d, name, c) to comma-joined ids, a bounded piece at a time."""
    node, ids, size = None, [], 0

    def piece():
        return pa.RecordBatch.from_pydict({"d": [node[0]], "name": [node[1]], "first": [ids[0]],
                                           "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for d, name, c in zip(*(col.to_pylist() for col in batch.columns)):
            if ids and (node != (d, name) or size > PIECE_BYTES):
                yield piece()
                ids, size = [], 0
            node = (d, name)
            ids.append(c)
            size += len(str(c)) + 1
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (d, name, first) to one SHA-256 per node."""
    node, state = None, None
    done: list[tuple[int, int, str]] = []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()),
                                           pa.array([x[1] for x in done], pa.int64()),
                                           pa.array([x[2] for x in done], pa.string())], ["d", "name", "ends_sha256"])

    for batch in batches:
        for d, name, ids in zip(*(batch.column(k).to_pylist() for k in ("d", "name", "ids"))):
            if node == (d, name):
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
                if len(done) >= 10_000:
                    yield flush()
                    done = []
            node, state = (d, name), hashlib.sha256(ids.encode())
    if node is not None:
        done.append((*node, state.hexdigest()))
    if done:
        yield flush()


def ends_digest(path: DataFrame, convs: DataFrame) -> DataFrame:
    """(d, name, ends_sha256) of the nodes at which some conversation ends."""
    ship_package(path.sparkSession)
    ends = stored(path.join(convs.withColumnRenamed("len", "d"), ["c", "d"]).select("d", "name", "c"), "trie-ends")
    ranges = ends.repartitionByRange("d", "name", "c").sortWithinPartitions("d", "name", "c")
    pieces = ranges.mapInArrow(_pieces, "d long, name long, first long, ids string")
    dealt = pieces.repartition("d", "name").sortWithinPartitions("d", "name", "first")
    return dealt.mapInArrow(_digests, "d long, name long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the sequences ``turns`` (c, d from 1, t, bytes) of the
    conversations ``convs`` (c, len): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    deepest = convs.agg(F.coalesce(F.max("len"), F.lit(0))).first()[0]
    height = 1 << int(deepest).bit_length()          # the least power of two above the depth
    path, nodes = _named(turns, convs, height)
    zero = F.lit(0).cast("long")
    parent = path.select(F.col("c").alias("name"), (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    size = turns.select(F.col("c").alias("name"), "d", "bytes")
    tree = stored(nodes.join(parent, ["name", "d"], "left").join(size, ["name", "d"], "left")
                  .select("d", "name", "parent", "n_convs",
                          ((F.col("n_convs") - 1) * F.coalesce("bytes", zero)).alias("saved")), "trie-nodes")
    children = (tree.where("parent is not null").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    tree = stored(tree.join(children, ["d", "name"], "left")
                  .withColumn("n_children", F.coalesce("n_children", zero)), "trie-tree")
    own = tree.select("d", "name", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    totals = _grafted(own, path, height, ["leaves", "saved"])
    return (tree.drop("saved").join(totals, ["d", "name"]).join(ends_digest(path, convs), ["d", "name"], "left")
            .select(F.col("name").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"),
                    "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))


def conversation_trie(df: DataFrame, **columns: str) -> DataFrame:
    """The trie of the rebuilt conversations of ``df`` (one row per turn)."""
    numbered = stored(named_turns(df, **columns), "trie-numbered")
    return trie(*rebuilt(numbered))
