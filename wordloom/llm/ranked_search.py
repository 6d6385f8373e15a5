"""Ranked lexical search by dense blocked matrix products.

Every document gets a score for every item (query): the sum over the item's
terms of weight times impact, all integers.

1. Items become (item, term, count) rows; items are dealt into slices of about
   ``SLICE_PAIRS`` such rows, and one slice at a time goes to the workers: its
   vocabulary as a table from term to column.  Each slice reads the corpus once.
2. One scan splits whole texts into terms and keeps, per document, its length
   and the (column, occurrences) of the slice's terms: written to the shared
   folder.  Document frequencies are a grouped count of those columns.
3. Items are put into tiles of at most ``TILE_CELLS`` cells (items x distinct terms
   of the tile).  The documents' impacts fill a dense float64 tile of
   ``DOC_TILE`` rows and ``COLUMN_TILE`` columns, which is multiplied with the
   weights by BLAS.  Column tiles are cut so that no sum in a product can
   reach 2^53, hence every product is exact in any order of addition; their sums
   are added as 64-bit integers.  A weight too large for that is split over
   several products.
4. A task keeps the best k documents of each item under the full order (score, then
   key), so equal scores never depend on the tiling, and the tasks' lists meet
   in one grouped top k (k rows per task and item are all that is shuffled).

Terms are the maximal runs of ASCII letters and digits and all other non-ASCII
characters, A-Z lower-cased.  Weight: floor(1000 ln((2N+2)/(2df+1))).  Impact:
(10^9 tf) div (1000 tf + 8m), m = 25 + (75 n N) div L.  N: documents with a term; L: all
their terms; n: those of the document.

Results for odd input: null and empty texts have no term, count nowhere and are
never found; an item without terms, or without a document of score above 0, has
no rows.  Rows that repeat an item's id and text are one item; rows of one id with
different texts are items of their own.  Null keys of documents come last
among equal scores; rows that repeat a key are documents of their own.  Very long
texts are split into terms in windows.  An empty table on either side gives an
empty result.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_sizes, map_arrow, row_chunks, ship_package, stored, text_or_empty

SLICE_PAIRS = 100_000
TILE_CELLS = 2_000_000          # float64: 16 MB of weights
DOC_TILE = 256
COLUMN_TILE = 4096
EXACT = (1 << 53) - 1
MAX_IMPACT = 1_000_000
WINDOW_BYTES = 4 << 20
CHUNK_BYTES = 4 << 20

# fixed: ASCII letters and digits stay (A-Z lower-cased), other ASCII separates, the rest belongs to terms
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def term_counts(data: bytes, count: Counter, column=None) -> int:
    """Adds the terms of a text (as ``column(term)``) to ``count``; returns how many there are."""
    text, at, n = data.translate(_FOLD), 0, 0
    while at < len(text):
        end = at + WINDOW_BYTES
        end = text.find(b" ", end) if end < len(text) else -1
        terms = text[at:end if end >= 0 else len(text)].split()
        at = end if end >= 0 else len(text)
        n += len(terms)
        count.update(terms if column is None else map(column, terms))
    return n


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(items (item, item_id), pairs (item, term, times)) of the distinct items."""
    rows = items.select(F.col(id_col).alias("item_id"), text_or_empty(text_col).alias("text")).distinct()
    rows = stored(rows.withColumn("item", F.monotonically_increasing_id()), "search-items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count: Counter = Counter()
                term_counts(text, count)
                if count:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(count), pa.int64()), pa.array(list(count), pa.binary()),
                         pa.array(list(count.values()), pa.int64())], ["item", "term", "times"])

    ship_package(items.sparkSession)
    pairs = rows.select("item", F.col("text").cast("binary").alias("b")).mapInArrow(
        run, "item long, term binary, times long")
    return rows.select("item", "item_id"), stored(pairs, "search-pairs")


@dataclass
class Slice:
    """The items of one pass: ``terms[k]`` is column k; entries (item row, column, times)."""
    items: np.ndarray
    terms: list[bytes]
    rows: np.ndarray
    columns: np.ndarray
    times: np.ndarray


def _slices(pairs: DataFrame) -> Iterator[Slice]:
    """One slice at a time, of about SLICE_PAIRS entries (an item is never cut)."""
    n = -(-pairs.count() // SLICE_PAIRS)
    for k in range(n):
        part = pairs.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).toArrow()
        if part.num_rows == 0:
            continue
        items, rows = np.unique(np.asarray(part.column("item")), return_inverse=True)
        seen: dict[bytes, int] = {}
        columns = np.array([seen.setdefault(t, len(seen)) for t in part.column("term").to_pylist()], dtype=np.int64)
        yield Slice(items, list(seen), rows, columns, np.asarray(part.column("times"), dtype=np.int64))


def postings(docs: DataFrame, terms: list[bytes], key_col: str, text_col: str) -> DataFrame:
    """(key, n, columns, tfs) of every document with a term; columns of ``terms`` only."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def make():
        column = {t: k for k, t in enumerate(shared.value)}.get

        def run(batch: pa.RecordBatch):
            col = batch.column(batch.num_columns - 1)
            for lo, hi in row_chunks(byte_sizes(col), CHUNK_BYTES):
                lens, ids, tfs, offsets = [], [], [], [0]
                for data in col.slice(lo, hi - lo).to_pylist():
                    count: Counter = Counter()
                    lens.append(term_counts(data, count, column))
                    count.pop(None, None)
                    ids.extend(count)
                    tfs.extend(count.values())
                    offsets.append(len(ids))
                cut = pa.array(offsets, pa.int32())
                yield lo, hi, [pa.array(lens, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(ids, pa.int32())),
                               pa.ListArray.from_arrays(cut, pa.array(tfs, pa.int64()))]
        return run

    slim = docs.select(F.col(key_col).cast("long").alias("key"), text_or_empty(text_col).cast("binary").alias("text"))
    found = map_arrow(slim, ["key"], [T.StructField("n", T.LongType(), False),
                                      T.StructField("columns", T.ArrayType(T.IntegerType(), False), False),
                                      T.StructField("tfs", T.ArrayType(T.LongType(), False), False)], make, ["text"])
    return found.where("n > 0")


@dataclass
class ItemTile:
    """Weights of some items: ``local[column]`` is the tile's place of a column of
    the slice (-1: none); ``products`` are (first place, dense places x items)."""
    items: np.ndarray
    local: np.ndarray
    products: list[tuple[int, np.ndarray]]


def _products(weights: np.ndarray, limit: int) -> list[tuple[int, np.ndarray]]:
    """Column tiles of ``weights`` (places x items) whose products with impacts stay exact."""
    out = []
    while (weights > 0).any():
        layer = np.minimum(weights, limit)
        most = layer.max(axis=1)
        lo, total = 0, 0
        for k in range(len(most) + 1):
            if k == len(most) or k - lo == COLUMN_TILE or total + most[k] > limit:
                if layer[lo:k].any():
                    out.append((lo, layer[lo:k].astype(np.float64)))
                lo, total = k, 0
            if k < len(most):
                total += int(most[k])
        weights = weights - layer
    return out


def _tiles(s: Slice, weight: np.ndarray, cells: int = TILE_CELLS, limit: int = EXACT // MAX_IMPACT) -> list[ItemTile]:
    """Items in order, put together while items x distinct weighted terms stay within ``cells``."""
    keep = weight[s.columns] > 0
    rows, columns, times = s.rows[keep], s.columns[keep], s.times[keep]
    order = np.argsort(rows, kind="stable")
    rows, columns, times = rows[order], columns[order], times[order]
    starts = np.searchsorted(rows, np.arange(len(s.items) + 1))
    tiles, lo, seen = [], 0, set()

    def close(hi: int) -> None:
        a, b = starts[lo], starts[hi]
        if a == b:
            return
        used, place = np.unique(columns[a:b], return_inverse=True)
        local = np.full(len(weight), -1, dtype=np.int64)
        local[used] = np.arange(len(used))
        dense = np.zeros((len(used), hi - lo), dtype=np.int64)
        dense[place, rows[a:b] - lo] = times[a:b] * weight[columns[a:b]]
        tiles.append(ItemTile(s.items[lo:hi], local, _products(dense, limit)))

    for k in range(len(s.items)):
        own = set(columns[starts[k]:starts[k + 1]].tolist())
        if k > lo and len(seen | own) * (k - lo + 1) > cells:
            close(k)
            lo, seen = k, set()
        seen |= own
    close(len(s.items))
    return tiles


def _best(k: int, item, score, null, key):
    """The k best of each item under (score descending, null keys last, key)."""
    order = np.lexsort((key, null, -score, item))
    item = item[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    order = order[place < k]
    return item[place < k], score[order], null[order], key[order]


def _score_tile(tile: ItemTile, row: np.ndarray, column: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores (documents x items) of one block of documents, exact."""
    place = tile.local[column]
    scores = np.zeros((n_docs, len(tile.items)), dtype=np.int64)
    for lo, weights in tile.products:
        here = (place >= lo) & (place < lo + len(weights))
        dense = np.zeros((n_docs, len(weights)))
        dense[row[here], place[here] - lo] = impact[here]
        scores += (dense @ weights).astype(np.int64)
    return scores


def _search(shared, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = shared.value
        none = np.zeros(0, dtype=np.int64)
        held = [(none, none, none.astype(bool), none) for _ in tiles]
        least = [np.ones(len(t.items), dtype=np.int64) for t in tiles]     # a candidate needs this score
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                null = np.asarray(part.column(0).is_null())
                key = np.asarray(part.column(0).fill_null(0), dtype=np.int64)
                m = np.array([25 + 75 * n * n_docs // n_terms for n in part.column(1).to_pylist()], dtype=np.int64)
                lists = part.column(2)
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths(), dtype=np.int64))
                column = np.asarray(lists.flatten(), dtype=np.int64)
                tf = np.asarray(part.column(3).flatten(), dtype=np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
                for j, tile in enumerate(tiles):
                    scores = _score_tile(tile, row, column, impact, part.num_rows)
                    doc, item = np.nonzero(scores >= least[j])
                    if not len(doc):
                        continue
                    new = (item, scores[doc, item], null[doc], key[doc])
                    held[j] = _best(k, *(np.concatenate(x) for x in zip(held[j], new)))
                    items, firsts, sizes = np.unique(held[j][0], return_index=True, return_counts=True)
                    full = sizes == k
                    least[j][items[full]] = held[j][1][firsts[full] + k - 1]
        for tile, (item, score, null, key) in zip(tiles, held):
            if len(item):
                yield pa.RecordBatch.from_arrays([pa.array(tile.items[item], pa.int64()),
                                                  pa.array(key, pa.int64(), mask=null),
                                                  pa.array(score, pa.int64())], ["item", "key", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, key_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item id, rank, document key, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    ids, pairs = _item_terms(items, item_col, item_text_col)
    best = None
    for s in _slices(pairs):
        found = stored(postings(docs, s.terms, key_col, text_col), "search-postings")
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
        counts = found.select(F.explode("columns").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("df")).toArrow()
        weight = np.zeros(len(s.terms), dtype=np.int64)
        for c, df in zip(counts.column("c").to_pylist(), counts.column("df").to_pylist()):
            weight[c] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        shared = spark.sparkContext.broadcast(_tiles(s, weight))
        lists = found.mapInArrow(_search(shared, n_docs, n_terms, k), "item long, key long, score long")
        lists = stored(lists, "search-lists")
        shared.unpersist()
        best = lists if best is None else best.unionByName(lists)
    if best is None:
        best = spark.createDataFrame([], "item long, key long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(ids, "item")
            .select(F.col("item_id").alias(item_col), "rank", F.col("key").alias(key_col), "score"))
