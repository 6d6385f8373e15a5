"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: its care positions are hashed,
the others ignored, so a changed word hides only the seeds that look at it.
Every window of every document is hashed under every mask and joined with the
hashes of the benchmark's windows; each hit fixes an alignment of document and
item, and the words around it are compared position by position.  The alignment
is an overlap if any of its windows of ``min_words`` words or more (of the whole
item if it is shorter) has at least 80 % equal words; the window with the best
score (+1 for an equal word, -4 for a changed one) is reported.

Words that repeat with a short period give the same hash at every turn.  Of
places (in an item) and of hits (in a text) that follow each other in equal
steps of at most ``PERIOD`` words only the two ends of the row are looked at: the
alignments between them compare the same words.  Of the overlaps of one item
that share words the best is reported.  So 1,000 equal words against 20,000
are a few alignments.

The benchmark is distinct normalised texts, cut into slices of a bounded number
of bytes; a slice's seed table goes to all tasks, which probe it while scanning
whole texts (a broadcast hash join).  Documents are not shuffled, and a text or
passage that repeats in a third of all rows costs what any other row costs.  With
several slices each is a pass of its own: its hits are written and its seed
table dropped before the next, and the hits of a document meet in one narrow join.

Words are lower-cased runs of characters other than white space and
punctuation.  Items shorter than a mask are hashed whole and found unchanged
only.  Null and empty texts, items without words and empty tables give no hits;
null keys are kept, rows that repeat are rows of their own, very long texts are
searched whole.  Items with equal words count as their smallest id.  Carried
columns may have any name; one named like ``out_col`` is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_sizes, map_arrow, row_chunks, stored

# fixed values: care positions (1) of the seeds, six each
MASKS = ("1110111", "11010111", "110011011", "1101000111")
PERIOD = 16
MIN_WORDS = 10
CHANGED = 4
SLICE_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20
FILTER_BITS = 22
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_ASCII_BREAKS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_WIDE_BREAKS = re.compile("[\u0080-©«-´¶-¹»-¿×÷"
                          " -⁯←-⯿　-〄〈-〠〰"
                          "！-／﻿]")
HIT = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start_word", T.IntegerType()),
    T.StructField("end_word", T.IntegerType()), T.StructField("matched", T.IntegerType())]))
_HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()),
                                 ("end_word", pa.int32()), ("matched", pa.int32())]))


def words_of(text: str) -> list[bytes]:
    text = text.lower()
    if not text.isascii():
        text = _WIDE_BREAKS.sub(" ", text)
    return text.encode("utf-8", "replace").translate(_ASCII_BREAKS).split()


def best_run(equal: np.ndarray, least: int, changed: int = CHANGED) -> tuple[int, int, int] | None:
    """(start, stop, equal words) of the best-scoring window of at least ``least``
    words, the longest of equal ones; None if all score below zero."""
    if len(equal) < least:
        return None
    cum = np.concatenate(([0], np.cumsum(np.where(equal, 1, -changed))))
    low = np.minimum.accumulate(cum[:len(cum) - least])      # of the starts that each stop may have
    gain = cum[least:] - low
    if gain.max() < 0:
        return None
    at = np.flatnonzero(gain == gain.max())
    starts = np.searchsorted(-low, -low[at], "left")         # the first start with that sum
    i = int(np.argmax(at + least - starts))
    start, stop = int(starts[i]), int(at[i]) + least
    return start, stop, int(equal[start:stop].sum())


def row_ends(group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` (ascending in each ``group``) are not inside a row
    of places of the same group in equal steps of at most ``PERIOD``."""
    inner = np.zeros(len(at), dtype=bool)
    if len(at) > 2:
        step = np.diff(at)
        same = (group[1:] == group[:-1]) & (step <= PERIOD)
        inner[1:-1] = same[1:] & same[:-1] & (step[1:] == step[:-1])
    return ~inner


class Seeds:
    """Seed table of one benchmark slice."""

    def __init__(self, items: Sequence[tuple[int, str]], masks: Sequence[str] = MASKS,
                 min_words: int = MIN_WORDS):
        least: dict[tuple[bytes, ...], int] = {}
        for item_id, text in items:
            w = tuple(words_of(text or ""))
            if w:
                least[w] = min(item_id, least.get(w, item_id))
        self.min_words = min_words
        self.vocab: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for w, item_id in sorted(least.items(), key=lambda x: x[1]):
            self.items.append((item_id, np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w],
                                                 dtype=np.int64)))
        span = max(map(len, masks))
        short = sorted({len(a) for _i, a in self.items if len(a) < span})
        self.care = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in masks]
        self.care += [np.arange(n) for n in short]
        hashes, places = [], []
        for m, care in enumerate(self.care):
            whole = m >= len(masks)
            for k, (_id, ids) in enumerate(self.items):
                if whole and len(ids) != len(care):
                    continue
                h = self.hash(ids, m)
                by = np.lexsort((np.arange(len(h)), h))
                by = by[row_ends(h[by], by)]
                hashes.append(h[by])
                places.append(np.column_stack([np.full(len(by), k), by]))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        p = np.concatenate(places) if places else np.empty((0, 2), np.int64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.places = h[order], p[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hash(self, ids: np.ndarray, m: int) -> np.ndarray:
        """64-bit hashes of all windows under mask ``m``."""
        care = self.care[m]
        n = len(ids) - int(care[-1])
        if n <= 0:
            return np.empty(0, np.uint64)
        x = ids.astype(np.uint64)
        h = np.full(n, np.uint64(m + 1))
        for c in care:
            h = (h ^ x[c:c + n]) * MULTIPLIER
            h ^= h >> np.uint64(29)
        return h * MULTIPLIER

    def alignments(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (offset of the item's first word, item) with a seed hit."""
        found = []
        for m in range(len(self.care)):
            h = self.hash(ids, m)
            at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(at):
                continue
            lo = np.searchsorted(self.hashes, h[at], "left")
            n = np.searchsorted(self.hashes, h[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            if not len(at):
                continue
            row = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            at = np.repeat(at, n)
            by = np.lexsort((at, row))           # by seed, in text order
            by = by[row_ends(row[by], at[by])]
            item, place = self.places[row[by]].T
            found.append(np.column_stack([at[by] - place, item]))
        if not found:
            return np.empty((0, 2), np.int64)
        return np.unique(np.concatenate(found), axis=0)

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """(item_id, start_word, end_word, matched) of each text."""
        words = [words_of(t) for t in texts]
        sizes = [len(w) for w in words]
        starts = np.concatenate(([0], np.cumsum([n + 1 for n in sizes])))[:-1]
        ids = np.zeros(int(sum(sizes)) + len(sizes), dtype=np.int64)
        for s, w in zip(starts.tolist(), words):
            ids[s:s + len(w)] = np.fromiter(map(self.vocab.get, w, repeat(0)), dtype=np.int64, count=len(w))
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for offset, k in self.alignments(ids).tolist():
            item_id, item = self.items[k]
            # the document that the hit lies in: the item may start before it or end after it
            lo, hi = max(offset, 0), min(offset + len(item), len(ids))
            first = int(np.searchsorted(starts, lo, "right")) - 1
            last = int(np.searchsorted(starts, hi - 1, "right")) - 1
            for d in range(first, last + 1):
                a, b = max(lo, int(starts[d])), min(hi, int(starts[d]) + sizes[d])
                if b <= a:
                    continue
                run = best_run(ids[a:b] == item[a - offset:b - offset], min(self.min_words, len(item)))
                if run:
                    s, e, same = run
                    out[d].append((item_id, a - int(starts[d]) + s, a - int(starts[d]) + e, same))
        return [_best_of_regions(x) for x in out]


def _best_of_regions(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """One hit per item and stretch of text: of hits of an item that share words
    the one with most equal words (then the first) stays."""
    out: list[tuple[int, int, int, int]] = []
    end = -1
    for h in sorted(set(hits)):
        if out and out[-1][0] == h[0] and h[1] < end:
            end = max(end, h[2])
            if h[3] > out[-1][3]:
                out[-1] = h
        else:
            out.append(h)
            end = h[2]
    return out


_WORKER: dict[str, Seeds] = {}


def _worker_seeds(key: str, shared, masks: Sequence[str], min_words: int) -> Seeds:
    """The slice's seed table, built once per worker."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Seeds(shared.value, masks, min_words)
    return _WORKER[key]


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[int, DataFrame]:
    """(number of slices, rows with their slice): at most about ``SLICE_BYTES``
    of distinct texts each."""
    rows = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.groupBy("text").agg(F.min("id").alias("id"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // SLICE_BYTES))
    return n, rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(n)))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id",
                  item_text_col: str = "text", out_col: str = "hits", keep: list[str] | None = None,
                  masks: Sequence[str] = MASKS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (its ``keep`` columns, default all) with ``out_col`` = array of
    (item_id, start_word, end_word, matched) overlaps with benchmark items."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    n, benchmark_rows = _slices(benchmark, id_col, item_text_col)
    # the carried columns travel as one struct, so their names cannot clash
    own = F.struct(*[F.col(c) for c in keep], F.lit(True).alias("__"))
    df = docs.select(own.alias("own"), F.col(text_col).cast("string").cast("binary").alias("text"))
    if n == 1:
        found = _one_slice(df, benchmark_rows, 0, ["own"], masks, min_words)[0]
    else:
        rows = stored(df.withColumn("row", F.monotonically_increasing_id()), "seed-rows")
        every = None
        for i in range(n):
            hits, shared = _one_slice(rows.select("row", "text"), benchmark_rows, i, ["row"], masks, min_words)
            hits = stored(hits.where(F.size("hits") > 0), "seed-hits")
            shared.unpersist()
            every = hits if every is None else every.unionByName(hits)
        each = every.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
        found = (rows.select("row", "own").join(each, "row", "left")
                 .withColumn("hits", F.coalesce("hits", F.array().cast(HIT))))
    return found.select(*[F.col("own")[c].alias(c) for c in keep], F.col("hits").alias(out_col))


def _one_slice(df: DataFrame, benchmark_rows: DataFrame, i: int, keep: list[str], masks: Sequence[str], min_words: int):
    """(``keep`` columns of ``df`` with ``hits`` of slice ``i``, the slice's broadcast)."""
    items = benchmark_rows.where(F.col("part") == i).select("id", "text").collect()
    shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in items])
    key = uuid.uuid4().hex

    def make():
        seeds = _worker_seeds(key, shared, masks, min_words)

        def run(batch: pa.RecordBatch):
            col = batch.column(batch.num_columns - 1)
            for lo, hi in row_chunks(byte_sizes(col), CHUNK_BYTES):
                texts = [(t or b"").decode("utf-8", "replace") for t in col.slice(lo, hi - lo).to_pylist()]
                hits = [[dict(zip(("item_id", "start_word", "end_word", "matched"), h)) for h in x]
                        for x in seeds.search(texts)]
                yield lo, hi, [pa.array(hits, _HIT_ARROW)]
        return run

    return map_arrow(df, keep, [T.StructField("hits", HIT, False)], make, ["text"]), shared


def is_contaminated(hits: str = "hits"):
    return F.size(hits) > 0
