"""Approximate nearest neighbours by inner product: an inverted multi-index.

The index works on distances, so inner product is reduced to distance first:
every entry gets the component sqrt(M^2 - |x|^2), M the largest norm, and every
query a zero.  Entries then all have norm M, and the nearest by distance are
those with the largest inner product, whatever the norms.

Vectors are cut in two halves; each half is quantised by its own k-means
codebook, so a pair of centroids names one of K*K cells.  For a query, centroid
pairs are visited in order of summed distance with a heap (multi-sequence
traversal) until the visited cells hold the wanted share of the entries; those
entries are reranked by the exact inner product in double precision.

* Codebooks are fitted on a bounded sample (``SAMPLE`` vectors, the first by a
  hash of their id); every vector is indexed and every query searched.
* Equal vectors are one entry that keeps its ``k + 1`` smallest ids (with a
  query's own id taken out, no more can be in a result, since ties go to the
  smaller id).  Equal query vectors are searched once.  So a vector that makes
  up a third of the table costs one entry and one search.
* Entries are stored in blocks of cells of at most ``BLOCK`` entries (a fuller
  cell takes several blocks) and queries in chunks; a task reranks one chunk
  against one block that some query of it visits, and per-query bests are merged
  by a grouped top-k.
* The codebooks, the cells' entry counts and the block numbers go to all tasks:
  at most 1024 * 1024 cells, whatever the input.

``share`` (of entries to rerank) trades time for recall.  Vectors without
cluster structure need a large share: see the README for measured recall.

Rows whose id or vector is null, whose vector is zero, has null or non-finite
components or another length than most vectors take no part.  Rows that agree
in id and vector count once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, stored

SAMPLE = 20_000
SHARE = 0.55
BLOCK = 4096
CHUNK = 4096
LLOYD_STEPS = 12
RERANK_ROWS = 256
SEED = 7


def usable(vec: str = "embedding"):
    v = F.col(vec)
    return (v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
            & F.exists(v, lambda x: x != 0))


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Entries with the component that brings each to ``norm``."""
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0.0))])


def kmeans(x: np.ndarray, k: int, seed: int = SEED, steps: int = LLOYD_STEPS) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; empty centroids stay."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    centre = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(steps):
        near = nearest_centroid(x, centre)
        n = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def nearest_centroid(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = 0.5 * (centre * centre).sum(axis=1)
    out = np.empty(len(x), dtype=np.int64)
    for lo in range(0, len(x), 4096):
        out[lo:lo + 4096] = np.argmin(half - x[lo:lo + 4096] @ centre.T, axis=1)
    return out


def codebook_size(n: int) -> int:
    """Centroids per half for ``n`` entries (64 up to a million, 1024 at most)."""
    return int(max(64, min(math.sqrt(n) / 16, 1024)))


class MultiIndex:
    """Codebooks, entry counts per cell and block numbers; ``norm`` is the
    largest of the entries."""

    def __init__(self, first: np.ndarray, second: np.ndarray, norm: float = 0.0):
        self.first, self.second, self.norm = first, second, norm
        self.k2 = len(second)
        self.counts = np.zeros(len(first) * len(second), dtype=np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = halves(x)
        b_cell = nearest_centroid(b, self.second) if b.shape[1] else np.zeros(len(x), np.int64)
        return nearest_centroid(a, self.first) * self.k2 + b_cell

    def set_counts(self, cells: np.ndarray, n: np.ndarray) -> None:
        self.counts[cells] = n
        self.block = np.zeros(len(self.counts), dtype=np.int64)
        self.parts: list[int] = []               # pieces of each block
        held = 0
        for c in np.flatnonzero(self.counts).tolist():
            n_c = int(self.counts[c])
            if not self.parts or held + n_c > BLOCK:
                self.parts.append(max(1, -(-n_c // BLOCK)))
                held = 0
            held += n_c
            self.block[c] = len(self.parts) - 1

    def visit(self, q: np.ndarray, wanted: int) -> list[int]:
        """Non-empty cells in order of summed distance until ``wanted`` entries."""
        a, b = halves(q[None])
        d1 = (0.5 * (self.first * self.first).sum(axis=1) - self.first @ a[0])
        d2 = (0.5 * (self.second * self.second).sum(axis=1) - self.second @ b[0]) if b.shape[1] else np.zeros(1)
        o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        counts, k2, last1, last2 = self.counts, self.k2, len(o1) - 1, len(o2) - 1
        heap = [(s1[0] + s2[0], 0, 0)]
        push, pop = heapq.heappush, heapq.heappop
        found: list[int] = []
        got = 0
        while heap and got < wanted:
            _d, i, j = pop(heap)
            cell = o1[i] * k2 + o2[j]
            n = counts[cell]
            if n:
                found.append(cell)
                got += n
            if j < last2:
                push(heap, (s1[i] + s2[j + 1], i, j + 1))
            if j == 0 and i < last1:
                push(heap, (s1[i + 1] + s2[0], i + 1, 0))
        return found


def _matrix(col) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _lists(col) -> list[list[int]]:
    return col.to_pylist()


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: MultiIndex = shared.value
        for b in batches:
            if b.num_rows:
                cells = index.cells(lifted(_matrix(b.column(2)), index.norm))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells)], names=["entry", "ids", "vec", "cell"])
    return run


def _route(shared, wanted: int, chunks: int):
    """Every query goes to the blocks that hold cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: MultiIndex = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            entries, x = b.column(0).to_pylist(), _matrix(b.column(1))
            for i, entry in enumerate(entries):
                cells = np.array(index.visit(np.append(x[i], 0.0), wanted), dtype=np.int64)
                order = np.argsort(index.block[cells], kind="stable")
                blocks, at = np.unique(index.block[cells[order]], return_index=True)
                groups = np.split(cells[order], at[1:])
                rows = [(int(k), p, g.tolist()) for k, g in zip(blocks, groups) for p in range(index.parts[k])]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([entry % chunks] * n, pa.int64()), pa.array([entry] * n, pa.int64()),
                    pa.array([x[i].tolist()] * n, pa.list_(pa.float64())),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                    names=["block", "part", "chunk", "query", "q", "cells"])
    return run


def _rerank(keep: int):
    schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = _matrix(entries.column("vec")), _matrix(queries.column("q"))
        ids = _lists(entries.column("ids"))
        least = np.array([i[0] for i in ids])
        cells, cell_no = np.unique(np.asarray(entries.column("cell")), return_inverse=True)
        names, wanted = np.asarray(queries.column("query")), _lists(queries.column("cells"))
        out_q: list[int] = []
        out_v: list[int] = []
        out_s: list[float] = []
        for lo in range(0, len(q), RERANK_ROWS):
            part = q[lo:lo + RERANK_ROWS]
            seen = np.zeros((len(part), len(cells)), dtype=bool)
            for r in range(len(part)):
                w = np.asarray(wanted[lo + r])
                at = np.searchsorted(cells, w)
                ok = at < len(cells)
                seen[r, at[ok][cells[at[ok]] == w[ok]]] = True
            score = np.where(seen[:, cell_no], part @ x.T, -np.inf)
            for r in range(len(part)):
                s = score[r]
                if len(s) > keep:
                    near = np.flatnonzero(s >= np.partition(s, len(s) - keep)[len(s) - keep])
                else:
                    near = np.arange(len(s))
                near = near[s[near] > -np.inf]
                exact = (x[near] * part[r]).sum(axis=1)
                order = np.lexsort((least[near], -exact))
                rows = [(-float(exact[o]), i) for o in order.tolist() for i in ids[near[o]]]
                for neg, i in sorted(rows)[:keep]:
                    out_q.append(int(names[lo + r]))
                    out_v.append(i)
                    out_s.append(-neg)
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()),
                         pa.array(out_s, pa.float64())], schema=schema)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
            vec_col: str = "embedding", share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found among
    all other rows.  ``queries`` are rows of ``vectors`` (ids and vectors)."""
    spark = vectors.sparkSession
    ship_package(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = (vectors.where(usable(vec_col) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
            .withColumn("h", F.xxhash64("vec")))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not size:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vec") == size[0]["n"]).groupBy("h", "vec", "id").agg(F.lit(1).alias("one"))

    # entries: distinct vectors with their k + 1 smallest ids
    smallest = Window.partitionBy("h", "vec").orderBy("id")
    entries = (rows.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
               .groupBy("h", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
               .select("h", F.col("ids")[0].alias("entry"), "ids", "vec"))
    entries = stored(entries, "ann-entries")
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, norm = entries.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    drawn = entries.select("entry", "vec").orderBy(F.xxhash64("entry"), "entry").limit(sample)
    drawn = np.array([r["vec"] for r in drawn.collect()], dtype=np.float64)      # at most ``sample`` vectors
    size_k = codebook_size(n)
    a, b = halves(lifted(drawn, norm))
    index = MultiIndex(kmeans(a, size_k), kmeans(b, size_k), norm)
    books = spark.sparkContext.broadcast(index)
    filed = stored(entries.select("entry", "ids", "vec").mapInArrow(
        _assign(books), "entry long, ids array<long>, vec array<float>, cell long"), "ann-index")
    counts = filed.groupBy("cell").count().toPandas()                            # at most K * K rows
    index.set_counts(counts["cell"].to_numpy(), counts["count"].to_numpy())
    shared = spark.sparkContext.broadcast(index)

    asked = (queries.where(usable(vec_col) & F.col(id_col).isNotNull())
             .select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<float>").alias("vec"))
             .withColumn("h", F.xxhash64("vec")))
    named = stored(asked.join(entries.select("h", "vec", "entry"), ["h", "vec"])
                   .select("query_id", "entry").distinct(), "ann-queries")
    searched = named.select("entry").distinct().join(entries.select("entry", "vec"), "entry")
    chunks = max(1, -(-named.select("entry").distinct().count() // CHUNK))
    wanted = min(n, max(math.ceil(share * n), k + 1))
    routed = stored(searched.repartition(spark.sparkContext.defaultParallelism * 2, "entry").mapInArrow(
        _route(shared, wanted, chunks), "block long, part long, chunk long, query long, q array<double>, cells array<long>"),
        "ann-routed")

    block = F.pandas_udf(lambda c: _series(shared.value.block[c.to_numpy()]), "long")
    parts = F.pandas_udf(lambda c: _series(np.array(shared.value.parts)[c.to_numpy()]), "long")
    placed = (filed.withColumn("block", block("cell"))
              .withColumn("part", F.pmod(F.xxhash64("entry"), parts("block"))))
    keys = ("block", "part", "chunk")
    # an entry goes only to the chunks of which some query asked for its block
    placed = placed.join(routed.select(*[F.col(c).alias(c) for c in keys]).distinct(), ["block", "part"])
    best = placed.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(
        _rerank(k + 1), "query long, vec_id long, score double")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (best.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
             .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (named.join(lists.withColumnRenamed("query", "entry"), "entry")
            .select("query_id", F.posexplode(others).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                    F.col("x.score").alias("score")))


def _series(values):
    import pandas as pd

    return pd.Series(values)
