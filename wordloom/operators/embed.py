"""The distributed embedding job.

``embed`` takes encoded id sequences (from the relational tokeniser, or
validated pre-tokenised ids) and runs the encoder inside ``mapInPandas``:
weights reach each Python worker once through a size-checked broadcast, rows
are placed by length bucket (F4) and sorted so equal-length sentences form
dense batches, and every forward call is bounded by a token budget so Python
memory stays flat whatever the Arrow batch size.

A vocabulary grows with its texts.  Word embeddings that would outgrow the
broadcast stay a table (``Model.words``): rows are dealt into blocks, a block asks
for each of its distinct words once, and its rows meet their vectors in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship_package, stored
from .batching import balance_by_length, encoder_partitions
from .encoder_math import (EMBEDDING_TENSORS, ModelConfig, check_weights, encode_batch,
                           limit_blas_threads, seeded_weights, seeded_word_rows)
from .heavy import heavy_join

# Weights above this size are refused for broadcast (the model is a bounded
# parameter, not data; 2 GB is also the binaryFile per-file limit).
MAX_MODEL_BYTES = 2 * 1024 ** 3
BLOCK_BYTES = 64 << 20     # word vectors of a block, if no token of it came twice
# so many (block, word) pairs are broadcast to the word table at most (about 25 MB)
BROADCAST_PAIRS = 500_000

_WORKER_CACHE: dict[str, dict[str, np.ndarray]] = {}


@dataclass
class Model:
    """A model whose weights live in a Spark broadcast (U4: ``dim``, ``max_seq``)."""
    config: ModelConfig
    weights_bc: object   # Broadcast[dict[str, np.ndarray]]
    name: str = "model"
    # (token_id, w array<float>), one row per id: word embeddings that are not in the broadcast
    words: DataFrame | None = field(default=None, compare=False, repr=False)
    # stable cache key for Python workers (worker-side broadcasts carry no id)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def dim(self) -> int:
        return self.config.hidden

    @property
    def max_seq(self) -> int:
        return self.config.max_seq


def model_from_weights(spark: SparkSession, cfg: ModelConfig, weights: dict[str, np.ndarray],
                       name: str = "model", with_words: bool = True) -> Model:
    """``with_words=False`` leaves the word embeddings out of the broadcast; the caller
    gives them as a table (``Model.words``)."""
    check_weights(cfg, weights)
    if not with_words:
        weights = {k: a for k, a in weights.items() if k != EMBEDDING_TENSORS[0]}
    size = sum(a.nbytes for a in weights.values())
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"model of {size} bytes exceeds the broadcast limit {MAX_MODEL_BYTES}")
    return Model(cfg, spark.sparkContext.broadcast(weights), name)


def seeded_model(spark: SparkSession, cfg: ModelConfig, seed: int = 0, with_words: bool = True) -> Model:
    return model_from_weights(spark, cfg, seeded_weights(cfg, seed), f"seeded-{seed}", with_words)


def seeded_words(spark: SparkSession, cfg: ModelConfig, rows: int, seed: int = 0) -> DataFrame:
    """``(token_id long, w array<float>)`` for ids 0..rows-1, drawn where they are read:
    the word embeddings of ``seeded_model(cfg, seed)``, continued beyond
    ``cfg.vocab_size`` if ``rows`` is more."""
    ship_package(spark)
    parts = max(1, -(-rows // cfg.vocab_size))
    schema = T.StructType([T.StructField("token_id", T.LongType()), T.StructField("w", T.ArrayType(T.FloatType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for first, vectors in seeded_word_rows(cfg, seed, part):
                    vectors = vectors[:max(0, rows - first)]
                    ids = pa.array(np.arange(first, first + len(vectors)))
                    yield pa.RecordBatch.from_arrays([ids, _vector_column(vectors)], names=schema.names).cast(arrow)

    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)


def with_vocabulary(model: Model, words: DataFrame, rows: int) -> Model:
    """``model`` (and its broadcast) with another word table, of ids 0..rows-1."""
    return replace(model, config=replace(model.config, vocab_size=rows), words=words)


def load_model(spark: SparkSession, model_dir: str, cfg: ModelConfig) -> Model:
    """Weights from ``model_dir/model.safetensors`` (any Hadoop-readable path):
    the file size is checked before its bytes are read, then the float32
    tensors are broadcast once."""
    from ..sources.safetensors import read_tensors
    weights = read_tensors(spark, f"{model_dir.rstrip('/')}/model.safetensors",
                           max_bytes=MAX_MODEL_BYTES)
    return model_from_weights(spark, cfg, weights, model_dir.rstrip("/").split("/")[-1])


def _weights(bc, key: str) -> dict[str, np.ndarray]:
    w = _WORKER_CACHE.get(key)
    if w is None:
        w = bc.value
        _WORKER_CACHE.clear()
        _WORKER_CACHE[key] = w
    return w


def _vector_column(vectors: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1)))


def _lengths(seqs: list[np.ndarray], cfg: ModelConfig) -> np.ndarray:
    lens = np.array([len(s) for s in seqs])
    if ((lens < 1) | (lens > cfg.max_seq)).any():
        raise ValueError("id sequence length outside 1..max_seq")
    return lens


def _encode_all(seqs: list[np.ndarray], lens: np.ndarray, w: dict[str, np.ndarray], cfg: ModelConfig,
                token_budget: int) -> np.ndarray:
    """Ragged calls of at most ``token_budget`` tokens, shortest first so equal lengths
    share attention groups."""
    out = np.zeros((len(seqs), cfg.hidden), dtype=np.float32)
    order = np.argsort(lens, kind="stable")
    lo = 0
    while lo < len(order):
        hi, used = lo, 0
        while hi < len(order) and (hi == lo or used + lens[order[hi]] <= token_budget):
            used += int(lens[order[hi]])
            hi += 1
        part = order[lo:hi]
        out[part] = encode_batch([seqs[i] for i in part], w, cfg)
        lo = hi
    return out


def _embed_fn(model: Model, id_cols: list[str], ids_col: str, token_budget: int,
              carry: list[str] = ()):
    cfg, bc, key = model.config, model.weights_bc, model.key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit_blas_threads(1)
        w = _weights(bc, key)
        for pdf in batches:
            if pdf.empty:
                continue
            seqs = [np.asarray(s, dtype=np.int64) for s in pdf[ids_col]]
            lens = _lengths(seqs, cfg)
            flat = np.concatenate(seqs)
            if flat.min() < 0 or flat.max() >= cfg.vocab_size:
                raise ValueError("token id outside the vocabulary")
            res = pdf[id_cols + list(carry)].copy()
            res["n_tokens"] = lens.astype(np.int32)
            res["embedding"] = list(_encode_all(seqs, lens, w, cfg, token_budget))
            yield res

    return run


def _block_fn(model: Model, kept: list[str], token_budget: int, schema: pa.Schema):
    cfg, bc, key = model.config, model.weights_bc, model.key

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        """One block: ids become places among the vectors of the block's words."""
        limit_blas_threads(1)
        ids, vectors = rows["_ids"].combine_chunks(), words["w"].combine_chunks()
        if ids.null_count:
            raise ValueError("id sequence is null")
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        lens = ids.value_lengths().to_numpy()
        known = words["token_id"].to_numpy()
        if (vectors.value_lengths().to_numpy() != cfg.hidden).any():
            raise ValueError(f"word vectors must have {cfg.hidden} numbers")
        table = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, cfg.hidden)
        order = np.argsort(known, kind="stable")
        near = np.searchsorted(known, flat, sorter=order)
        at = order[np.minimum(near, len(known) - 1)] if len(known) else near
        if len(flat) and (not len(known) or (known[at] != flat).any()):
            raise ValueError("token id outside the vocabulary")
        seqs = np.split(at, np.cumsum(lens)[:-1])
        out = _encode_all(seqs, _lengths(seqs, cfg), _weights(bc, key) | {EMBEDDING_TENSORS[0]: table}, cfg, token_budget)
        columns = [*(rows[c] for c in kept), pa.array(lens.astype(np.int32)), _vector_column(out)]
        return pa.table(columns, names=[*kept, "n_tokens", "embedding"]).cast(schema)

    return run


def _blocks(narrow: DataFrame, id_cols: list[str], dim: int, max_seq: int) -> tuple[DataFrame, int]:
    """(``narrow`` written, with its block ``_at``; number of blocks).  Rows are spread as
    by ``balance_by_length``; a part whose tokens are too many for one block is dealt
    out by row, so neither its size nor equal or null keys fill a block."""
    spark = narrow.sparkSession
    parts = encoder_partitions(spark)
    part = F.pmod(F.hash(F.xxhash64(*[F.col(c) for c in id_cols])), F.lit(parts))
    rows = stored(narrow.withColumn("_part", part).withColumn("_row", F.monotonically_increasing_id()), "encoded")
    tokens = {r["_part"]: r["_tokens"] for r in rows.groupBy("_part").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_tokens")).collect()}
    per = max(max_seq, BLOCK_BYTES // (4 * dim))
    many = [max(1, -(-tokens.get(k, 0) // per)) for k in range(parts)]
    first = np.cumsum([0, *many])
    starts = spark.createDataFrame([(k, int(first[k]), m) for k, m in enumerate(many)], "_part int, _first long, _many long")
    at = (F.col("_first") + F.pmod("_row", "_many")).cast("int").alias("_at")
    kept = [c for c in narrow.columns if c != "_n"]
    return rows.join(F.broadcast(starts), "_part").select(*kept, at), int(first[-1])


def _embed_by_blocks(narrow: DataFrame, model: Model, id_cols: list[str], kept: list[str],
                     token_budget: int, schema: T.StructType) -> DataFrame:
    """``embed`` for a model whose word embeddings are a table: only vectors of words
    that occur are sent, once per block."""
    rows, n = _blocks(narrow, id_cols, model.dim, model.max_seq)
    ids = F.col("_ids").cast("array<long>")
    pairs = stored(rows.select("_at", F.explode(ids).alias("token_id")).distinct(), "block-words")
    words = model.words.select(F.col("token_id").cast("long").alias("token_id"), "w")
    # the size of a drawn table is not known to Spark, that of the pairs is
    asked = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs.hint("merge")
    found = words.join(asked, "token_id").select("_at", "token_id", "w")

    def placed(df: DataFrame):
        return df.repartitionById(n, F.col("_at")).groupBy("_at")

    return placed(rows).cogroup(placed(found)).applyInArrow(
        _block_fn(model, kept, token_budget, to_arrow_schema(schema)), schema)


def embed(encoded: DataFrame, model: Model, id_col="doc_id", ids_col: str = "ids",
          balance: bool = True, token_budget: int = 4096, carry: Sequence[str] = ()) -> DataFrame:
    """``(*ids, ids array<int>)`` -> ``(*ids, *carry, n_tokens int, embedding array<float>)``.

    ``carry`` names narrow columns passed through unchanged (so no join is
    needed afterwards to bring them back).

    Rows with null ids (rejected upstream) must be filtered by the caller.
    ``mapInPandas`` is an optimisation barrier, so only the key and id columns
    cross into Python.  A model with a word table places rows by blocks, whatever
    ``balance``; an id that the table lacks fails the job.
    """
    ship_package(encoded.sparkSession)
    id_cols = [id_col] if isinstance(id_col, str) else list(id_col)
    carry = list(carry)
    narrow = encoded.select(*id_cols, *carry, F.col(ids_col).alias("_ids"),
                            F.size(ids_col).alias("_n"))
    schema = T.StructType([encoded.schema[c] for c in id_cols + carry] + [
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType()))])
    if model.words is not None:
        return _embed_by_blocks(narrow, model, id_cols, id_cols + carry, token_budget, schema)
    if balance:
        narrow = balance_by_length(narrow, "_n", key_cols=id_cols)
    narrow = narrow.drop("_n")
    return narrow.mapInPandas(_embed_fn(model, id_cols, "_ids", token_budget, carry), schema)


def token_embeddings(tokens: DataFrame, word_emb: DataFrame, pos_emb: DataFrame,
                     type_vec: list[float], id_col="doc_id") -> DataFrame:
    """``x[t] = word[id[t]] + pos[t] + type[0]`` in relational form.

    ``tokens``: (*ids, pos, token_id), written once; ``word_emb``: (token_id, w
    array<double>), one row per id, joined by broadcast for ids that hold more than
    1e-4 of all tokens and by size for the rest (``heavy_join``); ``pos_emb``: (pos, p array<double>) -- bounded by max_seq,
    always broadcast.  A token id or position without a row fails the job, as
    a token would otherwise be lost.
    """
    id_cols = [id_col] if isinstance(id_col, str) else list(id_col)
    tv = F.array(*[F.lit(float(x)) for x in type_vec])
    j = heavy_join(stored(tokens, "tokens"), word_emb, "token_id").join(F.broadcast(pos_emb), "pos", "left")
    x = F.zip_with(F.zip_with("w", "p", lambda a, b: a + b), tv, lambda a, b: a + b)
    lost = F.raise_error(F.format_string("no embedding for token %s at position %s", "token_id", "pos"))
    known = F.col("w").isNotNull() & F.col("p").isNotNull()
    return j.select(*id_cols, "pos", "token_id",
                    F.when(known, x).otherwise(lost.cast("array<double>")).alias("x"))
