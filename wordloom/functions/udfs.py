"""SQL surface.

``register_udfs`` registers, for use in ``spark.sql``:
  * ``token_count(text)``  -- Arrow-batched pandas UDF (U2)
  * ``embed_text(text)``   -- iterator pandas UDF, weights loaded once per worker (U1)
  * ``token_rows(TABLE(encoded) [PARTITION BY ...])`` -- Arrow UDTF over a table of
    encoded texts (doc_id, tokens, ids): rows ``(doc_id, pos, token, id)``, whole
    Arrow batches at a time (U3)
  * ``tokenize(text)``     -- Python UDTF for a single text: rows ``(pos, token, id)`` via LATERAL
The vocabulary reaches workers as a size-checked broadcast.  For whole tables
prefer the relational functions (``operators.wordpiece.tokenize`` + ``embed``),
which keep tokenisation inside Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MAX_SEQ
from ..operators.embed import Model, _weights
from ..operators.encoder_math import encode_batch, limit_blas_threads
from ..session import ship_package
from .pytokenizer import PyWordPiece

VOCAB_BROADCAST_MAX_BYTES = 256 << 20
_TOKENIZERS: dict[str, PyWordPiece] = {}


def _tokenizer(vbc) -> PyWordPiece:
    """``vbc`` = (stable key, broadcast dict); worker-side broadcasts carry no id."""
    key, bc = vbc
    tk = _TOKENIZERS.get(key)
    if tk is None:
        tk = PyWordPiece(bc.value)
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = tk
    return tk


def vocab_broadcast(spark: SparkSession, vocab: DataFrame):
    size = vocab.agg(F.coalesce(F.sum(F.octet_length("token") + 8), F.lit(0))).first()[0]
    if size > VOCAB_BROADCAST_MAX_BYTES:
        raise ValueError(f"vocabulary of {size} bytes is too large for a per-worker table; "
                         "use operators.wordpiece.tokenize, which joins it")
    import uuid
    return (uuid.uuid4().hex,
            spark.sparkContext.broadcast({r["token"]: int(r["id"]) for r in vocab.collect()}))


def make_token_count(vbc, max_seq: int = MAX_SEQ):
    @F.pandas_udf(T.IntegerType())
    def token_count(texts: pd.Series) -> pd.Series:
        tk = _tokenizer(vbc)
        return texts.map(lambda t: 0 if t is None else len(tk.encode(t, max_seq, True))).astype("int32")
    return token_count


def make_embed_text(vbc, model: Model):
    cfg, wbc, wkey = model.config, model.weights_bc, model.key

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        limit_blas_threads(1)
        tk, w = _tokenizer(vbc), _weights(wbc, wkey)
        for texts in batches:
            some = [i for i, t in enumerate(texts) if t is not None]
            ids = [np.array(tk.encode(texts.iloc[i], cfg.max_seq, True)) for i in some]
            out = [None] * len(texts)                   # a null text has no vector
            for s in range(0, len(ids), 64):
                for i, v in zip(some[s:s + 64], encode_batch(ids[s:s + 64], w, cfg)):
                    out[i] = v.astype(np.float32)
            yield pd.Series(out)
    return embed_text


def make_tokenize_udtf(vbc, max_seq: int = MAX_SEQ):
    class Tokenize:
        def eval(self, text: str):
            if text is None:
                return
            tk = _tokenizer(vbc)
            body = tk.tokens(text)[:max_seq - 2]
            ids = [tk.cls] + [tk.vocab.get(t, tk.unk) for t in body] + [tk.sep]
            for pos, (tok, i) in enumerate(zip(["[CLS]", *body, "[SEP]"], ids)):
                yield pos, tok, i

    return F.udtf(Tokenize, returnType="pos int, token string, id int")


def make_token_rows():
    """The token table as a table function.  Tokenising is the relational plan's
    work (``tokenize`` and ``encode``); a batch of encoded texts becomes its tokens by
    flattening its lists, without a Python object per token."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        given = batch.filter(pc.is_valid(batch.column("ids")))
        ids, tokens = given.column("ids"), given.column("tokens")
        lens = np.asarray(pc.list_value_length(ids), dtype=np.int64)
        pos = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        yield pa.table({"doc_id": given.column("doc_id").take(pc.list_parent_indices(ids)),
                        "pos": pa.array(pos, pa.int32()), "token": pc.list_flatten(tokens), "id": pc.list_flatten(ids)})

    # Spark reads the types themselves, not their names
    eval.__annotations__ = {"batch": pa.RecordBatch, "return": Iterator[pa.Table]}
    handler = type("TokenRows", (), {"eval": eval, "__module__": __name__})
    return F.arrow_udtf(handler, returnType="doc_id bigint, pos int, token string, id int")


def register_udfs(spark: SparkSession, vocab: DataFrame, model: Model | None = None) -> None:
    ship_package(spark)
    vbc = vocab_broadcast(spark, vocab)
    spark.udf.register("token_count", make_token_count(vbc))
    spark.udtf.register("tokenize", make_tokenize_udtf(vbc))
    spark.udtf.register("token_rows", make_token_rows())
    if model is not None:
        spark.udf.register("embed_text", make_embed_text(vbc, model))
