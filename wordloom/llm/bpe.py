"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a
merge, so the text may be cut between the two bytes; the fragments are encoded
independently and their ids concatenated.  Three guards keep the cuts equal to
the tokenizer's own pre-tokenisation of the whole text:

* no cut inside a UTF-8 character (a fragment must be text);
* no cut after white space (a run of spaces is split by what follows it);
* no cut before an apostrophe (whether ``'s`` is a contraction depends on the
  character before it).

Every other rule of the pre-tokeniser looks at one run of letters, digits or
other characters only, and a cut inside a run leaves both parts in their class.
Special strings count as tokens, so they are never cut.

Fragments repeat heavily (they are about one word each), so a worker keeps a
bounded fragment -> ids table and gives the library only the distinct new ones.
Encoding and decoding run inside the scan's tasks: no shuffle, no driver data.
The only broadcast is the tokenizer file (size checked).

Nulls encode as the empty text (no ids); null ids decode to the empty text;
ids outside the vocabulary decode to nothing.  An input column named like the
output column is replaced.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_sizes, map_arrow, row_chunks

MAX_TOKENIZER_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
CHUNK_TOKENS = 1 << 19
CACHE_FRAGMENTS = 400_000
CACHE_TOKENS = 4_000_000


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others for code points from 256 on, in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    table.update({chr(256 + i): b for i, b in enumerate(rest)})
    return table


def token_bytes(spec: dict) -> list[bytes]:
    """Bytes of every id (ids without a token are empty)."""
    alphabet = byte_alphabet()
    vocab = dict(spec["model"]["vocab"])
    vocab.update({t["content"]: t["id"] for t in spec.get("added_tokens", [])})
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        if all(c in alphabet for c in token):
            out[i] = bytes(alphabet[c] for c in token)
        else:
            out[i] = token.encode()
    return out


def check_spec(spec: dict) -> None:
    """Refuse a tokenizer for which cutting the text is not provably safe."""
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is not None:
        raise ValueError("forced-boundary splitting needs a tokenizer without a normalizer")
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        raise ValueError("a byte-level tokenizer without prefix space is needed")
    if spec["model"].get("type") != "BPE" or spec["model"].get("ignore_merges"):
        raise ValueError("a BPE model with merges is needed")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")
           for t in spec.get("added_tokens", [])):
        raise ValueError("special tokens that look at their surroundings are not supported")


def cut_table(tokens: Sequence[bytes]) -> np.ndarray:
    """``table[left * 256 + right]`` is true where a cut is certain."""
    inside = np.zeros(65536, dtype=bool)
    for t in tokens:
        if len(t) > 1:
            a = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
            inside[a[:-1] * 256 + a[1:]] = True
    cut = ~inside.reshape(256, 256)
    cut[:, 0x80:0xC0] = False          # inside a UTF-8 character
    cut[:, 0x27] = False               # before an apostrophe
    for b in (*range(0x09, 0x0E), *range(0x1C, 0x21)):
        cut[b, :] = False              # after ASCII white space
    return cut.reshape(-1)


def wide_space_table() -> np.ndarray:
    """``table[before * 256 + last]``: these two bytes may end a non-ASCII
    white-space character (U+0085, U+00A0, U+1680, U+2000-200A, U+2028,
    U+2029, U+202F, U+205F, U+3000)."""
    t = np.zeros(65536, dtype=bool)
    for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        b = chr(c).encode()
        t[b[-2] * 256 + b[-1]] = True
    return t


class Fragments:
    """Encoder of one worker: cut tables, library tokenizer, fragment table."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        check_spec(spec)
        tok = Tokenizer.from_str(text)
        tok.no_truncation()
        tok.no_padding()
        self.encode_batch = getattr(tok, "encode_batch_fast", tok.encode_batch)
        self.cut = cut_table(token_bytes(spec))
        self.wide = wide_space_table()
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.off, self.len, self.tok = array("q"), array("q"), array("i")

    def _learn(self, new: list[bytes]) -> None:
        for lo in range(0, len(new), 20_000):
            part = new[lo:lo + 20_000]
            encoded = self.encode_batch([f.decode("utf-8") for f in part], add_special_tokens=False)
            for f, e in zip(part, encoded):
                ids = e.ids
                self.index[f] = len(self.off)
                self.off.append(len(self.tok))
                self.len.append(len(ids))
                self.tok.extend(ids)

    def _places(self, frags: list[bytes]) -> np.ndarray:
        """Table place of every fragment; new ones are encoded first."""
        k = np.fromiter(map(self.index.get, frags, repeat(-1)), dtype=np.int64, count=len(frags))
        miss = np.flatnonzero(k < 0).tolist()
        if miss:
            lost = [frags[i] for i in miss]
            self._learn(list(dict.fromkeys(lost)))
            k[miss] = [self.index[f] for f in lost]
        return k

    def boundaries(self, buf: bytes, ends: np.ndarray) -> np.ndarray:
        """Sorted fragment ends over concatenated texts (text ends included)."""
        a = np.frombuffer(buf, dtype=np.uint8)
        if a.size < 2:
            return np.unique(ends)
        code = (a[:-1].astype(np.uint16) << 8) | a[1:]
        cut = self.cut[code]
        cut[1:] &= ~self.wide[code[:-1]]
        mark = np.zeros(a.size + 1, dtype=bool)
        mark[1:-1] = cut
        mark[ends] = True
        mark[0] = False
        return np.flatnonzero(mark)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token offsets (one more than texts) and flat ids."""
        if len(self.index) > CACHE_FRAGMENTS or len(self.tok) > CACHE_TOKENS:
            self.clear()
        buf = b"".join(texts)
        ends = np.cumsum([0] + [len(t) for t in texts])
        if not buf:
            return np.zeros(len(texts) + 1, np.int32), np.empty(0, np.int32)
        stops = self.boundaries(buf, ends[1:])
        starts = np.concatenate(([0], stops[:-1]))
        frags = [buf[s:e] for s, e in zip(starts.tolist(), stops.tolist())]
        k = self._places(frags)
        lens = np.frombuffer(self.len, dtype=np.int64)[k]
        off = np.frombuffer(self.off, dtype=np.int64)[k]
        cum = np.concatenate(([0], np.cumsum(lens)))
        flat = np.repeat(off - cum[:-1], lens) + np.arange(cum[-1])
        ids = np.frombuffer(self.tok, dtype=np.int32)[flat]
        text_frag = np.searchsorted(stops, ends, side="left") + 1
        text_frag[ends == 0] = 0
        return cum[text_frag].astype(np.int32), ids


_WORKER: dict[str, Fragments] = {}


def _fragments(key: str, text: str) -> Fragments:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Fragments(text)
    return _WORKER[key]


def load_tokenizer(path: str) -> tuple[str, str]:
    """(digest, JSON text) of a tokenizer file; its size bounds the broadcast."""
    import hashlib
    import os

    if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"tokenizer file above {MAX_TOKENIZER_BYTES} bytes: {path}")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    check_spec(json.loads(text))
    return hashlib.sha256(text.encode()).hexdigest(), text


def valid_utf8(texts: list[bytes | None]) -> list[bytes]:
    """Nulls become empty; invalid bytes become U+FFFD, as in the library's own
    string input."""
    out = []
    for t in texts:
        t = t or b""
        try:
            t.decode("utf-8")
        except UnicodeDecodeError:
            t = t.decode("utf-8", "replace").encode()
        out.append(t)
    return out


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "ids",
           keep: Sequence[str] | None = None, decoded_col: str | None = None) -> DataFrame:
    """``df`` (its ``keep`` columns, default all) with ``out_col`` =
    array<int> of the whole text's token ids.  With ``decoded_col`` the ids
    are decoded again in the same pass."""
    key, text = load_tokenizer(tokenizer_path)
    shared = df.sparkSession.sparkContext.broadcast(text)
    keep = [c for c in (df.columns if keep is None else keep) if c not in (out_col, decoded_col)]
    src = "_bpe_bytes"
    while src in df.columns:
        src += "_"

    def make():
        enc = _fragments(key, shared.value)
        table = TokenBytes(shared.value) if decoded_col else None

        def run(batch: pa.RecordBatch):
            col = batch.column(batch.num_columns - 1)
            for lo, hi in row_chunks(byte_sizes(col), CHUNK_BYTES):
                offsets, ids = enc.encode(valid_utf8(col.slice(lo, hi - lo).to_pylist()))
                arrays = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                                   pa.array(ids, pa.int32()))]
                if table:
                    arrays.append(pa.array(table.decode(ids.astype(np.int64), offsets), pa.string()))
                yield lo, hi, arrays
        return run

    fields = [T.StructField(out_col, T.ArrayType(T.IntegerType()), False)]
    if decoded_col:
        fields.append(T.StructField(decoded_col, T.StringType(), False))
    return map_arrow(df.withColumn(src, F.col(text_col).cast("string").cast("binary")), keep, fields,
                     make, [src])


class TokenBytes:
    """Decoder of one worker: flat token bytes with offsets."""

    def __init__(self, text: str):
        tokens = token_bytes(json.loads(text))
        self.n = len(tokens)
        self.len = np.array([len(t) for t in tokens] + [0], dtype=np.int64)
        self.off = np.concatenate(([0], np.cumsum(self.len)[:-1]))
        self.bytes = np.frombuffer(b"".join(tokens) or b"\0", dtype=np.uint8)

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        k = np.where((flat >= 0) & (flat < self.n), flat, self.n)
        lens = self.len[k]
        cum = np.concatenate(([0], np.cumsum(lens)))
        pick = np.repeat(self.off[k] - cum[:-1], lens) + np.arange(cum[-1])
        buf = self.bytes[pick].tobytes()
        cut = cum[offsets].tolist()
        return [buf[s:e].decode("utf-8", "replace") for s, e in zip(cut[:-1], cut[1:])]


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded",
           keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``out_col`` = the text of ``ids_col`` (special tokens kept)."""
    _key, text = load_tokenizer(tokenizer_path)
    shared = df.sparkSession.sparkContext.broadcast(text)
    keep = [c for c in (df.columns if keep is None else keep) if c != out_col]
    src = "_bpe_ids"
    while src in df.columns:
        src += "_"

    def make():
        table = TokenBytes(shared.value)

        def run(batch: pa.RecordBatch):
            lists = batch.column(batch.num_columns - 1)
            sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            cum = np.concatenate(([0], np.cumsum(sizes)))
            flat = np.asarray(lists.flatten().fill_null(-1), dtype=np.int64)
            for lo, hi in row_chunks(sizes.tolist(), CHUNK_TOKENS):
                texts = table.decode(flat[cum[lo]:cum[hi]], cum[lo:hi + 1] - cum[lo])
                yield lo, hi, [pa.array(texts, pa.string())]
        return run

    src_df = df.withColumn(src, F.col(ids_col))
    return map_arrow(src_df, keep, [T.StructField(out_col, T.StringType(), False)], make, [src])


def ids_digest(ids_col: str):
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ",").cast("binary"), 256)
