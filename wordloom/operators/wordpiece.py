"""WordPiece tokenisation as a relational plan.

Plan (Catalyst; Arrow only to put the bodies of many texts together, step 4):
  1. one pass over the texts: every row gets a key of its own, and its chunks are
     written once
  2. the longest token at the beginning of each distinct word (map-side partial
     aggregation collapses hot words) and at every later character is searched by
     halving over token lengths in a table of token prefixes: log2(longest token)
     joins with a small table instead of one candidate per length
  3. the greedy walk takes the longest hit at the current position, in runs of
     ``WINDOW`` hits, so its work is linear in the length of the word; a position
     without a hit makes the word ``[UNK]``
  4. few occurrences (counted) join the segmentation of their word and regroup by
     row.  Of many none is shuffled: texts are dealt into blocks of about 8 MB, a
     block sends each distinct word once and gets its pieces back, and its bodies
     are put together where its texts are (``_by_blocks``)
Rows are told apart by their own key: equal or null ids never mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..constants import (CLS_FALLBACK_ID, CLS_TOKEN, CONTINUATION_PREFIX,
                         MAX_CHUNKS, MAX_SEQ, SEP_FALLBACK_ID, SEP_TOKEN,
                         UNK_FALLBACK_ID, UNK_TOKEN)
from ..functions.text import basic_tokenize, clip_chars, utf8_valid
from ..functions.vectors import let
from ..session import ship_package, spread, stored
from .heavy import SUPPORT, split_join

WINDOW = 256          # characters per window of a word
# up to so many occurrences one plain join costs less than the preparation of blocks
PLAIN_JOIN_ROWS = 2_000_000
BLOCK_BYTES = 8 << 20  # text of a block
# an index of so many tokens at most is broadcast, whatever its files' size (about 100 MB)
BROADCAST_TOKENS = 500_000
HEAVY_PIECES = 64     # a word of more pieces is never broadcast: bounds the rows that are


@dataclass(frozen=True)
class VocabInfo:
    """Small facts about a vocabulary table, computed by one aggregate."""
    rows: int
    max_token_chars: int
    unk_id: int
    cls_id: int
    sep_id: int
    max_id: int = 0
    # longest continuation token ("##..."), counted without the prefix
    max_cont_chars: int = 0
    # marker table of the vocabulary, if it is kept (``with_index``)
    index: DataFrame | None = field(default=None, compare=False, repr=False)


def vocab_info(vocab: DataFrame) -> VocabInfo:
    def special(tok: str) -> Column:
        return F.min(F.when(F.col("token") == tok, F.col("id")))

    r = vocab.agg(F.count(F.lit(1)).alias("n"),
                  F.max(F.length("token")).alias("L"),
                  special(UNK_TOKEN).alias("unk"),
                  special(CLS_TOKEN).alias("cls"),
                  special(SEP_TOKEN).alias("sep"),
                  F.max("id").alias("max_id"),
                  F.max(F.when(F.col("token").startswith(CONTINUATION_PREFIX),
                               F.length("token") - len(CONTINUATION_PREFIX))).alias("Lc")).first()
    return VocabInfo(
        rows=int(r["n"]), max_token_chars=int(r["L"] or 0),
        unk_id=UNK_FALLBACK_ID if r["unk"] is None else int(r["unk"]),
        cls_id=CLS_FALLBACK_ID if r["cls"] is None else int(r["cls"]),
        sep_id=SEP_FALLBACK_ID if r["sep"] is None else int(r["sep"]),
        max_id=int(r["max_id"] or 0),
        max_cont_chars=int(r["Lc"] or 0))


def with_index(vocab: DataFrame, info: VocabInfo | None = None) -> VocabInfo:
    """``info`` with the stored marker table, for a vocabulary that is used repeatedly."""
    info = info or vocab_info(vocab)
    return replace(info, index=stored(prefix_index(vocab, info), "prefix-index"))


# ---------------------------------------------------------------- longest prefix search

def _halvings(longest: int) -> list[tuple[int, int]]:
    """(n, m): on its way to length ``n`` a search by halving over 1..longest looks at ``m <= n``."""
    out = []
    for n in range(1, longest + 1):
        lo, hi = 1, longest
        while lo <= hi:
            m = (lo + hi) // 2
            if m <= n:
                out.append((n, m))
                lo = m + 1
            else:
                hi = m - 1
    return out


def prefix_index(vocab: DataFrame, info: VocabInfo) -> DataFrame:
    """Markers for a longest-prefix search by halving over token lengths.

    Rows ``(mark, best)``: ``mark`` is a kind (``a`` the beginning of a word, ``b`` a
    later place) and a prefix of a token at which the search may look; ``best``
    (length * 2^32 + id, or null) is the longest token that begins the prefix.  A
    hit says that longer tokens may fit and which one fits already, a miss that
    only shorter ones can.  A token has at most log2(longest) markers.
    """
    cont = F.col("token").startswith(CONTINUATION_PREFIX) & (F.length("token") > len(CONTINUATION_PREFIX))
    bare = F.substring(F.col("token"), F.lit(len(CONTINUATION_PREFIX) + 1), F.length("token"))
    tokens = (vocab.where(F.length("token") > 0).select(F.lit("a").alias("kind"), F.col("token").alias("piece"), "id")
              .unionByName(vocab.where(cont).select(F.lit("b").alias("kind"), bare.alias("piece"), "id"))
              .withColumn("n", F.length("piece")))
    steps = [("a", *x) for x in _halvings(info.max_token_chars)] + [("b", *x) for x in _halvings(info.max_cont_chars)]
    looks = vocab.sparkSession.createDataFrame(steps, "kind string, n int, m int")
    marks = (tokens.join(looks, ["kind", "n"])
             .select("kind", F.substring(F.col("piece"), F.lit(1), F.col("m")).alias("mark")).distinct())
    begins = F.transform(F.sequence(F.lit(1), F.length("mark")), lambda k: F.substring(F.col("mark"), F.lit(1), k))
    value = (F.col("n").cast("long") * (1 << 32) + F.col("id")).alias("value")
    best = (marks.select("kind", "mark", F.explode(begins).alias("piece"))
            .join(tokens.select("kind", "piece", value), ["kind", "piece"], "left")
            .groupBy("kind", "mark").agg(F.max("value").alias("best")))
    return best.select(F.concat("kind", "mark").alias("mark"), "best")


def _search(rows: DataFrame, index: DataFrame, kind: str, text: Column, longest: int, out: str) -> DataFrame:
    """``rows`` with ``out`` = ``best`` of the longest token that begins ``text`` (null:
    none).  One left join per halving; Spark broadcasts an index of known small
    size, so the rows keep their place and partitioning."""
    own = list(rows.columns)
    rows = rows.select(*own, F.substring(text, F.lit(1), F.lit(longest)).alias("_t"), F.lit(1).alias("_lo"),
                       F.lit(longest).alias("_hi"), F.lit(None).cast("long").alias(out))
    for _ in range(longest.bit_length()):
        m = F.when(F.col("_lo") <= F.col("_hi"), F.shiftright(F.col("_lo") + F.col("_hi"), 1))
        look = F.when(m <= F.length("_t"), F.concat(F.lit(kind), F.substring(F.col("_t"), F.lit(1), m)))
        marks = index.select(F.col("mark").alias("_mark"), F.col("best").alias("_best"))
        rows = rows.select("*", m.alias("_m"), look.alias("_look")).join(marks, F.col("_look") == F.col("_mark"), "left")
        hit = F.col("_mark").isNotNull()
        rows = rows.select(*own, "_t", F.when(hit, F.col("_m") + 1).otherwise(F.col("_lo")).alias("_lo"),
                           F.when(hit | F.col("_m").isNull(), F.col("_hi")).otherwise(F.col("_m") - 1).alias("_hi"),
                           F.when(hit, F.col("_best")).otherwise(F.col(out)).alias(out))
    return rows.select(*own, out)


def _walk(hits: Column, start: Column, kind: str) -> Column:
    """Greedy walk from character ``start`` over ``hits`` (sorted structs with s, l):
    struct(nxt, ok, parts array of arrays of the hits taken).  Hits are taken in
    runs of ``WINDOW``, so a list that grows stays short."""

    def step(acc: Column, e: Column) -> Column:
        at = acc["ok"] & (e["s"] == acc["nxt"])
        return F.struct(
            F.when(at, e["s"] + e["l"]).otherwise(acc["nxt"]).alias("nxt"),
            (acc["ok"] & (e["s"] <= acc["nxt"])).alias("ok"),
            F.when(at, F.concat(acc["taken"], F.array(e))).otherwise(acc["taken"]).alias("taken"))

    def run(acc: Column, w: Column) -> Column:
        inner = F.aggregate(F.slice(hits, w * WINDOW + 1, F.lit(WINDOW)),
                            F.struct(acc["nxt"].alias("nxt"), acc["ok"].alias("ok"),
                                     F.array().cast(f"array<{kind}>").alias("taken")), step)
        return let(inner, lambda r: F.struct(r["nxt"].alias("nxt"), r["ok"].alias("ok"),
                                             F.concat(acc["parts"], F.array(r["taken"])).alias("parts")))

    runs = F.sequence(F.lit(0), F.floor(F.size(hits) / WINDOW).cast("int"))
    return F.aggregate(runs, F.struct(start.alias("nxt"), F.lit(True).alias("ok"),
                                      F.array().cast(f"array<array<{kind}>>").alias("parts")), run)


def segment_words(words: DataFrame, vocab: DataFrame, info: VocabInfo | None = None,
                  word_col: str = "word", with_pieces: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Distinct words -> ``(word, *carry, pieces array<string>, piece_ids array<int>)``
    (``with_pieces=False``: ids only).

    Greedy longest match from the left; non-first pieces carry ``##``; a
    position without any match turns the whole word into one ``[UNK]``.
    ``words`` must hold each word once.

    The longest token at a word's beginning is searched once per word; what it
    leaves is cut into windows and searched at every character.  Each search
    takes log2 of the longest token many probes of a marker table (``prefix_index``).
    All of it runs where the word is: words that come partitioned by themselves
    (out of ``distinct``) are grouped again without another exchange.
    """
    info = info or vocab_info(vocab)
    index = info.index if info.index is not None else stored(prefix_index(vocab, info), "prefix-index")
    if info.rows <= BROADCAST_TOKENS:
        index = F.broadcast(index)
    cont = info.max_cont_chars
    window = max(WINDOW, cont)
    keys = ["word", *carry, "_first"]
    own = _search(words.select(F.col(word_col).alias("word"), *carry), index, "a", F.col("word"), info.max_token_chars, "_first")
    taken = F.coalesce(F.shiftright("_first", 32), F.lit(0)).cast("int")
    rest = F.when(F.col("_first").isNotNull() & (F.length("word") > taken),
                  F.substring(F.col("word"), taken + 1, F.length("word")))
    # windows of the rest, each with the characters that a token may reach beyond it
    windows = let(F.regexp_extract_all(rest, F.lit(f"(?s).{{1,{window}}}"), F.lit(0)), lambda parts: F.transform(
        parts, lambda x, w: F.struct((taken + w * window).alias("before"), F.length(x).alias("n"), F.concat(
            x, F.substring(F.coalesce(F.get(parts, w + 1), F.lit("")), F.lit(1), F.lit(max(cont - 1, 0)))).alias("c"))))
    cut = own.select(*keys, F.explode_outer(windows).alias("x"))
    at = cut.select(*keys, "x.before", "x.c", F.explode_outer(
        F.when(F.col("x.n") > 0, F.sequence(F.lit(1), F.col("x.n")))).alias("i"))
    found = _search(at.select(*keys, (F.col("before") + F.col("i")).alias("_s"),
                              F.substring(F.col("c"), F.col("i"), F.lit(max(cont, 1))).alias("_c")),
                    index, "b", F.col("_c"), cont, "_b")
    size = F.shiftright("_b", 32).cast("int")
    low = F.lit((1 << 32) - 1)
    fields = [F.col("_s").alias("s"), size.alias("l"), F.col("_b").bitwiseAND(low).cast("int").alias("id")]
    kind = "struct<s:int,l:int,id:int>"
    if with_pieces:
        fields.append(F.concat(F.lit(CONTINUATION_PREFIX), F.substring(F.col("_c"), F.lit(1), size)).alias("piece"))
        kind = "struct<s:int,l:int,id:int,piece:string>"
    hits = F.array_sort(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct(*fields))))
    by_word = found.groupBy(*keys).agg(hits.alias("_hits"))
    walked = by_word.withColumn("_st", _walk(F.col("_hits"), taken + 1, kind))
    ok = F.col("_first").isNotNull() & F.col("_st.ok") & (F.col("_st.nxt") == F.length("word") + 1)
    parts = F.flatten("_st.parts")
    ids = F.concat(F.array(F.col("_first").bitwiseAND(low).cast("int")), F.transform(parts, lambda e: e["id"]))
    out = [F.col("word").alias(word_col), *carry]
    if with_pieces:
        pieces = F.concat(F.array(F.substring(F.col("word"), F.lit(1), taken)), F.transform(parts, lambda e: e["piece"]))
        out.append(F.when(ok, pieces).otherwise(F.array(F.lit(UNK_TOKEN))).alias("pieces"))
    return walked.select(*out, F.when(ok, ids).otherwise(F.array(F.lit(info.unk_id))).alias("piece_ids"))


def _ids(id_col) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def text_error(text: Column) -> Column:
    """Reason why a text is refused: ``null_text``, ``invalid_utf8`` or null."""
    return (F.when(text.isNull(), "null_text")
            .when(~utf8_valid(text), "invalid_utf8"))


def chunk_table(docs: DataFrame, text_col: str = "text", id_col="doc_id",
                carry: Sequence[str] = (), clip: int | None = None,
                max_chunks: int | None = None) -> DataFrame:
    """C1 exploded: ``(*ids, *carry, pos, word)``; documents without chunks keep
    one row with null ``pos``/``word`` so they are not lost."""
    text = F.col(text_col)
    if clip is not None:
        text = clip_chars(text, clip)
    return docs.select(*_ids(id_col), *carry,
                       F.posexplode_outer(basic_tokenize(text, max_chunks)).alias("pos", "word"))


def tokenize(docs: DataFrame, vocab: DataFrame, text_col: str = "text",
             id_col="doc_id", carry: Sequence[str] = (), clip: int | None = None,
             info: VocabInfo | None = None, max_chunks: int | None = MAX_CHUNKS,
             with_tokens: bool = True) -> DataFrame:
    """``(id, *carry, body_tokens array<string>, body_ids array<int>,
    text_error string)``: pieces of the first ``max_chunks`` chunks (None: of
    all), in order, without CLS/SEP.  ``with_tokens=False`` regroups ids only
    (``body_tokens`` is null).

    A null text or one that is not valid UTF-8 (a string or binary column) has
    null tokens and ids and its ``text_error``.  Each input row gives one output
    row, whatever its id.

    ``docs`` is read once: the chunks of each row are written to the shared folder
    and the distinct words, the join and the regrouping read that table.
    """
    info = info or vocab_info(vocab)
    ids = _ids(id_col)
    raw = F.col(text_col)
    text = raw.cast("string")
    bad = text_error(text)
    shown = text if clip is None else clip_chars(text, clip)
    chunks = F.when(F.col("text_error").isNull(), basic_tokenize(F.col("_text"), max_chunks))
    head = F.struct(*[F.col(c) for c in [*ids, *carry]], F.col("text_error"))
    given = spread(docs.select(*ids, *carry, text_col))
    # a chunk holds no blank, so the chunks of a text are one string
    rows = stored(given.select(F.monotonically_increasing_id().alias("_row"), *ids, *carry, bad.alias("text_error"),
                               shown.alias("_text"))
                  .select("_row", head.alias("_head"), chunks.alias("_chunks"))
                  .select("_row", "_head", F.array_join("_chunks", " ").alias("_chunks"), F.size("_chunks").alias("_n")),
                  "chunks")
    n_words, size = rows.agg(F.sum(F.when(F.col("_n") > 0, F.col("_n"))), F.sum(F.octet_length("_chunks"))).first()
    fields = ["piece_ids"] + (["pieces"] if with_tokens else [])
    if (n_words or 0) <= PLAIN_JOIN_ROWS:
        bodies = _by_rows(rows, vocab, info, fields)
    else:
        bodies = _by_blocks(rows, int(size or 0), vocab, info, fields)
    toks = F.col("pieces") if with_tokens else F.lit(None).cast("array<string>")
    return bodies.select(*[F.col("_head")[c].alias(c) for c in [*ids, *carry]], toks.alias("body_tokens"),
                         F.col("piece_ids").alias("body_ids"), F.col("_head.text_error").alias("text_error"))


def _chunk_list() -> Column:
    return F.when(F.col("_chunks") != "", F.split("_chunks", " "))


def _by_rows(rows: DataFrame, vocab: DataFrame, info: VocabInfo, fields: Sequence[str]) -> DataFrame:
    """``(_head, *fields)`` per row: every occurrence joins its word's pieces, and the
    occurrences regroup by row."""
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    occ = (rows.select("_row", "_head", F.posexplode_outer(_chunk_list()).alias("pos", "word"))
           .select("_row", "pos", "word", F.when(first, F.col("_head")).alias("_head")))
    words = occ.where(F.col("word").isNotNull()).select("word").distinct()
    seg = segment_words(words, vocab, info, with_pieces="pieces" in fields)
    part = F.when(F.col("pos").isNotNull(), F.struct("pos", *fields))
    grouped = occ.join(seg, "word", "left").groupBy("_row").agg(
        F.first("_head", ignorenulls=True).alias("_head"), F.array_sort(F.collect_list(part)).alias("_parts"))
    fine = F.col("_head.text_error").isNull()
    return grouped.select("_head", *[F.when(fine, F.flatten(F.col(f"_parts.{f}"))).alias(f) for f in fields])


def _by_blocks(rows: DataFrame, size: int, vocab: DataFrame, info: VocabInfo, fields: Sequence[str]) -> DataFrame:
    """``_by_rows`` for many occurrences, of which none is shuffled.

    The texts are dealt into blocks.  A block sends each of its distinct words once,
    and each word's pieces come back once per block; words in many blocks are joined
    by broadcast (at most 1 / SUPPORT of them).  A block's texts then meet its words'
    pieces, and its bodies are put together by Arrow (``_bodies``).
    """
    ship_package(rows.sparkSession)
    part = F.shiftright("_row", 33)            # rows written by one task
    parts = rows.groupBy(part.alias("_part")).agg(F.sum(F.octet_length("_chunks")).alias("_size"))
    parts = stored(parts.select("_part", F.ceil(F.coalesce("_size", F.lit(0)) / BLOCK_BYTES).alias("_many")), "block-counts")
    # a task's rows go to blocks of their own, so its words are made distinct before they are sent
    blocks = rows.withColumn("_part", part).join(F.broadcast(parts), "_part").withColumn(
        "_block", F.xxhash64("_part", F.pmod("_row", F.greatest(F.lit(1).cast("long"), F.col("_many")))))
    known = stored(blocks.select("_block", F.explode(_chunk_list()).alias("word")).distinct(), "block-words")
    seg = stored(segment_words(known.groupBy("word").agg(F.count(F.lit(1)).alias("_n")), vocab, info,
                               with_pieces="pieces" in fields, carry=["_n"]), "segments")
    total = seg.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    heavy = (F.col("_n") > SUPPORT * total) & (F.size("piece_ids") <= HEAVY_PIECES)
    pieces = split_join(known, seg, "word", heavy).select("_block", "word", *fields)
    schema = T.StructType([rows.schema["_head"], *[pieces.schema[f] for f in fields]])
    return (blocks.select("_block", "_head", "_chunks").groupBy("_block").cogroup(pieces.groupBy("_block"))
            .applyInArrow(_bodies(list(fields), to_arrow_schema(schema)), schema))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _bodies(fields: list[str], schema: pa.Schema):
    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        """One block: each text's chunks looked up among the block's words, their
        pieces laid out one after another."""
        chunks, head = _whole(texts["_chunks"]), _whole(texts["_head"])
        chunks = pc.if_else(pc.equal(chunks, ""), pa.scalar(None, chunks.type), chunks)
        lists = pc.split_pattern(chunks, " ")
        of_row = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.index_in(lists.flatten(), value_set=_whole(known["word"]))
        if at.null_count:
            raise ValueError("a word of the block has no pieces")
        at = at.to_numpy()
        n = pc.list_value_length(_whole(known["piece_ids"])).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(n[at])])
        pick = np.arange(upto[-1]) + np.repeat((np.cumsum(n) - n)[at] - upto[:-1], n[at])
        offsets = pa.array(upto[np.concatenate([[0], np.cumsum(of_row)])], pa.int32())
        refused = pc.is_valid(pc.struct_field(head, "text_error"))
        out = [pa.ListArray.from_arrays(offsets, _whole(known[f]).flatten().take(pa.array(pick)), mask=refused) for f in fields]
        return pa.table([head, *out], names=["_head", *fields]).cast(schema)

    return run


def encode(tokenized: DataFrame, info: VocabInfo, max_seq: int = MAX_SEQ,
           policy: str = "truncate") -> DataFrame:
    """C5 + B6: ``[CLS] + body[:max_seq-2] + [SEP]`` with an over-length policy.

    A text refused by ``tokenize`` is ``rejected`` with its reason, null ids and
    0 tokens under every policy.
    ``truncate`` keeps the first max_seq-2 body tokens (SEP always last);
    ``reject`` keeps over-length rows with ``status='rejected'`` and null ids
    (route them to a rejects table); ``fail`` raises on the first one.
    max_seq < 2 is always an error.  Adds ``n_body``, ``truncated``,
    ``ids``, ``tokens``, ``n_tokens`` (C6) and ``status``/``reason``.
    """
    if max_seq < 2:
        raise ValueError("max_seq must be at least 2 (room for [CLS] and [SEP])")
    if policy not in ("truncate", "reject", "fail"):
        raise ValueError(f"unknown over-length policy {policy!r}")
    cap = max_seq - 2
    if "text_error" not in tokenized.columns:
        tokenized = tokenized.withColumn("text_error", F.lit(None).cast("string"))
    body_ids, body_toks = F.col("body_ids"), F.col("body_tokens")
    refused = F.col("text_error").isNotNull()
    over = ~refused & F.coalesce(F.size(body_ids) > cap, F.lit(False))
    ids = F.concat(F.array(F.lit(info.cls_id)), F.slice(body_ids, 1, cap), F.array(F.lit(info.sep_id)))
    toks = F.concat(F.array(F.lit(CLS_TOKEN)), F.slice(body_toks, 1, cap), F.array(F.lit(SEP_TOKEN)))
    keep = ~refused
    if policy == "reject":
        keep = keep & ~over
    if policy == "fail":
        ids = F.when(over, F.raise_error(F.lit(f"text longer than {cap} body tokens"))).otherwise(ids)
    out = (tokenized.withColumn("n_body", F.when(~refused, F.size(body_ids)).otherwise(0))
           .withColumn("over_length", over)
           .withColumn("ids", F.when(keep, ids)).withColumn("tokens", F.when(keep, toks))
           .withColumn("status", F.when(keep, "ok").otherwise("rejected"))
           .withColumn("reason", F.when(refused, F.col("text_error")).when(~keep, F.lit("over_length"))))
    return (out.withColumn("truncated", over & F.lit(policy == "truncate"))
               .withColumn("n_tokens", F.when(F.col("ids").isNotNull(), F.size("ids")).otherwise(0))
               .drop("body_ids", "body_tokens", "text_error"))


def token_count(encoded: DataFrame) -> Column:
    """Encoded length after truncation, CLS and SEP included; null -> 0."""
    return F.when(F.col("ids").isNotNull(), F.size("ids")).otherwise(0)


def token_table(encoded: DataFrame, id_col="doc_id") -> DataFrame:
    """C4: one row per token: ``(*ids, pos, token, token_id)``."""
    ids = _ids(id_col)
    # tokens may be null (ids-only tokenisation): pair ids with null texts
    toks = F.coalesce(F.col("tokens"), F.array_repeat(F.lit(None).cast("string"), F.size("ids")))
    return encoded.where(F.col("ids").isNotNull()).select(
        *ids, F.posexplode(F.arrays_zip(toks.alias("token"),
                                          F.col("ids").alias("token_id"))).alias("pos", "t")
    ).select(*ids, "pos", F.col("t.token").alias("token"), F.col("t.token_id").alias("token_id"))


def validate_ids(df: DataFrame, vocab_rows: int, ids_col: str = "ids",
                 max_seq: int = MAX_SEQ) -> DataFrame:
    """Pre-tokenised id sequences: 1 <= length <= max_seq (never truncated)
    and every id in [0, vocab_rows).  Adds ``status``/``reason`` columns."""
    ids = F.col(ids_col)
    bad_len = ids.isNull() | (F.size(ids) < 1) | (F.size(ids) > max_seq)
    bad_id = ~F.forall(ids, lambda x: x.isNotNull() & (x >= 0) & (x < vocab_rows))
    return df.withColumn("status", F.when(bad_len | bad_id, "rejected").otherwise("ok")) \
             .withColumn("reason", F.when(bad_len, "bad_length").when(bad_id, "id_out_of_range"))
