"""Quality classifier: an interpolated modified Kneser-Ney model of character
n-grams, trained per language on trusted text, gives every document a
perplexity; language-specific quantiles of it decide.

1. Documents and their labels are dealt into blocks of a bounded number of
   bytes by a hash of the key; the documents of a task travel in compressed
   packs.  Each block reduces its whole texts to their distinct n-grams, with
   the counts from trusted training documents (map-side combine: a block sends
   each n-gram once).
2. The n-grams of all blocks are joined into one count table per order
   (continuation counts below the highest), sharded by (language, n-gram).
   Grouped sums give each history's total and discounted mass (the discounts come
   from the language's own counts of counts), and a chain of joins interpolates
   the probability of every n-gram that any document needs.
   All of it grows with the corpus and none of it meets in one task.
3. Each block gets the log-probabilities of the n-grams it asked for and sums
   them over its documents.

Trusted text is the text of documents labelled good outside the held-out fold;
thresholds are quantiles of the held-out good documents, so they are not
measured on the training text.  A document is rejected when its perplexity is
above the smaller of two such bounds: the ``quantile`` of its language, and the
median plus ``spread`` times the distance to the 95 % quantile (logs; with few
documents the quantile is their maximum, and one odd document would decide).
A language with fewer than ``MIN_HELD`` held-out good documents takes the
median of its documents outside the training text, and the distance to the
bound from the held-out good documents of all languages.

Python touches text only to turn it into n-grams and to add up their logs.

Nulls: a null or empty text has no perplexity and is not rejected.  A null
language is a language of its own.  With fewer than ``MIN_HELD`` held-out good
documents in all there is no pooled bound, and a language without a bound
rejects nothing.  A key with several labels is trusted
only if all are good; rows with a null key are scored and never trusted.
U+0002 marks text starts, so it is read as U+FFFD inside texts.  Inside a block
n-grams are told apart by a 64-bit hash of their characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import hand_on, scratch_scope, ship_package, small_batches, stored

ORDER = 5
BLOCK_BYTES = 48 << 20
PACK_BYTES = 1 << 19          # raw text; compressed packs stay far below half a heap region
PENDING_BYTES = 16 << 20
CHUNK_BYTES = 2 << 20
CHUNK_CHARS = 1 << 19
DENSE_KEYS = 1 << 25
START = "\x02"
QUANTILE = 0.995
SPREAD = 4.0
MIN_HELD = 20                 # from here on the 95 % quantile is not the maximum
FOLDS = 5
MANY_LANGUAGES = 100_000
NAMED_BLOCKS = 4096


# --- n-grams of a chunk of texts -------------------------------------------

def gram_keys(chars: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points."""
    key = np.full(len(chars), np.uint64(len(START)))
    for i in range(chars.shape[1]):
        key = (key ^ chars[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


class Chunk:
    """The distinct n-grams of a few texts (``grams``: their code points) and, per
    position, their number; ``starts``/``stops`` delimit each text's positions."""

    def __init__(self, texts: list[str], order: int):
        pad = START * (order - 1)
        a = code_points("".join(pad + t.replace(START, "\ufffd") for t in texts))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes + order - 1)[:-1])).astype(np.int64)
        self.stops = self.starts + sizes
        n = len(a) - order + 1
        char, width = _renumber(a)
        ids, count = char, width
        for k in range(1, order):
            ids, count = _renumber(ids[:len(ids) - 1] * width + char[k:])
        self.size, self.ids, self.count = n, ids, count
        self.inside = self._positions(np.ones(len(texts), dtype=bool))
        at = np.zeros(count, dtype=np.int64)
        at[ids] = np.arange(n)
        self.grams = a[at[:, None] + np.arange(order)]
        self.used = np.bincount(ids[self.inside], minlength=count)

    def _positions(self, chosen: np.ndarray) -> np.ndarray:
        mark = np.zeros(self.size + 1, dtype=np.int32)
        on = chosen & (self.stops > self.starts)
        np.add.at(mark, self.starts[on], 1)
        np.add.at(mark, self.stops[on], -1)
        return np.cumsum(mark[:-1]) > 0

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """Occurrences of every n-gram in the chosen texts."""
        return np.bincount(self.ids[self._positions(chosen)], minlength=self.count)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values[n-gram]`` over each text."""
        cum = np.concatenate(([0.0], np.cumsum(np.where(self.inside, values[self.ids], 0.0))))
        return cum[self.stops] - cum[self.starts]


def _renumber(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense numbers of the distinct keys, in key order."""
    keys = keys.astype(np.int64)
    if not len(keys):
        return keys, 0
    top = int(keys.max()) + 1
    if top <= DENSE_KEYS:
        seen = np.zeros(top, dtype=bool)
        seen[keys] = True
        place = np.cumsum(seen, dtype=np.int64) - 1
        return place[keys], int(place[-1]) + 1
    names, ids = np.unique(keys, return_inverse=True)
    return ids.reshape(-1).astype(np.int64), len(names)


# --- blocks --------------------------------------------------------------------

def _pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _pack_rows(schema: pa.Schema):
    """Documents of a task, gathered by block and compressed; a pack closes at
    PACK_BYTES of text, all of them when PENDING_BYTES wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[int, list[pa.Table]] = {}
        sizes: dict[int, int] = {}

        def close(blocks: list[int]) -> pa.RecordBatch:
            packs = [_pack(pa.concat_tables(pending.pop(b))) for b in blocks]
            for b in blocks:
                sizes.pop(b)
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(packs, pa.binary()),
                 pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.int32())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            number = np.asarray(batch.column(0))
            order = np.argsort(number, kind="stable")
            edges = np.flatnonzero(np.diff(number[order])) + 1
            for rows in np.split(order, edges):
                b = int(number[rows[0]])
                part = table.take(pa.array(rows)).drop(["block"])
                pending.setdefault(b, []).append(part)
                sizes[b] = sizes.get(b, 0) + part.nbytes
            full = [b for b, n in sizes.items() if n >= PACK_BYTES]
            if sum(sizes.values()) >= PENDING_BYTES:
                full = list(pending)
            if full:
                yield close(full)
        if pending:
            yield close(list(pending))

    return run


class Block:
    """One block: its packs of documents, and which keys are good."""

    def __init__(self, table: pa.Table):
        self.packs = [p for p in table.column("payload") if p.is_valid]
        self.grade: dict[int, int] = {}
        for k, g in zip(table.column("key").to_pylist(), table.column("good").to_pylist()):
            if g is not None:
                self.grade[k] = min(g, self.grade.get(k, g))

    def parts(self) -> Iterator[tuple[pa.Table, list[str], list[int | None], np.ndarray]]:
        """(rows, languages, labels, trained) of a few packs at a time."""
        held, size = [], 0
        for i, p in enumerate(self.packs):
            held.append(_unpack(p.as_py()))
            size += held[-1].nbytes
            if size >= CHUNK_BYTES or i + 1 == len(self.packs):
                rows = pa.concat_tables(held)
                good = [None if k is None else self.grade.get(k) for k in rows.column("key").to_pylist()]
                held_out = np.asarray(rows.column("held_out"), dtype=bool)
                yield (rows, [x or "" for x in rows.column("lang").to_pylist()], good,
                       np.array([g == 1 for g in good], dtype=bool) & ~held_out)
                held, size = [], 0


def _chunks(rows: pa.Table, langs: list[str], order: int) -> Iterator[tuple[str, np.ndarray, Chunk]]:
    """(language, row numbers, chunk) of bounded groups of rows of a language."""
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by.setdefault(lang, []).append(i)
    column = rows.column("text")
    for lang, members in by.items():
        texts, held, chars = [], [], 0
        for j, i in enumerate(members):
            t = (column[i].as_py() or b"").decode("utf-8", "replace")
            texts.append(t)
            held.append(i)
            chars += len(t)
            if chars >= CHUNK_CHARS or j + 1 == len(members):
                yield lang, np.array(held), Chunk(texts, order)
                texts, held, chars = [], [], 0


def block_grams(block: Block, order: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Per language: code points of every distinct n-gram, and its count in
    training texts."""
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        grams = np.concatenate([g for g, _n in found[lang]])
        _keys, first, ids = np.unique(gram_keys(grams), return_index=True, return_inverse=True)
        total = np.bincount(ids.reshape(-1), weights=np.concatenate([n for _g, n in found[lang]]))
        return grams[first], total.astype(np.int64)

    for rows, langs, _good, trained in block.parts():
        for lang, members, chunk in _chunks(rows, langs, order):
            on = chunk.used > 0
            found.setdefault(lang, []).append((chunk.grams[on], chunk.counts(trained[members])[on]))
            if len(found[lang]) >= 16:
                found[lang] = [merged(lang)]
    for lang in found:
        yield lang, *merged(lang)


# --- model -------------------------------------------------------------------

def levels(grams: DataFrame, order: int) -> dict[int, DataFrame]:
    """(lang, gram, k) per order: counts at the top, continuation counts below."""
    out = {order: stored(grams.where("c > 0").select("lang", "gram", F.col("c").alias("k")), "kn-counts")}
    for n in range(order - 1, 0, -1):
        out[n] = stored(out[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram"))
                        .agg(F.count(F.lit(1)).alias("k")), "kn-counts")
    return out


def small(df: DataFrame) -> DataFrame:
    """A stored table of one row per language, to be broadcast if its counted rows
    allow it (a corpus of more languages has no hot one)."""
    return F.broadcast(df) if df.count() <= MANY_LANGUAGES else df


def discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the discounts of an order in each language, from its
    counts of counts, each kept within what the count can give."""
    n = {i: F.sum((F.col("k") == i).cast("long")).cast("double") for i in (1, 2, 3, 4)}
    rows = level.groupBy("lang").agg(*[v.alias(f"n{i}") for i, v in n.items()])
    n1, n2, n3, n4 = (F.col(f"n{i}") for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, F.when(n3 > 0, 3 - 4 * y * n4 / n3).otherwise(1.5))
    few = (n1 == 0) | (n2 == 0)
    return rows.select("lang", *[F.when(few, usual).otherwise(F.least(F.greatest(d, F.lit(0.05)), F.lit(i + 0.95))).alias(f"d{i + 1}")
                                 for i, (d, usual) in enumerate(zip(raw, (0.5, 1.0, 1.5)))])


def log_probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp) for every row of ``grams`` (lang, gram, c): natural
    log of the interpolated probability of the last character after the others.
    c is the training count (0: only asked for)."""
    tables = levels(grams, order)
    letters = tables[1].groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("_v"))
    out = grams.select("lang", "gram").withColumn("p", F.lit(None).cast("double"))
    for n in range(1, order + 1):
        level = tables[n].join(small(stored(discounts(tables[n]), "kn-discounts")), "lang")
        cut = F.when(F.col("k") == 1, F.col("d1")).when(F.col("k") == 2, F.col("d2")).otherwise(F.col("d3"))
        history = (level.groupBy("lang", F.substring("gram", 1, n - 1).alias("_h"))
                   .agg(F.sum("k").alias("_total"), F.sum(cut).alias("_mass")))
        if n == 1:
            history = history.join(letters, "lang")
        here = level.select("lang", F.col("gram").alias("_g"), (F.col("k") - cut).alias("_a"))
        # lower orders are interpolated once per distinct suffix
        wanted = grams.select("lang", F.substring("gram", order - n + 1, n).alias("_g")).distinct() \
            if n < order else grams.select("lang", F.col("gram").alias("_g"))
        lower = F.lit(1.0) / F.coalesce(F.col("_v"), F.lit(1 << 20)) if n == 1 else F.col("_low")
        rows = wanted.withColumn("_h", F.substring("_g", 1, n - 1))
        if n > 1:
            below = out.select("lang", F.col("gram").alias("_s"), F.col("p").alias("_low"))
            rows = rows.withColumn("_s", F.substring("_g", 2, n - 1)).join(below, ["lang", "_s"])
        rows = rows.join(here, ["lang", "_g"], "left").join(history, ["lang", "_h"], "left")
        p = F.coalesce((F.coalesce("_a", F.lit(0.0)) + F.col("_mass") * lower) / F.col("_total"), lower)
        out = stored(rows.select("lang", F.col("_g").alias("gram"), p.alias("p")), "kn-p")
    return out.select("lang", "gram", F.log("p").alias("logp"))


# --- documents -----------------------------------------------------------------

def _block_names(spark, n: int):
    """Names for blocks 0..n-1 that Spark's hash partitioning deals into n different
    partitions, so that no task gets two blocks and another none.  With very many
    blocks the hash is even enough by itself."""
    if not 1 < n <= NAMED_BLOCKS:
        return lambda number: number
    drawn = spark.range(32 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    found = {r["p"]: r["id"] for r in drawn.groupBy("p").agg(F.min("id").alias("id")).collect()}
    names = F.array(*[F.lit(found.get(b, 32 * n + b)).cast("long") for b in range(n)])
    return lambda number: F.get(names, number.cast("int"))


def _blocks(docs: DataFrame, labels: DataFrame, key_col: str, text_col: str, lang_col: str,
            label_col: str, block_bytes: int, carry: tuple[str, ...]) -> DataFrame:
    """Packs of documents, and labels, dealt into blocks by key."""
    total = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    names = _block_names(docs.sparkSession, n)
    key = F.col(key_col).cast("long")
    text = F.col(text_col).cast("string")
    # rows without a key are dealt by their text
    number = names(F.pmod(F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(n)))
    held_out = F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    rows = docs.select(number.alias("block"), key.alias("key"), F.col(lang_col).cast("string").alias("lang"),
                       held_out.alias("held_out"), text.cast("binary").alias("text"), *carry)
    out = "block long, payload binary, key long, good int"
    schema = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("key", pa.int64()), ("good", pa.int32())])
    packs = rows.mapInArrow(_pack_rows(schema), out)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(key_col).isNotNull()).select(
        names(F.pmod(F.xxhash64(key), F.lit(n))).alias("block"), F.lit(None).cast("binary").alias("payload"),
        key.alias("key"), F.col(label_col).cast("int").alias("good"))
    return packs.unionByName(marks).repartition(max(n, 2), "block")


def _grams_of_block(order: int):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        parts = []
        for lang, grams, counts in block_grams(Block(table), order):
            n = len(grams)
            text = grams.astype("<u4").tobytes().decode("utf-32-le")
            parts.append(pa.table({
                "block": pa.array(np.full(n, number, dtype=np.int64)),
                "lang": pa.array([lang] * n, pa.string()),
                "gram": pa.array([text[i * order:(i + 1) * order] for i in range(n)], pa.string()),
                "c": pa.array(counts)}))
        schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("gram", pa.string()),
                            ("c", pa.int64())])
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def _log_tables(logs: pa.Table, order: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language, sorted n-gram hashes and their log-probabilities."""
    out = {}
    lang = logs.column("lang").combine_chunks().dictionary_encode() if logs.num_rows else None
    if lang is None:
        return out
    code = np.asarray(lang.indices)
    values = np.asarray(logs.column("logp"), dtype=np.float64)
    gram = logs.column("gram").combine_chunks()
    for i, name in enumerate(lang.dictionary.to_pylist()):
        rows = np.flatnonzero(code == i)
        chars = code_points("".join(gram.take(pa.array(rows)).to_pylist())).reshape(-1, order)
        keys = gram_keys(chars)
        by = np.argsort(keys)
        out[name] = keys[by], values[rows][by]
    return out


def _score_block(order: int, carry: tuple[str, ...], schema: pa.Schema):
    def run(docs: pa.Table, logs: pa.Table) -> pa.Table:
        tables = _log_tables(logs, order)
        parts = []
        for rows, langs, good, _trained in Block(docs).parts():
            total, chars = np.zeros(len(langs)), np.zeros(len(langs), dtype=np.int64)
            for lang, members, chunk in _chunks(rows, langs, order):
                chars[members] = chunk.stops - chunk.starts
                if not chunk.used.any():
                    continue
                keys, logp = tables[lang]
                at = np.searchsorted(keys, gram_keys(chunk.grams))
                total[members] = chunk.sums(logp[np.minimum(at, len(logp) - 1)])
            parts.append(pa.table({
                "key": rows.column("key"), "lang": pa.array(langs, pa.string()), "n_chars": pa.array(chars),
                "log_likelihood": pa.array(total), "good": pa.array(good, pa.int32()),
                "held_out": rows.column("held_out"), **{c: rows.column(c) for c in carry}}))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def score(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", label_col: str = "quality", order: int = ORDER,
          block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang, n_chars, log_likelihood, good, held_out, carry columns,
    perplexity) for every row; perplexity is per character, null for empty
    texts."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    schema = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("lang", T.StringType()),
        T.StructField("n_chars", T.LongType()), T.StructField("log_likelihood", T.DoubleType()),
        T.StructField("good", T.IntegerType()), T.StructField("held_out", T.BooleanType()),
        *[T.StructField(c, docs.schema[c].dataType) for c in carry]])
    with scratch_scope(docs.sparkSession) as scratch:
        blocks = _blocks(docs, labels, key_col, text_col, lang_col, label_col, block_bytes, carry)
        asked = stored(blocks.groupBy("block").applyInArrow(
            _grams_of_block(order), "block long, lang string, gram string, c long"), "kn-grams")
        grams = stored(asked.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "kn-all")
        logs = log_probabilities(grams, order)
        answers = stored(asked.select("block", "lang", "gram").join(logs, ["lang", "gram"])
                         .select("block", "lang", "gram", F.col("logp").cast("float").alias("logp")), "kn-answers")
        scored = stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
            _score_block(order, carry, to_arrow_schema(schema)), schema), "kn-scores")
        hand_on(scratch)
    return scored.withColumn("perplexity", F.when(F.col("n_chars") > 0, F.exp(
        -F.col("log_likelihood") / F.col("n_chars"))))


def thresholds(scores: DataFrame, quantile: float = QUANTILE, spread: float = SPREAD) -> DataFrame:
    """(lang, threshold) from the held-out good documents of each language, or
    of all where a language has few."""
    log = F.log("perplexity")
    good = F.coalesce(F.col("good") == 1, F.lit(False))
    held = good & F.col("held_out")

    def quantiles(value: Column) -> Column:
        return F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(quantile)), F.lit(10000))

    def bound(q: str) -> Column:
        q = F.col(q)
        return F.least(q[2], q[0] + spread * (q[1] - q[0]))

    rows = scores.where("perplexity is not null")
    own = rows.groupBy("lang").agg(
        (F.count(F.when(held, 1)) >= MIN_HELD).alias("_many"), quantiles(F.when(held, log)).alias("_q"),
        F.percentile_approx(F.when(~(good & ~F.col("held_out")), log), 0.5, F.lit(10000)).alias("_mid"))
    own = own.withColumn("_centre", F.when(F.col("_many"), F.col("_q")[0]).otherwise(F.col("_mid")))
    own = stored(own, "kn-quantiles")
    pooled = (rows.where(held).join(small(own).select("lang", "_centre"), "lang")
              .agg(F.count(F.lit(1)).alias("_n"), quantiles(log - F.col("_centre")).alias("_all")))
    width = F.when(F.col("_n") >= MIN_HELD, bound("_all"))
    return own.crossJoin(pooled).select("lang", F.exp(
        F.when(F.col("_many"), bound("_q")).otherwise(F.col("_centre") + width)).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, spread: float = SPREAD,
             **columns) -> DataFrame:
    """``score`` with the language's threshold and ``rejected``."""
    scores = score(docs, labels, **columns)
    limit = small(stored(thresholds(scores, quantile, spread), "kn-thresholds"))
    return (scores.join(limit, "lang", "left")
            .withColumn("rejected", F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False))))
