"""Toxicity scores from a weighted lexicon.

Texts are folded first (NFKC, lower case, look-alike letters, digit and sign
substitutions, invisible characters dropped), then every letter run is looked
up with an Aho-Corasick automaton that holds whole words, word stems and
exception phrases.  A one is read as an i and as an l.  A word counts with its
best entry's weight unless it lies inside an exception phrase.  The score is a logistic function of the summed
weight and of the weight per word (length normalised).

Entries and weights are learned from labelled rows: document frequencies of
folded words and word stems in toxic and in clean texts give smoothed log-odds;
entries that are rare or not clearly toxic are left out; built-in words stay
unless the labels speak against them.  Phrases of two words around an entry that
clean texts have and toxic ones do not become exceptions beside the built-in
ones.  The labelled sample is
bounded (``max_labelled`` rows, the first by a hash of the key), which bounds
the lexicon and the calibration data; every document is scored whole.

The driver's training data are the sample's (weight, length, label) rows and
the lexicon, both bounded by parameters.  Scoring runs in the scan's tasks.

Nulls and empty texts score as texts without entries, an empty table gives an
empty result, equal texts have equal scores, very long texts are scored whole.
Labels that are null are ignored; a key with several labels is toxic if one of
them is; of rows that repeat a key one is learned from.  Rows with a null key are
scored and count as not held out.  Carried columns may have any name.  Without labelled rows of both
kinds the built-in word list and default calibration are used.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_sizes, map_arrow, row_chunks, scratch_scope, stored

CHUNK_BYTES = 1 << 20
MAX_LABELLED = 12_000
MAX_LEXICON = 20_000
MIN_DOCS = 3
MIN_PRECISION = 0.95
STEM_LENGTHS = (4, 5, 6)
MAX_EXCEPTIONS = 5_000
MAX_PHRASE = 80          # characters

# fixed values: letters that look like Latin ones, and signs used for letters
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
                 "@": "a", "$": "s"}
INVISIBLE = "­​‌‍‎‏⁠﻿"
# fixed values: words used when no labels are given
BASE_WORDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid",
              "trash", "worthless")
# fixed values: phrases in which an entry is harmless
EXCEPTIONS = ("class clown", "clown fish", "clown car", "idiot proof", "pond scum", "soap scum",
              "trash bag", "trash bin", "trash can", "trash collection", "trash folder")

_FOLD = {ord(k): v for k, v in {**HOMOGLYPHS, **SUBSTITUTIONS}.items()}
_FOLD.update({ord(c): None for c in INVISIBLE})
_RUN = re.compile(r"[^\W\d_]+")
_ONE = re.compile(r"1[0-9@$]*[^\W\d_]|[^\W\d_][0-9@$]*1")       # a one in a run that has a letter


_OTHER = {**_FOLD, ord("1"): "l"}      # a one may stand for an i or an l


def _plain(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def fold(text: str, other: bool = False) -> str:
    return _plain(text).translate(_OTHER if other else _FOLD)


def readings(text: str) -> list[str]:
    """The folded texts of equal length: one, or two if a one in a word can be read in two ways."""
    t = _plain(text)
    first = t.translate(_FOLD)
    return [first, t.translate(_OTHER)] if "1" in t and _ONE.search(t) else [first]


def features(text: str, stems: Sequence[int] = STEM_LENGTHS) -> list[str]:
    """Distinct ``=word`` and ``^stem`` features of a text."""
    words = set(_RUN.findall(fold(text)))
    out = {"=" + w for w in words}
    for n in stems:
        out.update("^" + w[:n] for w in words if len(w) > n)
    return sorted(out)


@dataclass
class ToxicModel:
    """Weights of ``=word`` and ``^stem`` entries, and the calibration of
    (1, log(1 + weight), log(1 + 100 * weight / words))."""

    weights: dict[str, float] = field(default_factory=lambda: {"=" + w: 3.0 for w in BASE_WORDS})
    coef: tuple[float, float, float] = (-4.0, 2.0, 1.5)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(entry[1:], (*self._seen(a, entry[1:]), (entry[0], len(entry) - 1, w)))
        for p in self.exceptions:
            a.add_word(p, (*self._seen(a, p), ("!", len(p), 0.0)))
        if len(a):
            a.make_automaton()
        return a

    @staticmethod
    def _seen(a, key: str) -> tuple:
        return a.get(key) if key in a else ()


def design(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    w, n = np.asarray(weight, float), np.maximum(np.asarray(words, float), 1.0)
    return np.column_stack([np.ones_like(w), np.log1p(w), np.log1p(100.0 * w / n)])


def match(automaton, text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
    """(summed weight, words, matched spans of the folded text)."""
    texts = readings(text)
    words = len(_RUN.findall(texts[0]))
    if not len(automaton):
        return 0.0, words, []
    best: dict[int, tuple[int, float]] = {}
    safe: list[tuple[int, int]] = []
    for t in texts:
        size = len(t)
        for last, entries in automaton.iter(t):
            for kind, n, w in entries:
                start = last - n + 1
                if start and t[start - 1].isalpha():
                    continue
                if kind != "^" and last + 1 < size and t[last + 1].isalpha():
                    continue
                if kind == "!":
                    safe.append((start, last))
                elif start not in best or w > best[start][1]:
                    best[start] = (last, w)
    safe = _joined(safe)
    firsts = [a for a, _b in safe]
    spans = []
    for s, (e, w) in sorted(best.items()):
        i = bisect_right(firsts, s) - 1
        if i < 0 or safe[i][1] < e:
            spans.append((s, e, w))
    return sum(w for _s, _e, w in spans), words, spans


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by start, each with the furthest end of those that start up to it."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        e = max(e, out[-1][1]) if out and out[-1][1] >= s else e
        if out and out[-1][0] == s:
            out[-1] = (s, max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def neighbours(automaton, text: str) -> list[str]:
    """Two-word phrases of a text, folded, that hold a matched word: what could
    make the word harmless."""
    t = fold(text)
    runs = [(m.start(), m.end()) for m in _RUN.finditer(t)]
    at = {s: i for i, (s, _e) in enumerate(runs)}
    found = set()
    for s, _e, _w in match(automaton, text)[2]:
        i = at.get(s)
        for j in (i - 1, i) if i is not None else ():
            if 0 <= j and j + 1 < len(runs):
                phrase = t[runs[j][0]:runs[j + 1][1]]
                if phrase.count(" ") == 1 and len(phrase) <= MAX_PHRASE:
                    found.add(phrase)
    return sorted(found)


def _by_text(df: DataFrame, model: ToxicModel, text_col: str, keep: list[str], fields: list[T.StructField],
             each) -> DataFrame:
    """``own`` (struct of the ``keep`` columns, so that their names cannot clash) and
    the ``fields`` that ``each`` makes of (automaton, texts)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        automaton = shared.value.automaton()

        def run(batch: pa.RecordBatch):
            col = batch.column(batch.num_columns - 1)
            for lo, hi in row_chunks(byte_sizes(col), CHUNK_BYTES):
                yield lo, hi, each(automaton, [(t or b"").decode("utf-8", "replace")
                                               for t in col.slice(lo, hi - lo).to_pylist()])
        return run

    own = F.struct(*[F.col(c) for c in keep], F.lit(True).alias("__")).alias("own")
    return map_arrow(df.select(own, F.col(text_col).cast("string").cast("binary").alias("text")), ["own"], fields, make, ["text"])


def _scored(df: DataFrame, model: ToxicModel, text_col: str, keep: list[str]) -> DataFrame:
    """``own``, weight and words of every row."""
    def each(automaton, texts):
        found = [match(automaton, t)[:2] for t in texts]
        return [pa.array([float(w) for w, _n in found], pa.float64()), pa.array([n for _w, n in found], pa.int64())]

    return _by_text(df, model, text_col, keep, [T.StructField("weight", T.DoubleType(), False),
                                                T.StructField("words", T.LongType(), False)], each)


def held_out(key: str | Column, folds: int = 5) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton steps on the ridge-penalised mean logistic loss."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -40, 40)))
        grad = x.T @ (p - y) / len(y) + ridge * b
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", folds: int = 5, max_labelled: int = MAX_LABELLED,
          max_lexicon: int = MAX_LEXICON) -> ToxicModel:
    """Learn entries, weights and calibration from labelled rows outside the
    held-out fold, at most ``max_labelled`` of them."""
    with scratch_scope(docs.sparkSession):
        return _learn(docs, labels, key_col, text_col, label_col, folds, max_labelled, max_lexicon)


def _learn(docs: DataFrame, labels: DataFrame, key_col: str, text_col: str, label_col: str, folds: int,
           max_labelled: int, max_lexicon: int) -> ToxicModel:
    model = ToxicModel()
    sample = (labels.where(F.col(label_col).isNotNull() & F.col(key_col).isNotNull()
                           & ~held_out(key_col, folds))
              .groupBy(F.col(key_col).alias("_key")).agg(F.max(label_col).cast("int").alias("_toxic"))
              .orderBy(F.xxhash64("_key"), "_key").limit(max_labelled))
    texts = (docs.select(F.col(key_col).alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
             .join(F.broadcast(sample), "_key"))
    # a key that repeats counts once, with its least text: at most max_labelled rows
    texts = stored(texts.groupBy("_key", "_toxic").agg(F.min("_text").alias("_text")), "toxic-sample")

    def make():
        def run(batch: pa.RecordBatch):
            rows = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for lo, hi in row_chunks([len(t) for t in rows], CHUNK_BYTES):
                yield lo, hi, [pa.array([features(t) for t in rows[lo:hi]], pa.list_(pa.string()))]
        return run

    listed = stored(map_arrow(texts, ["_toxic"], [T.StructField("_f", T.ArrayType(T.StringType()), False)],
                              make, ["_text"]), "toxic-features")
    n_toxic, n_clean = (texts.agg(F.coalesce(F.sum("_toxic"), F.lit(0)),
                                  F.coalesce(F.sum(1 - F.col("_toxic")), F.lit(0))).first())
    if not n_toxic or not n_clean:
        return model
    counts = (listed.select("_toxic", F.explode("_f").alias("entry")).groupBy("entry")
              .agg(F.sum("_toxic").alias("t"), F.sum(1 - F.col("_toxic")).alias("c")))
    odds = (F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0)))
    # the share of toxic texts the entry would have if both kinds were equally common
    share = F.col("t") / n_toxic / (F.col("t") / n_toxic + F.col("c") / n_clean)
    kept = (counts.where((F.col("t") >= MIN_DOCS) & (share >= MIN_PRECISION))
            .withColumn("w", odds).where("w > 0")
            .orderBy(F.desc(F.col("w") * F.col("t")), "entry").limit(max_lexicon)
            .select("entry", "w").collect())
    if not kept:
        return model
    # the built-in words stay unless the labels speak against them
    seen = {r[0]: (r[1], r[2]) for r in counts.where(F.col("entry").isin(sorted(model.weights)))
            .select("entry", "t", "c").collect()}
    base = {e: w for e, w in model.weights.items()
            if e not in seen or seen[e][0] * n_clean > seen[e][1] * n_toxic}
    model.weights = base | {r[0]: float(r[1]) for r in kept}
    model.exceptions = tuple(sorted({*model.exceptions, *_harmless(texts, model)}))
    rows = (_scored(texts, model, "_text", ["_toxic"]).select("own._toxic", "weight", "words")
            .collect())                                              # at most max_labelled rows
    y = np.array([r[0] for r in rows], float)
    x = design(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    model.coef = tuple(float(v) for v in _fit_logistic(x, y))
    if not all(map(math.isfinite, model.coef)):
        model.coef = ToxicModel.coef
    return model


def _harmless(texts: DataFrame, model: ToxicModel) -> list[str]:
    """Phrases around an entry that ``MIN_DOCS`` clean texts of the sample or more
    have and no toxic one, the most frequent ``MAX_EXCEPTIONS``."""
    def each(automaton, rows):
        return [pa.array([neighbours(automaton, t) for t in rows], pa.list_(pa.string()))]

    listed = _by_text(texts, model, "_text", ["_toxic"], [T.StructField("p", T.ArrayType(T.StringType()), False)], each)
    counts = (listed.select("own._toxic", F.explode("p").alias("phrase")).groupBy("phrase")
              .agg(F.sum("_toxic").alias("t"), F.count(F.lit(1)).alias("n")).where((F.col("t") == 0) & (F.col("n") >= MIN_DOCS)))
    return [r["phrase"] for r in counts.orderBy(F.desc("n"), "phrase").limit(MAX_EXCEPTIONS).collect()]


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text", keep: list[str] | None = None,
          score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``keep`` columns (default all) with a score in 0..1 and a prediction;
    input columns of those two names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (score_col, predicted_col)]
    rows = _scored(docs, model, text_col, keep)
    c0, c1, c2 = (F.lit(float(c)) for c in model.coef)
    z = (c0 + c1 * F.log1p(F.col("weight"))
         + c2 * F.log1p(100.0 * F.col("weight") / F.greatest(F.col("words"), F.lit(1))))
    value = 1.0 / (1.0 + F.exp(-z))
    return rows.select(*[F.col("own")[c].alias(c) for c in keep], value.alias(score_col),
                       (value >= 0.5).cast("int").alias(predicted_col))
