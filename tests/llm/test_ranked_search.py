import math
import re
from collections import Counter

import numpy as np
import pytest

from wordloom.llm import queries, ranked_search
from tests.llm.conftest import rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [(key, Counter(terms(t))) for key, t in docs]
    counts = [(key, c, sum(c.values())) for key, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in set(items):
        asked, scored = Counter(terms(text)), []
        for key, c, n in counts:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, key is None, key))
        out += [(item, r + 1, key, -s) for r, (s, _, key) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in ranked_search.ranked_search(d, i, k).select(
        "item_id", "rank", "doc_id", "score").collect()], key=str)


ITEMS = [(1, "The river and the OLD mill"), (1, "The river and the OLD mill"), (2, None), (3, "zzz qqq"), (4, "one two, 中文 café"),
         (4, "harvest price"), (None, "x" * 30_000), (6, "river " * 50 + "mill")]


def test_edge_rows(spark):
    docs = [(r[0], r[1]) for r in rows()]
    assert found(spark, docs, ITEMS, 3) == brute(docs, ITEMS, 3)


@pytest.mark.parametrize("tile", [dict(DOC_TILE=3, COLUMN_TILE=2), dict(DOC_TILE=7, COLUMN_TILE=100)])
def test_ties_and_tiles(spark, monkeypatch, tile):
    """Many documents of equal score, over small tiles and several slices."""
    for name, v in tile.items():
        monkeypatch.setattr(ranked_search, name, v)
    monkeypatch.setattr(ranked_search, "SLICE_PAIRS", 5)
    monkeypatch.setattr(ranked_search, "WINDOW_BYTES", 4)
    words = "alpha beta gamma delta épsilon zeta eta".split()
    docs = [(97 * i % 200, " ".join(words[j] for j in range(7) if (i % 8) >> (j % 3) & 1)) for i in range(200)]
    items = [(j, f"{words[j]} {words[(j + 1) % 7]}!") for j in range(7)]
    assert found(spark, docs, items, 5) == brute(docs, items, 5)


def test_products_stay_exact():
    """Column tiles keep every sum below the bound, whatever the weights."""
    rng = np.random.default_rng(1)
    weights = rng.integers(0, 90, (50, 4)).astype(np.int64)
    weights[7, 2] = 1000
    limit = 100
    parts = ranked_search._products(weights, limit)
    assert all(part.sum(axis=0).max() <= limit for _, part in parts) and len(parts) > 5
    back = np.zeros_like(weights)
    for lo, part in parts:
        back[lo:lo + len(part)] += part.astype(np.int64)
    assert (back == weights).all()
    impact = rng.integers(0, 10**6, (9, 50))
    for cells in (1, 60, 10**6):
        item, place = np.nonzero(weights.T)
        s = ranked_search.Slice(np.arange(4), [b""] * 50, item, place, weights.T[item, place])
        tiles = ranked_search._tiles(s, np.ones(50, dtype=np.int64), cells, limit)
        row, col = np.divmod(np.arange(9 * 50), 50)
        scores = np.hstack([ranked_search._score_tile(t, row, col, impact.ravel(), 9) for t in tiles])
        assert (scores == impact @ weights).all()


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(ranked_search, "WINDOW_BYTES", 10)
    text = "Ab-c1_d " * 50 + "é" * 100 + "\x00Z"
    count = Counter()
    n = ranked_search.term_counts(text.encode(), count)
    assert n == len(terms(text)) and count == Counter(t.encode() for t in terms(text))


def test_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.ranked_search(no_docs, some).count() == 0
    assert ranked_search.ranked_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op11_ranked_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 10)
