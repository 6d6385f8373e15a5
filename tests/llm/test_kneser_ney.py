import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import kneser_ney as K
from wordloom.llm import queries
from tests.llm.conftest import rows


def brute(docs, labels, order=5):
    """{(doc_id, text): perplexity}: dictionaries only."""
    grade = {}
    for i, q in labels:
        if q is not None and i is not None:
            grade[i] = min(q, grade.get(i, q))
    pad = K.START * (order - 1)
    langs = {}
    for i, t, lang in docs:
        langs.setdefault(lang or "", []).append((i, (t or "").replace(K.START, "\ufffd")))
    tables = {}
    for lang, part in langs.items():
        top = Counter()
        for i, t in part:
            if i is not None and grade.get(i) == 1 and zlib.crc32(str(i).encode()) % 5:
                top.update((pad + t)[j:j + order] for j in range(len(t)))
        level = {order: top}
        for n in range(order - 1, 0, -1):
            level[n] = Counter(g[1:] for g in level[n + 1])
        tables[lang] = level
    cuts = {}
    for lang, level in tables.items():
        cut = cuts[lang] = {}
        for n in range(1, order + 1):
            n1, n2, n3, n4 = (sum(v == i for v in level[n].values()) for i in (1, 2, 3, 4))
            if not n1 or not n2:
                cut[n] = (0, 0.5, 1.0, 1.5)
                continue
            y = n1 / (n1 + 2 * n2)
            raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
            cut[n] = (0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)))
    out = {}
    for lang, part in langs.items():
        level, cut = tables[lang], cuts[lang]
        history = {n: {} for n in level}
        for n, lv in level.items():
            for g, v in lv.items():
                h = history[n].setdefault(g[:-1], [0, 0.0])
                h[0] += v
                h[1] += cut[n][min(v, 3)]
        letters = len(level[1]) + 1 if level[1] else 1 << 20

        def p(g):
            n = len(g)
            low = 1 / letters if n == 1 else p(g[1:])
            h = history[n].get(g[:-1])
            if h is None:
                return low
            v = level[n].get(g, 0)
            return ((v - cut[n][min(v, 3)] if v else 0) + h[1] * low) / h[0]

        for i, t in part:
            s = pad + t
            out.setdefault((i, t), math.exp(-sum(math.log(p(s[j:j + order])) for j in range(len(t))) / len(t))
                           if t else None)
    return out


def same(got, want):
    return got is None and want is None or got == pytest.approx(want, rel=1e-6)


def test_perplexity_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = brute([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()],
                 [(r["doc_id"], r["quality"]) for r in labels.collect()])
    want = {i: v for (i, _t), v in want.items()}
    for size in (K.BLOCK_BYTES, 50_000):              # one block, and many
        got = K.score(docs, labels, block_bytes=size).collect()
        assert len(got) == len(want) and all(same(r["perplexity"], want[r["key"]]) for r in got)


def test_chunk_counts_and_sums():
    texts = ["abcabc", "", "zabc", "\U0001F600é"]
    c = K.Chunk(texts, 3)
    names = ["".join(map(chr, g)) for g in c.grams.tolist()]
    want = Counter()
    for t in texts:
        s = K.START * 2 + t
        want.update(s[j:j + 3] for j in range(len(t)))
    assert {n: u for n, u in zip(names, c.used.tolist()) if u} == dict(want)
    only = c.counts(np.array([False, True, True, False]))
    assert {n: u for n, u in zip(names, only.tolist()) if u} == Counter([K.START * 2 + "z", K.START + "za", "zab", "abc"])
    assert c.sums(np.ones(c.count)).tolist() == [6, 0, 4, 2]
    empty = K.Chunk(["", ""], 3)
    assert empty.sums(np.ones(empty.count)).tolist() == [0, 0] and not empty.used.any()


def test_edge_rows(spark, edge_docs, edge_labels):
    got = K.classify(edge_docs, edge_labels).collect()
    want = brute([(r[0], r[1], r[2]) for r in rows()], [(1, 1), (5, 1), (5, 0), (6, 1), (7, 0), (9, 1)])
    values = sorted((r["key"] or -1, r["n_chars"], r["perplexity"] or 0) for r in got)
    expected = sorted((r[0] or -1, len(r[1] or ""), want[(r[0], r[1] or "")] or 0) for r in rows())
    assert len(values) == len(expected)
    for a, b in zip(values, expected):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-6)
    assert not any(r["rejected"] for r in got if not r["n_chars"])


def test_empty_tables(spark, no_docs, no_labels, edge_docs):
    assert K.classify(no_docs, no_labels).count() == 0
    assert not any(r["rejected"] for r in K.classify(edge_docs, no_labels).collect())


def test_discounts_stay_within_their_counts(spark):
    rows_ = [("de", k) for k, n in ((1, 5), (2, 9), (3, 20), (4, 90)) for _ in range(n)] + [("fr", 3), ("fr", 4)]
    got = {r["lang"]: (r["d1"], r["d2"], r["d3"]) for r in K.discounts(spark.createDataFrame(rows_, "lang string, k long")).collect()}
    assert all(0 < x < i + 1 for i, x in enumerate(got["de"])) and got["fr"] == (0.5, 1.0, 1.5)


def test_blocks_have_partitions_of_their_own(spark):
    n = 13
    names = K._block_names(spark, n)
    df = spark.range(n).select(names(F.col("id")).alias("block")).repartition(n, "block")
    assert df.select("block").distinct().count() == n
    assert df.groupBy(F.spark_partition_id()).count().count() == n


def brute_thresholds(rows_, quantile=K.QUANTILE, spread=K.SPREAD):
    """{language: threshold}; nearest-rank quantiles over plain lists."""
    def at(values, q):
        values = sorted(values)
        return values[max(0, math.ceil(q * len(values)) - 1)]

    def bound(values):
        lo, hi, top = at(values, 0.5), at(values, 0.95), at(values, quantile)
        return min(top, lo + spread * (hi - lo))

    logs = {}
    for lang, x, good, held in rows_:
        logs.setdefault(lang, []).append((math.log(x), good == 1, held))
    held = {lang: [x for x, g, h in v if g and h] for lang, v in logs.items()}
    centre = {lang: at(held[lang], 0.5) if len(held[lang]) >= K.MIN_HELD else
              at([x for x, g, h in v if not (g and not h)], 0.5) for lang, v in logs.items()}
    pooled = [x - centre[lang] for lang, v in held.items() for x in v]
    return {lang: math.exp(bound(held[lang])) if len(held[lang]) >= K.MIN_HELD else
            math.exp(centre[lang] + bound(pooled)) if len(pooled) >= K.MIN_HELD else None for lang in logs}


def test_thresholds_and_rejections_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    rows_ = [(lang, math.exp(rng.gauss(1.5, 0.2) if rng.random() < 0.9 else rng.gauss(4, 1)), rng.choice([1, 1, 0, None]),
              rng.random() < 0.3) for lang, n in (("de", 400), ("en", 900), ("fr", 30)) for _ in range(n)]
    df = spark.createDataFrame(rows_, "lang string, perplexity double, good int, held_out boolean")
    want = brute_thresholds(rows_)
    limit = K.thresholds(df)
    got = {r["lang"]: r["threshold"] for r in limit.collect()}
    assert got == pytest.approx(want, rel=1e-9)
    rejected = df.join(limit, "lang").where("perplexity > threshold").count()
    assert rejected == sum(x > want[lang] for lang, x, _g, _h in rows_) > 0


def test_query_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows_ = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r["rejected"] for r in rows_ if r["quality"] == 1]
    bad = [r["rejected"] for r in rows_ if r["quality"] == 0]
    assert sum(good) <= 0.02 * len(good) and sum(bad) >= 0.75 * len(bad)


def scored(spark, parts):
    """Rows of ``thresholds``: held-out good documents and others of each language."""
    rows = [(lang, float(x), g, h) for lang, held, others in parts
            for x, g, h in [(x, 1, True) for x in held] + [(x, None, False) for x in others]]
    return spark.createDataFrame(rows, "lang string, perplexity double, good int, held_out boolean")


def test_one_odd_good_document_does_not_decide(spark):
    usual = [4 + i / 100 for i in range(106)]
    limit = {r["lang"]: r["threshold"] for r in K.thresholds(scored(spark, [("de", usual + [126.0], [])])).collect()}
    assert max(usual) < limit["de"] < 20


def test_languages_with_few_held_out_documents_take_the_pooled_bound(spark):
    usual = [4 + i / 100 for i in range(100)]
    df = scored(spark, [("de", usual, []), ("fr", [120.0], [8 + i / 50 for i in range(50)]), ("xx", [], [9.0, 9.0, 9.5])])
    limit = {r["lang"]: r["threshold"] for r in K.thresholds(df).collect()}
    assert 9 < limit["fr"] < 20 and 9.5 < limit["xx"] < 20
    few = K.thresholds(scored(spark, [("de", usual[:5], usual)])).collect()
    assert [r["threshold"] for r in few] == [None]
