import hashlib
import re
from collections import defaultdict

import pytest

from wordloom.llm import exact_dedup, queries
from tests.llm.conftest import rows


def brute(pairs):
    """(key, keep, size, kept count, sha) of every group, by comparing whole texts."""
    groups = defaultdict(list)
    for key, text in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(key)
    out = []
    for text, keys in groups.items():
        keep = min(keys, key=lambda k: (k is None, k or 0))
        out += [(k, keep, len(keys), hashlib.sha256(text.encode()).hexdigest()) for k in keys]
    return sorted(out, key=str)


def found(df):
    got = df.collect()
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str), got


@pytest.mark.parametrize("chunk_bytes", [64 << 10, 100])
def test_edge_rows(spark, edge_docs, chunk_bytes):
    df = exact_dedup.exact_duplicates(edge_docs, carry=["ids", "key", "n_chars"], chunk_bytes=chunk_bytes)
    got, all_rows = found(df)
    assert got == brute([(r[0], r[1]) for r in rows()])
    # one row of each group stays, and it bears the kept key
    assert sum(r["kept"] for r in all_rows) == len({r["text_sha256"] for r in all_rows})
    assert all(r["doc_id"] == r["keep_id"] for r in all_rows if r["kept"])
    assert {(r["ids"], r["key"]) for r in all_rows} == {("own", "own")}


def test_empty_table_and_clashing_names(spark, no_docs, edge_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(edge_docs.withColumnRenamed("ids", "kept"), carry=["kept"])


@pytest.mark.parametrize("chunk_bytes", [7, 1000])
def test_collisions_are_told_apart(spark, chunk_bytes):
    """Moduli of 2 and 3 let most texts of a length collide."""
    pairs = [(i, f"text {i % 40:02d} tail") for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got, _ = found(exact_dedup.exact_duplicates(df, chunk_bytes=chunk_bytes, primes=(2, 3)))
    assert got == brute(pairs)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    pairs = [(i, f"word {'x' * (i % 7) * 30}") for i in range(60)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got, _ = found(exact_dedup.exact_duplicates(df, chunk_bytes=64))
    assert got == brute(pairs)


def test_hot_group(spark):
    """A third of all rows share a text above one chunk, spelt with different blanks."""
    df = spark.range(3000).selectExpr(
        "id as doc_id", "case when id % 3 = 0 then concat(repeat('long text ', 50), if(id % 2 = 0, '\t\n', ' '), 'end') "
        "else concat('t', id) end as text")
    got = exact_dedup.exact_duplicates(df, chunk_bytes=200).groupBy("keep_id").count().where("count > 1").collect()
    assert [(r["keep_id"], r["count"]) for r in got] == [(0, 1000)]


def test_fingerprints_compose():
    p, q = exact_dedup.moduli()
    assert p != q and exact_dedup.moduli() == (p, q) != exact_dedup.moduli(1)
    assert not exact_dedup._is_prime(2**61 - 3) and exact_dedup._is_prime(2**61 - 1)
    text = bytes(range(256)) * 9
    whole = exact_dedup.shifted(text, 0, p)
    for size in (1, 10, 255, 4000):
        parts = [text[i:i + size] for i in range(0, len(text), size)]
        after = [max(0, len(text) - i - size) for i in range(0, len(text), size)]
        assert sum(exact_dedup.shifted(c, a, p) for c, a in zip(parts, after)) % p == whole


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got, _ = found(queries.op12_exact_dedup(spark, "/root/testdata/sf0.001"))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs])
