
import numpy as np
import pytest
import xxhash

from wordloom.llm import queries, simhash
from tests.llm.conftest import rows


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, bits=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = np.asarray(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def gray_rank(f):
    f = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        f ^= f >> np.uint64(s)
    return f


def noisy(rng, n, centres, p):
    c = rng.integers(0, 2**64, centres, dtype=np.uint64)
    flips = np.packbits(rng.random((n, 64)) < p, axis=1).view("<u8")[:, 0]
    f = np.unique(c[rng.integers(0, centres, n)] ^ flips)
    return f[np.argsort(gray_rank(f))]


@pytest.mark.parametrize("n,centres,p", [(500, 10, .03), (1500, 30, .06), (2500, 1, .04), (40, 2, .05)])
def test_hierarchical_linking_equals_brute_force(n, centres, p):
    f = noisy(np.random.default_rng(n), n, centres, p)
    assert list(simhash._link_large(f, 3)) == brute_roots(f)


@pytest.mark.parametrize("limit", [simhash.NODE_LIMIT, 40])
def test_components_through_spark(spark, limit):
    f = noisy(np.random.default_rng(5), 1200, 12, .035)
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.fingerprint_components(df, 3, limit).collect()}
    want = brute_roots(f)
    signed = f.view(np.int64).tolist()
    mine = [got.get(x, x) for x in signed]
    pairs = set(zip(mine, want))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_block_masks_cover_all_bits_once():
    masks = simhash.block_masks(0, 4)
    assert sum(masks) == 2**64 - 1
    assert all(m & 0xFFFF == 0xFFFF for m in simhash.block_masks(0xFFFF, 4))


def test_edge_rows(spark, edge_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    data = rows()
    fps = [brute_fingerprint(r[1]) for r in data]
    roots = brute_roots(fps)
    least = {}
    for r, c in zip(data, roots):
        if r[0] is not None:
            least[c] = min(r[0], least.get(c, r[0]))
    want = sorted((r[0] or -1, f, least.get(c) or -1) for r, f, c in zip(data, fps, roots))
    assert sorted((r["doc_id"] or -1, r["fp"] % 2**64, r["component_id"] or -1) for r in got) == want


def test_empty_table(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_words_split_at_ascii_space_only_and_fold_ascii_only():
    h = xxhash.xxh64_intdigest
    assert simhash.fingerprint("A B É".encode(), 3, h) == brute_fingerprint("a b É")
    assert simhash.fingerprint("É x".encode(), 3, h) != simhash.fingerprint("é x".encode(), 3, h)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = sorted(docs, key=lambda r: r["doc_id"])
    fps = [brute_fingerprint(r["text"]) for r in docs]
    want = [(r["doc_id"], f"{f:016x}", docs[c]["doc_id"]) for r, f, c in zip(docs, fps, brute_roots(fps))]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"])
                 for r in queries.op7_simhash(spark, "/root/testdata/sf0.001").collect())
    assert got == want
