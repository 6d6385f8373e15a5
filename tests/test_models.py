"""A4, A5, A9 on generated files; D1/D2 encoder goldens, erf accuracy,
partition invariance, full-length sentences."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import encoder_math as M
from wordloom.operators.embed import embed, model_from_weights, load_model
from wordloom.sources.safetensors import (audit_model_dirs, parse_safetensors,
                                          safetensors_bytes, scan_models, weight_rows)

TINY = M.ModelConfig(vocab_size=1000, hidden=32, layers=2, heads=4, max_seq=64, ffn=128)


def _write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_erf_accuracy():
    xs = np.linspace(-7, 7, 20001)
    ref = np.array([math.erf(v) for v in xs])
    assert np.max(np.abs(M.erf(xs) - ref)) < 1e-7


def test_attention_goldens():
    eye = np.array([[[1, 0], [0, 1]]], dtype=np.float32)
    out = M.attention(eye, eye, eye, heads=1)[0]
    assert np.allclose(out, [[0.6704, 0.3296], [0.3296, 0.6704]], atol=1e-3)
    q = np.array([[[1, 0, 0, 0], [0, 0, 0, 1]]], dtype=np.float32)
    out = M.attention(q, q, q, heads=2)[0]
    assert np.allclose(out[0], [0.6704, 0, 0, 0.5], atol=1e-3)
    assert np.allclose(out[1], [0.5, 0, 0, 0.6704], atol=1e-3)
    q3 = np.array([[[1, 0], [0, 1], [1, 1]]], dtype=np.float32)
    mask = np.array([[1, 1, 0]] * 3)
    out = M.attention(q3, q3, q3, heads=1, mask=mask)[0]
    assert np.allclose(out[0], [0.6704, 0.3296], atol=1e-3)


def test_catalogue_and_rows(spark, scratch):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    b = np.array([0.5, -1.25], dtype=np.float32)
    _write(f"{scratch}/m1/model.safetensors", safetensors_bytes({"a": a, "b": b}))
    _write(f"{scratch}/m2/model.safetensors", safetensors_bytes({"c": np.ones((2, 2), np.float32)}))
    _write(f"{scratch}/m3/model.safetensors", safetensors_bytes({"h": np.ones(4, np.float16)}))
    cat = {(r["path"].split("/")[-2], r["name"]): r for r in scan_models(spark, scratch).collect()}
    assert set(cat) == {("m1", "a"), ("m1", "b"), ("m2", "c"), ("m3", "h")}
    ra, rb = cat[("m1", "a")], cat[("m1", "b")]
    assert ra["dtype"] == "F32" and list(ra["shape"]) == [3, 4] and ra["numel"] == 12
    assert (ra["begin_off"], ra["end_off"]) == (0, 48) and (rb["begin_off"], rb["end_off"]) == (48, 56)
    raw = open(f"{scratch}/m1/model.safetensors", "rb").read()
    assert ra["header_len"] == int.from_bytes(raw[:8], "little")
    rows = weight_rows(spark, f"{scratch}/m1", ["a", "b"]).collect()
    got = {(r["name"], r["row"]): list(r["vec"]) for r in rows}
    assert got[("a", 2)] == [8.0, 9.0, 10.0, 11.0] and got[("b", 0)] == [0.5, -1.25]
    with pytest.raises(Exception):
        weight_rows(spark, f"{scratch}/m3", ["h"]).collect()
    with pytest.raises(ValueError):
        weight_rows(spark, f"{scratch}/m1", ["nope"])


def test_model_dir_audit(spark, scratch):
    _write(f"{scratch}/full/model.safetensors", b"x")
    _write(f"{scratch}/full/vocab.txt", b"[PAD]\n")
    _write(f"{scratch}/novocab/model.safetensors", b"x")
    _write(f"{scratch}/noweights/vocab.txt", b"a\n")
    _write(f"{scratch}/noweights/other.json", b"{}")
    res = {r["dir"].split("/")[-1]: (r["ready"], list(r["missing"]))
           for r in audit_model_dirs(spark, scratch).collect()}
    assert res["full"] == (True, [])
    assert res["novocab"] == (False, ["vocab.txt"])
    assert res["noweights"] == (False, ["model.safetensors"])


def _ids_df(spark, n=40, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        L = int(rng.integers(2, TINY.max_seq + 1))
        rows.append((i, [101] + rng.integers(0, TINY.vocab_size, L - 2).tolist() + [102]))
    return spark.createDataFrame(rows, "doc_id long, ids array<int>")


def test_embed_matches_single_sentence_and_partitioning(spark, scratch):
    w = M.seeded_weights(TINY, seed=1)
    _write(f"{scratch}/tiny/model.safetensors", safetensors_bytes(w))
    model = load_model(spark, f"{scratch}/tiny", TINY)
    df = _ids_df(spark)
    a = {r["doc_id"]: np.array(r["embedding"]) for r in embed(df, model).collect()}
    b = {r["doc_id"]: np.array(r["embedding"])
         for r in embed(df.repartition(3), model, balance=False, token_budget=64).collect()}
    direct = {}
    for r in df.collect():
        direct[r["doc_id"]] = M.encode_same_length(np.array([r["ids"]]), w, TINY)[0]
    for k in direct:
        assert np.max(np.abs(a[k] - direct[k])) < 1e-5
        assert np.max(np.abs(b[k] - direct[k])) < 1e-5
        assert abs(np.linalg.norm(a[k]) - 1) < 1e-3


def test_full_length_and_bad_ids(spark):
    model = model_from_weights(spark, TINY, M.seeded_weights(TINY, 2))
    df = spark.createDataFrame([(i, [101] + [5 + i] * (TINY.max_seq - 2) + [102]) for i in range(4)],
                               "doc_id long, ids array<int>")
    out = embed(df, model).collect()
    assert len(out) == 4 and all(r["n_tokens"] == TINY.max_seq for r in out)
    assert all(np.isfinite(r["embedding"]).all() for r in out)
    bad = spark.createDataFrame([(1, [101] * (TINY.max_seq + 1))], "doc_id long, ids array<int>")
    with pytest.raises(Exception):
        embed(bad, model, balance=False).collect()


def test_parse_roundtrip():
    w = {"x": np.arange(6, dtype=np.float32).reshape(2, 3)}
    got = parse_safetensors(safetensors_bytes(w))
    assert np.array_equal(got["x"], w["x"])


def test_published_shape_full_length_batch():
    cfg = M.PUBLISHED_CONFIG
    w = M.seeded_weights(cfg, seed=3)
    rng = np.random.default_rng(1)
    seqs = [np.concatenate([[101], rng.integers(103, cfg.vocab_size, cfg.max_seq - 2), [102]])
            for _ in range(4)]
    out = M.encode_batch(seqs, w, cfg)
    assert out.shape == (4, 512) and np.isfinite(out).all()
    assert np.allclose(np.linalg.norm(out, axis=1), 1, atol=1e-3)
    # a short sentence in the same ragged batch does not change the long ones
    mixed = M.encode_batch(seqs[:2] + [np.array([101, 7, 102])], w, cfg)
    assert np.max(np.abs(mixed[:2] - out[:2])) < 1e-5


def test_bad_files_are_reported_and_missing_tensors_found_per_file(spark, tmp_path):
    import struct

    good = {"a": np.ones((2, 3), np.float32), "b": np.zeros(4, np.float32)}
    (tmp_path / "m1.safetensors").write_bytes(safetensors_bytes(good))
    (tmp_path / "m2.safetensors").write_bytes(safetensors_bytes({"a": good["a"]}))
    rows = {(r["path"].rsplit("/", 1)[1], r["name"]): r["reason"] for r in scan_models(spark, str(tmp_path)).collect()}
    assert rows == {("m1.safetensors", "a"): None, ("m1.safetensors", "b"): None, ("m2.safetensors", "a"): None}
    with pytest.raises(ValueError, match=r"m2\.safetensors: missing tensors: \['b'\]"):
        weight_rows(spark, str(tmp_path), ["a", "b"])
    assert weight_rows(spark, str(tmp_path), ["a"]).count() == 4

    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "short.safetensors").write_bytes(b"abc")
    (bad / "long.safetensors").write_bytes(struct.pack("<Q", 2**63 + 5) + b"{}")
    (bad / "text.safetensors").write_bytes(struct.pack("<Q", 5) + b"nope!")
    (bad / "empty.safetensors").write_bytes(struct.pack("<Q", 2) + b"{}")
    head = b'{"x":{"dtype":"F32","shape":[2],"data_offsets":[0,99]},"y":{"dtype":"F32","shape":[3],"data_offsets":[0,8]}}'
    (bad / "offsets.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + bytes(8))
    got = {(r["path"].rsplit("/", 1)[1], r["name"]): (r["status"], r["reason"])
           for r in scan_models(spark, str(bad)).collect()}
    assert {k[0] for k in got} == {f"{n}.safetensors" for n in ("short", "long", "text", "empty", "offsets")}
    assert all(s == "rejected" for s, _r in got.values())
    assert got[("offsets.safetensors", "x")][1] == "tensor lies outside the data"
    assert got[("offsets.safetensors", "y")][1] == "offsets do not agree with the shape"
    with pytest.raises(ValueError, match="short"):
        weight_rows(spark, str(bad))


def _word_model(spark, weights, words):
    from wordloom.operators.embed import with_vocabulary

    base = model_from_weights(spark, TINY, weights, with_words=False)
    assert M.EMBEDDING_TENSORS[0] not in base.weights_bc.value
    rows = [(i, v.tolist()) for i, v in enumerate(words)]
    return with_vocabulary(base, spark.createDataFrame(rows, "token_id int, w array<float>"), len(rows))


def test_seeded_words_go_on_beyond_the_word_tensor(spark):
    from wordloom.operators.embed import seeded_words

    cfg = M.ModelConfig(vocab_size=1500, hidden=8, layers=1, heads=2, max_seq=16, ffn=16)
    got = {n: {r["token_id"]: r["w"] for r in seeded_words(spark, cfg, n, seed=5).collect()} for n in (700, 1500, 4000)}
    assert all(sorted(w) == list(range(n)) for n, w in got.items())
    tensor = M.seeded_weights(cfg, 5)[M.EMBEDDING_TENSORS[0]]
    assert np.array_equal(np.array([got[1500][i] for i in range(1500)], np.float32), tensor)
    for w in got.values():      # a word's vector does not depend on the size of the vocabulary
        assert all(w[i] == got[4000][i] for i in w)
    assert len({tuple(v) for v in got[4000].values()}) == 4000


@pytest.mark.parametrize("pairs", [500_000, 0])
def test_word_table_gives_the_vectors_of_the_broadcast(spark, monkeypatch, pairs):
    from wordloom.operators import embed as E

    weights = M.seeded_weights(TINY, seed=4)
    rows = [(r["doc_id"], r["ids"]) for r in _ids_df(spark, n=60).collect()]
    rows += [(None, [101, 7, 102])] * 40 + [(3, [101] + [9] * 30 + [102])] * 40     # null and repeated keys
    df = spark.createDataFrame([(k, f"c{i}", s) for i, (k, s) in enumerate(rows)], "doc_id long, c string, ids array<int>")
    monkeypatch.setattr(E, "BLOCK_BYTES", 4 * TINY.hidden * 100)
    monkeypatch.setattr(E, "BROADCAST_PAIRS", pairs)
    blocks, n = E._blocks(df.select("doc_id", F.col("ids").alias("_ids"), F.size("ids").alias("_n")), ["doc_id"], TINY.hidden, TINY.max_seq)
    held = [r["t"] for r in blocks.groupBy("_at").agg(F.sum(F.size("_ids")).alias("t")).collect()]
    assert n >= 20 and max(held) <= 100 + 3 * TINY.max_seq and sum(held) == sum(len(s) for _, s in rows)
    model = _word_model(spark, weights, weights[M.EMBEDDING_TENSORS[0]])
    out = embed(df, model, carry=["c"])
    assert out.columns == ["doc_id", "c", "n_tokens", "embedding"]
    got = {r["c"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, (k, s) in enumerate(rows):
        r = got[f"c{i}"]
        assert (r["doc_id"], r["n_tokens"]) == (k, len(s))
        assert np.max(np.abs(np.array(r["embedding"]) - M.encode_same_length(np.array([s]), weights, TINY)[0])) < 1e-5
    assert embed(df.limit(0), model).count() == 0


@pytest.mark.parametrize("ids", [[101, 1000, 102], [101, -1, 102], [101] * (TINY.max_seq + 1), [], None])
def test_word_table_refuses_bad_ids(spark, ids):
    weights = M.seeded_weights(TINY, seed=4)
    model = _word_model(spark, weights, weights[M.EMBEDDING_TENSORS[0]])
    df = spark.createDataFrame([(1, ids), (2, [101, 5, 102])], "doc_id long, ids array<int>")
    with pytest.raises(Exception):
        embed(df, model).collect()


def test_benchmark_takes_a_vocabulary_larger_than_the_published_one(spark, tmp_path):
    from wordloom.plans import model_queries as Q
    from wordloom.plans.context import vocab

    words = [f"zz{i:05d}" for i in range(22_000)]
    spark.createDataFrame([(i, " ".join(words)) for i in range(30)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    texts = [" ".join(words[-40:]), "zz00000 zz21999", "zz00000 unknown!", "", "zz00000 zz21999"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    v, info = vocab(spark, str(tmp_path))
    ids = {r["token"]: r["id"] for r in v.collect()}
    cfg = M.PUBLISHED_CONFIG
    assert info.max_id >= cfg.vocab_size and ids["zz21999"] >= cfg.vocab_size
    got = {r["item_id"]: r for r in Q.d1_embed_benchmark(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[0]["n_tokens"] == 42 and got[3]["n_tokens"] == 2
    assert np.allclose(got[1]["embedding"], got[4]["embedding"], atol=1e-5)
    assert not np.allclose(got[1]["embedding"], got[2]["embedding"], atol=1e-2)
    w = M.seeded_weights(cfg, 0)
    more = np.concatenate([rows for _, rows in M.seeded_word_rows(cfg, 0, 1)])
    w[M.EMBEDDING_TENSORS[0]] = np.concatenate([w[M.EMBEDDING_TENSORS[0]], more])
    for i in (0, 1):
        seq = [101, *(ids[x] for x in texts[i].split()), 102]
        assert np.max(np.abs(np.array(got[i]["embedding"]) - M.encode_same_length(np.array([seq]), w, cfg)[0])) < 1e-5
