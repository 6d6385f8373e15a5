import hashlib
import random

import numpy as np
import pytest

from wordloom.llm import bpe, queries
from tests.llm.conftest import rows

PATH = queries.tokenizer_path("byte_bpe_50k.json")
PIECES = ["a", "s", "t", "re", "ll", "'", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\x85", "é",
          "ß", "ñ", "中", "😀", "!", "#", "’", "1", "٣", "<|endoftext|>", "<|", "\x1c", "\x00", "İ", "​",
          ".", ",", "q", "z", "Z", "\x7f", "“"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_fragments_equal_the_library_on_adversarial_texts(reference):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(6000)]
    _key, spec = bpe.load_tokenizer(PATH)
    enc, dec = bpe.Fragments(spec), bpe.TokenBytes(spec)
    offsets, ids = enc.encode([t.encode() for t in texts])
    decoded = dec.decode(ids.astype(np.int64), offsets)
    for i, e in enumerate(reference.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == e.ids, repr(texts[i])
        assert decoded[i] == reference.decode(e.ids, skip_special_tokens=False)


def test_cuts_are_certain_and_frequent():
    _key, spec = bpe.load_tokenizer(PATH)
    enc = bpe.Fragments(spec)
    text = b"forced boundaries fall between words, it's said"
    stops = enc.boundaries(text, np.array([len(text)]))
    cut = [text[a:b] for a, b in zip([0, *stops[:-1]], stops)]
    assert b"".join(cut) == text and b" boundaries" in cut and not any(f.startswith(b"'") for f in cut)


def test_a_tokenizer_whose_cuts_are_unsafe_is_refused():
    with pytest.raises(ValueError):
        bpe.load_tokenizer(queries.tokenizer_path("word_bpe_49k.json"))


def test_edge_rows_round_trip(spark, edge_docs, reference):
    out = bpe.encode(edge_docs, PATH, decoded_col="decoded")
    assert "ids" in out.columns and dict(out.dtypes)["ids"] == "array<int>"     # the clashing column is replaced
    got = sorted((r["doc_id"] or -1, r["decoded"], tuple(r["ids"])) for r in out.collect())
    want = sorted((r[0] or -1, r[1] or "", tuple(reference.encode(r[1] or "", add_special_tokens=False).ids))
                  for r in rows())
    assert got == want
    again = bpe.decode(out.drop("decoded"), PATH, keep=["doc_id"])
    assert sorted(r["decoded"] for r in again.collect()) == sorted(r[1] or "" for r in rows())


def test_unknown_and_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, [15496, 999999, -1]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] for r in bpe.decode(df, PATH).collect()} == {1: "Hello", 2: "", 3: ""}


def test_empty_table(spark, no_docs):
    assert bpe.encode(no_docs, PATH, decoded_col="decoded").count() == 0


def test_query_digests(spark, reference):
    out = {r["doc_id"]: r for r in queries.op2_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for r in docs:
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        row = out[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_ids_digest_of_an_empty_text(spark):
    df = spark.createDataFrame([([],)], "ids array<int>").select(bpe.ids_digest("ids").alias("d"))
    assert df.first()["d"] == hashlib.sha256(b"").hexdigest()
