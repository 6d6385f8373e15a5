"""Randomised agreement: Catalyst basic tokeniser vs an independent Python
regex implementation, relational WordPiece vs greedy brute force, on seeded
random texts covering every character class (one Spark job per property)."""

import random

from pyspark.sql import functions as F

from wordloom.functions.pytokenizer import PyWordPiece
from wordloom.functions.text import basic_tokenize
from wordloom.operators.wordpiece import segment_words, vocab_info

ALPHABET = (list("abcxyzAB09éüñ") + list("!#$%&()*+,-./:;<=>?@[\\]^_`{|}~") +
            [" ", " ", "\t", "\n", "\r", "　", " ", "\u000b", "\u0000"] +
            ["一", "北", "鿿", "㐀", "䶿", "\U00020000", "\U0002a6df",
             "\U0001f600", "、", "，", "’"])


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_basic_tokenize_matches_python(spark):
    texts = _texts(500, 11)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r["i"]: list(r["c"]) for r in df.select("i", basic_tokenize("text", None).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == PyWordPiece.basic(t, None), (i, t)


def test_wordpiece_random_words_match_brute_force(spark):
    rng = random.Random(5)
    letters = "abcdeé北京"
    vocab_tokens = {"[UNK]": 100, "[CLS]": 101, "[SEP]": 102}
    for tok in {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(60)}:
        vocab_tokens.setdefault(tok, 200 + len(vocab_tokens))
        vocab_tokens.setdefault("##" + tok, 200 + len(vocab_tokens))
    vocab = spark.createDataFrame([(i, t) for t, i in vocab_tokens.items()], "id int, token string")
    words = sorted({"".join(rng.choice(letters + "z") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    wdf = spark.createDataFrame([(w,) for w in words], "word string")
    seg = {r["word"]: (list(r["pieces"]), list(r["piece_ids"]))
           for r in segment_words(wdf, vocab, vocab_info(vocab)).collect()}
    py = PyWordPiece(vocab_tokens)
    for w in words:
        pieces = py.word(w)
        assert seg[w][0] == pieces, w
        assert seg[w][1] == [vocab_tokens.get(p, 100) for p in pieces], w
