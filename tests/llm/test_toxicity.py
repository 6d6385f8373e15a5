import zlib

import numpy as np

from wordloom.llm import queries, toxicity as X
from tests.llm.conftest import rows


def hits(text, model=None):
    return X.match((model or X.ToxicModel()).automaton(), text)


def test_folding_sees_through_look_alikes_digits_and_invisible_signs():
    for t in ("loser", "LOSER", "l0ser", "lоser", "ｌｏｓｅｒ", "lo\u200bser", "lo$er", "loser!"):
        assert hits(t)[0] > 0, t


def test_words_stems_and_boundaries():
    m = X.ToxicModel(weights={"=bad": 1.0, "^zorg": 2.0, "=zorgon": 5.0})
    assert hits("bad badly abad", m)[0] == 1.0
    assert hits("zorgs azorg", m)[0] == 2.0
    assert hits("zorgon", m)[0] == 5.0              # the best entry of a word counts once
    assert hits("bad " * 3, m)[:2] == (3.0, 3)


def test_exception_phrases_shield_their_words_only():
    assert hits("put it in the trash can")[0] == 0
    assert hits("trash can, you trash")[0] == 3.0


def test_score_is_length_normalised(spark):
    df = spark.createDataFrame([(1, "you loser"), (2, "you loser " + "and so on it goes " * 400)],
                               "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in X.score(df, X.ToxicModel()).collect()}
    assert s[1] > s[2] > 0


def test_edge_rows(spark, edge_docs, edge_labels):
    model = X.learn(edge_docs, edge_labels)
    out = X.score(edge_docs, model).collect()
    assert len(out) == len(rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["predicted"] for r in out} <= {0, 1} and all(r["key"] == "own" for r in out)
    flagged = {r["doc_id"] for r in out if r["predicted"] == 1}
    assert flagged == {9}


def test_empty_tables(spark, no_docs, no_labels, edge_docs):
    model = X.learn(no_docs, no_labels)
    assert model.weights == X.ToxicModel().weights
    assert X.score(no_docs, model).count() == 0
    assert X.learn(edge_docs, no_labels).coef == X.ToxicModel.coef


def test_held_out_fold(spark):
    df = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    for r in df.select("doc_id", X.held_out("doc_id").alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_held_out_labels_are_never_read(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 "
                                "then 1 - toxic else toxic end as toxic")
    a, b = X.learn(docs, labels), X.learn(docs, flipped)
    assert a.weights == b.weights and np.allclose(a.coef, b.coef)


def test_query_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    rows_ = out.select("toxic", "predicted", "score").collect()
    wrong = sum(r["toxic"] != r["predicted"] for r in rows_)
    assert len(rows_) > 500 and wrong <= 0.02 * len(rows_)
    found = [r["predicted"] for r in rows_ if r["toxic"] == 1]
    assert sum(found) >= 0.9 * len(found)


def plain_scan(model, text):
    """What ``match`` should find, by looking at every place of both readings."""
    best, safe, words = {}, [], 0
    texts = [X.fold(text), X.fold(text, True)]
    for t in texts:
        for i in range(len(t)):
            if i and t[i - 1].isalpha():
                continue
            for entry, w in model.weights.items():
                end = i + len(entry) - 1
                if t.startswith(entry[1:], i) and (entry[0] == "^" or not t[end:end + 1].isalpha()):
                    if i not in best or w > best[i][1]:
                        best[i] = (end - 1, w)
            safe += [(i, i + len(p) - 1) for p in model.exceptions if t.startswith(p, i) and not t[i + len(p):i + len(p) + 1].isalpha()]
    spans = [(s, e, w) for s, (e, w) in sorted(best.items()) if not any(a <= s and e <= b for a, b in safe)]
    return sum(w for _s, _e, w in spans), spans


def test_match_equals_a_plain_scan():
    import random

    rng = random.Random(9)
    model = X.ToxicModel(weights={"=bad": 1.0, "^bad": 0.5, "=lid": 2.0, "^li": 0.25, "=oil": 3.0, "=so": 1.5, "^abad": 4.0},
                         exceptions=("bad lid", "so bad", "lid", "oil so bad"))
    a = model.automaton()
    pieces = ["bad", "b4d", "lid", "1id", "l1d", "oil", "0i1", "so", "5o", "abad", "x", "é", " ", "  ", ".", "badly", "\u200b", "ﬁ", "Ｂad"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", " ", "-"]) for _ in range(rng.randrange(9)))
        got = X.match(a, text)
        want = plain_scan(model, text)
        assert (got[0], got[2]) == want, text


def test_ones_are_read_both_ways():
    assert hits("1oser")[0] > 0 and hits("id1ot")[0] > 0 and hits("wor7h1ess")[0] > 0


def test_exceptions_are_learned_from_clean_texts(spark):
    docs = [(i, f"what a clown nose it was number {i}") for i in range(40)] + \
           [(100 + i, f"you are a clown and a fool {i}") for i in range(200)]
    labels = [(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(200)]
    model = X.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    if "=clown" in model.weights:
        assert "clown nose" in model.exceptions and hits("a clown nose", model)[0] == 0 < hits("a clown", model)[0]


def test_repeated_keys_stay_within_the_bound(spark):
    """A third of all rows share one labelled id."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "concat('you l0ser ', id % 3) as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    seen = []
    plain = X.stored
    try:
        def counted(df, name):
            out = plain(df, name)
            seen.append((name, out.count()))
            return out

        X.stored = counted
        X.learn(docs, labels, max_labelled=500)
    finally:
        X.stored = plain
    assert 0 < dict(seen)["toxic-sample"] <= 500


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "you loser", 1, 2, 3, "x")], "doc_id long, text string, _weight int, _words int, weight int, own string")
    r = X.score(df, X.ToxicModel()).first()
    assert (r["_weight"], r["_words"], r["weight"], r["own"]) == (1, 2, 3, "x") and r["score"] > 0.5
