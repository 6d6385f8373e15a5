"""A2/B1 request parsing edge cases, E2/A7 response assembly on inline rows."""

import json

from pyspark.sql import functions as F

from wordloom.constants import MODEL_NAME
from wordloom.operators.requests import (assemble_responses, explode_requests, parse_request,
                                         request_bodies, response_json)


def test_parse_request_cases(spark):
    bodies = [
        (1, json.dumps({"input": "北京的天气不错", "model": "m1"})),
        (2, json.dumps({"input": ["a", "b", "c"]})),
        (3, json.dumps({"input": []})),
        (4, json.dumps({"model": "m"})),
        (5, json.dumps({"input": 5})),
        (6, json.dumps({"input": ["a", 5]})),
        (7, "not json"),
        (8, json.dumps({"input": "[CLS] hi"})),
        (9, json.dumps({"input": '["q"]'})),
        (10, json.dumps({"input": ["", "x"]})),
    ]
    df = spark.createDataFrame(bodies, "rid long, body string")
    texts, rejects = explode_requests(df, ["rid"])
    got = {}
    for r in texts.collect():
        got.setdefault(r["rid"], []).append((r["index"], r["text"], r["model"]))
    assert got[1] == [(0, "北京的天气不错", "m1")]
    assert [t for _, t, _ in sorted(got[2])] == ["a", "b", "c"] and got[2][0][2] == "bge-small-zh-v1.5"
    assert got[8] == [(0, "[CLS] hi", "bge-small-zh-v1.5")]       # kept as a plain string
    assert got[9] == [(0, '["q"]', "bge-small-zh-v1.5")]          # a string, not a list
    assert sorted(got[10]) == [(0, "", "bge-small-zh-v1.5"), (1, "x", "bge-small-zh-v1.5")]  # empty string passes
    errors = {r["rid"]: r["error"] for r in rejects.collect()}
    assert errors == {3: "input must not be empty", 4: "missing input",
                      5: "input must be a string or a list of strings",
                      6: "input must be a string or a list of strings", 7: "invalid json"}


def test_response_assembly_order_and_usage(spark):
    rows = [(7, 2, [0.3], 4, "m"), (7, 0, [0.1], 9, "m"), (7, 1, [0.2], 5, "m"), (8, 0, [1.0], 3, "m")]
    df = spark.createDataFrame(rows, "rid long, index int, embedding array<float>, n_tokens int, model string")
    resp = assemble_responses(df, ["rid"])
    docs = {r["rid"]: json.loads(r["response"]) for r in response_json(resp, ["rid"]).collect()}
    d = docs[7]
    assert d["object"] == "list" and d["model"] == "m"
    assert [x["index"] for x in d["data"]] == [0, 1, 2]
    assert [round(x["embedding"][0], 4) for x in d["data"]] == [0.1, 0.2, 0.3]
    assert all(x["object"] == "embedding" for x in d["data"])
    assert d["usage"] == {"prompt_tokens": 18, "total_tokens": 18}
    assert docs[8]["usage"]["total_tokens"] == 3


def test_model_must_be_a_string_or_left_out(spark):
    bodies = [(1, '{"input": "a", "model": "m"}'), (2, '{"input": "a"}'), (3, '{"input": "a", "model": 5}'),
              (4, '{"input": "a", "model": null}'), (5, '{"input": ["a"], "model": ["m"]}')]
    df = spark.createDataFrame(bodies, "id long, body string")
    got = {r["id"]: (r["r"]["model"], r["r"]["error"]) for r in df.select("id", parse_request(F.col("body")).alias("r")).collect()}
    assert got[1] == ("m", None) and got[2] == (MODEL_NAME, None)
    assert {got[i][1] for i in (3, 4, 5)} == {"model must be a string"}


def test_a_request_holds_all_its_inputs(spark):
    texts = spark.range(3000).selectExpr("id % 2 as k", "id as o", "concat('t', id) as text")
    bodies = request_bodies(texts, ["k"], "o")
    rows, rejects = explode_requests(bodies, ["k"])
    assert bodies.count() == 2 and rejects.count() == 0
    got = rows.where("k = 1").orderBy("index").select("text").collect()
    assert [r["text"] for r in got] == [f"t{i}" for i in range(1, 3000, 2)]


def test_batches_of_null_and_repeated_ids(spark):
    """A batch member is its place, not its id."""
    from wordloom.operators.batching import batch_reject, batch_tokens, ragged_offsets
    from wordloom.operators.wordpiece import vocab_info
    from wordloom.plans.service_queries import batched_tokens

    vocab = spark.createDataFrame([(0, "a"), (100, "[UNK]"), (101, "[CLS]"), (102, "[SEP]")], "id int, token string")
    docs = spark.createDataFrame([(1, "a", "s"), (1, "a a", "s"), (None, "a a a", "s"), (2, "a a a a", "s"), (3, "", None)],
                                 "doc_id long, text string, source string")
    got = batched_tokens(docs, vocab, vocab_info(vocab))
    offsets = sorted((r["source"] or "", r["idx_in_batch"], r["doc_id"], r["offset"], r["n_tokens"])
                     for r in ragged_offsets(got, ["source"]).collect())
    assert offsets == [("", 0, 3, 0, 2), ("s", 0, None, 0, 5), ("s", 1, 1, 5, 3), ("s", 2, 1, 8, 4), ("s", 3, 2, 12, 6)]
    assert sorted((r["source"] or "", r["batch_tokens"]) for r in batch_tokens(got, ["source"]).collect()) == [("", 2), ("s", 18)]
    rejected = batch_reject(got, ["source"])
    assert rejected.count() == 5 and rejected.where("batch_status = 'ok'").count() == 5
