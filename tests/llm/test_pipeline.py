from collections import Counter

import pytest

import corpus_pipeline
from wordloom.llm import stages
from tests.llm.conftest import EXTRA, rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_edge_rows(spark, edge_docs, no_docs, name, stage):
    kept = stage(spark, edge_docs, SF).collect()
    assert stage(spark, no_docs, SF).count() == 0
    given = Counter((r[0], r[1]) for r in rows())
    if name == "bpe":
        assert Counter(r["doc_id"] for r in kept) == Counter(r[0] for r in rows()) and all(r["round_trip"] for r in kept)
        return
    assert list(kept[0].asDict()) == edge_docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept)
    assert all(got[x] <= given[x] for x in got) and all(r[5:] == EXTRA for r in kept)
    if name == "near_duplicates":
        assert max(got.values()) == 1
        assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1, 2, 6, 7, 8, 9, 10, 11]
    elif name == "toxicity":
        assert given - got == Counter({(9, "l0ser tra$h ıdiot"): 1})
    elif name == "decontamination":
        assert got == given
    else:
        assert all(got[x] == given[x] for x in given if not x[1])


def test_stages_over_the_documents(spark):
    """Each stage against the labels and a brute-force view of its own input."""
    from wordloom.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        seen[name] = (before, set(after))
    before, after = seen["quality"]
    clean = [i for i in before if i in labels and labels[i]["quality"] == 1]
    assert sum(i not in after for i in clean) <= 0.02 * len(clean)
    junk = [i for i in before if i in labels and labels[i]["quality"] == 0]
    assert sum(i in after for i in junk) <= 0.25 * len(junk)
    before, after = seen["toxicity"]
    clean = [i for i in before if i in labels and labels[i]["toxic"] == 0]
    assert sum(i not in after for i in clean) <= 0.03 * len(clean)
    assert seen["bpe"][0] == seen["bpe"][1] and docs.where("not round_trip").count() == 0


def test_stage_names_and_order():
    assert [f for _n, f in corpus_pipeline.STAGES] == [
        stages.quality, stages.toxic, stages.near_duplicates, stages.decontaminated, stages.encoded]
    assert corpus_pipeline.ORACLE_SQL is None
