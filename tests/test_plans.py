"""Plan-shape guards for the tokeniser's scale properties (README "Scale
design"): what is read and how rows move."""

import contextlib
import io

from conftest import SF001
from wordloom.operators.ordering import ordered_index
from wordloom.operators.wordpiece import segment_words, tokenize, vocab_info
from wordloom.sources.vocab import fixture_vocab


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _docs_vocab(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    vocab = fixture_vocab(docs)
    return docs, vocab, vocab_info(vocab)


def test_tokeniser_reads_its_input_once_and_stays_in_the_jvm(spark):
    docs, vocab, info = _docs_vocab(spark)
    plan = _plan(tokenize(docs, vocab, carry=["lang"], info=info))
    assert "documents.parquet" not in plan              # the occurrences are read instead
    assert "Python" not in plan and "Pandas" not in plan


def test_segmentation_probes_the_vocabulary_by_broadcast_when_it_is_small(spark):
    docs, vocab, info = _docs_vocab(spark)
    words = docs.selectExpr("explode(split(text, ' ')) as word").where("word <> ''").distinct()
    plan = _plan(segment_words(words, vocab, info))
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "SortMergeJoin" not in plan
    # the exchange that makes the words distinct is the only one
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") - plan.count("BroadcastExchange") == 1


def test_ordered_index_has_no_python(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "source")
    plan = _plan(ordered_index(docs, ["source"], ["doc_id"]))
    assert "Python" not in plan and "Pandas" not in plan
