"""Per-session shared inputs for the registered queries: the table reader and
the vocabulary.  The fixture vocabulary is built once per application and data
folder, written as a vocabulary file and read back through ``read_vocab``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.wordpiece import VocabInfo, with_index
from ..session import read_table, scratch_path, stored
from ..sources.vocab import fixture_vocab, read_vocab, write_vocab

_VOCABS: dict[tuple[str, str], tuple[DataFrame, VocabInfo]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def vocab(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, VocabInfo]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VOCABS:
        path = scratch_path(spark, "vocab-file")
        write_vocab(fixture_vocab(table(spark, sf_dir, "documents")), path)
        v = stored(read_vocab(spark, path), "vocab")
        _VOCABS[key] = (v, with_index(v))
    return _VOCABS[key]
