"""Training-corpus pipeline over ``documents``: quality, toxicity, near
duplicates, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet in the shared folder and reread as the next stage's docs, so a lost
executor repeats one stage at most.  What a stage writes in between, and the
stages' own tables once the last is written, are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import read_table, settled
from wordloom.llm.stages import STAGES

ORACLE_SQL = None    # the stages are language-model and classifier decisions; see tests/llm

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the whole ``documents`` table."""
    def staged() -> DataFrame:
        docs = read_table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = settled(spark, f"pipeline-{name}", lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)

    return settled(spark, "pipeline", staged)
