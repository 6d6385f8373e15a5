"""Stages of the corpus pipeline.  Each takes (spark, docs, sf_dir), judges every
row of ``docs`` by its whole text and returns the kept rows with the columns
they came with (the last one: token ids).  A stage's own columns carry a prefix,
so input columns of any name pass through.

Rows are told apart by two hashes of key and text, not by the key, so null and
repeated keys are judged row by row.  Null and empty texts pass the quality,
toxicity and decontamination stages; near duplicates keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, decontaminate, kneser_ney, simhash, toxicity
from .common import read_table
from .queries import tokenizer_path

ROW = ("_wl_row", "_wl_row2")


def _with_row(docs: DataFrame) -> DataFrame:
    key, text = F.col("doc_id"), F.col("text")
    empty = text.isNull()          # a null text is another row than an empty one
    return (docs.withColumn(ROW[0], F.xxhash64(key, text, key.isNull(), empty))
            .withColumn(ROW[1], F.xxhash64(F.lit("second"), text, key, empty, key.isNull())))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity is within their language's threshold."""
    rows = _with_row(docs)
    judged = kneser_ney.classify(rows, read_table(spark, sf_dir, "labels"), carry=ROW)
    bad = judged.where("rejected").select(*ROW).distinct()
    return rows.join(bad, list(ROW), "left_anti").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, score_col="_wl_score", predicted_col="_wl_toxic")
    return scored.where("_wl_toxic = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the one with the smallest key (null last)."""
    rows = _with_row(docs)
    found = simhash.near_duplicates(rows, shingle=3, max_bits=3, carry=ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *ROW))
    kept = found.groupBy("root").agg(first.alias("w")).select(*[F.col(f"w.{c}").alias(c) for c in ROW])
    # repeated rows are cut to one before the shuffle ends (grouped limit), then matched
    once = Window.partitionBy(*ROW).orderBy(F.lit(1))
    single = rows.withColumn("_wl_n", F.row_number().over(once)).where("_wl_n = 1")
    return single.join(kept, list(ROW), "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an overlap with a benchmark item."""
    found = decontaminate.find_overlaps(docs, read_table(spark, sf_dir, "benchmark"), out_col="_wl_hits")
    return found.where(~decontaminate.is_contaminated("_wl_hits")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, round_trip): BPE ids of every row,
    and whether decoding gives the text back."""
    keep = ["doc_id", "lang", "source", "_wl_text"]
    rows = bpe.encode(docs.withColumn("_wl_text", F.xxhash64(F.coalesce("text", F.lit("")))),
                      tokenizer_path("byte_bpe_50k.json"), keep=keep, decoded_col="_wl_decoded")
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       (F.xxhash64("_wl_decoded") == F.col("_wl_text")).alias("round_trip"))


STAGES = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]
