"""A1 corpus read, A8 baseline-vector read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType | None = DOCUMENT_SCHEMA,
                stream: bool = False) -> DataFrame:
    """A1: texts to embed.  Explicit schema (no inference); the same call with
    ``stream=True`` gives the Structured Streaming source for H1.  ``text``
    format yields one text per line in column ``text``."""
    reader = spark.readStream if stream else spark.read
    if fmt == "text":
        df = reader.text(path).withColumnRenamed("value", "text")
        return df
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def vector_from_text(col) -> "F.Column":
    """A8 helper: a whole text file with one float per line -> array<float>;
    line order is component order; blank trailing lines are ignored."""
    c = F.col(col) if isinstance(col, str) else col
    lines = F.split(F.regexp_replace(c, r"\s+\z", ""), r"\r?\n")
    return F.transform(lines, lambda x: F.trim(x).cast("float"))


def read_baseline_vectors(spark: SparkSession, path: str) -> DataFrame:
    """One baseline vector per file -> ``(path, vec array<float>)``."""
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("path"), vector_from_text("value").alias("vec")))
