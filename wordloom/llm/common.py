"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hand_on, read_table, scratch_path, scratch_scope, settled, ship_package, stored

__all__ = ["hand_on", "read_table", "scratch_path", "scratch_scope", "settled", "ship_package", "stored", "map_arrow",
           "text_or_empty", "utf8_size", "row_chunks", "byte_sizes", "small_batches"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def utf8_size(col: str | Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.octet_length(text_or_empty(col)).cast("long")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_BATCH_ROWS = 500


def small_batches(spark) -> None:
    """Whole texts go to Python: Spark's default of 10,000 rows per Arrow
    batch would hold tens of MB (or GB, with long texts) on both sides."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXT_BATCH_ROWS:
        spark.conf.set(BATCH_ROWS, str(TEXT_BATCH_ROWS))


def map_arrow(df: DataFrame, keep: Sequence[str], new_fields: Sequence[T.StructField],
              make: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple[int, int, list[pa.Array]]]]],
              inputs: Sequence[str]) -> DataFrame:
    """Append columns computed per Arrow batch inside the scan's own tasks.

    ``make()`` runs once per task and returns a function from a batch of the
    ``inputs`` columns to ``(start, stop, arrays)`` slices; the ``keep``
    columns pass through unchanged.  Slices keep the working set of a task
    small whatever the batch size.  No shuffle.
    """
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    extra = [c for c in inputs if c not in keep]
    src = df.select(*keep, *extra)
    names = [f.name for f in new_fields]
    schema = T.StructType([df.schema[c] for c in keep] + list(new_fields))
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for start, stop, arrays in fn(batch):
                kept = [batch.column(i).slice(start, stop - start) for i in range(n_keep)]
                yield pa.RecordBatch.from_arrays(kept + list(arrays), names=list(keep) + names)

    return src.mapInArrow(run, schema)


def byte_sizes(col: pa.Array) -> list[int]:
    """Bytes of each value of a binary column (0 for null)."""
    import pyarrow.compute as pc

    return pc.binary_length(col).fill_null(0).to_pylist()


def row_chunks(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes (one row at least)."""
    start, acc = 0, 0
    for i, n in enumerate(sizes):
        if acc and acc + n > limit:
            yield start, i
            start, acc = i, 0
        acc += int(n)
    if start < len(sizes):
        yield start, len(sizes)
