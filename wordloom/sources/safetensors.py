"""A4 model catalogue scan, A5 weight-matrix read, A9 model-directory audit.

Safetensors layout: 8-byte little-endian header length n, n bytes of JSON
``{name: {dtype, shape, data_offsets: [begin, end]}, "__metadata__": {...}}``,
then the data; offsets are relative to the data start ``8 + n``.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import REQUIRED_MODEL_FILES
from ..session import ship_package
from .tensor_files import HeaderSource, TensorSource

# fixed values: bytes of one element
DTYPE_BYTES = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1}
HEADER_SCHEMA = "map<string,struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>>"


def _source(spark: SparkSession, source, path: str, **options) -> DataFrame:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")     # Spark wants it for sources that take filters
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(path)


def header_length(content: Column) -> Column:
    """First 8 bytes as an unsigned little-endian integer (byte order reversed
    on the hex text, so no byte is ever decoded as a character)."""
    hx = F.hex(F.substring(content, 1, 8))
    big_endian = F.concat(*[F.substring(hx, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(big_endian, 16, 10).try_cast("long")


def catalogue(files: DataFrame) -> DataFrame:
    """A4: files (path, length, content: the whole file or its header at least) ->
    one row per tensor: ``(path, header_len, name,
    dtype, shape, numel, begin_off, end_off, data_start, status, reason)``;
    ``__metadata__`` (no dtype) is skipped.

    A file that is too short, whose header does not fit in it or is no JSON
    object of tensors gives one row with null ``name``, status ``rejected`` and a
    reason; so does a tensor whose offsets lie outside the data or do not agree
    with its shape.  Nothing is dropped silently.
    """
    size = F.col("length").cast("long")
    # an unsigned length above the file's own is refused before it is used
    hl = F.when(size >= 8, header_length(F.col("content")))
    fits = hl.isNotNull() & (hl >= 0) & (hl <= size - 8)
    header = F.when(fits, F.substring(F.col("content"), F.lit(9), hl.cast("int")))
    text = F.when(F.call_function("is_valid_utf8", header.cast("string")), header.cast("string"))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    parsed = files.select(
        "path", hl.alias("header_len"), (F.lit(8) + hl).alias("data_start"), (size - 8 - hl).alias("_data"),
        F.when(is_object, F.from_json(text, HEADER_SCHEMA)).alias("_tensors"),
        F.when(size < 8, "file shorter than its length field")
         .when(~fits, "header longer than the file")
         .when(~is_object, "header is not a JSON object").alias("_file"))
    rows = parsed.select("path", "header_len", "data_start", "_data", "_file",
                         F.explode_outer("_tensors").alias("name", "t"))
    rows = rows.where(F.col("_file").isNotNull() | F.col("name").isNull() | F.col("t.dtype").isNotNull()
                      | (F.col("name") != "__metadata__"))
    numel = F.when(F.col("t.shape").isNotNull(),
                   F.aggregate("t.shape", F.lit(1).cast("long"), lambda a, x: a * x))
    begin, end = F.get("t.data_offsets", F.lit(0)), F.get("t.data_offsets", F.lit(1))
    width = F.create_map(*[F.lit(x) for k, v in DTYPE_BYTES.items() for x in (k, v)])[F.col("t.dtype")]
    reason = (F.when(F.col("_file").isNotNull(), F.col("_file"))
              .when(F.col("name").isNull(), "no tensors in the header")
              .when(F.col("t.dtype").isNull() | numel.isNull() | begin.isNull() | end.isNull(),
                    "tensor entry is incomplete")
              .when((begin < 0) | (end < begin) | (end > F.col("_data")), "tensor lies outside the data")
              .when(F.exists("t.shape", lambda x: x < 0) | (numel * width != end - begin),
                    "offsets do not agree with the shape"))
    return rows.select("path", "header_len", "name", F.col("t.dtype").alias("dtype"), F.col("t.shape").alias("shape"),
                       numel.alias("numel"), begin.alias("begin_off"), end.alias("end_off"), "data_start",
                       F.when(reason.isNull(), "ok").otherwise("rejected").alias("status"), reason.alias("reason"))


def scan_models(spark: SparkSession, path: str) -> DataFrame:
    """A4 over a directory of many safetensors files (or one file): a task reads
    the header of a file, never its tensors."""
    return catalogue(_source(spark, HeaderSource, path))


def weight_rows(spark: SparkSession, path: str, names: Sequence[str] | None = None,
                range_bytes: int = 32 << 20) -> DataFrame:
    """A5: tensors as rows ``(path, name, row, vec array<float>)`` (row-major;
    a 1-D tensor is one row).  A bad file, a tensor that any one file lacks and
    a non-F32 tensor fail.  A task reads one byte range of a file: the rows that
    begin in it, of the wanted tensors only."""
    cat = scan_models(spark, path)
    wanted = F.array(*[F.lit(n) for n in (names or [])]).cast("array<string>")
    chosen = F.lit(True) if names is None else F.array_contains(wanted, F.col("name"))
    per_file = cat.groupBy("path").agg(
        F.max("reason").alias("bad"),
        F.max(F.when(chosen & (F.col("dtype") != "F32"), F.concat_ws(" ", "name", F.lit("is"), "dtype"))).alias("other"),
        F.collect_set(F.when(F.array_contains(wanted, F.col("name")), F.col("name"))).alias("have"))
    wrong = (per_file.select("path", "bad", "other", F.array_sort(F.array_except(wanted, "have")).alias("missing"))
             .where(F.col("bad").isNotNull() | F.col("other").isNotNull() | (F.size("missing") > 0))
             .orderBy("path").limit(5).collect())
    if wrong:
        raise ValueError("; ".join(f"{r['path']}: {r['bad'] or (r['other'] and r['other'] + ', not F32') or 'missing tensors: ' + str(r['missing'])}"
                                   for r in wrong))
    rows = _source(spark, TensorSource, path, range_bytes=range_bytes)
    return rows if names is None else rows.where(F.col("name").isin(list(names)))


def read_tensors(spark: SparkSession, path: str, max_bytes: int) -> dict[str, np.ndarray]:
    """Whole F32 tensors of one model file for broadcasting; the file length
    is checked (content column pruned) before any byte is fetched."""
    files = spark.read.format("binaryFile").load(path)
    sizes = files.select("path", "length").collect()
    if len(sizes) != 1:
        raise ValueError(f"expected one model file at {path}, found {len(sizes)}")
    if sizes[0]["length"] > max_bytes:
        raise ValueError(f"model file of {sizes[0]['length']} bytes exceeds {max_bytes}")
    buf = files.select("content").first()["content"]
    return parse_safetensors(bytes(buf))


def parse_safetensors(buf: bytes) -> dict[str, np.ndarray]:
    n = struct.unpack("<Q", buf[:8])[0]
    header = json.loads(buf[8:8 + n].decode("utf-8"))
    out = {}
    for name, t in header.items():
        if name == "__metadata__" or not isinstance(t, dict) or "dtype" not in t:
            continue
        if t["dtype"] != "F32":
            raise ValueError(f"tensor {name} is {t['dtype']}, not F32")
        b, e = t["data_offsets"]
        arr = np.frombuffer(buf, dtype="<f4", count=(e - b) // 4, offset=8 + n + b)
        out[name] = arr.reshape([int(s) for s in t["shape"]]).copy()
    return out


def safetensors_bytes(tensors: dict[str, np.ndarray], metadata: dict | None = None) -> bytes:
    """Serialise arrays (fixtures and seeded models); dtype from the array."""
    names = {np.dtype("<f4"): "F32", np.dtype("<f2"): "F16", np.dtype("<f8"): "F64",
             np.dtype("<i4"): "I32", np.dtype("<i8"): "I64", np.dtype("i1"): "I8", np.dtype("u1"): "U8"}
    header: dict = {"__metadata__": metadata or {"format": "pt"}}
    blobs, off = [], 0
    for name, arr in tensors.items():
        a = np.ascontiguousarray(arr)
        a = a.astype(a.dtype.newbyteorder("<"), copy=False)
        data = a.tobytes()
        header[name] = {"dtype": names[np.dtype(a.dtype.str)], "shape": list(a.shape),
                        "data_offsets": [off, off + len(data)]}
        blobs.append(data)
        off += len(data)
    hb = json.dumps(header, separators=(",", ":")).encode("utf-8")
    hb += b" " * ((8 - len(hb) % 8) % 8)
    return struct.pack("<Q", len(hb)) + hb + b"".join(blobs)


def audit_model_dirs(spark: SparkSession, root: str,
                     required: Sequence[str] = REQUIRED_MODEL_FILES) -> DataFrame:
    """``(dir, ready, missing array<string>)`` for every directory holding at
    least one file under ``root``.  Only file names are listed (the content
    column is pruned); only required names are collected per directory, so a
    group holds at most ``len(required)`` entries."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .load(root).select("path"))
    parts = listing.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"),
                           F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    req = F.array(*[F.lit(r) for r in required])
    present = parts.groupBy("dir").agg(
        F.collect_set(F.when(F.array_contains(req, F.col("file")), F.col("file"))).alias("present"))
    missing = F.array_sort(F.array_except(req, F.col("present")))
    return present.select("dir", (F.size(missing) == 0).alias("ready"), missing.alias("missing"))
