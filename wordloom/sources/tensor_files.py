"""Data sources over safetensors files that read byte ranges.

``safetensors_headers``: one input partition per file; rows (path, length,
content), content being the length field and the header.
``safetensors_rows``: one input partition per byte range of a file; rows
(path, name, row, vec) of the F32 tensors' rows that begin in the range.  Filters
on ``name`` are pushed down: other tensors are not read.

Planning lists files and their sizes only.  Files are read through pyarrow's file
systems (local paths, ``file:``, ``hdfs:``, ``s3:``, ``gs:``).  A file whose header
cannot be read has no rows here; ``catalogue`` reports it.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

RANGE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
SUFFIX = ".safetensors"


def open_path(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a model file, or of all below a directory."""
    from pyarrow import fs

    system, inside = open_path(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[:len(path) - len(inside)] if path.endswith(inside) else ""
    found = system.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX))


def read_range(path: str, offset: int, size: int) -> bytes:
    system, inside = open_path(path)
    with system.open_input_file(inside) as f:
        return f.read_at(size, offset)


def read_header(path: str, size: int) -> bytes:
    """The length field and the header, or the length field if that does not fit."""
    head = read_range(path, 0, min(8, size))
    n = struct.unpack("<Q", head)[0] if len(head) == 8 else 0
    return head + read_range(path, 8, n) if 0 < n <= size - 8 else head


def tensors_of(head: bytes) -> list[tuple[str, list[int], int, int]]:
    """(name, shape, begin, end in the file) of the F32 tensors of a readable header."""
    try:
        entries = json.loads(head[8:].decode("utf-8"))
        start = len(head)
        return [(name, [int(x) for x in t["shape"]], start + int(t["data_offsets"][0]), start + int(t["data_offsets"][1]))
                for name, t in entries.items() if isinstance(t, dict) and t.get("dtype") == "F32"]
    except (ValueError, AttributeError, KeyError, TypeError, IndexError):
        return []


class ByteRange(InputPartition):
    def __init__(self, path: str, size: int, lo: int, hi: int):
        self.path, self.size, self.lo, self.hi = path, size, lo, hi


class HeaderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(p, n, 0, n) for p, n in list_files(self.path)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        if partition.path:
            yield partition.path, partition.size, read_header(partition.path, partition.size)


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors_headers"

    def schema(self) -> str:
        return "path string, length bigint, content binary"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options["path"])


class TensorReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the tensor's name are answered here, all others by Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("name",):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = some if self.names is None else self.names & some
            else:
                yield f

    def partitions(self) -> list[ByteRange]:
        out = [ByteRange(p, n, lo, min(lo + self.range_bytes, n)) for p, n in list_files(self.path)
               for lo in range(0, n, self.range_bytes)]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        for name, shape, begin, end in tensors_of(read_header(partition.path, partition.size)):
            if self.names is not None and name not in self.names:
                continue
            width = 4 * (shape[-1] if shape else 1)
            if end <= begin or width <= 0:
                continue
            # rows that begin in this range
            first = max(0, -(-(partition.lo - begin) // width))
            stop = min((end - begin) // width, max(0, -(-(partition.hi - begin) // width)))
            step = max(1, BATCH_BYTES // width)
            for lo in range(first, stop, step):
                n = min(step, stop - lo)
                flat = np.frombuffer(read_range(partition.path, begin + lo * width, n * width), dtype="<f4")
                cut = pa.array(np.arange(0, len(flat) + 1, width // 4, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * n), pa.array([name] * n), pa.array(np.arange(lo, lo + n, dtype=np.int64)),
                     pa.ListArray.from_arrays(cut, pa.array(flat.astype(np.float32)))], names=["path", "name", "row", "vec"])


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors_rows"

    def schema(self) -> str:
        return "path string, name string, row bigint, vec array<float>"

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))
