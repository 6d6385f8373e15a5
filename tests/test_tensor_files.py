"""Byte-range data sources over safetensors files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.sources import tensor_files as TF
from wordloom.sources.safetensors import safetensors_bytes, scan_models, weight_rows


def _write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 20])
def test_ranges_hold_every_row_once(spark, scratch, range_bytes):
    rng = np.random.default_rng(1)
    tensors = {"a": rng.normal(size=(37, 5)), "b": rng.normal(size=11), "c": rng.normal(size=(2, 3, 4)),
               "empty": np.zeros((0, 4)), "scalar": np.array(2.5)}
    tensors = {k: v.astype(np.float32) for k, v in tensors.items()}
    _write(f"{scratch}/m/model.safetensors", safetensors_bytes(tensors))
    got = weight_rows(spark, scratch, range_bytes=range_bytes).collect()
    want = {(n, i): r for n, v in tensors.items() for i, r in enumerate(v.reshape(-1, v.shape[-1] if v.shape else 1))}
    assert len(got) == len(want)
    for r in got:
        assert np.array_equal(np.array(r["vec"], np.float32), want[(r["name"], r["row"])])
    some = weight_rows(spark, scratch, ["b", "c"], range_bytes=range_bytes).collect()
    assert {r["name"] for r in some} == {"b", "c"} and len(some) == 7


def test_a_large_tensor_is_read_by_several_tasks(spark, scratch):
    big = (np.arange(100 * 2**18) % 65521).astype(np.float32).reshape(-1, 1024)         # 100 MB
    path = _write(f"{scratch}/big/model.safetensors", safetensors_bytes({"small": np.ones(3, np.float32), "big": big}))
    rows = weight_rows(spark, f"{scratch}/big", ["big"]).select("row", F.spark_partition_id().alias("p"), F.col("vec")[7].alias("x"))
    tasks = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x") != (F.col("row") * 1024 + 7) % 65521).cast("int")).alias("bad"))
    out = tasks.collect()
    assert len(out) >= 3 and sum(r["n"] for r in out) == len(big) and not any(r["bad"] for r in out)
    # the catalogue takes the header only
    assert len(TF.read_header(path, os.path.getsize(path))) < 1000
    assert {r["name"]: r["numel"] for r in scan_models(spark, f"{scratch}/big").collect()} == {"small": 3, "big": big.size}


def test_names_are_pushed_to_the_source(spark, scratch):
    _write(f"{scratch}/m/model.safetensors", safetensors_bytes({"a": np.ones(3, np.float32), "b": np.ones(3, np.float32)}))
    reader = TF.TensorReader(scratch, 100)
    left = list(reader.pushFilters([TF.EqualTo(("name",), "a"), TF.EqualTo(("row",), 0)]))
    assert left == [TF.EqualTo(("row",), 0)] and reader.names == {"a"}
    assert [b.column(1).to_pylist() for p in reader.partitions() for b in reader.read(p)] == [["a"]]
    assert [r["name"] for r in weight_rows(spark, scratch, ["b"]).collect()] == ["b"]


def test_bad_files_are_reported(spark, scratch):
    good = safetensors_bytes({"a": np.ones((2, 2), np.float32)})
    bad = {"short": b"abc", "long": (10**6).to_bytes(8, "little") + b"{}", "huge": b"\xff" * 8 + b"{}",
           "text": (2).to_bytes(8, "little") + b"[]", "bytes": (4).to_bytes(8, "little") + b"\xff\xfe{}",
           "outside": good[:-4], "empty": b""}
    for name, data in bad.items():
        _write(f"{scratch}/{name}/model.safetensors", data)
        with pytest.raises(ValueError):
            weight_rows(spark, f"{scratch}/{name}")
    _write(f"{scratch}/good/model.safetensors", good)
    got = {r["path"].split("/")[-2]: (r["status"], r["reason"]) for r in scan_models(spark, scratch).collect()}
    assert set(got) == {*bad, "good"} and got["good"] == ("ok", None)
    assert all(s == "rejected" and reason for k, (s, reason) in got.items() if k != "good")
    assert scan_models(spark, f"{scratch}/good/model.safetensors").count() == 1
