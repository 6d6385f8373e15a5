"""H2: size-or-time batch assignment.

A batch opens with its first item (time t0) and takes the next item of the
same key iff it holds fewer than ``size`` items and ``t - t0 < wait`` (at
exactly the limit the item opens a new batch).

Batch form (``assign_batches``): a fold over a key's items in time order, done
with one sort and a fixed number of jobs whatever the length of a key:
  1. items are range-partitioned and sorted by (key, time, item) and written
     once, so a key that holds a third of all items is spread over many tasks;
  2. only the key that a partition shares with the one before it is open: its
     first batch there can start at one of the first ``size`` items, as the
     batch left open before takes fewer than ``size`` more.  Each partition
     folds that key once per possible start and reports where each ends;
  3. the driver chains these reports (a few numbers per partition) and gives
     every partition the batch that is open when it begins;
  4. each partition folds its items once more, from that state, and numbers them.
The sorted table is dealt out by partition number again for steps 2 and 4.

Stream form (``batch_stream``): ``transformWithStateInPandas`` keeps per key the
open batch (number, opening time, items), in event time.  A timer closes a
batch when its wait ends although nothing more arrives; the watermark bounds
how late an item may be, and a key that stays idle loses its state.  A stream can
go on where a batch run over the history ends (``handover``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BATCH_MAX_ITEMS, BATCH_MAX_WAIT_MS
from ..operators.reports import micros_since_epoch
from ..session import ship_package, stored

OUTPUT = "key long, item_id long, batch_no long, pos_in_batch int"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT_WAIT_US = int(BATCH_MAX_WAIT_MS * 1000)


@dataclass
class Open:
    """The open batch of a key: number (from 0), opening time, items so far."""

    batch: int = -1
    t0: int = 0
    held: int = 0

    def take(self, t: int, wait_us: int, size: int) -> None:
        if 0 < self.held < size and t - self.t0 < wait_us:
            self.held += 1
        else:
            self.batch, self.t0, self.held = self.batch + 1, t, 1


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    """(start, stop) of each run of equal keys."""
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i
            start = i


def _report(wait_us: int, size: int):
    """One row per partition: its first key and, per possible start of that key's
    first new batch, the state at the end of the key's run; the state that the
    last key ends with; the times before the first start."""
    schema = ["pid", "first_key", "last_key", "whole", "times", "exits", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = first_key = last_key = None
        times: list[int] = []
        folds: list[Open] = []
        first_n, in_first, last = 0, True, Open()
        for b in batches:
            if not b.num_rows:
                continue
            parts, keys, ts = (b.column(i).to_pylist() for i in range(3))
            if pid is None:
                pid, first_key, last_key = parts[0], keys[0], keys[0]
                folds = [Open() for _ in range(size)]
            for lo, hi in _runs(keys):
                if keys[lo] != last_key:
                    in_first, last, last_key = False, Open(), keys[lo]
                for t in ts[lo:hi]:
                    if in_first:
                        if first_n < size:
                            times.append(t)
                        for start, fold in enumerate(folds):
                            if first_n >= start:
                                fold.take(t, wait_us, size)
                        first_n += 1
                    else:
                        last.take(t, wait_us, size)
        if pid is not None:
            exits = [[f.batch, f.t0, f.held] for f in folds]
            yield pa.RecordBatch.from_pylist([dict(zip(schema, (
                pid, first_key, last_key, in_first, times, exits, [last.batch, last.t0, last.held])))],
                schema=pa.schema([("pid", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()),
                                  ("whole", pa.bool_()), ("times", pa.list_(pa.int64())),
                                  ("exits", pa.list_(pa.list_(pa.int64()))), ("last", pa.list_(pa.int64()))]))
    return run


def _chain(rows: list, wait_us: int, size: int) -> dict[int, tuple[int, int, int]]:
    """The open batch of each partition's first key when the partition begins."""
    states: dict[int, tuple[int, int, int]] = {}
    key, now = None, Open()
    for r in sorted(rows, key=lambda x: x["pid"]):
        begin = Open(now.batch, now.t0, now.held) if key == r["first_key"] and now.held else Open()
        if begin.held:
            states[r["pid"]] = (begin.batch, begin.t0, begin.held)
        start = 0
        while begin.held and start < len(r["times"]) and begin.held < size and r["times"][start] - begin.t0 < wait_us:
            begin.held += 1
            start += 1
        if r["whole"]:
            batch, t0, held = r["exits"][start] if start < size else (-1, 0, 0)
            now = Open(begin.batch + 1 + batch, t0, held) if held else begin
        else:
            now = Open(*r["last"])
        key = r["last_key"]
    return states


def _number(states: dict[int, tuple[int, int, int]], wait_us: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, begun = None, Open(), False
        for b in batches:
            if not b.num_rows:
                continue
            parts, keys, ts = (b.column(i).to_pylist() for i in range(3))
            if not begun:
                begun, key, now = True, keys[0], Open(*states.get(parts[0], (-1, 0, 0)))
            numbers, places = [], []
            for k, t in zip(keys, ts):
                if k != key:
                    key, now = k, Open()
                now.take(t, wait_us, size)
                numbers.append(now.batch)
                places.append(now.held - 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(3), pa.array(numbers, pa.int64()), pa.array(places, pa.int32()), b.column(2)],
                names=["key", "item_id", "batch_no", "pos_in_batch", "t"])
    return run


def assign_batches(items: DataFrame, key: str, item_id: str, ts: str,
                   wait_us: int = DEFAULT_WAIT_US, size: int = BATCH_MAX_ITEMS) -> DataFrame:
    """-> ``(key, item_id, batch_no, pos_in_batch)``; order within a key is
    ``(ts, item_id)``.  Keys and items are longs; null keys are a key."""
    return _assigned(items, key, item_id, ts, wait_us, size).drop("t")


def handover(items: DataFrame, key: str, item_id: str, ts: str, wait_us: int = DEFAULT_WAIT_US,
             size: int = BATCH_MAX_ITEMS) -> tuple[DataFrame, DataFrame]:
    """History for a stream to go on from: (batches that are over, state).  A key's
    last batch may still take items of the stream, so its items (at most ``size``)
    are the state ``(k, batch, t, item)`` that ``batch_stream`` takes as ``initial``;
    all earlier batches are over.  Items of the stream must not be earlier than the
    history's.  Rows without a key stay in the history."""
    rows = stored(_assigned(items, key, item_id, ts, wait_us, size), "h2-history")
    last = rows.where("key is not null").groupBy("key").agg(F.max("batch_no").alias("batch_no"))
    state = rows.join(last, ["key", "batch_no"]).select(
        F.col("key").alias("k"), F.col("batch_no").alias("batch"), "t", F.col("item_id").alias("item"))
    over = rows.join(last, ["key", "batch_no"], "left_anti").select("key", "item_id", "batch_no", "pos_in_batch")
    return over, state


def _assigned(items: DataFrame, key: str, item_id: str, ts: str, wait_us: int, size: int) -> DataFrame:
    spark = items.sparkSession
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = items.select(F.col(key).cast("long").alias("k"), micros_since_epoch(ts).alias("t"),
                        F.col(item_id).cast("long").alias("item"))
    parts = stored(base.repartitionByRange(n, "k", "t", "item").sortWithinPartitions("k", "t", "item")
                   .withColumn("at", F.monotonically_increasing_id()), "h2-sorted")
    # a file may be read in several splits: the reader's partitions are put together again by number
    rows = (parts.select(F.shiftright("at", 33).alias("pid"), "k", "t", "item", "at")
            .repartitionById(n, F.col("pid").cast("int")).sortWithinPartitions("at").drop("at"))
    report = rows.mapInArrow(_report(wait_us, size), "pid long, first_key long, last_key long, whole boolean, "
                             "times array<long>, exits array<array<long>>, last array<long>").collect()
    states = _chain(report, wait_us, size)            # a few numbers per partition
    return rows.mapInArrow(_number(states, wait_us, size), OUTPUT + ", t long")


def batch_stream(items: DataFrame, key: str, item_id: str, ts: str, wait_us: int = DEFAULT_WAIT_US,
                 size: int = BATCH_MAX_ITEMS, late: str = "10 seconds", idle: str = "1 hour",
                 initial: DataFrame | None = None) -> DataFrame:
    """Streaming H2: items are numbered when their batch closes (it is full, an
    item past its wait arrives, or event time passes its end), so an item
    within the watermark delay ``late`` takes its place in time order; later
    ones are dropped by the watermark.  A key without items for ``idle`` of event
    time loses its state and starts again at batch 0.  ``initial`` is the state that
    ``handover`` leaves: batch numbers go on and open batches take further items.

    -> ``(key, item_id, batch_no, pos_in_batch)``; ``ts`` is a timestamp column.
    """
    ship_package(items.sparkSession)
    # the operator keeps several state variables per key, which this provider supports
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    base = items.select(F.col(key).cast("long").alias("k"), F.col(item_id).cast("long").alias("item"),
                        F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return base.groupBy("k").transformWithStateInPandas(
        statefulProcessor=make_processor(wait_us, size, idle_ms), outputStructType=OUTPUT,
        outputMode="append", timeMode="eventTime", initialState=None if initial is None else initial.groupBy("k"))


def make_processor(wait_us: int, size: int, idle_ms: int):
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Batcher(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.next = handle.getValueState("next", "batch long")
            self.waiting = handle.getListState("waiting", "t long, item long")

        def _timer(self, when_ms: int) -> None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(when_ms)

        def _close(self, key, waiting: list, until_us: int) -> tuple[list, list]:
            """Batches that are over at event time ``until_us``, and what still waits."""
            batch = self.next.get()[0] if self.next.exists() else 0
            out = []
            while waiting:
                t0 = waiting[0][0]
                if t0 + wait_us > until_us:
                    break       # an item of this batch may still arrive
                n = 1
                while n < min(size, len(waiting)) and waiting[n][0] - t0 < wait_us:
                    n += 1
                out += [(key, item, batch, i) for i, (_t, item) in enumerate(waiting[:n])]
                waiting, batch = waiting[n:], batch + 1
            self.next.update((batch,))
            return out, waiting

        def _step(self, key, waiting: list, watermark_ms: int) -> pd.DataFrame:
            out, waiting = self._close(key, sorted(waiting), watermark_ms * 1000)
            if waiting:
                self.waiting.put([(int(t), int(i)) for t, i in waiting])
                self._timer(-(-(waiting[0][0] + wait_us) // 1000))
            else:
                if self.waiting.exists():
                    self.waiting.clear()
                self._timer(max(watermark_ms, 0) + idle_ms)
            return pd.DataFrame(out, columns=["key", "item_id", "batch_no", "pos_in_batch"]).astype(
                {"key": "int64", "item_id": "int64", "batch_no": "int64", "pos_in_batch": "int32"})

        def handleInitialState(self, key, initialState, timerValues) -> None:
            held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
            held += list(zip(initialState["t"].tolist(), initialState["item"].tolist()))
            self.next.update((int(initialState["batch"].min()),))
            self.waiting.put(sorted((int(t), int(i)) for t, i in held))
            self._timer(-(-(min(held)[0] + wait_us) // 1000))

        def handleInputRows(self, key, rows, timerValues):
            held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
            for pdf in rows:
                t = pdf["ts"].astype("datetime64[us, UTC]" if pdf["ts"].dt.tz is not None else "datetime64[us]")
                held += list(zip(t.astype("int64").tolist(), pdf["item"].tolist()))
            yield self._step(key[0], held, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
            if held:
                yield self._step(key[0], held, timerValues.getCurrentWatermarkInMs())
            else:               # idle: the key's state goes
                self.next.clear()
                yield pd.DataFrame({"key": [], "item_id": [], "batch_no": [], "pos_in_batch": []}).astype(
                    {"key": "int64", "item_id": "int64", "batch_no": "int64", "pos_in_batch": "int32"})

        def close(self) -> None:
            pass

    return Batcher()
