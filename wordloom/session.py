"""Session helpers: building a local session for tests/bench, table loading and
the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "wordloom") -> SparkSession:
    """A local session with the settings the library expects (tests, bench).

    On a cluster the caller builds its own session; nothing here is required
    except a shared ``spark.checkpoint.dir``.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only a local-mode session without the setting gets
    a scratch folder of its own (tests); a cluster must name a shared one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster needs a shared folder "
                "for checkpoints")
        configured = tempfile.mkdtemp(prefix="wordloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint into the shared folder (never a local one):
    freezes partition contents, cuts lineage and survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for intermediate tables."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


_SCOPES: list[list[str]] = []
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: a
    lineage cut that any executor can reread, with column pruning and known
    sizes.  The shuffle files behind it are dropped at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Intermediate tables made inside are deleted at the end: for work whose
    results are written before the scope ends.  Yields their paths, newest last;
    the newest stays if it is handed on (``hand_on``)."""
    held: list[str] = []
    _SCOPES.append(held)
    try:
        yield held
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not held]
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in held:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build()`` makes, written; every intermediate table made
    on the way is deleted, the result belongs to the scope around (if any)."""
    with scratch_scope(spark) as held:
        out = stored(build(), name)
        hand_on(held)
    return out


def hand_on(held: list[str]) -> None:
    """The newest table of a scope is its result: it belongs to the scope around, or
    to the caller if there is none."""
    path = held.pop()
    outer = next((i for i, x in enumerate(_SCOPES) if x is held), 0) - 1
    if outer >= 0:
        _SCOPES[outer].append(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wordloom`` importable in Python workers (``mapInPandas`` and
    UDF code refers to it): zip the package in memory once per application,
    write it into the shared folder (through the Hadoop FileSystem API, so
    any cluster file system works) and hand it to ``addPyFile``."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import io
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = f"{shared_dir(spark).rstrip('/')}/wordloom-code-{app}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan that has fewer splits than the cluster has cores (one small
    file, say) over all cores.  Decided from file names and sizes alone: no job
    runs, and larger inputs come back unchanged, so no shuffle is added at scale."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    splits = 0
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(f)
        splits += -(-path.getFileSystem(conf).getFileStatus(path).getLen() // split)
    return df if splits >= cores else df.repartition(cores)
