"""Plumbing shared by the operators: table access, shared scratch tables, row keys."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


#: Rows of text that Spark hands a worker at a time, where the session has no setting of its own.
BATCH_ROWS = 1_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":  # Spark's default
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and is removed by ``discard`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that no later plan reads."""
    for df in tables:
        _remove(df.sparkSession, df._scratch_path)
        _written[:] = [(s, p) for s, p in _written if p != df._scratch_path]


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more: it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone already
            _remove(spark, path)


def row_keys(start: int, n: int) -> pa.Array:
    """Keys for n rows of this task from its start-th on: the same after a retry, as a scan's splits are."""
    context = TaskContext.get()
    base = ((context.partitionId() if context else 0) << 38) + start
    return pa.array(range(base, base + n), pa.int64())


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(sizes: list[int], most: int):
    """Ranges of consecutive items whose sizes sum to ``most`` at the most (or that hold one item)."""
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > most:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def forget_worker_state(but: str | None = None) -> None:
    """Free what earlier operators' tasks left in this worker process, ``but`` one key of ``worker_state``."""
    own = sys.modules.get("_panelspark_worker_state")
    for key in [k for k in vars(own) if not k.startswith("__") and k != but] if own else []:
        delattr(own, key)
    give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers live on between stages, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable, keeps: str | None = None) -> Callable:
    """``run``, a task over batches, that keeps nothing of the tasks before it but the ``worker_state`` it names, and no freed memory of its own."""

    def task(batches):
        forget_worker_state(keeps)
        yield from run(batches)
        give_back()

    return task


def worker_state(key: str, make: Callable):
    """What ``make`` returned the first time in this worker process: tasks that a worker runs one after another share it."""
    own = sys.modules.setdefault("_panelspark_worker_state", types.ModuleType("_panelspark_worker_state")).__dict__
    if key not in own:
        own[key] = make()
    return own[key]
