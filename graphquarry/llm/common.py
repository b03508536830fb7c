"""What several operators share: the shared folder, checkpoints, checked broadcasts, memory-mapped files."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows may be broadcast (narrow rows: some tens of MB at most).
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset.

    Only a run on one machine may leave the setting out.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphquarry-")
        sc.setCheckpointDir(folder)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once into the shared folder; later readers survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return this process's freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`rows`, for mapInArrow, so that a worker, which waits for later tasks, does not keep what this task has freed."""

    def run(batches):
        yield from rows(batches)
        give_back()

    return run


def trim_driver(spark: SparkSession) -> bool:
    """Return the native memory that the driver's JVM has freed to the system; whether it could (Java before 17.0.9 cannot).

    Every exchange runs in a thread of its own, and what planning and compiling free there stays with that thread.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kinds = gateway.new_array(jvm.java.lang.Class, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    # the server's own class is not open to callers, its interface is
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    given = gateway.new_array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False
    return True


def tidy(spark: SparkSession) -> None:
    """Let go of what earlier steps left: unreferenced shuffles, broadcasts and checkpoints, and freed memory of the driver."""
    gc.collect()
    spark._jvm.System.gc()  # Spark's cleaner learns from the collector what nobody refers to any more
    trim_driver(spark)
    give_back()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it holds few rows; otherwise unmarked, so that joins shuffle (and AQE splits skew).

    `df` must be cheap to count: a checkpoint or a small aggregate.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mapped_folder(spark: SparkSession, name: str) -> str:
    """A new folder, below the shared one, whose files every process may memory-map."""
    folder = new_folder(spark, name)
    if "://" in folder or folder.startswith("file:"):
        scheme, rest = folder.split(":", 1)
        if scheme != "file":
            raise RuntimeError("memory-mapped tables need a spark.checkpoint.dir that is mounted as files")
        folder = "/" + rest.lstrip("/")
    os.makedirs(folder, exist_ok=True)
    return folder


#: So many files a process keeps mapped; a system lets it map some ten thousands.
MAPS = 4096
_maps: OrderedDict[str, np.ndarray | None] = OrderedDict()


def mapped(path: str, kind: type | None = None) -> np.ndarray | None:
    """The memory-mapped array of a file (of bare numbers of a kind, or written by `save`), or None if there is none.

    The `MAPS` files that were asked for last stay mapped.
    """
    if path in _maps:
        _maps.move_to_end(path)
        return _maps[path]
    if not os.path.exists(path):
        found = None
    elif kind is None:
        found = np.load(path, mmap_mode="r")
    else:
        found = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    _maps[path] = found
    if len(_maps) > MAPS:
        _maps.popitem(last=False)
    return found


def save(path: str, values: np.ndarray) -> None:
    """Write an array so that readers see all of it or nothing; a task that runs again replaces its file by an equal one."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, values)
    os.replace(part, path)
