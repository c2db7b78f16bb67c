"""Helpers shared by the corpus operators: shared storage, tables, word caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in one Arrow batch handed to Python; a batch is the unit of memory there.
ARROW_ROWS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, read by Spark whatever the store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the number of rows that a Python worker holds at a time.

    All operators set the same bound, and leave it set: results are lazy, so it has to
    hold when they are computed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="tapeloom-")
    shared_dir.own = base
    return base


def scratch(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/tapeloom-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and fixes values such
    as generated ids, which a recomputed task could otherwise change.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    if Workspace.open:
        Workspace.open[-1].paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Give up what is done with. Spark drops broadcasts and shuffle files of plans that are no
    longer referred to only when the driver collects garbage, which it does late by itself."""
    gc.collect()
    spark._jvm.System.gc()
    _trim()


def compact(spark: SparkSession) -> None:
    """Let executors give back the memory that their garbage takes, by a task on each core.

    A JVM keeps the heap that one stage made it take, and Python workers come beside it; a
    full collection returns what the next stage may need for those.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator], holds: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, giving memory back to the system at the end of each task.

    Python workers serve one task after another, of all kinds; what their tables leave
    behind in pieces would add up. Of what is resident() only ``holds`` stays.
    """

    def wrapped(batches: Iterator) -> Iterator:
        for name in set(_resident) - {holds}:
            del _resident[name]
        yield from run(batches)
        gc.collect()
        _trim()

    return wrapped


#: What this Python worker holds for the tasks that follow, by name.
_resident: dict[str, object] = {}


def resident(name: str, make: Callable[[], object]):
    """``make()``, kept in this Python worker for later tasks, until another name is asked for.

    Workers outlive the plans they serve: tables that each operator kept would add up.
    """
    if name not in _resident:
        _resident.clear()
        gc.collect()
        _trim()
        _resident[name] = make()
    return _resident[name]


class Workspace:
    """Tables written on the way to a result, and broadcasts; all but the tables kept go
    when it ends.

        with Workspace(spark) as work:
            ...  # any materialize() in here
            result = work.keep(df)
    """

    open: ClassVar[list[Workspace]] = []
    #: Characters of a plan's text; Spark keeps those of the last 1,000 plans in the driver.
    TEXT: ClassVar[tuple[str, str]] = ("spark.sql.maxPlanStringLength", "4000")

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.shared = spark, [], []

    def __enter__(self) -> Workspace:
        Workspace.open.append(self)
        self.before = self.spark.conf.get(self.TEXT[0], None)
        self.spark.conf.set(*self.TEXT)
        return self

    def own(self, path: str) -> str:
        """``path``, to be deleted with this workspace."""
        self.paths.append(path)
        return path

    def share(self, value) -> Broadcast:
        """A broadcast of ``value`` that ends with this workspace."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def keep(self, df: DataFrame, tag: str = "result") -> DataFrame:
        """Write ``df`` where it outlives this workspace, but not the one around it."""
        out = materialize(df, tag)
        path = self.paths.pop()
        if len(Workspace.open) > 1:
            Workspace.open[-2].paths.append(path)
        return out

    def __exit__(self, *_) -> None:
        Workspace.open.remove(self)
        if self.before is None:
            self.spark.conf.unset(self.TEXT[0])
        else:
            self.spark.conf.set(self.TEXT[0], self.before)
        for sent in self.shared:
            sent.destroy()
        for path in self.paths:
            delete(self.spark, path)
        release(self.spark)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table or folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shards(spark: SparkSession, times: int = 4) -> int:
    """How many pieces to deal an ordered table into: some per shuffle partition."""
    return times * int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memo(dict):
    """A dict that computes missing values and forgets everything when it is full.

    Lookups of present keys stay in C, so ``map(memo.__getitem__, words)`` costs
    little; ``limit`` bounds the memory of a Python worker whatever the vocabulary.
    Keys longer than ``longest`` are computed each time and never kept.
    """

    def __init__(self, make, limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
