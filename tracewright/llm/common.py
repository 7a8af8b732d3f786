"""Helpers that the operators share: session settings, shared storage, let-binding."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


T_ = TypeVar("T_")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where it is unset and Spark runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def give_back() -> None:
    """Return what a Python worker has freed to the system: it lives on from task to task beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


_held: dict[tuple[str, str], object] = {}


def held(kind: str, name: str, make: Callable[[], T_], most: int = 1) -> T_:
    """What this Python worker keeps from task to task: ``most`` objects of one kind. Those of other kinds go, so a worker that has served one operator holds nothing of it in another."""
    if (kind, name) not in _held:
        for key in [k for k in _held if k[0] != kind]:
            del _held[key]
        while len(_held) >= most:
            del _held[next(iter(_held))]
        give_back()
        _held[kind, name] = make()
    return _held[kind, name]


class Stored:
    """Intermediate tables in the shared folder: they cut lineage, outlive executors and go when done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tracewright-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_columns(df: DataFrame, replaced: list[str]) -> list[str]:
    """The columns of ``df`` but those ``replaced``, in any case."""
    low = {c.lower() for c in replaced}
    return [c for c in df.columns if c.lower() not in low]


def map_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: they travel by number, as ``c0`` and so on, and get ``schema``'s names again."""
    inside = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=inside.names)

    return numbered.mapInArrow(renamed, inside).toDF(*schema.names)


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names`` changed where needed so that none is one of ``taken``, in any case."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in low:
            pass
        out.append(name)
        low.add(name.lower())
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
