"""Running a stream over tables that are fed in parts, with state and results in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.shared import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Files of a part; a stream takes as many at a time.
FILES = 2


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def feed(df: DataFrame, path: str, keys: list[str]) -> None:
    """One part more for the streams over ``path``; a key's rows are in one file, so in one batch."""
    df.repartition(FILES, *keys).write.mode("append").parquet(path)


def fed(df: DataFrame, at: str, keys: list[str], parts: int = 3, closing: Row | None = None) -> str:
    """A folder with ``df`` in parts by ``at``, written one after the other, and a last row that moves the watermark on."""
    path = f"{shared_folder(df.sparkSession)}/fed-{uuid.uuid4().hex}"
    n = F.col(at).cast("timestamp").cast("double") if df.schema[at].dataType.typeName().startswith("timestamp") else F.col(at)
    least, most = df.agg(F.min(n), F.max(n)).first()
    part = F.least(F.floor((n - F.lit(least)) * parts / F.lit((most - least) or 1)), F.lit(parts - 1)) if least is not None else F.lit(0)
    for i in range(parts):
        feed(df.where(F.coalesce(part, F.lit(0)) == i), path, keys)
    if closing is not None:
        df.sparkSession.createDataFrame([closing], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The parts in ``path``, as they come."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", FILES).parquet(path)


def finished(rows: DataFrame, root: str | None = None) -> DataFrame:
    """What ``rows`` has appended once it has taken all there is, in several batches; from the same ``root`` a stream goes on where it stopped."""
    spark = rows.sparkSession
    root = root or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with with_state(spark):
        query = rows.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).format("parquet").option("path", f"{root}/out").start()
        query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out")
