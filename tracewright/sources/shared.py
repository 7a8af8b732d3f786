"""The folder that the driver and all executors share, and tables written there to be read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and Spark runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tracewright-")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once, as Parquet in the shared folder: nothing is made twice, and lost executors lose nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_large(df: DataFrame) -> DataFrame:
    """``stored``, and joined by merges: repetitive texts make files far smaller than their rows, so a file's size would let Spark send a large table through the driver."""
    return stored(df).hint("merge")
