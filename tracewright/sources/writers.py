"""Sinks: telemetry by day, single documents, turn logs. All append but the documents, which replace what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_day(events: DataFrame) -> DataFrame:
    """``date`` of the event's own time (milliseconds, UTC); events without a time have none."""
    return events.withColumn("date", F.to_date(F.timestamp_millis("timestamp")))


def append_events(events: DataFrame, path: str) -> None:
    """Event records, one JSON object a line, into a folder a day."""
    with_day(events).write.mode("append").partitionBy("date").json(path)


def stream_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same from a stream; what was there is written once, after a restart too."""
    return with_day(events).writeStream.format("json").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def documents(df: DataFrame, key: str) -> DataFrame:
    """Each row as one indented JSON document, fields without a value left out."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("document"))


def write_documents(df: DataFrame, key: str, path: str) -> None:
    """One folder a key with the row's document; rows of one key must be single."""
    documents(df, key).repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def append_turns(turns: DataFrame, path: str) -> None:
    """Turn records of running agents into a folder a log; a batch is seen whole or not at all."""
    turns.write.mode("append").partitionBy("log").json(path)
