"""Captured requests and line frames: from what goes over the wire to messages, and back to bodies.

Both work on batch and streaming DataFrames. Defined results: a body that is no JSON object with a list of messages
gives no messages (the caller forwards it as it is); blank and malformed frames go; the rest keep their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURED = "req bigint, method string, url string, headers map<string,string>, body string"


def captured(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Captured requests, one JSON record a line; as a stream, new files are taken as they come."""
    return (spark.readStream if streaming else spark.read).schema(CAPTURED).json(path)


def message_requests(requests: DataFrame) -> DataFrame:
    """The requests that carry messages: POST to the message path, with or without a query."""
    return requests.where((F.col("method") == "POST") & F.startswith("url", F.lit("/v1/messages")))


def messages(requests: DataFrame) -> DataFrame:
    """(req, body) to (req, idx, role, content); a list of blocks stays JSON text, a string loses its quotes."""
    body = F.from_json("body", "messages array<struct<role:string,content:string>>")
    return requests.select("req", F.posexplode(body["messages"]).alias("idx", "m")).select("req", F.col("idx").cast("bigint").alias("idx"), "m.role", "m.content")


def lists(messages_: DataFrame) -> DataFrame:
    """(req, idx, role, content) to (req, messages), the JSON list of a request's messages in order.

    Content that is a JSON list goes in as it is, all other text as a string, null as null.
    """
    blocks = F.try_parse_json("content").isNotNull() & F.startswith(F.ltrim("content"), F.lit("["))
    text = F.regexp_extract(F.to_json(F.struct(F.col("content").alias("c"))), r"(?s)^\{\"c\":(.*)\}$", 1)
    content = F.when(F.col("content").isNull(), "null").when(blocks, F.col("content")).otherwise(text)
    role = F.to_json(F.struct("role"))
    one = F.concat(F.left(role, F.length(role) - 1), F.lit(',"content":'), content, F.lit("}"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("json")))), lambda x: x["json"])
    return messages_.groupBy("req").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("messages"))


def bodies(messages_: DataFrame) -> DataFrame:
    """(req, idx, role, content) to one body a request: what is forwarded after rewriting."""
    return lists(messages_).select("req", F.concat(F.lit('{"messages":'), "messages", F.lit("}")).alias("body"))


def frames(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines to frames: id, method and params of each line that is a JSON object, beside the other columns."""
    parsed = lines.withColumn("_frame", F.try_parse_json(F.trim(line)))
    whole = parsed.where(F.startswith(F.schema_of_variant("_frame"), F.lit("OBJECT")))
    get = lambda k: F.try_variant_get("_frame", f"$.{k}", "string").alias(k)
    return whole.select(*[c for c in lines.columns if c != line], get("id"), get("method"), get("params"))
