"""Sessions from other shapes: datasets with ready-paired tool uses, and the replies of model annotators.

Defined results: what is no JSON, or not of the shape, gives no rows; nulls count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.text import trim_space


def output_text(out: Column) -> Column:
    """An output given as text, as an object (its text, else its content) or as a list of both, newline-joined; ``out`` is text or JSON."""
    of_object = lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.content"), F.lit(""))
    item = lambda x: F.when(F.startswith(x, F.lit("{")), of_object(x)).otherwise(x)
    items = F.from_json(out, "array<string>")
    listed = F.startswith(F.ltrim(out), F.lit("[")) & items.isNotNull()
    return F.when(listed, F.concat_ws("\n", F.transform(items, item))).when(F.startswith(out, F.lit("{")), of_object(out)).otherwise(F.coalesce(out, F.lit("")))


def command_of(given: Column) -> Column:
    """command, file_path, path, pattern or query of an input object: the first that is not empty; else the object's JSON, 300 characters."""
    keys = ["command", "file_path", "path", "pattern", "query"]
    found = [F.nullif(F.get_json_object(given, f"$.{k}"), F.lit("")) for k in keys]
    return F.when(F.startswith(given, F.lit("{")), F.coalesce(*found, F.left(given, F.lit(300)))).otherwise("")


def from_tool_uses(rows: DataFrame) -> DataFrame:
    """(session_id, messages JSON) to steps (session_id, idx, role, tool_name, cmd, output, input_file, text).

    A message's tool uses each make a tool step, and its text is then left out; otherwise a text that is not blank makes a
    user's or an assistant's step, trimmed. Sessions without a tool step give none.
    """
    m = rows.select("session_id", F.posexplode(F.from_json("messages", "array<struct<role:string,content:string,tool_uses:array<string>>>")).alias("at", "m"))
    use = "struct<tool:string,input:string,output:string>"
    tools = m.where(F.size("m.tool_uses") > 0).select("session_id", "at", F.posexplode("m.tool_uses").alias("n", "raw")).where(F.startswith("raw", F.lit("{"))).withColumn("u", F.from_json("raw", use))
    given = F.coalesce("u.input", F.lit("{}"))
    file = F.coalesce(F.nullif(F.get_json_object(given, "$.file_path"), F.lit("")), F.get_json_object(given, "$.path"))
    tools = tools.select("session_id", "at", "n", F.lit("tool").alias("role"), F.coalesce("u.tool", F.lit("")).alias("tool_name"), F.when(given == "{}", "{}").otherwise(command_of(given)).alias("cmd"), output_text(F.col("u.output")).alias("output"), file.alias("input_file"), F.lit("").alias("text"))
    said = m.where(F.coalesce(F.size("m.tool_uses"), F.lit(0)) <= 0).withColumn("t", trim_space(F.col("m.content"))).where("t <> ''")
    none = F.lit("")
    said = said.select("session_id", "at", F.lit(0).alias("n"), F.when(F.col("m.role") == "user", "user_text").otherwise("assistant_text").alias("role"), none.alias("tool_name"), none.alias("cmd"), none.alias("output"), F.lit(None).cast("string").alias("input_file"), F.col("t").alias("text"))
    one = W.partitionBy("session_id")
    steps = tools.unionByName(said).withColumn("idx", (F.row_number().over(one.orderBy("at", "n")) - 1).cast("bigint")).withColumn("has_tool", F.max(F.col("role") == "tool").over(one))
    return steps.where("has_tool").select("session_id", "idx", "role", "tool_name", "cmd", "output", "input_file", "text")


def reply_events(replies: DataFrame) -> DataFrame:
    """(session_id, reply) to the labels an annotator gave: (session_id, pos, expire, after_step, progress_type, finding, evidence, next_direction).

    The reply's JSON is what lies between its first and last brace. An event counts if it has just one of expire and checkpoint; an expire
    must be a whole number (a fraction is cut), a checkpoint an object with after_step and progress_type.
    """
    whole = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    events = replies.select("session_id", F.posexplode(F.from_json(F.get_json_object(whole, "$.events"), "array<string>")).alias("pos", "e"))
    keys = F.map_keys(F.from_json("e", "map<string,string>"))
    has = lambda k: F.array_contains(keys, k)
    whole_number = lambda c: F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("bigint")).when(c.rlike(r"^[+-]?\d+\.\d+$"), c.try_cast("double").cast("bigint"))
    get = lambda k: F.get_json_object("e", f"$.checkpoint.{k}")
    rows = events.where(has("expire") != has("checkpoint")).select(
        "session_id", F.col("pos").cast("bigint").alias("pos"), F.when(has("expire"), whole_number(F.get_json_object("e", "$.expire"))).alias("expire"), F.when(has("checkpoint"), whole_number(get("after_step"))).alias("after_step"),
        get("progress_type").alias("progress_type"), *[F.when(has("checkpoint"), F.coalesce(get(k), F.lit(""))).alias(k) for k in ("finding", "evidence", "next_direction")],
    )
    return rows.where("expire is not null or (after_step is not null and progress_type is not null)")
