"""Messages to content blocks to tool calls to steps.

A message's content is a string or a JSON array of blocks; both become rows of
(req, msg, ord, role, type, text, id, name, input, result). Pairing is join-free: uses and
results of one id are one ordered stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import text as text_functions
from tracewright.functions.stats import floor_percentiles

BLOCK = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:map<string,string>,tool_use_id:string,content:string>>"


def result_text(content: Column) -> Column:
    """Text blocks of a list joined by newlines; a string as it is; else ''."""
    parsed = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parsed, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & parsed.isNotNull(), F.concat_ws("\n", texts)).otherwise(F.coalesce(content, F.lit("")))


def raw_blocks(content: Column) -> Column:
    """The JSON texts of the blocks of a list; null for a string."""
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.from_json(content, "array<string>"))


def field(block: str, name: str) -> Column:
    """A field of a block's JSON text: strings as they are, else JSON."""
    return F.get_json_object(block, f"$.{name}")


def tool_names(messages: DataFrame) -> DataFrame:
    """(req, id, name) of every tool use of an assistant message; of a repeated id the last name."""
    b = messages.where("role = 'assistant'").select("req", "idx", F.posexplode(raw_blocks(F.col("content"))).alias("pos", "b"))
    uses = b.select("req", "idx", "pos", field("b", "type").alias("type"), field("b", "id").alias("id"), field("b", "name").alias("name")).where("type = 'tool_use' and id <> '' and name <> ''")
    return uses.groupBy("req", "id").agg(F.max_by("name", F.struct("idx", "pos")).alias("name"))


def last_turn_calls(messages: DataFrame) -> DataFrame:
    """Tool uses of each request's last assistant message with the last result of their id, '' without one: (req, pos, id, name, input, output)."""
    last = messages.where("role = 'assistant'").groupBy("req").agg(F.max_by("content", "idx").alias("content"))
    uses = last.select("req", F.posexplode(raw_blocks(F.col("content"))).alias("pos", "b")).where(field("b", "type") == "tool_use")
    results = messages.where("role = 'user'").select("req", "idx", F.posexplode(raw_blocks(F.col("content"))).alias("rpos", "b")).where(field("b", "type") == "tool_result")
    results = results.groupBy("req", field("b", "tool_use_id").alias("id")).agg(F.max_by(result_text(field("b", "content")), F.struct("idx", "rpos")).alias("output"))
    uses = uses.select("req", F.col("pos").cast("bigint").alias("pos"), field("b", "id").alias("id"), field("b", "name").alias("name"), field("b", "input").alias("input"))
    return uses.join(results, ["req", "id"], "left").withColumn("output", F.coalesce("output", F.lit("")))


def tally_results(messages: DataFrame) -> DataFrame:
    """Per request over its tool results: count, total, longest, middle and ninth-tenth length in UTF-16 units, and offloaded ones."""
    b = messages.where("role = 'user'").select("req", F.explode(raw_blocks(F.col("content"))).alias("b")).where(field("b", "type") == "tool_result")
    sized = b.select("req", result_text(field("b", "content")).alias("t")).select("req", text_functions.utf16_length(F.col("t")).alias("n"), text_functions.is_offloaded(F.col("t")).cast("int").alias("off"))
    sizes = floor_percentiles(sized, ["req"], "n", {"p50_chars": 0.5, "p90_chars": 0.9}).withColumnsRenamed({"total": "total_chars", "max": "max_chars"})
    off = sized.groupBy("req").agg(F.sum("off").alias("offloaded_markers"))
    all_ = messages.select("req").distinct()
    return all_.join(sizes, "req", "left").join(off, "req", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def request_summary(bodies: DataFrame) -> DataFrame:
    """(req, body, betas) to what a request asks for; ``body`` is its JSON, ``betas`` the header's value.

    ``context_management`` has the number of edits and, of each, its type and settings as JSON; ``tool_results`` the tally of the
    messages' results. Both are null where the request has none.

    A body that is no JSON object gives nulls and zeros, as an empty one does.
    """
    body = lambda path: F.get_json_object("body", path)
    size = lambda path: F.coalesce(F.size(F.from_json(body(path), "array<string>")), F.lit(0))
    system = F.coalesce(F.from_json(body("$.system"), "array<struct<text:string>>"), F.array().cast("array<struct<text:string>>"))
    plain = ~F.startswith(F.ltrim(body("$.system")), F.lit("["))
    total = F.aggregate(system, F.lit(0).cast("bigint"), lambda a, b: a + F.coalesce(text_functions.utf16_length(b["text"]), F.lit(0).cast("bigint")))
    managed = body("$.context_management")
    truthy = managed.isNotNull() & ~managed.isin("", "0", "false", "null")
    edits = F.coalesce(F.when(F.startswith(body("$.context_management.edits"), F.lit("[")), F.from_json(body("$.context_management.edits"), "array<string>")), F.array().cast("array<string>"))
    knobs = ["type", "trigger", "keep", "clear_at_least", "exclude_tools"]
    strategies = F.transform(edits, lambda e: F.struct(*[F.get_json_object(e, f"$.{k}").alias(k) for k in knobs]))
    from tracewright.sources import wire

    tally = tally_results(wire.messages(bodies.where(F.startswith(body("$.messages"), F.lit("["))))).where("count > 0")
    tally = tally.select(F.col("req").alias("_req"), F.struct(*[c for c in tally.columns if c != "req"]).alias("tool_results"))
    bodies = bodies.join(tally, F.col("req").eqNullSafe(F.col("_req")), "left")
    return bodies.select(
        "req", body("$.model").alias("model"), (F.coalesce(body("$.stream"), F.lit("")) == "true").alias("stream"), body("$.max_tokens").try_cast("double").try_cast("bigint").alias("max_tokens"),
        F.filter(F.transform(F.coalesce(F.split("betas", ","), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "").alias("betas"),
        F.when(size("$.messages") > 0, size("$.messages")).otherwise(0).cast("bigint").alias("message_count"), F.when(size("$.tools") > 0, size("$.tools")).otherwise(0).cast("bigint").alias("tool_count"),
        F.coalesce(F.when(plain, text_functions.utf16_length(body("$.system"))), total).alias("system_size_chars"), F.when(truthy, F.struct(F.size(edits).cast("bigint").alias("edit_count"), strategies.alias("strategies"))).alias("context_management"), "tool_results",
        text_functions.utf16_length(F.col("body")).alias("body_size_chars"),
    )


def blocks(messages: DataFrame) -> DataFrame:
    """(req, idx, role, content) to one row per block."""
    parsed = F.when(F.startswith(F.ltrim("content"), F.lit("[")), F.from_json("content", BLOCK))
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("thinking", "id", "name")], F.lit(None).cast("map<string,string>").alias("input"), *[F.lit(None).cast("string").alias(c) for c in ("tool_use_id", "content")]))
    rows = messages.select("req", "idx", "role", F.posexplode(F.coalesce(parsed, text)).alias("pos", "b"))
    return rows.select("req", "idx", "pos", "role", F.col("b.type").alias("type"), F.col("b.text").alias("text"), F.coalesce("b.thinking", F.when(F.col("b.type") == "thinking", F.col("b.text"))).alias("thinking"), F.coalesce("b.id", "b.tool_use_id").alias("id"), F.col("b.name").alias("name"), F.col("b.input").alias("input"), result_text(F.col("b.content")).alias("result"))


def pair_calls(stream: DataFrame) -> DataFrame:
    """Uses and results (req, id, ord, kind) to calls in emit order: (req, seq, id, use_ord, result_ord).

    A result takes the use right before it of the same id; uses that another use follows are
    overwritten; a use that nothing follows is flushed at the end, at the place of the first
    use of its unbroken run.
    """
    one = W.partitionBy("req", "id").orderBy("ord")
    rows = stream.select("*", F.lag("kind").over(one).alias("prev"), F.lag("ord").over(one).alias("prev_ord"), F.lead("kind").over(one).alias("next"), F.count_if(F.col("kind") == "result").over(one).alias("run"))
    rows = rows.withColumn("run_start", F.min(F.when(F.col("kind") == "use", F.col("ord"))).over(W.partitionBy("req", "id", "run")))
    pairs = rows.where("kind = 'result' and prev = 'use'").select("req", "id", F.col("prev_ord").alias("use_ord"), F.col("ord").alias("result_ord"), F.lit(0).alias("phase"), F.col("ord").alias("at"))
    orphans = rows.where("kind = 'use' and next is null").select("req", "id", F.col("ord").alias("use_ord"), F.lit(None).cast("bigint").alias("result_ord"), F.lit(1).alias("phase"), F.col("run_start").alias("at"))
    return pairs.unionByName(orphans).select("req", (F.row_number().over(W.partitionBy("req").orderBy("phase", "at")) - 1).cast("bigint").alias("seq"), "id", "use_ord", "result_ord")


def tool_calls(messages: DataFrame) -> DataFrame:
    """(req, idx, role, content) to (req, seq, id, name, input, cmd, output, thinking)."""
    b = blocks(messages).withColumn("ord", F.row_number().over(W.partitionBy("req").orderBy("idx", "pos")).cast("bigint"))
    b = b.withColumn("grp", F.count_if(F.col("type") == "tool_use").over(W.partitionBy("req").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)))
    b = b.withColumn("carried", F.last("thinking", ignorenulls=True).over(W.partitionBy("req", "grp").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)))
    kind = F.when((F.col("type") == "tool_use") & (F.col("role") == "assistant"), "use").when((F.col("type") == "tool_result") & (F.col("role") == "user"), "result")
    calls = pair_calls(b.withColumn("kind", kind).where("kind is not null and id is not null").select("req", "id", "ord", "kind"))
    uses = b.select("req", F.col("ord").alias("use_ord"), "name", "input", F.col("carried").alias("thinking"))
    results = b.select("req", F.col("ord").alias("result_ord"), F.col("result").alias("output"))
    out = calls.join(uses, ["req", "use_ord"]).join(results, ["req", "result_ord"], "left")
    return out.select("req", "seq", "id", "name", "input", command(F.col("input")).alias("cmd"), F.coalesce("output", F.lit("")).alias("output"), "thinking")


def command(i: Column) -> Column:
    """By key presence: command, file_path, pattern; if that is empty: description, or prompt, by key presence too, 200 characters."""
    get = lambda k: F.try_element_at(i, F.lit(k))
    first = F.when(F.map_contains_key(i, "command"), get("command")).when(F.map_contains_key(i, "file_path"), get("file_path")).otherwise(get("pattern"))
    said = F.left(F.coalesce(F.when(F.map_contains_key(i, "description"), get("description")).otherwise(get("prompt")), F.lit("")), F.lit(200))
    return F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(said)


def first_truthy(i: Column) -> Column:
    """command, file_path, path, pattern, query: the first that is not empty; else the JSON of all, 300 characters."""
    keys = ["command", "file_path", "path", "pattern", "query"]
    return F.coalesce(*[F.nullif(F.try_element_at(i, F.lit(k)), F.lit("")) for k in keys], F.left(F.to_json(i), F.lit(300)))


def recent_tools(messages: DataFrame, tail: int = 20, most: int = 8) -> DataFrame:
    """Per request the last ``most`` uses of its last ``tail`` messages, as 'name: detail'."""
    recent = messages.withColumn("back", F.row_number().over(W.partitionBy("req").orderBy(F.desc("idx")))).where(F.col("back") <= tail)
    get = lambda k: F.try_element_at(F.col("input"), F.lit(k))
    uses = blocks(recent).where("type = 'tool_use'")
    said = F.concat("name", F.lit(": "), F.left(F.coalesce(*map(get, ["command", "file_path", "pattern", "description", "prompt"]), F.lit("")), F.lit(60)))
    lines = uses.groupBy("req").agg(F.array_sort(F.collect_list(F.struct("idx", "pos", said.alias("s")))).alias("a"))
    return lines.select("req", F.transform(F.slice("a", -F.least(F.size("a"), F.lit(most)), F.least(F.size("a"), F.lit(most))), lambda x: x["s"]).alias("tools"))
