"""Training chunks as rows: prompt, completion, messages and meta.

A chunk is an interval of its session's messages: the goal, the newest messages that fit, and what the model is to say. Its
messages come by a join on places, in order, as nested rows, and its texts are their turns in the template, one after the
other. Costs are running sums of the turns' tokens, counted once a message by the count that is given; a turn ends with a
mark of the template's, so the tokens of a text are those of its turns. Counted messages and chunks are stored, unless ``keep`` says
otherwise: each step is planned by itself, and messages meet chunks by merges, not through the driver.

Defined results: a chunk whose whole text does not start with its prompt gives no row, as for the tokens of one that
does not fit; null contents stay null in the messages and count as empty in the texts. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import cap_response
from tracewright.operators import render
from tracewright.operators.prompts import Template, turn_text
from tracewright.sources.shared import stored_large

MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,name:string>"


def message(role: Column, content: Column, tool: Column, call_id: Column, arguments: Column) -> Column:
    """A message as training data has it: a call names its tool in ``tool_calls``, a response in ``name``."""
    is_call, is_response = arguments.isNotNull(), role == "tool"
    calls = F.when(is_call, F.array(F.struct(call_id.alias("id"), tool.alias("name"), arguments.alias("arguments"))))
    return F.struct(role.alias("role"), content.alias("content"), calls.alias("tool_calls"), F.when(is_response, call_id).alias("tool_call_id"), F.when(is_response, tool).alias("name")).cast(MESSAGE)


def specs(messages: DataFrame, checkpoints: DataFrame, ratio: float, seed: int, post: int, most: int, measure: render.Measure, keep: Callable[[DataFrame], DataFrame] = stored_large, **limits: int) -> DataFrame:
    """Which chunks there are: (session_id, label, n, at, progress_type, first_idx, end_idx, n_context, n_tokens); ``n`` is the checkpoint's number, or the call's place."""
    messages = render.counted(messages, measure, most)
    pos = keep(render.positives(messages, checkpoints, post, most, measure, **limits))
    neg = render.negatives(messages, checkpoints, pos, ratio, seed, most, measure, **limits)
    none = F.lit(None).cast("string").alias("progress_type")
    span = ["first_idx", "end_idx", "n_context", "n_tokens"]
    out = pos.select("session_id", F.lit("positive").alias("label"), F.col("chunk").alias("n"), F.col("checkpoint_step").alias("at"), "progress_type", *span)
    out = out.unionByName(neg.select("session_id", F.lit("negative").alias("label"), F.col("anchor_idx").alias("n"), F.col("anchor_idx").alias("at"), none, *span))
    cold, no = render.cold_starts(messages, most, measure), F.lit(0).cast("bigint")
    return out.unionByName(cold.select("session_id", F.lit("cold_start").alias("label"), F.col("call_idx").alias("n"), F.col("call_idx").alias("at"), none, (no + 1).alias("first_idx"), no.alias("end_idx"), no.alias("n_context"), "n_tokens"))


def parts(messages: DataFrame, checkpoints: DataFrame, made: DataFrame, post: int, most: int) -> DataFrame:
    """The messages of chunks: (session_id, label, n, done, ord, role, content, tool, call_id, arguments); ``done`` ones are what the model is to say."""
    key = ["session_id", "label", "n"]
    place = lambda idx, done: F.struct(idx.alias("idx"), F.lit(done).alias("done"))
    context = F.transform(F.when(F.col("n_context") > 0, F.sequence("first_idx", "end_idx")).otherwise(F.array().cast("array<bigint>")), lambda i: place(i, False))
    call = F.when(F.col("label") != "positive", F.array(place(F.col("n"), True), place(F.col("n") + 1, True))).otherwise(F.array().cast("array<struct<idx:bigint,done:boolean>>"))
    places = made.select(*key, F.inline(F.concat(F.array(place(F.lit(0).cast("bigint"), False)), context, call)))
    capped = F.when(F.col("done") & (F.col("role") == "tool"), cap_response(F.coalesce("content", F.lit("")), most)).otherwise(F.col("content"))
    shape = [*key, "done", F.col("idx").alias("ord"), "role", capped.alias("content"), "tool", "call_id", "arguments"]
    said = F.col("arguments").isNotNull() | (F.col("role") == "tool")
    rows = places.join(messages, ["session_id", "idx"]).where(~F.col("done") | ((F.col("idx") == F.col("n")) & F.col("arguments").isNotNull()) | ((F.col("idx") > F.col("n")) & (F.col("role") == "tool") & said)).select(shape)
    after = render.completion_messages(messages, checkpoints, post, most).withColumnsRenamed({"chunk": "n"})
    after = after.join(made.where("label = 'positive'").select("session_id", "label", "n"), ["session_id", "n"])
    after = after.join(messages.select("session_id", "idx", "call_id"), ["session_id", "idx"], "left")
    call_id = F.coalesce("call_id", F.concat(F.lit("call_ckpt_"), F.col("n").cast("string")))
    return rows.unionByName(after.select(*key, F.lit(True).alias("done"), F.col("idx").alias("ord"), "role", "content", "tool", call_id.alias("call_id"), "arguments"))


def chunk_rows(
    messages: DataFrame, checkpoints: DataFrame, template: Template = Template(), measure: render.Measure | None = None, ratio: float = 1.0, seed: int = 42, cold: int = 1, post: int = 1, most: int = 500, keep: Callable[[DataFrame], DataFrame] = stored_large, **limits: int
) -> DataFrame:
    """Every training chunk as (prompt, completion, messages, meta), cold starts ``cold`` times each; ``meta`` has label, source_session, the place, n_tokens and more.

    ``measure``: how turns are counted; by default four characters of a turn a token. A chunk holds at most its budget of tokens.
    """
    measure = measure or render.Measure(template=template)
    messages = keep(render.token_counts(messages, measure, most))
    made = keep(specs(messages, checkpoints, ratio, seed, post, most, measure, keep, **limits))
    rows = parts(messages, checkpoints, made, post, most)
    turn = turn_text(template, *map(F.col, ("role", "content", "tool", "arguments")))
    one = F.struct("done", "ord", turn.alias("turn"), message(*map(F.col, ("role", "content", "tool", "call_id", "arguments"))).alias("message"))
    whole = rows.groupBy("session_id", "label", "n").agg(F.array_sort(F.collect_list(one)).alias("m"))
    text = lambda ms: F.array_join(F.transform(ms, lambda x: x["turn"]), "")
    prompt = F.concat(F.lit(template.preamble), text(F.filter("m", lambda x: ~x["done"])), F.lit(template.opening))
    texts = whole.select("session_id", "label", "n", prompt.alias("prompt"), F.concat(F.lit(template.preamble), text(F.col("m"))).alias("full"), F.transform("m", lambda x: x["message"]).alias("messages"))
    texts = texts.where(F.startswith("full", F.col("prompt"))).withColumn("completion", F.substr("full", F.length("prompt") + 1))
    on = lambda label, c: F.when(F.col("label") == label, F.col(c))
    meta = F.struct("label", F.col("session_id").alias("source_session"), on("positive", "at").alias("checkpoint_step"), "progress_type", on("negative", "at").alias("negative_anchor_idx"), "n_tokens", F.col("n_context").alias("n_context_msgs"))
    out = made.join(texts, ["session_id", "label", "n"]).withColumn("meta", meta)
    times = F.when(F.col("label") == "cold_start", F.lit(cold)).otherwise(1)
    return out.select("prompt", "completion", "messages", "meta", F.explode(F.array_repeat(F.lit(1), times)).alias("_n")).drop("_n")
