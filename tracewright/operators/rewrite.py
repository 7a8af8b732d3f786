"""Order-preserving history rewrites over message tables (req, idx, role, content), one partitioning per request.

``content`` is a string or a JSON array of blocks; ``idx`` is the message's place, from 0 without gaps. Blocks that a
rewrite does not touch keep their JSON text; of a block that changes all but its content stays, byte for byte. Rewrites return ``ord`` (double) where messages come in between;
``renumber`` makes it an idx again. Lengths are counted as UTF-16 units, as the protocol's clients do.

Defined results: null content is no list; empty tables give empty tables; requests without what a rewrite looks for stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.jsontext import let, member, quoted, with_member
from tracewright.functions.text import summary_text, utf16_length
from tracewright.operators.normalize import field, raw_blocks, result_text, tool_names
from tracewright.sources.shared import stored

#: The checkpoint tool's name, by itself or behind a server's prefix; the notes that rewrites leave. Fixed values.
CHECKPOINT_TOOL = "checkpoint_progress"
REWIND_NOTE = "[Previous exploration elided — agent summary: %s]"
SHADOW_NOTE = "[Checkpoint note from your prior reasoning — prior exploration elided]\n%s\n\nThe next messages show the most-recent verification evidence. Continue with any remaining work from the original task."
HARNESS_NOTE = "[Checkpoint note from your prior reasoning]\n%s\n\nThe turn immediately above shows the verification evidence. Continue with any remaining work from the original task."


def text_message(text: Column) -> Column:
    return F.concat(F.lit('[{"type":"text","text":'), quoted(text), F.lit("}]"))


def renumber(messages: DataFrame) -> DataFrame:
    """(req, ord, role, content) with ``idx`` from 0 instead of ``ord``."""
    return messages.select("req", (F.row_number().over(W.partitionBy("req").orderBy("ord")) - 1).cast("bigint").alias("idx"), "role", "content")


def truncate_lines(text: Column, first: int, last: int, marker: str, least: int) -> Column:
    """``first`` and ``last`` lines of a text of ``least`` lines or more around a marker with the number left out."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    tail = F.slice(lines, -F.least(F.lit(last), n), F.lit(last))
    cut = F.concat_ws("\n", F.concat_ws("\n", F.slice(lines, 1, first)), F.format_string(marker, n - first - last), F.concat_ws("\n", tail))
    return F.when(n >= least, cut).otherwise(text)


def compacted_blocks(messages: DataFrame, stale_turns: int = 2, keep_first: int = 30, keep_last: int = 10, min_lines: int = 50) -> DataFrame:
    """Stale long Bash results in short: (req, idx, pos, block, lines, tokens_saved), one row per block that changes."""
    req = W.partitionBy("req")
    assistant = F.count_if(F.col("role") == "assistant")
    age = assistant.over(req) - assistant.over(req.orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow))
    stale = messages.withColumn("age", age).where((F.col("role") == "user") & (F.col("age") >= stale_turns))
    b = stale.select("req", "idx", F.posexplode(raw_blocks(F.col("content"))).alias("pos", "b")).where(field("b", "type") == "tool_result")
    b = b.withColumn("id", field("b", "tool_use_id")).join(tool_names(messages), ["req", "id"]).where("name = 'Bash'")
    text = result_text(field("b", "content"))
    b = b.withColumn("text", text).withColumn("lines", F.size(F.split("text", "\n"))).where(F.col("lines") >= min_lines)
    seen = F.startswith("text", F.lit("[COMPACTED"))
    short = truncate_lines(F.col("text"), keep_first, keep_last, "\n[... %s lines compacted ...]\n", min_lines)
    b = b.where(~seen).withColumn("out", F.concat(F.format_string("[COMPACTED — %s lines → %s]\n", "lines", F.lit(keep_first + keep_last)), short))
    b = b.withColumn("saved", utf16_length(F.col("text")) - utf16_length(F.col("out"))).where("saved > 0")
    return b.select("req", "idx", "pos", with_member(F.col("b"), "content", quoted(F.col("out"))).alias("block"), "lines", F.floor(F.col("saved") / 4 + 0.5).alias("tokens_saved"))


def compact(messages: DataFrame, stale_turns: int = 2, keep_first: int = 30, keep_last: int = 10, min_lines: int = 50) -> DataFrame:
    """``messages`` with stale long Bash results in short, and n_compacted and tokens_saved; done twice it changes nothing more."""
    changed = compacted_blocks(messages, stale_turns, keep_first, keep_last, min_lines)
    by_message = changed.groupBy("req", "idx").agg(F.map_from_entries(F.collect_list(F.struct("pos", "block"))).alias("new"), F.count(F.lit(1)).alias("n"), F.sum("tokens_saved").alias("saved"))
    blocks = F.transform(raw_blocks(F.col("content")), lambda b, i: F.coalesce(F.try_element_at("new", i), b))
    content = F.when(F.col("new").isNull(), F.col("content")).otherwise(F.concat(F.lit("["), F.concat_ws(",", blocks), F.lit("]")))
    return messages.join(by_message, ["req", "idx"], "left").select("req", "idx", "role", content.alias("content"), F.coalesce("n", F.lit(0)).alias("n_compacted"), F.coalesce("saved", F.lit(0)).alias("tokens_saved"))


def with_checkpoints(messages: DataFrame) -> DataFrame:
    """``messages`` with ``summary``: what the first checkpoint call of an assistant message says; null where there is none."""
    is_call = lambda b: (F.get_json_object(b, "$.type") == "tool_use") & ((F.get_json_object(b, "$.name") == CHECKPOINT_TOOL) | F.endswith(F.get_json_object(b, "$.name"), F.lit("__" + CHECKPOINT_TOOL)))
    call = F.get(F.filter(raw_blocks(F.col("content")), is_call), F.lit(0))
    said = [F.get_json_object("call", f"$.input.{k}") for k in ("progress_type", "finding", "evidence", "next_direction", "summary")]
    marked = messages.withColumn("call", F.when(F.col("role") == "assistant", call))
    return marked.withColumn("summary", F.when(F.col("call").isNotNull(), summary_text(*said))).drop("call")


def _elided(messages: DataFrame) -> DataFrame:
    back = W.partitionBy("req").orderBy(F.desc("idx"))  # from the end, so the next checkpoint is the last one so far
    rows = with_checkpoints(messages).withColumn("anchor", F.col("summary").isNotNull())
    at = F.when(F.col("anchor"), F.struct("idx", "summary"))
    rows = rows.select("*", F.last(at, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("next"), F.coalesce(F.lead("anchor").over(back), F.lit(False)).alias("after"))
    pair = F.col("anchor") | ((F.col("role") == "user") & F.col("after"))
    return rows.withColumn("elided", (F.col("idx") > 0) & F.col("next").isNotNull() & ~pair)


def rewind(messages: DataFrame) -> DataFrame:
    """What lies between checkpoints goes; one note each says what the checkpoint after it says: (req, ord, role, content).

    The first message and every checkpoint's call and result stay. A checkpoint in the first message stays twice, as it is its own pair.
    """
    rows = _elided(messages)
    kept = rows.where("not elided").select("req", F.explode(F.when((F.col("idx") == 0) & F.col("anchor"), F.array(F.lit(0.0), F.lit(0.25))).otherwise(F.array(F.col("idx").cast("double")))).alias("ord"), "role", "content")
    notes = rows.where("elided").select("req", "next").distinct()
    notes = notes.select("req", (F.col("next.idx") - 0.5).alias("ord"), F.lit("user").alias("role"), text_message(F.format_string(REWIND_NOTE, "next.summary")).alias("content"))
    return kept.unionByName(notes)


def message_length(role: Column, content: Column) -> Column:
    """UTF-16 units of the message's JSON."""
    body = F.when(raw_blocks(content).isNotNull(), content).otherwise(quoted(F.coalesce(content, F.lit(""))))
    return utf16_length(F.concat(F.lit('{"role":'), quoted(role), F.lit(',"content":'), body, F.lit("}")))


def elisions(messages: DataFrame) -> DataFrame:
    """Side output of ``rewind``: per checkpoint the turns that went before it, the length of their JSON array, and its summary."""
    gone = _elided(messages).where("elided").groupBy("req", F.col("next.idx").alias("anchor_idx"), F.col("next.summary").alias("summary"))
    return gone.agg(F.count(F.lit(1)).alias("turns_elided"), (F.sum(message_length(F.col("role"), F.col("content"))) + F.count(F.lit(1)) + 1).cast("bigint").alias("bytes_saved"))


def judge_rewind(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Keep the goal and everything from the assistant message before the last tool result on, with the judge's summary between.

    ``summaries``: (req, summary). Fires with 4 messages or more, if that message is an assistant's, all its tool
    uses have their results in the next and something goes. Returns (req, ord, role, content, n_elided).
    """
    req = W.partitionBy("req")
    ids = lambda kind, key: F.transform(F.filter(raw_blocks(F.col("content")), lambda b: F.get_json_object(b, "$.type") == kind), lambda b: F.get_json_object(b, f"$.{key}"))
    rows = messages.join(summaries.select("req", F.col("summary").alias("said")), "req", "left")
    rows = rows.withColumn("uses", F.when(F.col("role") == "assistant", F.filter(F.coalesce(ids("tool_use", "id"), F.array()), lambda x: x.isNotNull()))).withColumn("results", F.when(F.col("role") == "user", ids("tool_result", "tool_use_id")))
    rows = rows.withColumn("l", F.max(F.when(F.size("results") > 0, F.col("idx"))).over(req)).withColumn("n", F.count(F.lit(1)).over(req))
    uses, results = (F.first(F.when(F.col("idx") == at, F.col(c)), ignorenulls=True).over(req) for c, at in (("uses", F.col("l") - 1), ("results", F.col("l"))))
    rows = rows.withColumn("u", uses).withColumn("r", results)
    fires = (F.col("n") >= 4) & (F.col("l") >= 3) & F.col("u").isNotNull() & (F.size(F.array_except("u", "r")) == 0) & (F.coalesce("said", F.lit("")) != "")
    rows = rows.withColumn("fires", F.coalesce(fires, F.lit(False)))
    n_elided = F.when(F.col("fires"), F.col("l") - 2).otherwise(0).cast("bigint").alias("n_elided")
    kept = rows.where(~F.col("fires") | (F.col("idx") == 0) | (F.col("idx") >= F.col("l") - 1)).select("req", F.col("idx").cast("double").alias("ord"), "role", "content", n_elided)
    notes = rows.where(F.col("fires") & (F.col("idx") == 0)).select("req", F.lit(0.5).alias("ord"), F.lit("user").alias("role"), text_message(F.format_string(SHADOW_NOTE, "said")).alias("content"), n_elided)
    return kept.unionByName(notes)


def harness_rewind(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """For system, user, assistant and tool messages: the first two, the last tool message and the one before it, then a note.

    Fires with 4 messages or more and a last tool message in fourth place or later. Returns (req, ord, role, content, n_elided).
    """
    req = W.partitionBy("req")
    rows = messages.withColumn("l", F.max(F.when(F.col("role") == "tool", F.col("idx"))).over(req)).withColumn("n", F.count(F.lit(1)).over(req))
    rows = rows.withColumn("fires", F.coalesce((F.col("n") >= 4) & (F.col("l") >= 3), F.lit(False))).withColumn("n_elided", F.when(F.col("fires"), F.col("l") - 3).otherwise(0).cast("bigint"))
    stays = (F.col("idx") < 2) | ((F.col("idx") >= F.col("l") - 1) & (F.col("idx") <= F.col("l")))
    kept = rows.where(~F.col("fires") | stays).select("req", F.col("idx").cast("double").alias("ord"), "role", "content", "n_elided")
    notes = rows.where(F.col("fires") & (F.col("idx") == 0)).join(summaries.select("req", F.col("summary").alias("said")), "req")
    notes = notes.select("req", (F.col("l") + 0.5).alias("ord"), F.lit("user").alias("role"), F.format_string(HARNESS_NOTE, "said").alias("content"), "n_elided")
    return kept.unionByName(notes)


#: The edit's type; a fixed value.
CLEAR_EDIT = "clear_tool_uses_20250919"


def inject_clear(edits: Column, trigger: int = 30000, keep: int = 3, at_least: int = 5000, exclude: tuple[str, ...] = ("Read", "Grep", "Glob")) -> Column:
    """Append the clear-tool-uses edit unless one is there; edits is array<struct<type, trigger, keep, clear_at_least, exclude_tools>>."""
    kind = CLEAR_EDIT
    new = F.struct(F.lit(kind).alias("type"), F.lit(trigger).cast("bigint").alias("trigger"), F.lit(keep).cast("bigint").alias("keep"), F.lit(at_least).cast("bigint").alias("clear_at_least"), F.array(*map(F.lit, exclude)).alias("exclude_tools"))
    return F.when(F.exists(edits, lambda e: e["type"] == kind), edits).otherwise(F.concat(F.coalesce(edits, F.array().cast("array<struct<type:string,trigger:bigint,keep:bigint,clear_at_least:bigint,exclude_tools:array<string>>>")), F.array(new)))


def inject_text(trigger: int = 30000, keep: int = 3, at_least: int = 5000, exclude: tuple[str, ...] = ("Read", "Grep", "Glob")) -> str:
    """The clear-tool-uses edit as JSON."""
    knob = lambda kind, n: {"type": kind, "value": n}
    return json.dumps({"type": CLEAR_EDIT, "trigger": knob("input_tokens", trigger), "keep": knob("tool_uses", keep), "clear_at_least": knob("input_tokens", at_least), "exclude_tools": list(exclude)}, separators=(",", ":"))


def inject(body: Column, edit: str | None = None) -> Column:
    """A request's JSON with the clear-tool-uses edit as its last edit; one that has it already, or is no object, stays as it is."""
    edit = edit or inject_text()

    def into(p: Column) -> Column:
        listed = F.coalesce(F.startswith(F.ltrim(p["edits"]), F.lit("[")), F.lit(False))
        items = F.when(listed, F.from_json(p["edits"], "array<string>")).otherwise(F.array().cast("array<string>"))
        there = F.exists(items, lambda e: F.coalesce(F.get_json_object(e, "$.type") == CLEAR_EDIT, F.lit(False)))
        edits = F.when(F.size(items) > 0, F.concat(F.regexp_replace(p["edits"], r"\]\s*$", ""), F.lit("," + edit + "]"))).otherwise(F.lit("[" + edit + "]"))
        return F.when(there, p["body"]).otherwise(with_member(p["body"], "context_management", with_member(p["cm"], "edits", edits)))

    def managed(p: Column) -> Column:
        cm = F.when(F.startswith(F.ltrim(p["own"]), F.lit("{")), p["own"]).otherwise(F.lit("{}"))
        return let(F.struct(p["body"].alias("body"), cm.alias("cm")), lambda q: let(F.struct(q["body"].alias("body"), q["cm"].alias("cm"), member(q["cm"], "edits").alias("edits")), into))

    def whole(b: Column) -> Column:  # each step's text is made once, however often the next one names it
        return F.when(F.startswith(F.ltrim(b), F.lit("{")), let(F.struct(b.alias("body"), member(b, "context_management").alias("own")), managed)).otherwise(b)

    return let(body, whole)


def cache_mark(messages: DataFrame) -> DataFrame:
    """The second-to-last message (the last if there is only one) becomes the cache point: its last block is marked, a string becomes a text block."""
    req = W.partitionBy("req")
    here = F.col("idx") == F.greatest(F.count(F.lit(1)).over(req) - 2, F.lit(0))
    mark = ',"cache_control":{"type":"ephemeral"}}'
    blocks = raw_blocks(F.col("content"))
    n = F.size(blocks)
    last = F.regexp_replace(F.element_at(blocks, -1), r'(?s),"cache_control":\{[^{}]*\}(?=\}$)', "")
    listed = F.concat(F.lit("["), F.concat_ws(",", F.concat(F.slice(blocks, 1, n - 1), F.array(F.concat(F.left(last, F.length(last) - 1), F.lit(mark))))), F.lit("]"))
    text = F.concat(F.lit('[{"type":"text","text":'), quoted(F.col("content")), F.lit(mark), F.lit("]"))
    content = F.when(~here | F.col("content").isNull() | (n == 0), F.col("content")).when(blocks.isNull(), text).otherwise(listed)
    return messages.select("req", "idx", "role", content.alias("content"))


def rewrite(messages: DataFrame, summaries: DataFrame | None = None, rewinds: bool = True, compacts: bool = True, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """The chain of one request: rewind at checkpoints, then the judge's rewind where ``summaries`` has one, then compaction: (req, idx, role, content).

    Each step reads its input several times, so what comes in and what a step gives is kept: written once to the shared folder, unless ``keep`` does otherwise.
    """
    out = keep(messages.select("req", "idx", "role", "content"))
    if rewinds:
        out = keep(renumber(rewind(out)))
    if summaries is not None:
        out = keep(renumber(judge_rewind(out, summaries)))
    return compact(out).select("req", "idx", "role", "content") if compacts else out


def forward(bodies: DataFrame, summaries: DataFrame | None = None, rewinds: bool = True, compacts: bool = True, edit: str | None = None, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """What goes on to the model, (req, body): each request's messages through the chain, then the edit that clears old tool uses.

    ``bodies``: (req, body), a request's JSON. Of a body only its ``messages`` and the edits change; what is no object with a list
    of messages goes through the edit alone.
    """
    from tracewright.sources import wire

    done = rewrite(wire.messages(bodies), summaries, rewinds, compacts, keep)
    new = wire.lists(done).withColumnRenamed("messages", "_messages")
    joined = bodies.select("req", "body").join(new, "req", "left")
    changed = F.when(F.col("_messages").isNull(), F.col("body")).otherwise(with_member(F.col("body"), "messages", F.col("_messages")))
    return joined.select("req", inject(changed, edit).alias("body"))
