"""Sessions to prompts, chat messages and training chunks.

Messages of a session: (session_id, idx, role, content, tool, call_id, arguments, step). What they cost is a ``Measure``: a count
of a text column, four characters a token unless one is given, of the content and arguments or of turns as a template writes them.

``chunks`` stores the counted messages and the positive chunks, which it reads more than once, unless ``keep`` says otherwise: each is
planned by itself, and none is sent whole through the driver.

Defined results: null texts count as empty; sessions without steps give no messages; chunks that do not fit give no row.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.text import cap_response, estimate_tokens
from tracewright.functions.wrap import wrapped
from tracewright.operators.prompts import Template, turn_text
from tracewright.sources.shared import stored_large

#: The checkpoint tool's name in training data and its answer; fixed values.
CHECKPOINT_TOOL = "mcp__bookmarks__checkpoint_progress"
CHECKPOINT_ACK = "Checkpoint saved. Prior exploration may now be condensed."


def transcript(steps: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """Ordered string aggregation of ``line``."""
    return steps.groupBy(by).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line])).alias("transcript"))


class Measure(NamedTuple):
    """What a message costs; with a template its whole turn, and the template's preamble once a chunk."""

    count: Callable[[Column], Column] = estimate_tokens
    template: Template | None = None

    def message(self, role: Column, content: Column, tool: Column, arguments: Column) -> Column:
        if self.template:
            return self.count(turn_text(self.template, role, content, tool, arguments))
        return self.count(F.concat(F.coalesce(content, F.lit("")), F.coalesce(arguments, F.lit(""))))

    def fixed(self) -> Column:
        return self.count(F.lit(self.template.preamble)) if self.template else F.lit(0).cast("bigint")


def call_arguments(tool: Column, cmd: Column, input_file: Column) -> Column:
    """The arguments of a tool call, by tool, as JSON."""
    target = F.coalesce(F.nullif(input_file, F.lit("")), cmd)
    j = lambda **named: F.to_json(F.struct(*[c.alias(k) for k, c in named.items()]))
    return (
        F.when(tool == "Bash", j(command=cmd)).when(tool == "Read", j(file_path=target)).when(tool.isin("Write", "Edit", "MultiEdit"), j(file_path=target, content=F.lit("[elided]")))
        .when(tool.isin("Grep", "Glob"), j(pattern=cmd)).otherwise(j(input=cmd))
    )


def chat_messages(steps: DataFrame) -> DataFrame:
    """Text steps become one message, tool steps a call and its response; ``idx`` numbers a session's messages, ``step`` is the step's."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    tool, none = F.col("role") == "tool", F.lit(None).cast("string")
    message = lambda part, role, content, args: F.struct(F.lit(part).alias("part"), role.alias("role"), content.alias("content"), args.alias("arguments"))
    call = message(0, F.lit("assistant"), none, call_arguments(F.col("tool_name"), text("cmd"), F.col("input_file")))
    response = message(1, F.lit("tool"), text("output"), none)
    said = message(0, F.when(F.col("role") == "user_text", "user").otherwise("assistant"), text("text"), none)
    rows = steps.select("session_id", F.col("idx").alias("step"), F.when(tool, F.col("tool_name")).alias("tool"), F.when(tool, F.concat(F.lit("call_"), F.col("idx").cast("string"))).alias("call_id"), F.explode(F.when(tool, F.array(call, response)).otherwise(F.array(said))).alias("m"))
    idx = (F.row_number().over(W.partitionBy("session_id").orderBy("step", "m.part")) - 1).cast("bigint")
    return rows.select("session_id", idx.alias("idx"), "m.role", "m.content", "tool", "call_id", "m.arguments", "step")


def anchors(messages: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints with the index of the last message of their step; those of unknown steps go. ``chunk`` numbers a session's."""
    last = messages.groupBy("session_id", F.col("step").alias("after_step")).agg(F.max("idx").alias("anchor_idx"))
    rows = checkpoints.join(last, ["session_id", "after_step"])
    chunk = F.row_number().over(W.partitionBy("session_id").orderBy("after_step")) - 1
    return rows.withColumn("chunk", chunk.cast("bigint"))


def token_counts(messages: DataFrame, measure: Measure = Measure(), most: int = 500) -> DataFrame:
    """``messages`` with n_tokens, and capped_tokens with a content of ``most`` characters at most."""
    named = [F.col(c) for c in ("tool", "arguments")]
    capped = cap_response(F.coalesce("content", F.lit("")), most)
    return messages.withColumns({"n_tokens": measure.message(F.col("role"), F.col("content"), *named), "capped_tokens": measure.message(F.col("role"), capped, *named)})


def counted(messages: DataFrame, measure: Measure = Measure(), most: int = 500) -> DataFrame:
    """``token_counts`` of messages that are not counted yet."""
    return messages if "capped_tokens" in messages.columns else token_counts(messages, measure, most)


def completions(messages: DataFrame, at: DataFrame, post: int = 1, most: int = 500) -> DataFrame:
    """Per checkpoint the next ``post`` assistant tool calls after it with their responses, capped: (session_id, chunk, idx, role, content, arguments, n_tokens)."""
    order = W.partitionBy("session_id").orderBy("idx")
    messages = counted(messages, most=most)
    calls = messages.withColumn("is_call", (F.col("role") == "assistant") & F.col("arguments").isNotNull()).withColumn("answers", F.coalesce(F.lag("is_call").over(order), F.lit(False)) & (F.col("role") == "tool"))
    numbered = calls.withColumn("call", F.count_if("is_call").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    seen = numbered.select("session_id", F.col("idx").alias("anchor_idx"), F.col("call").alias("calls_before"))
    a = at.join(seen, ["session_id", "anchor_idx"]).select("session_id", "chunk", F.explode(F.sequence(F.col("calls_before") + 1, F.col("calls_before") + post)).alias("call"))
    rows = numbered.where("is_call or answers").join(a, ["session_id", "call"])
    capped = F.when(F.col("answers"), cap_response(F.col("content"), most)).otherwise(F.col("content"))
    return rows.select("session_id", "chunk", "idx", "role", capped.alias("content"), "arguments", F.col("capped_tokens").alias("n_tokens"))


def fill(messages: DataFrame, targets: DataFrame, measure: Measure = Measure(), budget: int = 8192, goal_budget: int = 2048, reserve: int = 512, min_context: int = 10) -> DataFrame:
    """Per target the newest messages up to ``end_idx`` that fit beside goal and completion: ``targets`` with first_idx, n_context and n_tokens.

    ``targets``: session_id, end_idx, completion_tokens and more. The goal is message 0, a user's, and must fit ``goal_budget``; what is
    left beside goal and completion must be ``reserve`` at least; fewer than ``min_context`` messages give no chunk.
    Running sums and thresholds are sorted together, largest first, and each takes the last message that came before it: one running
    frame, linear in a session however many targets it has.
    """
    order = W.partitionBy("session_id").orderBy("idx")
    sums = messages.select("session_id", "idx", F.sum("n_tokens").over(order).alias("upto"))
    goals = messages.where("idx = 0 and role = 'user'").where(measure.count(F.coalesce("content", F.lit(""))) <= goal_budget).select("session_id", (F.col("n_tokens") + measure.fixed()).alias("goal_tokens"))
    room = F.lit(budget) - F.col("goal_tokens") - F.col("completion_tokens")
    t = targets.join(goals, "session_id").where(room >= reserve).join(sums.withColumnsRenamed({"idx": "end_idx", "upto": "total"}), ["session_id", "end_idx"])
    wanted = t.select("session_id", (F.col("total") - room).alias("value"), F.lit(-1).cast("bigint").alias("idx"), F.struct(*t.columns).alias("t"))
    rows = wanted.unionByName(sums.select("session_id", F.col("upto").alias("value"), "idx"), allowMissingColumns=True)
    larger = W.partitionBy("session_id").orderBy(F.desc("value"), F.desc("idx")).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.last(F.when(F.col("idx") >= 0, F.struct("idx", "value")), ignorenulls=True).over(larger)  # the last message that does not go in
    t = rows.withColumn("before", before).where("idx < 0").select("t.*", "before")
    t = t.withColumn("first_idx", F.least(F.col("before.idx"), F.col("end_idx")) + 1).withColumn("n_context", F.col("end_idx") - F.col("first_idx") + 1).where(F.col("n_context") >= min_context)
    used = F.when(F.col("n_context") > 0, F.col("total") - F.col("before.value")).otherwise(0)
    return t.withColumn("n_tokens", F.col("goal_tokens") + F.col("completion_tokens") + used).drop("total", "before")


def positives(messages: DataFrame, checkpoints: DataFrame, post: int = 1, most: int = 500, measure: Measure = Measure(), **limits: int) -> DataFrame:
    """A chunk per checkpoint that fits: its call, the answer and what really followed are the completion."""
    m = counted(messages, measure, most)
    at = anchors(m, checkpoints)
    call = F.to_json(F.struct("progress_type", "finding", "evidence", "next_direction"))
    none, tool = F.lit(None).cast("string"), F.lit(CHECKPOINT_TOOL)
    own = measure.message(F.lit("assistant"), none, tool, call) + measure.message(F.lit("tool"), F.lit(CHECKPOINT_ACK), tool, none)
    after = completions(m, at, post, most).groupBy("session_id", "chunk").agg(F.sum("n_tokens").alias("after_tokens"), F.count_if(F.col("role") == "assistant").alias("post_steps"))
    t = at.join(after, ["session_id", "chunk"], "left").select("session_id", "chunk", F.col("anchor_idx").alias("end_idx"), F.col("after_step").alias("checkpoint_step"), "progress_type", call.alias("call"), (own + F.coalesce("after_tokens", F.lit(0))).alias("completion_tokens"), F.coalesce("post_steps", F.lit(0)).alias("post_steps"))
    return fill(m, t, measure, **limits)


def completion_messages(messages: DataFrame, checkpoints: DataFrame, post: int = 1, most: int = 500) -> DataFrame:
    """What the model learns to say at each checkpoint, in order: its call, the answer, then the calls that really followed with capped responses."""
    at = anchors(messages, checkpoints)
    none = F.lit(None).cast("string")
    call = F.struct(F.lit(-2).cast("bigint").alias("idx"), F.lit("assistant").alias("role"), none.alias("content"), F.to_json(F.struct("progress_type", "finding", "evidence", "next_direction")).alias("arguments"), F.lit(CHECKPOINT_TOOL).alias("tool"))
    ack = F.struct(F.lit(-1).cast("bigint").alias("idx"), F.lit("tool").alias("role"), F.lit(CHECKPOINT_ACK).alias("content"), none.alias("arguments"), F.lit(CHECKPOINT_TOOL).alias("tool"))
    own = at.select("session_id", "chunk", F.inline(F.array(call, ack)))
    after = completions(messages, at, post, most).select("session_id", "chunk", "idx", "role", "content", "arguments")
    return own.unionByName(after.join(messages.select("session_id", "idx", "tool"), ["session_id", "idx"]))


def negative_candidates(messages: DataFrame, at: DataFrame, seed: int = 42) -> DataFrame:
    """Assistant tool calls after a tool or user message that is no checkpoint's anchor, ranked by hash: (session_id, idx, rank)."""
    order = W.partitionBy("session_id").orderBy("idx")
    rows = messages.withColumn("prev", F.lag("role").over(order)).where((F.col("role") == "assistant") & F.col("arguments").isNotNull() & F.col("prev").isin("tool", "user") & (F.col("idx") > 0))
    fit = rows.join(at.select("session_id", (F.col("anchor_idx") + 1).alias("idx")), ["session_id", "idx"], "left_anti")
    key = F.md5(F.concat_ws("/", F.col("session_id").cast("string"), F.col("idx").cast("string"), F.lit(str(seed))))
    return fit.select("session_id", "idx", F.row_number().over(W.partitionBy("session_id").orderBy(key, "idx")).alias("rank"))


def negatives(messages: DataFrame, checkpoints: DataFrame, made: DataFrame, ratio: float = 1.0, seed: int = 42, most: int = 500, measure: Measure = Measure(), **limits: int) -> DataFrame:
    """Per session round-half-even(positive chunks x ratio) chunks whose completion is an ordinary call and its capped response.

    ``made``: the positive chunks. Three times as many candidates are taken by rank; the first that fit count.
    """
    m = counted(messages, measure, most)
    quota = made.groupBy("session_id").agg(F.bround(F.count(F.lit(1)) * F.lit(ratio)).cast("bigint").alias("quota")).where("quota > 0")
    c = negative_candidates(m, anchors(m, checkpoints), seed).join(quota, "session_id").where("rank <= quota * 3")
    response = m.where("role = 'tool'").select("session_id", (F.col("idx") - 1).alias("idx"), F.col("capped_tokens").alias("response_tokens"))
    own = m.select("session_id", "idx", F.col("n_tokens").alias("own_tokens"))
    t = c.join(own, ["session_id", "idx"]).join(response, ["session_id", "idx"], "left").select("session_id", F.col("idx").alias("anchor_idx"), (F.col("idx") - 1).alias("end_idx"), "rank", "quota", (F.col("own_tokens") + F.coalesce("response_tokens", F.lit(0))).alias("completion_tokens"))
    built = fill(m, t, measure, **limits).withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy("rank")))
    return built.where("n <= quota").drop("n", "quota", "rank")


def cold_starts(messages: DataFrame, most: int = 500, measure: Measure = Measure()) -> DataFrame:
    """Per session that begins with a user's message: the goal alone, completed by the first assistant tool call and its capped response."""
    m = counted(messages, measure, most)
    goals = m.where("idx = 0 and role = 'user'").select("session_id", (F.col("n_tokens") + measure.fixed()).alias("goal_tokens"))
    first = m.where("role = 'assistant' and arguments is not null and idx > 0").groupBy("session_id").agg(F.min("idx").alias("call_idx"))
    own = m.select("session_id", F.col("idx").alias("call_idx"), F.col("n_tokens").alias("own_tokens"))
    response = m.where("role = 'tool'").select("session_id", (F.col("idx") - 1).alias("call_idx"), F.col("capped_tokens").alias("response_tokens"))
    rows = goals.join(first, "session_id").join(own, ["session_id", "call_idx"]).join(response, ["session_id", "call_idx"], "left")
    return rows.select("session_id", "call_idx", (F.col("goal_tokens") + F.col("own_tokens") + F.coalesce("response_tokens", F.lit(0))).alias("n_tokens"))


def chunks(messages: DataFrame, checkpoints: DataFrame, ratio: float = 1.0, seed: int = 42, cold: int = 1, post: int = 1, most: int = 500, keep: Callable[[DataFrame], DataFrame] = stored_large, **limits: int) -> DataFrame:
    """All training chunks: (session_id, label, at, progress_type, first_idx, end_idx, n_context, n_tokens); cold starts ``cold`` times each."""
    messages = keep(token_counts(messages, most=most))
    pos = keep(positives(messages, checkpoints, post, most, **limits))
    neg = negatives(messages, checkpoints, pos, ratio, seed, most, **limits)
    shape = ["session_id", "label", "at", "progress_type", "first_idx", "end_idx", "n_context", "n_tokens"]
    none, zero = F.lit(None).cast("string").alias("progress_type"), F.lit(0).cast("bigint")
    out = pos.withColumns({"label": F.lit("positive"), "at": F.col("checkpoint_step")}).select(shape).unionByName(neg.withColumns({"label": F.lit("negative"), "at": F.col("anchor_idx")}).select("session_id", "label", "at", none, "first_idx", "end_idx", "n_context", "n_tokens"))
    again = cold_starts(messages, most).select("*", F.explode(F.array_repeat(F.lit(1), cold)))
    return out.unionByName(again.select("session_id", F.lit("cold_start").alias("label"), F.col("call_idx").alias("at"), none, (zero + 1).alias("first_idx"), zero.alias("end_idx"), zero.alias("n_context"), "n_tokens"))


def chunk_messages(messages: DataFrame, chunk: DataFrame, most: int = 500) -> DataFrame:
    """The messages of chunks, in order: the goal, the context, then for negatives and cold starts the call and its capped response
    (``completion_messages`` has those of positives).

    ``chunk``: rows of ``chunks``. A chunk's context is at most its budget of tokens, whatever its session holds.
    """
    m = messages.withColumn("capped", cap_response(F.col("content"), most))
    rows = chunk.withColumn("call", F.when(F.col("label") == "negative", F.col("end_idx") + 1).when(F.col("label") == "cold_start", F.col("at")))
    places = F.array_union(F.array(F.lit(0).cast("bigint")), F.when(F.col("n_context") > 0, F.sequence("first_idx", "end_idx")).otherwise(F.array().cast("array<bigint>")))
    places = F.transform(places, lambda x: F.struct(x.alias("idx"), F.lit(False).alias("done")))
    tail = F.when(F.col("call").isNull(), F.array().cast("array<struct<idx:bigint,done:boolean>>")).otherwise(F.array(F.struct(F.col("call").alias("idx"), F.lit(True).alias("done")), F.struct((F.col("call") + 1).alias("idx"), F.lit(True).alias("done"))))
    named = rows.select("session_id", "label", "at", F.inline(F.concat(places, tail)))
    joined = named.join(m, ["session_id", "idx"]).where(~F.col("done") | (F.col("role") == "tool") | F.col("arguments").isNotNull())
    return joined.select("session_id", "label", "at", "idx", "done", "role", F.when(F.col("done") & (F.col("role") == "tool"), F.col("capped")).otherwise(F.col("content")).alias("content"), "arguments")


def chunk_totals(made: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored_large) -> DataFrame:
    """Counts by label and the spread of token counts: sorted[floor(n * q)]."""
    from tracewright.functions.stats import floor_percentiles

    made = keep(made.select("label", "n_tokens"))
    n = lambda label: F.count_if(F.col("label") == label).alias(label)
    counts = made.agg(n("positive"), n("negative"), n("cold_start"), F.min("n_tokens").alias("min"))
    spread = floor_percentiles(made.withColumn("one", F.lit(1)), ["one"], "n_tokens", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}).select("p25", "p50", "p75", "p95", "max")
    return counts.join(F.broadcast(spread))  # one row each


def unknown_tools(messages: DataFrame, known: list[str]) -> DataFrame:
    """Per session with tool messages the tool names that are not ``known``; null where there are none."""
    tools = messages.where((F.col("role") == "tool") | F.col("tool").isNotNull())
    names = tools.groupBy("session_id").agg(F.array_sort(F.collect_set(F.when(~F.col("tool").isin(known), F.col("tool")))).alias("names"))
    return names.select("session_id", F.when(F.size("names") > 0, F.col("names")).alias("unknown"))


def review(steps: DataFrame, checkpoints: DataFrame, expires: DataFrame, most: int = 300) -> DataFrame:
    """A session's steps for human review: (session_id, idx, entry, fires).

    ``entry``: number, role or tool, an EXPIRE badge, then text (300 characters), command (200) and output (``most``; 0 leaves it out), with what is left out
    counted, wrapped at 110. ``fires``: a banner with finding, evidence and next direction for each checkpoint after the step; null without.
    """
    over = lambda c, n, what: F.concat(F.left(c, F.lit(n)), F.when(F.length(c) > n, F.format_string(f"  (…%d more{what})", F.length(c) - n)).otherwise(""))
    text, cmd, output, tool = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "cmd", "output", "tool_name"))
    badge = F.when(F.col("gone"), F.format_string("  ◀── EXPIRE (step %d)", "idx")).otherwise("")
    said = lambda who: F.concat(F.format_string(f"[%3d] {who} TEXT", "idx"), badge, F.lit("\n    "), wrapped(over(text, 300, "")))
    call = F.concat(F.format_string("[%3d] TOOL  ", "idx"), tool, badge, F.lit("\n    cmd: "), wrapped(over(cmd, 200, "")))
    call = F.concat(call, F.when(output != "", F.concat(F.lit("\n    out: "), wrapped(over(output, most, " chars")))).otherwise("")) if most > 0 else call
    entry = F.when(F.col("role") == "user_text", said("USER")).when(F.col("role") == "assistant_text", said("ASST")).otherwise(call)
    head = F.format_string("━━━━━━━━━━  CHECKPOINT after step %d  [%s]  ━━━━━━━━━━", "after_step", F.coalesce("progress_type", F.lit("?")))
    field = lambda name, c: F.concat(F.lit(f"  {name}:".ljust(13)), wrapped(F.col(c), indent=" " * 13), F.lit("\n"))
    banner = F.concat(F.lit("\n"), head, F.lit("\n"), field("finding", "finding"), field("evidence", "evidence"), field("next", "next_direction"), F.repeat(F.lit("━"), F.length(head)), F.lit("\n"))
    marks = checkpoints.select("session_id", F.col("after_step").alias("idx"), banner.alias("banner")).groupBy("session_id", "idx").agg(F.array_join(F.array_sort(F.collect_list("banner")), "").alias("fires"))
    gone = expires.select("session_id", F.col("expire").alias("idx"), F.lit(True).alias("gone")).distinct()
    rows = steps.join(marks, ["session_id", "idx"], "left").join(gone, ["session_id", "idx"], "left")
    return rows.select("session_id", "idx", entry.alias("entry"), "fires")
