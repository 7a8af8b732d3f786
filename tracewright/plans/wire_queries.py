"""Queries over captured bodies, frames, replies, prompts and resume, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import normalize, prompts, runs, state
from tracewright.plans import views as V
from tracewright.plans.catalog import query
from tracewright.plans.registry import ST1, _judge_input
from tracewright.plans.trace_queries import R, _chat
from tracewright.sources import readers, wire, writers

Q = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _captured(s, d):
    """What a proxy captures: most requests carry messages, some go elsewhere, some bodies are broken."""
    made = wire.bodies(V.requests(s, d))
    kind = F.col("req") % 7
    body = F.when(kind == 3, F.left("body", F.lit(40))).otherwise(F.col("body"))
    return made.select("req", F.when(kind == 1, "GET").otherwise("POST").alias("method"), F.when(kind == 2, "/v1/models").when(kind == 4, "/v1/messages?beta=true").otherwise("/v1/messages").alias("url"), body.alias("body"))


query("src10_captured_messages", f"with {R} select req, idx, role, content from messages where req % 7 not in (1, 2, 3)")(lambda s, d: wire.messages(wire.message_requests(_captured(s, d))))
query(
    "snk6_forwarded_bodies",
    f"""with {R} select req, '{{"messages":[' || string_agg('{{"role":"' || role || '","content":' || case when starts_with(content, '[') then content else to_json(content)::varchar end || '}}', ',' order by idx) || ']}}' as body from messages group by req""",
)(lambda s, d: wire.bodies(V.requests(s, d)))


def _lines(s, d):
    e = V.load(s, d, "events").select("event_id", "props")
    n, at = F.col("event_id").cast("string"), F.col("event_id") % 6
    call = Q(' {"jsonrpc":"2.0","id":', n, ',"method":"tools/call","params":', F.replace("props", F.lit(" "), F.lit("")), "} ")
    line = F.when(at == 0, call).when(at == 1, F.left(call, F.lit(30))).when(at == 2, "   ").when(at == 3, '{"jsonrpc":"2.0","method":"notifications/initialized"}').when(at == 4, "[1, 2]").otherwise(Q('{"id":"x', n, '","method":"ping"}'))
    return e.select("event_id", line.alias("value"))


query(
    "src11_frames",
    """select event_id, case event_id % 6 when 0 then event_id::varchar when 5 then 'x' || event_id end as id, case event_id % 6 when 0 then 'tools/call' when 3 then 'notifications/initialized' else 'ping' end as method,
    case when event_id % 6 = 0 then replace(props, ' ', '') end as params from events where event_id % 6 in (0, 3, 5)""",
)(lambda s, d: wire.frames(_lines(s, d)))


def _usage(s, d):
    """Event streams, plain bodies and broken ones; long texts stand before the numbers, some counts are no whole numbers."""
    e = V.load(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    n = F.col("event_id").cast("string")
    at, nums = F.col("event_id") % 4, Q('{"input_tokens":', F.col("k"), ',"output_tokens":', F.when(F.col("event_id") % 5 == 0, Q(n, ".5")).when(F.col("event_id") % 5 == 1, '"x"').otherwise(n), "}")
    body = F.when(at == 0, Q("event: message_start\n", 'data: {"type":"message_start","message":{"usage":', nums, "}}\n\n", 'data: {"usage":{"output_tokens":1}}\n')).when(at == 1, Q('{"content":"', F.repeat(F.lit("x"), 40000), '","usage":', nums, "}")).when(at == 2, Q("data: {", nums)).otherwise("")
    return e.select("event_id", text.extract_usage(body).alias("u")).select("event_id", "u.*")


query("src12_usage", "with e as (select event_id, json_extract_string(props, '$.k')::bigint as k, event_id % 4 < 2 as ok from events) select event_id, case when ok then k end as input_tokens, null::bigint as cache_creation, null::bigint as cache_read, case when ok and event_id % 5 <> 1 then event_id end as output_tokens from e")(_usage)


def _replies(s, d):
    c = V.load(s, d, "conversations")
    return c.select("conv_id", "turn", "role", F.col("text").alias("t"))


SAID = "r as (select conv_id, turn, role, text as t from conversations)"
TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
query(
    "nrm14_tool_call",
    f"with {SAID} select conv_id, turn, case when turn % 3 <> 2 then case when turn % 2 = 0 then 'mcp__bookmarks__checkpoint_progress' else 'Bash' end end as name, case when turn % 3 <> 2 then {TRIM.format('t')} end as command, case when turn % 3 <> 2 then 1 end as n_arguments, turn % 3 <> 2 and turn % 2 = 0 as is_checkpoint from r",
)(
    lambda s, d: _replies(s, d)
    .select("conv_id", "turn", text.parse_tool_call(F.when(F.col("turn") % 3 != 2, Q("thinking <tool_call><function=no-name></function></tool_call> <tool_call>\n<function=", F.when(F.col("turn") % 2 == 0, "mcp__bookmarks__checkpoint_progress").otherwise("Bash"), ">\n<parameter=a-b>no</parameter><parameter=command>old</parameter><parameter=command>\n", F.col("t"), "\n</parameter></function>\n</tool_call> tail")).otherwise(F.col("t"))).alias("c"))
    .select("conv_id", "turn", "c.name", F.try_element_at("c.arguments", F.lit("command")).alias("command"), F.nullif(F.size("c.arguments"), F.lit(-1)).alias("n_arguments"), text.is_checkpoint(F.col("c.name")).alias("is_checkpoint"))
)
query(
    "nrm16_verdicts",
    f"with {SAID} select conv_id, turn, case turn % 4 when 0 then 'YES' when 1 then 'NO' end as should, case when turn % 5 <> 0 then case when {TRIM.format('t')} = '' then 'SUMMARY:' else {TRIM.format("string_split(" + TRIM.format('t') + ", chr(10))[1]")} end end as reason, {TRIM.format("t || chr(10) || 'end'")} as summary from r",
)(
    lambda s, d: _replies(s, d).select("conv_id", "turn", text.parse_verdict(Q("should_checkpoint: ", F.when(F.col("turn") % 4 == 0, "yes").when(F.col("turn") % 4 == 1, "NO").otherwise("NOTHING"), F.when(F.col("turn") % 5 == 0, "\nReason: ").otherwise("\nREASON: \n "), F.col("t"), "\nSUMMARY:\n", F.col("t"), "\nend \n")).alias("v"))
    .select("conv_id", "turn", "v.*")
)
query("flt14_passed_headers", "select event_id, case when event_id % 3 = 0 then 'k' || event_id end as \"key\", 3 + (case when event_id % 3 = 0 then 1 else 0 end) + (case when event_id % 2 = 0 then 1 else 0 end) as n from events")(
    lambda s, d: V.load(s, d, "events")
    .select("event_id", text.passed_headers(F.map_filter(F.create_map(F.lit("X-Api-Key"), F.when(F.col("event_id") % 3 == 0, Q("k", F.col("event_id").cast("string"))), F.lit("cookie"), F.lit("c"), F.lit("User-Agent"), F.when(F.col("event_id") % 2 == 0, "ua")), lambda k, v: v.isNotNull())).alias("h"))
    .select("event_id", F.try_element_at("h", F.lit("X-Api-Key")).alias("key"), F.size("h").alias("n"))
)
query(
    "st9_checkpoint_ack",
    "select event_id, case when event_id % 2 = 0 then 'Milestone' else 'Approach eliminated' end || ': ' || event_type || '. Evidence: ' || props || '. Next: go. Prior exploration will be condensed for focus; the full history remains accessible via bookmark_recall.' as ack from events",
)(
    lambda s, d: V.load(s, d, "events").select("event_id", text.checkpoint_ack(F.when(F.col("event_id") % 2 == 0, "milestone_achieved").otherwise("approach_eliminated"), F.col("event_type"), F.col("props"), F.lit("go")).alias("ack"))
)
query("ag22_judge_state", f"with o as ({ST1}) select key, arg_max(cooldown, seq) as cooldown_remaining, count(*) filter (outcome = 'fired') as rewind_count from o group by key")(lambda s, d: state.snapshot(state.judge(_judge_input(s, d))))


def _patches(s, d):
    """Diffs over four files, with and without the expected word, which does not bear on the verdict."""
    p = V.load(s, d, "part")
    k = F.col("p_partkey")
    diff = F.when(k % 5 == 0, "").otherwise(Q("diff --git a/f", (k % 4).cast("string"), ".c b/f", (k % 4).cast("string"), ".c\n+++ b/f", (k % 4).cast("string"), ".c\n+", F.when(k % 3 == 0, "guard").otherwise("none")))
    h = p.select((k % 6).cast("string").alias("task")).distinct().where("task <> '5'").select("task", F.array(F.lit("f1.c"), F.lit("f2.c")).alias("files"), F.array(F.lit("guard")).alias("keywords"))
    return runs.patch_verdict(p.select((k % 6).cast("string").alias("task"), k.alias("run"), diff.alias("diff")), h).select("task", "run", "verdict")


query("flt12_patch_verdicts", "select (p_partkey % 6)::varchar as task, p_partkey as run, case when p_partkey % 6 = 5 then 'no_heuristic' when p_partkey % 5 = 0 then 'no_patch' when p_partkey % 4 in (1, 2) then 'ok' else 'wrong_area' end as verdict from part")(_patches)


def _sessions(s, d):
    return V.load(s, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n_steps"))


DONE = "done as (select distinct conv_id as session_id from conversations where conv_id % 3 = 0)"
query("sl3_up_to_target", f"with {DONE}, s as (select conv_id as session_id, count(*) as n_steps from conversations group by 1) select * from s where session_id not in (select session_id from done) order by session_id limit 5")(
    lambda s, d: readers.up_to(_sessions(s, d), _sessions(s, d).where("session_id % 3 = 0"), _sessions(s, d).where("session_id % 3 = 0").count() + 5, ["session_id"])
)
query("sl5_seeded_choice", "with s as (select conv_id as session_id, count(*) as n_steps from conversations group by 1), f as (select * from s order by n_steps, session_id limit 20) select * from f order by md5(session_id || ':42'), session_id limit 1")(lambda s, d: readers.seeded_choice(_sessions(s, d), "n_steps"))
query("sl8_nth_session", "with s as (select conv_id as session_id, count(*) as n_steps from conversations group by 1) select * from s order by session_id limit 1 offset 7")(lambda s, d: readers.nth(_sessions(s, d), ["session_id"], 7))
query(
    "snk1_event_days",
    "select event_id, date_trunc('day', ts)::date as date from events",
)(lambda s, d: writers.with_day(V.load(s, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))).select("event_id", "date"))

SHOWN = """t as (select session_id, idx, role, tool_name, cmd, output, text, coalesce(nullif(input_file, ''), cmd) as target from trace),
  call as (select *, case when tool_name = 'Bash' then '{"command":' || to_json(cmd) || '}' when tool_name = 'Read' then '{"file_path":' || to_json(target) || '}' when tool_name in ('Write', 'Edit', 'MultiEdit') then '{"file_path":' || to_json(target) || ',"content":"[elided]"}' when tool_name in ('Grep', 'Glob') then '{"pattern":' || to_json(cmd) || '}' else '{"input":' || to_json(cmd) || '}' end as args from t),
  turn as (select session_id, idx, case role when 'user_text' then '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) when 'assistant_text' then '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' || chr(10)
    else '<|im_start|>assistant' || chr(10) || '<tool_call>' || chr(10) || '{"name": "' || tool_name || '", "arguments": ' || args || '}' || chr(10) || '</tool_call><|im_end|>' || chr(10) || '<|im_start|>tool' || chr(10) || output || '<|im_end|>' || chr(10) end as shown from call)"""
query("rn6_rendered_sessions", f"with {V.TRACE}, {SHOWN} select session_id, string_agg(shown, '' order by idx) as rendered from turn group by session_id")(lambda s, d: prompts.rendered(_chat(s, d), ["session_id"]))
query(
    "rn6_prompts",
    f"""with {V.TRACE}, {SHOWN}, l as (select session_id, max(idx) as last from trace group by 1) select session_id, coalesce(string_agg(shown, '' order by idx) filter (idx < last), '') || '<|im_start|>assistant' || chr(10) as prompt,
    case when starts_with(any_value(shown) filter (idx = last), '<|im_start|>assistant') then substr(any_value(shown) filter (idx = last), 23) else any_value(shown) filter (idx = last) end as completion from turn join l using (session_id) group by session_id""",
)(lambda s, d: prompts.prompt_and_completion(_last_step(_chat(s, d)), ["session_id"]))


def _last_step(messages):
    last = messages.groupBy("session_id").agg(F.max("step").alias("last"))
    return messages.join(last, "session_id").withColumn("part", F.when(F.col("step") == F.col("last"), "completion").otherwise("prompt"))


def _inputs(s, d):
    """Inputs of tool uses, with empty and missing keys by the event's number."""
    n, t = F.col("event_id"), F.col("props")
    given = lambda c, key, value: F.when(c, F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,string>"))
    parts = [given(n % 2 == 0, "command", F.when(n % 4 == 0, "").otherwise(t)), given(n % 3 == 0, "file_path", F.lit("f")), given(n % 5 == 0, "pattern", F.lit("p")), given(n % 7 < 3, "description", F.when(n % 7 == 1, "").otherwise(F.repeat(t, 20))), given(n % 11 < 6, "prompt", F.concat(F.lit("say "), t))]
    return V.load(s, d, "events").select("event_id", F.map_concat(*parts).alias("i"))


query(
    "nrm6_commands",
    """with e as (select event_id, event_id as n, props as t from events), f as (select *, case when n % 2 = 0 then case when n % 4 = 0 then '' else t end when n % 3 = 0 then 'f' when n % 5 = 0 then 'p' else '' end as first from e)
    select event_id, case when first <> '' then first else left(case when n % 7 < 3 then case when n % 7 = 1 then '' else repeat(t, 20) end when n % 11 < 6 then 'say ' || t else '' end, 200) end as cmd from f""",
)(lambda s, d: _inputs(s, d).select("event_id", normalize.command(F.col("i")).alias("cmd")))
