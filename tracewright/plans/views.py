"""Engine inputs derived from the driver's tables, in Spark and as SQL prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool steps: one session per user, ordered by time."""
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Grep").when(F.col("event_type") == "purchase", "Edit").otherwise("Bash")
    return e.select(
        F.col("user_id").alias("session_id"),
        (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("idx"),
        tool.alias("tool_name"),
        (F.col("event_type") == "error").alias("has_error"),
        k.alias("k"),
        (k % 5).alias("sig"),
        (k % 7).alias("file"),
        "value",
    )


STEPS = """steps as (select user_id as session_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as idx,
  case event_type when 'view' then 'Read' when 'click' then 'Grep' when 'purchase' then 'Edit' else 'Bash' end as tool_name,
  event_type = 'error' as has_error, json_extract_string(props, '$.k')::bigint as k, json_extract_string(props, '$.k')::bigint % 5 as sig,
  json_extract_string(props, '$.k')::bigint % 7 as file, value from events)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxy events: one run per user; signups stand for compactions, the rest for cache statistics."""
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("user_id").alias("run"),
        F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("line"),
        F.when(F.col("event_type") == "signup", "compact").otherwise("cache_stats").alias("type"),
        k.alias("input_tokens"),
        F.when(k % 10 != 0, k * 3).alias("cache_creation"),
        (k * 7).alias("cache_read"),
        (k % 13).alias("output_tokens"),
        F.when(k % 4 != 0, k).alias("saved"),
        "ts",
    )


TELEMETRY = """telemetry as (select user_id as run, row_number() over (partition by user_id order by ts, event_id)::bigint as line,
  case when event_type = 'signup' then 'compact' else 'cache_stats' end as type, k as input_tokens, case when k % 10 <> 0 then k * 3 end as cache_creation,
  k * 7 as cache_read, k % 13 as output_tokens, case when k % 4 <> 0 then k end as saved, ts from (select *, json_extract_string(props, '$.k')::bigint as k from events))"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: one per conversation; every sixth assistant turn is a checkpoint."""
    c = load(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("req"), F.col("turn").alias("idx"), "role", "text", ((F.col("role") == "assistant") & (F.col("turn") % 6 == 5)).alias("anchor"))


MESSAGES = "messages as (select conv_id as req, turn as idx, role, text, role = 'assistant' and turn % 6 = 5 as anchor from conversations)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark runs: off and on by the order's number."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("num"), F.when(F.col("o_orderkey") % 2 == 0, "off").otherwise("on").alias("proxy"), F.col("o_orderpriority").alias("task"), F.col("o_totalprice").alias("dur"),
        (F.col("o_orderkey") % 5).alias("exit_code"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 2).alias("verify_exit"), (F.col("o_custkey") % 7).alias("checkpoints"),
    )


RUNS = """runs as (select o_orderkey as num, case when o_orderkey % 2 = 0 then 'off' else 'on' end as proxy, o_orderpriority as task, o_totalprice as dur,
  o_orderkey % 5 as exit_code, case when o_orderkey % 3 <> 0 then o_orderkey % 2 end as verify_exit, o_custkey % 7 as checkpoints from orders)"""


#: What the commands and outputs of the traces are taken from: inputs, not rules of the engine.
COMMANDS = ["make test", "git revert HEAD", "ls -la src lib", "git checkout -- a.py", "python -m pytest tests -x", "GIT STASH", "undo it", "make  test", "", "echo undone", "make test"]
OUTPUTS = ["ok", "12 passed in 3s", "x\nError: cannot find module y\nat line 3", "panic now", "assertion hit", "unresolved symbol main", "cannot open file", "  \nmake: *** No such file", "", "build succeeded", "Traceback (most recent call last):\nValueError: bad", "finished in 3s", "saved to /tmp/x.txt", "compiled"]


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of whole sessions, with commands, outputs and texts: one session per user, ordered by time."""
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    idx = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))
    kind, k = F.col("event_type"), F.col("k")
    role = F.when((F.col("idx") == 0) | ((kind == "signup") & (k % 4 == 3)), "user_text").when((kind == "signup") & (k % 4 == 0), "assistant_text").otherwise("tool")
    tool = F.when(kind == "view", pick(["Read", "Glob", "read_file"], k)).when(kind == "click", "Grep").when(kind == "purchase", pick(["Edit", "Write", "MultiEdit"], k)).when((kind == "signup") & (k % 4 == 1), "mcp__bookmarks__checkpoint_progress").otherwise("Bash")
    rows = e.withColumn("idx", idx).withColumn("role", role).withColumn("tool_name", F.when(F.col("role") == "tool", tool).otherwise(""))
    file = F.concat(F.lit("src/f"), (k % 7).cast("string"), F.lit(".py"))
    has_file = F.col("tool_name").isin("Read", "read_file", "Edit", "Write", "MultiEdit")
    cmd = F.when(F.col("tool_name") == "Bash", pick(COMMANDS, k)).when(F.col("tool_name").isin("Grep", "Glob"), F.concat(F.lit("pattern_"), (k % 9).cast("string"))).when(has_file, file).otherwise("")
    out = pick(OUTPUTS, k + F.col("idx"))
    is_tool = F.col("role") == "tool"
    return rows.select(
        F.col("user_id").alias("session_id"), "idx", "role", "tool_name", cmd.alias("cmd"), F.when(is_tool, F.when(k % 10 == 0, F.repeat(F.concat(out, F.lit("\n")), 60)).otherwise(out)).otherwise("").alias("output"),
        F.when(has_file & (k % 7 < 6), file).alias("input_file"), F.when(~is_tool, F.concat(F.lit("say "), k.cast("string"), F.repeat(F.lit(" word"), (k * 2).cast("int")))).otherwise("").alias("text"), "k",
    )


_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"
TRACE = f"""tr0 as (select user_id as session_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as idx, event_type, json_extract_string(props, '$.k')::bigint as k from events),
  tr1 as (select *, case when idx = 0 or event_type = 'signup' and k % 4 = 3 then 'user_text' when event_type = 'signup' and k % 4 = 0 then 'assistant_text' else 'tool' end as role from tr0),
  tr2 as (select *, case when role <> 'tool' then '' when event_type = 'view' then ['Read', 'Glob', 'read_file'][1 + k % 3] when event_type = 'click' then 'Grep' when event_type = 'purchase' then ['Edit', 'Write', 'MultiEdit'][1 + k % 3] when event_type = 'signup' and k % 4 = 1 then 'mcp__bookmarks__checkpoint_progress' else 'Bash' end as tool_name,
    {_list(OUTPUTS)}[1 + (k + idx) % {len(OUTPUTS)}] as o from tr1),
  trace as (select session_id, idx, role, tool_name, case when tool_name = 'Bash' then {_list(COMMANDS)}[1 + k % {len(COMMANDS)}] when tool_name in ('Grep', 'Glob') then 'pattern_' || (k % 9) when tool_name in ('Read', 'read_file', 'Edit', 'Write', 'MultiEdit') then 'src/f' || (k % 7) || '.py' else '' end as cmd,
    case when role <> 'tool' then '' when k % 10 = 0 then repeat(o || chr(10), 60) else o end as output, case when tool_name in ('Read', 'read_file', 'Edit', 'Write', 'MultiEdit') and k % 7 < 6 then 'src/f' || (k % 7) || '.py' end as input_file,
    case when role <> 'tool' then 'say ' || k || repeat(' word', (k * 2)::int) else '' end as text, k from tr2)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the traces as clients send them: strings, or JSON lists of blocks with uses, results and checkpoints."""
    t = trace(spark, sf_dir)
    tool = F.col("role") == "tool"
    rows = t.select("*", F.explode(F.when(tool, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("part"))
    q = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    k, step = F.col("k").cast("string"), F.col("idx").cast("string")
    kind = F.when(F.col("k") % 3 == 0, "approach_eliminated").otherwise("milestone_achieved")
    said = F.when(F.col("k") % 8 == 1, q('"summary":"legacy ', k, '"')).otherwise(q('"progress_type":"', kind, '","finding":"f', k, '","evidence":"', F.when(F.col("k") % 5 == 0, "").otherwise(q("e", k)), '","next_direction":"n', k, '"'))
    given = F.when(F.col("tool_name") == "Bash", q('"command":"', F.col("cmd"), '"')).when(F.col("tool_name").isin("Grep", "Glob"), q('"pattern":"', F.col("cmd"), '"')).when(F.col("tool_name").contains("checkpoint"), said).otherwise(q('"file_path":"', F.col("cmd"), '"'))
    use = q('[{"type":"tool_use","id":"call_', step, '","name":"', F.col("tool_name"), '","input":{', given, "}}]")
    out = q('"', F.replace("output", F.lit("\n"), F.lit("\\n")), '"')
    result = q('[{"type":"tool_result","tool_use_id":"call_', step, '","content":', F.when(F.col("k") % 3 == 0, q('[{"type":"text","text":', out, "}]")).otherwise(out), F.when(F.col("k") % 4 < 2, ',"is_error":false,"meta":{"content":[1,"a,b}"]}').otherwise(""), "}", F.when(F.col("k") % 5 == 0, ',{"type":"text","text":"note"}').otherwise(""), "]")
    role = F.when((F.col("role") == "user_text") | (F.col("part") == 1), "user").otherwise("assistant")
    idx = (F.row_number().over(W.partitionBy("session_id").orderBy("idx", "part")) - 1).cast("bigint")
    return rows.select(F.col("session_id").alias("req"), idx.alias("idx"), role.alias("role"), F.when(~tool, F.col("text")).when(F.col("part") == 0, use).otherwise(result).alias("content"))


REQUESTS = TRACE + """, rq0 as (select *, unnest(case when role = 'tool' then [0, 1] else [0] end) as part from trace),
  messages as (select session_id as req, (row_number() over (partition by session_id order by idx, part) - 1)::bigint as idx, case when role = 'user_text' or part = 1 then 'user' else 'assistant' end as role,
    case when role <> 'tool' then text when part = 0 then '[{"type":"tool_use","id":"call_' || idx || '","name":"' || tool_name || '","input":{' ||
      case when tool_name = 'Bash' then '"command":"' || cmd || '"' when tool_name in ('Grep', 'Glob') then '"pattern":"' || cmd || '"' when tool_name like '%checkpoint%' then
        case when k % 8 = 1 then '"summary":"legacy ' || k || '"' else '"progress_type":"' || case when k % 3 = 0 then 'approach_eliminated' else 'milestone_achieved' end || '","finding":"f' || k || '","evidence":"' || case when k % 5 = 0 then '' else 'e' || k end || '","next_direction":"n' || k || '"' end
      else '"file_path":"' || cmd || '"' end || '}}]'
    else '[{"type":"tool_result","tool_use_id":"call_' || idx || '","content":' || case when k % 3 = 0 then '[{"type":"text","text":"' || replace(output, chr(10), '\\n') || '"}]' else '"' || replace(output, chr(10), '\\n') || '"' end || case when k % 4 < 2 then ',"is_error":false,"meta":{"content":[1,"a,b}"]}' else '' end || '}' || case when k % 5 = 0 then ',{"type":"text","text":"note"}' else '' end || ']' end as content from rq0)"""


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark runs with conditions, costs and verdicts, one per order."""
    from tracewright.operators.runs import condition

    o = load(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rewind = F.when(k % 3 == 0, "on").when(k % 3 == 1, "off")
    hint = F.when(c % 3 == 0, "on").when(c % 3 == 1, "off")
    verdict = F.when(c % 4 == 0, "ok").when(c % 4 == 1, "wrong_area").when(c % 4 == 2, "no_patch")
    return o.select(F.col("o_orderpriority").alias("task"), condition(rewind, hint).alias("condition"), F.when(k % 7 != 0, F.col("o_totalprice") / 1000).alias("cost"), F.when(k % 11 != 0, k * 10).alias("dur_ms"), (c % 50).alias("turns"), (c % 3).alias("checkpoints"), (k % 1000).alias("bytes_saved"), verdict.alias("verdict"), k.alias("run"))


BENCH_RUNS = """bench as (select o_orderpriority as task, case when o_orderkey % 3 = 0 and o_custkey % 3 = 0 then 'rewind+hint' when o_orderkey % 3 = 0 and o_custkey % 3 = 1 then 'rewind-only' when o_orderkey % 3 <> 0 then 'baseline' else 'rewind=on/hint=?' end as condition, case when o_orderkey % 7 <> 0 then o_totalprice / 1000 end as cost, case when o_orderkey % 11 <> 0 then o_orderkey * 10 end as dur_ms,
  o_custkey % 50 as turns, o_custkey % 3 as checkpoints, o_orderkey % 1000 as bytes_saved, case o_custkey % 4 when 0 then 'ok' when 1 then 'wrong_area' when 2 then 'no_patch' end as verdict, o_orderkey as run from orders)"""
