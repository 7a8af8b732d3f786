"""Queries that write what the tables hold as files of the protocol's shapes and read them back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewright.plans import views as V
from tracewright.plans.catalog import query
from tracewright.sources import readers, writers
from tracewright.sources.shared import shared_folder


def _folder(s):
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}"


def _events(s, d):
    """Event files by day, as the sink writes them, and files of broken and blank lines beside."""
    path = _folder(s)
    e = V.load(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    writers.append_events(e.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("sessionId"), k.alias("input_tokens"), F.lit("x").alias("unknown")), path)
    e.select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"type":"t","timestamp":'), F.col("event_id").cast("string"))).otherwise("").alias("value")).write.text(f"{path}/date=broken")
    return path


EVENTS = "e as (select (epoch_us(ts) // 1000)::bigint as timestamp, event_type as type, user_id::varchar as \"sessionId\", json_extract_string(props, '$.k')::bigint as input_tokens from events)"
query("src3_event_files", f"with {EVENTS} select type, \"sessionId\", timestamp, input_tokens from e")(lambda s, d: readers.telemetry(s, f"{_events(s, d)}/*").select("type", "sessionId", "timestamp", "input_tokens"))
query("src3_malformed_lines", "select raw, count(*) as n from (select '{\"type\":\"t\",\"timestamp\":' || event_id as raw from events where event_id % 2 = 0) group by raw")(lambda s, d: readers.malformed(s, f"{_events(s, d)}/*").groupBy("raw").agg(F.count(F.lit(1)).alias("n")))


def _sessions(s, d):
    """Whole sessions, one a line, with legacy labels for some."""
    path = _folder(s)
    step = F.struct("idx", "role", "tool_name", "cmd", "output", "input_file", "text")
    rows = V.trace(s, d).groupBy("session_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    third = F.when(F.col("session_id") % 3 == 0, F.array(F.lit(2).cast("bigint"), F.lit(1).cast("bigint")))
    readers.write_sessions(rows.select(F.col("session_id").cast("string").alias("session_id"), F.lit("made").alias("source"), "steps", third.alias("expire_step_ids")), path)
    return readers.sessions(s, path)


query("src2_session_files", f"with {V.TRACE} select session_id::varchar as session_id, idx, role, tool_name, cmd, output, input_file, text from trace")(lambda s, d: readers.explode_steps(_sessions(s, d)))
query("src2_legacy_labels", "with u as (select distinct user_id from events) select user_id::varchar as session_id, unnest(case when user_id % 3 = 0 then [1, 2]::bigint[] else []::bigint[] end) as expire from u")(
    lambda s, d: _sessions(s, d).select("session_id", F.inline("events")).select("session_id", "expire")
)


def _transcripts(s, d):
    """A transcript per customer in folders as runs have them, its result lines among others, some broken."""
    root = _folder(s)
    o = V.load(s, d, "orders")
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 0, F.concat(F.lit('{"type":"result","num_turns":'), k.cast("string"), F.lit(',"is_error":'), F.when(k % 8 == 0, "true").otherwise("false"), F.lit(',"usage":{"input_tokens":'), (k * 2).cast("string"), F.lit("}}"))).when(k % 4 == 1, F.concat(F.lit('{"type":"result",'), k.cast("string"))).otherwise(F.concat(F.lit('{"type":"x","n":'), k.cast("string"), F.lit("}")))
    rows = o.select(line.alias("value"), F.concat(F.lit("run_"), (F.col("o_custkey") % 7).cast("string")).alias("run"), k)
    for n in range(7):  # a folder per run; its one file is read by splits
        part = rows.where(F.col("run") == f"run_{n}")
        part.repartitionByRange(1, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(f"{root}/run_{n}/t/transcript_1.jsonl")
    return root


query(
    "src7_last_results",
    "with r as (select 'run_' || (o_custkey % 7) as run, o_orderkey as k from orders where o_orderkey % 4 = 0) select run, max(k) as num_turns, max(k) % 8 = 0 as is_error, 2 * max(k) as input_tokens from r where run in ('run_1', 'run_4') group by run",
)(lambda s, d: readers.last_result(s, _transcripts(s, d), runs=["run_1", "run_4"]).select("run", "num_turns", "is_error", F.col("usage.input_tokens").alias("input_tokens")))
