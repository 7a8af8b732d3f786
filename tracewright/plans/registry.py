"""All queries of the engine with their SQL. Names start with the operator inventory's IDs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import stats, text
from tracewright.operators import normalize, render, runs, state
from tracewright.plans import trace_queries
from tracewright.plans import views as V
from tracewright.plans.catalog import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "trace_queries"]

MSG = V.MESSAGES
query("ag3_floor_percentiles", f"with {MSG}, r as (select role, length(text)::bigint as n, row_number() over (partition by role order by length(text)) - 1 as rn, count(*) over (partition by role) as c from messages) select role, count(*) as count, sum(n)::bigint as total, max(n) as max, max(case when rn = floor(c * 0.5) then n end) as p50, max(case when rn = floor(c * 0.9) then n end) as p90 from r group by role")(
    lambda s, d: stats.floor_percentiles(V.messages(s, d).select("role", F.length("text").cast("bigint").alias("n")), ["role"], "n", {"p50": 0.5, "p90": 0.9})
)
query("key_session_text", f"with {MSG}, u as (select req, list(trim(regexp_replace(text, '(?is)<system-reminder>.*?</system-reminder>', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) order by idx) as t from messages where role = 'user' group by req) select r.req, coalesce(left(list_filter(t, lambda x: x <> '')[1], 200), '__default__') as key from (select distinct req from messages) r left join u using (req)")(
    lambda s, d: V.messages(s, d).groupBy("req").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("idx", "text")))).alias("a")).select("req", text.session_key(F.transform("a", lambda x: x["text"])).alias("key"))
)
query("key_session_hash", f"with {MSG} select req, case when arg_min(role, idx) <> 'user' then 'nongoal' else left(sha1(arg_min(text, idx)), 16) end as key from messages group by req")(
    lambda s, d: V.messages(s, d).groupBy("req").agg(F.min_by(F.struct("role", "text"), "idx").alias("f")).select("req", F.when(F.col("f.role") != "user", "nongoal").otherwise(F.left(F.sha1("f.text"), F.lit(16))).alias("key"))
)
query("rn2_transcript", f"with {MSG} select req, string_agg(case role when 'user' then 'USER: ' when 'assistant' then 'ASST: ' else role || ': ' end || left(text, 500), chr(10) order by idx) as transcript from messages group by req")(
    lambda s, d: render.transcript(V.messages(s, d).select("req", "idx", F.concat(F.when(F.col("role") == "user", "USER: ").when(F.col("role") == "assistant", "ASST: ").otherwise(F.concat("role", F.lit(": "))), F.left("text", F.lit(500))).alias("line")), "req", "idx", "line")
)


R = V.RUNS
AP = "ap as (select * from (select task, num as off_num, lead(num) over o as on_num, dur as off_dur, lead(dur) over o as on_dur, proxy, lead(proxy) over o as np from runs window o as (partition by task order by num)) where proxy = 'off' and np = 'on' and on_num = off_num + 1)"
query("jn6_adjacent_pairs", f"with {R}, {AP} select task, off_num, on_num, off_dur, on_dur from ap")(lambda s, d: runs.adjacent_pairs(V.runs(s, d)).select("task", "off_num", "on_num", "off_dur", "on_dur"))
query("jn7_positional_pairs", f"with {R}, a as (select proxy, num, dur, row_number() over (partition by proxy order by num::varchar) as k from runs) select x.k, x.num as off_num, x.dur as off_dur, y.num as on_num, y.dur as on_dur from a x join a y on x.k = y.k and x.proxy = 'off' and y.proxy = 'on'")(lambda s, d: runs.positional_pairs(V.runs(s, d)))
query("jn8_compare", f"with {R}, f as (select task, count(dur) filter (proxy = 'off') as n_off, median(dur) filter (proxy = 'off') as median_off, count(dur) filter (proxy = 'on') as n_on, median(dur) filter (proxy = 'on') as median_on from runs group by task) select task, n_off, round(median_off, 4) as median_off, n_on, round(median_on, 4) as median_on, round((median_on - median_off) * 100 / median_off, 4) as delta_pct from f")(
    lambda s, d: runs.compare(V.runs(s, d)).select("task", "n_off", F.round("median_off", 4).alias("median_off"), "n_on", F.round("median_on", 4).alias("median_on"), F.round("delta_pct", 4).alias("delta_pct"))
)
#: Typed from the published table, apart from the engine's own.
TC = "(select max_by(v, d) from (values (1, 12.71), (2, 4.3), (3, 3.18), (4, 2.78), (5, 2.57), (6, 2.45), (7, 2.36), (8, 2.31), (9, 2.26), (10, 2.23), (11, 2.2), (12, 2.18), (13, 2.16), (14, 2.14), (15, 2.13), (16, 2.12), (17, 2.11), (18, 2.1), (19, 2.09), (20, 2.09), (21, 2.08), (22, 2.07), (23, 2.07), (24, 2.06), (25, 2.06), (30, 2.04), (40, 2.02), (60, 2.0), (120, 1.98)) as c(d, v) where d <= n - 1)::double"
query("ag6_paired_stats", f"with {R}, {AP}, s as (select task, count(*) as n, avg(on_dur - off_dur) as m, stddev_samp(on_dur - off_dur) as sd from ap group by task having count(*) >= 2), t as (select *, m / (sd / sqrt(n)) as t, m / sd as d, {TC} as t_crit from s) select task, n, round(m, 3) as mean_delta, round(sd, 3) as sd, round(t, 5) as t, round(d, 5) as d, t_crit, abs(t) > t_crit as significant, case when abs(d) > 0.05 then greatest(ceil(pow(2.8 / abs(d), 2)), 1)::bigint end as n_for_power from t")(
    lambda s, d: stats.paired(runs.adjacent_pairs(V.runs(s, d)), ["task"], "off_dur", "on_dur").select("task", "n", F.round("mean_delta", 3).alias("mean_delta"), F.round("sd", 3).alias("sd"), F.round("t", 5).alias("t"), F.round("d", 5).alias("d"), "t_crit", "significant", "n_for_power")
)
query("ag8_pooled_change", f"with {R}, {AP} select count(*) as n, round(sum(off_dur), 2) as off_total, round(sum(on_dur), 2) as on_total, round((sum(on_dur) - sum(off_dur)) * 100 / greatest(sum(off_dur), 1), 6) as pct from ap")(
    lambda s, d: runs.adjacent_pairs(V.runs(s, d)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("off_dur"), 2).alias("off_total"), F.round(F.sum("on_dur"), 2).alias("on_total"), F.round((F.sum("on_dur") - F.sum("off_dur")) * 100 / F.greatest(F.sum("off_dur"), F.lit(1.0)), 6).alias("pct"))
)
query(
    "ag7_pass_counts",
    f"with {R}, q as (select *, lead(proxy) over w as np, lead(num) over w as nn, lead(exit_code) over w as ne, lead(verify_exit) over w as nv from runs window w as (partition by task order by num)) select task, count(*) as n, count(*) filter (exit_code = 0) as off_pass, count(*) filter (ne = 0) as on_pass, case when count(verify_exit) > 0 then count(*) filter (verify_exit = 0) end as off_verify_pass, case when count(verify_exit) > 0 then count(*) filter (nv = 0) end as on_verify_pass from q where proxy = 'off' and np = 'on' and nn = num + 1 group by task",
)(lambda s, d: runs.pass_counts(runs.adjacent_pairs(V.runs(s, d))))
MED = ", ".join(f"round(median({c}){f}, 4) as median_{n}{o}" for f, o in (("", ""), (" filter (verdict = 'ok')", "_ok")) for n, c in (("cost", "cost"), ("dur", "dur_ms"), ("turns", "turns"), ("saved", "bytes_saved")))
query("ag9_by_condition", f"with {V.BENCH_RUNS} select task, condition, count(*) as n, {MED}, round(avg(case when checkpoints > 0 then 1 else 0 end), 6) as checkpoint_rate, round(avg(case when verdict = 'ok' then 1 else 0 end), 6) as ok_rate, count(*) filter (verdict = 'ok') as n_ok, round(avg(case when checkpoints > 0 then 1 else 0 end) filter (verdict = 'ok'), 6) as checkpoint_rate_ok from bench group by task, condition")(
    lambda s, d: (lambda g: g.select(*[F.round(c, 4 if c.startswith("median") else 6).alias(c) if c.startswith(("median", "checkpoint", "ok")) else c for c in g.columns]))(runs.by_condition(V.bench_runs(s, d)))
)
query("ag16_rewind_totals", f"with {V.STEPS} select session_id as run, count(*) filter (tool_name = 'Edit') as rewinds, coalesce(sum(case when tool_name = 'Edit' and k % 5 <> 0 then k end), 0)::bigint as bytes_saved from steps group by 1")(
    lambda s, d: runs.rewind_totals(_rewinds(s, d))
)
query("jn14_task_rewinds", f"with {V.STEPS}, {V.BENCH_RUNS}, t as (select session_id as run, count(*) filter (tool_name = 'Edit') as rewinds, coalesce(sum(case when tool_name = 'Edit' and k % 5 <> 0 then k end), 0)::bigint as bytes_saved from steps group by 1) select bench.run, task, coalesce(rewinds, 0) as rewinds, coalesce(t.bytes_saved, 0) as bytes_saved from bench left join t on t.run = bench.run")(
    lambda s, d: runs.with_rewinds(V.bench_runs(s, d).select("run", "task"), runs.rewind_totals(_rewinds(s, d)))
)
query("ag17_task_metrics", "with s as (select o_orderpriority as task, o_totalprice as v, o_orderkey as k from orders) select task, metric, count(*) as n, round(median(value), 4) as median from (select task, 'duration_seconds' as metric, v::double as value from s union all select task, 'input_tokens', k from s where k % 3 <> 0 union all select task, 'total_cost_usd', v / 100 from s union all select task, 'num_turns', k % 40 from s) group by 1, 2")(
    lambda s, d: runs.task_metrics(V.load(s, d, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_totalprice").cast("string").alias("duration_seconds"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).otherwise("n/a").alias("input_tokens"), *[F.lit(None).cast("string").alias(c) for c in runs.METRICS[2:5]], (F.col("o_totalprice") / 100).alias("total_cost_usd"), (F.col("o_orderkey") % 40).alias("num_turns"))).withColumn("median", F.round("median", 4))
)
query("ag23_harness_totals", f"with {V.STEPS} select session_id as log, max(idx) + 1 as steps, count(*) filter (tool_name <> 'Edit') as n_tool_calls, count(*) filter (k % 3 = 0) as n_shadow_yes, count(*) filter (k % 9 = 0) as n_rewinds, sum(k)::bigint as total_input_tokens, round(sum(value), 4) as turn_seconds from steps group by 1")(
    lambda s, d: runs.harness_totals(V.steps(s, d).select(F.col("session_id").alias("log"), F.col("idx").alias("turn"), F.when(F.col("tool_name") != "Edit", F.struct(F.col("tool_name").alias("name"))).alias("tool_call"), F.struct(F.when(F.col("k") % 3 == 0, "YES").otherwise("NO").alias("should")).alias("shadow"), (F.col("k") % 9 == 0).alias("rewind_applied"), F.col("k").alias("agent_prompt_tokens"), F.col("value").alias("t_turn_s"))).withColumn("turn_seconds", F.round("turn_seconds", 4))
)
query("snk5_formatted", "select o_orderkey, '$' || printf('%.3f', o_totalprice) as usd, case when abs(k) >= 1000000 then printf('%.2fM', k / 1000000) when abs(k) >= 1000 then printf('%.0fK', k / 1000) else printf('%.0f', k) end as k from (select o_orderkey, o_totalprice, o_orderkey * 997.0::double + 0.3 as k from orders)")(
    lambda s, d: V.load(s, d, "orders").select("o_orderkey", stats.fmt_usd(F.col("o_totalprice")).alias("usd"), stats.fmt_k(F.col("o_orderkey") * 997.0 + 0.3).alias("k"))
)


DUR = "case when x < 60 then printf('%.0f', x) || 's' else printf('%.1f', x / 60) || 'm' end"
query("snk5_changes", f"select o_orderkey, {DUR} as dur, case when x >= 1000 then printf('%.0f', x / 1000) || 'k' else printf('%.0f', x) end as n, case when o_orderkey % 7 = 0 then '—' else printf('%+.0f', (o_totalprice - b) / b * 100) || '%' end as change from (select *, o_orderkey::double as x, (o_orderkey % 7 * 20000)::double as b from orders)")(
    lambda s, d: V.load(s, d, "orders").select("o_orderkey", stats.fmt_duration(F.col("o_orderkey").cast("double")).alias("dur"), stats.fmt_int(F.col("o_orderkey").cast("double")).alias("n"), stats.delta_pct((F.col("o_orderkey") % 7 * 20000).cast("double"), F.col("o_totalprice")).alias("change"))
)
query("flt9_of_task", f"with {V.STEPS} select session_id as run, tool_name as task, idx from steps where session_id in (select session_id from steps where tool_name = 'Edit')")(
    lambda s, d: runs.of_task(V.steps(s, d).select(F.col("session_id").alias("run"), F.col("tool_name").alias("task"), "idx"), "Edit")
)
query("so3_task_names", f"with {R} select task from runs where proxy = 'off' union select task from runs where proxy = 'on'")(lambda s, d: runs.task_names(*[V.runs(s, d).where(F.col("proxy") == p) for p in ("off", "on")]))
query("ag5_mean", f"with {V.TELEMETRY} select run, round(avg(saved), 6) as saved, round(avg(cache_creation), 6) as cache_creation from telemetry group by run")(
    lambda s, d: V.telemetry(s, d).groupBy("run").agg(F.round(stats.mean("saved"), 6).alias("saved"), F.round(stats.mean("cache_creation"), 6).alias("cache_creation"))
)


def _rewinds(s, d):
    """Edits stand for rewinds."""
    return V.steps(s, d).select(F.col("session_id").alias("run"), F.when(F.col("tool_name") == "Edit", "rewind_applied").otherwise("cache_stats").alias("type"), F.when(F.col("k") % 5 != 0, F.col("k")).alias("bytes_saved"))


query("ag12_cache_runs", f"with {V.TELEMETRY}, g as (select *, count(*) filter (type = 'cache_stats') over (partition by run order by line rows between unbounded preceding and 1 preceding) as grp from telemetry), f as (select *, type = 'cache_stats' and bool_or(type = 'compact') over (partition by run, grp) as fu from g), a as (select run, count(*) filter (type = 'cache_stats') as n_requests, count(*) filter (type = 'compact') as n_compact, count(*) filter (fu) as n_follow_up, coalesce(sum(saved) filter (type = 'compact'), 0)::bigint as compact_tokens_saved_est, coalesce(sum(input_tokens) filter (type = 'cache_stats'), 0)::bigint as input_tokens, coalesce(sum(cache_creation) filter (type = 'cache_stats'), 0)::bigint as cache_creation, coalesce(sum(cache_read) filter (type = 'cache_stats'), 0)::bigint as cache_read, coalesce(sum(output_tokens) filter (type = 'cache_stats'), 0)::bigint as output_tokens, case when count(*) filter (fu) > 0 and count(*) filter (type = 'cache_stats') >= 3 then median(coalesce(cache_creation, 0)) filter (fu) - median(coalesce(cache_creation, 0)) filter (type = 'cache_stats') end as creation_spike from f group by run) select *, round(input_tokens + 1.25 * cache_creation + 0.1 * cache_read, 4)::double as weighted_cost, round(coalesce(cache_read / nullif(input_tokens + cache_creation + cache_read, 0), 0), 6) as hit_rate from a")(
    lambda s, d: runs.cache_run(V.telemetry(s, d))
)


def _judge_input(s, d):
    return V.steps(s, d).select(F.col("session_id").alias("key"), F.col("idx").alias("seq"), (F.col("k") % 12).alias("n_messages"), F.when(F.col("k") % 11 != 0, F.when(F.col("k") % 3 == 0, "YES").otherwise("NO")).alias("verdict"), F.when(F.col("k") % 9 != 0, "s").otherwise("").alias("summary"), (F.col("k") % 2 == 0).alias("can_elide"))


ST1 = f"with recursive {V.STEPS}, i as (select session_id as key, row_number() over (partition by session_id order by idx) as rn, idx as seq, k % 12 as n, case when k % 11 <> 0 then case when k % 3 = 0 then 'YES' else 'NO' end end as verdict, case when k % 9 <> 0 then 's' else '' end as summary, k % 2 = 0 as can from steps), w as (select *, case when verdict is null then 'shadow_error' when verdict <> 'YES' then 'shadow_no' when summary = '' then 'no_summary' when not can then 'nothing_to_elide' else 'fired' end as free from i), z as (select key, rn, seq, case when n < 6 then 'too_short' else free end as outcome, case when n >= 6 and free = 'fired' then 3 else 0 end as cooldown from w where rn = 1 union all select w.key, w.rn, w.seq, case when n < 6 then 'too_short' when z.cooldown > 0 then 'cooldown' else free end, case when n < 6 then z.cooldown when z.cooldown > 0 then z.cooldown - 1 when free = 'fired' then 3 else 0 end from z join w on w.key = z.key and w.rn = z.rn + 1) select key, seq, outcome, cooldown from z"
query("st1_judge", ST1)(lambda s, d: state.judge(_judge_input(s, d)))


def _harness_input(s, d):
    return V.steps(s, d).select(F.col("session_id").alias("key"), F.col("idx").alias("seq"), F.when(F.col("k") % 3 == 0, "YES").otherwise("NO").alias("verdict"), F.when(F.col("k") % 9 != 0, "s").otherwise("").alias("summary"), (F.col("k") % 4).alias("n_elided"))


ST2 = f"with recursive {V.STEPS}, w as (select session_id as key, row_number() over (partition by session_id order by idx) as rn, idx as seq, k % 3 = 0 and k % 9 <> 0 as wants, k % 4 as e from steps), z as (select key, rn, seq, case when wants and e >= 1 then 'fired' when wants then 'unchanged' else 'wait' end as outcome, case when wants and e >= 1 then 3 else 0 end as cooldown from w where rn = 1 union all select w.key, w.rn, w.seq, case when wants and z.cooldown = 0 and e >= 1 then 'fired' when wants and z.cooldown = 0 then 'unchanged' else 'wait' end, case when wants and z.cooldown = 0 and e >= 1 then 3 when wants and z.cooldown = 0 then 0 else greatest(z.cooldown - 1, 0) end from z join w on w.key = z.key and w.rn = z.rn + 1) select key, seq, outcome, cooldown from z"
query("st2_harness", ST2)(lambda s, d: state.harness(_harness_input(s, d)))
query("st8_bookmarks", f"with {V.STEPS}, e as (select session_id as session, idx as seq, case when tool_name in ('Bash', 'Edit') then 'mark' else 'recall' end as kind, 'n' || sig as name, 's' || k as summary from steps), a as (select *, count(*) filter (kind = 'mark') over w as n, last_value(case when kind = 'mark' then summary end ignore nulls) over w as last from e window w as (partition by session, name order by seq rows between unbounded preceding and 1 preceding)) select session, seq, kind, name, case when kind = 'mark' then n > 0 end as overwrote, case when kind = 'recall' then n > 0 end as found, case when kind = 'recall' then last end as recalled from a")(
    lambda s, d: state.bookmarks(V.steps(s, d).select(F.col("session_id").alias("session"), F.col("idx").alias("seq"), F.when(F.col("tool_name").isin("Bash", "Edit"), "mark").otherwise("recall").alias("kind"), F.concat(F.lit("n"), F.col("sig").cast("string")).alias("name"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("summary")))
)
query("nrm1_pair_calls", f"with {V.STEPS}, e as (select session_id as req, k % 6 as id, idx as ord, case when tool_name in ('Read', 'Bash') then 'use' else 'result' end as kind from steps), a as (select *, lag(kind) over o as prev, lag(ord) over o as prev_ord, lead(kind) over o as nxt, count(*) filter (kind = 'result') over o as run from e window o as (partition by req, id order by ord)), b as (select *, min(case when kind = 'use' then ord end) over (partition by req, id, run) as rs from a), c as (select req, id, prev_ord as use_ord, ord as result_ord, 0 as phase, ord as place from b where kind = 'result' and prev = 'use' union all select req, id, ord, null, 1, rs from b where kind = 'use' and nxt is null) select req, (row_number() over (partition by req order by phase, place) - 1)::bigint as seq, id, use_ord, result_ord from c")(
    lambda s, d: normalize.pair_calls(V.steps(s, d).select(F.col("session_id").alias("req"), (F.col("k") % 6).alias("id"), F.col("idx").alias("ord"), F.when(F.col("tool_name").isin("Read", "Bash"), "use").otherwise("result").alias("kind")))
)
query("rw10_truncate_output", "with l as (select doc_id, text, string_split(text, chr(10)) as l from documents) select doc_id, case when len(l) <= 28 then text else array_to_string(l[1:15], chr(10)) || chr(10) || '[... ' || (len(l) - 25) || ' lines omitted ...]' || chr(10) || array_to_string(l[len(l)-9:len(l)], chr(10)) end as out from l")(
    lambda s, d: V.load(s, d, "documents").select("doc_id", text.truncate_output(F.col("text")).alias("out"))
)
query("rw11_truncate_middle", "select doc_id, case when length(text) > 8000 then left(text, 4000) || chr(10) || '... [truncated, total ' || length(text) || ' chars]' || chr(10) || right(text, 4000) else text end as middle, case when length(text) > 500 then left(text, 500) || chr(10) || '[truncated]' else text end as capped from documents")(
    lambda s, d: V.load(s, d, "documents").select("doc_id", text.truncate_middle(F.col("text")).alias("middle"), text.cap_response(F.col("text")).alias("capped"))
)
query("rw11_numbered_lines", "with l as (select doc_id, text, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) as l from documents), m as (select doc_id, text, case when len(l) > 500 then list_append(l[1:500], '... [truncated at 500 lines]') else l end as l from l) select doc_id, case when text = '' then '' else array_to_string(list_transform(l, lambda x, i: i || ': ' || x), chr(10)) end as shown from m")(
    lambda s, d: V.load(s, d, "documents").select("doc_id", text.numbered_lines(F.col("text")).alias("shown"))
)
query("wn8_command_signature", "select doc_id, left(array_to_string(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0b\\f\\r]+')[1:3], ' '), 80) as sig from documents")(lambda s, d: V.load(s, d, "documents").select("doc_id", text.command_signature(F.col("text")).alias("sig")))
query("rn15_cost_estimate", "select source, count(*) as n, sum(length(text))::bigint as chars, round((sum(length(text)) / 4.0) / 1e6 * 3 + 1000 / 1e6 * 15, 6)::double as usd from documents group by source")(
    lambda s, d: V.load(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.round(F.sum(F.length("text")) / 4 / 1e6 * 3 + F.lit(1000 / 1e6 * 15), 6).alias("usd"))
)
query("jn10_resume", "select distinct conv_id as session_id from conversations where conv_id not in (select doc_id from labels)")(
    lambda s, d: V.load(s, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct().join(V.load(s, d, "labels").select(F.col("doc_id").alias("session_id")), "session_id", "left_anti")
)
query("jn11_allow_list", "select distinct conv_id as session_id from conversations where conv_id in (select doc_id from labels where quality = 1)")(
    lambda s, d: V.load(s, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct().join(V.load(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("session_id")), "session_id", "left_semi")
)
query("jn9_prefix_match", "with k as (select distinct left(text, 64) as key from conversations where role = 'user' union select distinct left(text, 9) from conversations where role = 'user' union select ''), p as (select conv_id as task, arg_min(text, turn) as prompt from conversations where role = 'user' group by conv_id) select key, min(task) as task from k join p on starts_with(left(key, 64), left(prompt, 64)) or starts_with(left(prompt, 64), left(key, 64)) where key <> '' group by key")(
    lambda s, d: runs.prefix_match(V.load(s, d, "conversations").where("role = 'user'").select(F.explode(F.array(F.left("text", F.lit(64)), F.left("text", F.lit(9)), F.lit(""))).alias("key")).distinct(), V.load(s, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("task")).agg(F.min_by("text", "turn").alias("prompt")))
)
query("sl6_seeded_sample", "select doc_id from (select doc_id, row_number() over (order by md5(doc_id || '/42'), doc_id) as rn from documents) where rn <= 20")(
    lambda s, d: V.load(s, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("/42"))), "doc_id").limit(20)
)
query("relational_smoke", "select n_name, o_orderpriority, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where l_shipdate >= timestamp '1995-01-01' group by cube (n_name, o_orderpriority)")(
    lambda s, d: V.load(s, d, "lineitem").where("l_shipdate >= timestamp '1995-01-01'").join(V.load(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(V.load(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(V.load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    .cube("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
)

from tracewright.plans import file_queries, stream_queries, wire_queries  # noqa: E402, F401  (they take inputs of this module)
