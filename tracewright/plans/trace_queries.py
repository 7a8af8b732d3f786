"""Queries over whole traces: the annotator, labels and rewrites on steps and on messages as clients send them, with their SQL.

The SQL states every pattern, word list and text anew; it takes nothing from the engine's own constants.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import annotate, chunk_rows, labels, normalize, prompts, render, rewrite, runs, sessions, state
from tracewright.plans import views as V
from tracewright.plans.catalog import query
from tracewright.sources import wire
from tracewright.sources.shared import stored, stored_large

ERR = r"(?i)\b(error|exception|traceback|undefined|cannot find|failed|fatal|not found|syntax error|unresolved|permission denied|no such file|abort|segmentation fault|command not found)\b"
GOOD = r"(?i)\b(build (succeeded|successful)|compilation (successful|ok)|passed|passing|\bok\b|finished in \d|tests? (passed|ok)|\[==========\] .* passed|all tests passed)\b"
BACK = r"(?i)\bgit (revert|reset --?hard|stash|checkout --? )|\bundo\b|rollback"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES = f"list_filter(list_transform(string_split(output, chr(10)), lambda x: trim(x, {BLANK})), lambda x: x <> '')"

H = f"""{V.TRACE}, h0 as (select *, regexp_matches(output, '{ERR}') as has_error, left(array_to_string(list_filter(string_split_regex(cmd, '\\s+'), lambda x: x <> '')[1:3], ' '), 80) as sig, {LINES} as ls, coalesce(nullif(input_file, ''), cmd) as target from trace where role = 'tool'),
  h as (select *, left(coalesce(list_filter(ls, lambda x: regexp_matches(x, '{ERR}'))[1], ls[1], ''), 120) as err from h0)"""
M1 = """rd as (select session_id, idx, target, row_number() over (partition by session_id order by idx) as r from h where tool_name in ('Read', 'Grep', 'Glob')),
  ed as (select session_id, idx, target, (select count(*) from rd where rd.session_id = h.session_id and rd.idx < h.idx) as n from h where tool_name in ('Edit', 'Write', 'MultiEdit')),
  ef as (select * from (select *, row_number() over (partition by session_id order by idx) as rn from ed where n >= 2) where rn = 1),
  el as (select ef.session_id, ef.idx, string_agg(rd.target, '; ' order by r) as reads from ef join rd on rd.session_id = ef.session_id and r > greatest(n - 5, 0) and r <= greatest(n - 5, 0) + 3 and r <= n group by 1, 2),
  m1 as (select ef.session_id, ef.idx as after_step, 'milestone_achieved' as progress_type, 'M1' as detector, 'First edit to ' || target || ' after exploring ' || n || ' file(s) — likely identified fix location.' as finding, left('Read/Grep steps: ' || reads || '. Edit target: ' || target || '.', 400) as evidence, 'Verify the edit with a test or build.' as next_direction from ef join el using (session_id, idx))"""
M4 = """f0 as (select *, lag(has_error) over o as failed, lag(err) over o as perr, row_number() over o as rn from h where tool_name = 'Bash' and sig <> '' window o as (partition by session_id, sig order by idx)),
  f1 as (select *, rn - coalesce(lag(rn) over (partition by session_id, sig order by idx), 1) as n from f0 where failed and not has_error),
  m4 as (select session_id, idx as after_step, 'milestone_achieved' as progress_type, 'M4' as detector, '`' || sig || '` now succeeds after ' || n || ' prior failure(s).' as finding, coalesce(nullif(left(perr, 300), ''), 'prior runs showed error output') as evidence, 'Build is usable; move to next subtask or verify correctness.' as next_direction from f1)"""
E1 = """g0 as (select *, row_number() over (partition by session_id, sig, left(err, 60) order by idx) as n from h where tool_name = 'Bash' and has_error and sig <> '' and err <> ''),
  e1 as (select session_id, idx as after_step, 'approach_eliminated' as progress_type, 'E1' as detector, 'Same error from `' || sig || '` repeated — current approach isn''t fixing it.' as finding, 'Error signature: ' || left(err, 200) as evidence, 'Change strategy; the current edits are not addressing the root cause.' as next_direction from g0 where n = 2)"""
E2 = f"""e2 as (select session_id, idx as after_step, 'approach_eliminated' as progress_type, 'E2' as detector, 'Explicit rollback — prior edits didn''t work.' as finding, 'Rollback command: ' || left(cmd, 200) as evidence, 'Revisit the hypothesis; the reverted change was not correct.' as next_direction from h where tool_name = 'Bash' and cmd <> '' and regexp_matches(cmd, '{BACK}'))"""
E3 = """k0 as (select *, idx - lag(idx) over (partition by session_id, target order by idx) as gap from h where tool_name in ('Edit', 'Write', 'MultiEdit') and target <> ''),
  e3 as (select session_id, idx as after_step, 'approach_eliminated' as progress_type, 'E3' as detector, 'Re-edited ' || target || ' within ' || gap || ' steps — prior attempt wasn''t right.' as finding, 'Same file edited twice in short succession' as evidence, 'Settle on an approach before making more edits.' as next_direction from k0 where gap <= 4)"""
#: The greedy rule itself: walk a session's distinct positions, keep one that lies two or more past the last kept.
ANN = """un as (select * from m1 union all select * from m4 union all select * from e1 union all select * from e2 union all select * from e3),
  u1 as (select * from (select *, row_number() over (partition by session_id, after_step order by case progress_type when 'milestone_achieved' then 0 else 1 end, case detector when 'M1' then 1 when 'M4' then 2 when 'E1' then 3 when 'E2' then 4 else 5 end) as rn from un) where rn = 1),
  ats as (select session_id, list(after_step order by after_step) as l from u1 group by 1),
  kept as (select session_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: case when x[1] - a[len(a)] <= 1 then a else list_concat(a, x) end)) as after_step from ats),
  ann as (select u1.* exclude (rn) from u1 join kept using (session_id, after_step))"""
EXP = "ex as (select session_id, idx as expire from (select *, max(idx) over (partition by session_id) as last from trace) where role = 'tool' and tool_name = 'Bash' and length(output) >= 500 and last - idx >= 3)"
ALL = f"{H}, {M1}, {M4}, {E1}, {E2}, {E3}, {ANN}"

query("wn1_edit_after_reads", f"with {H}, {M1} select * from m1")(lambda s, d: annotate.edit_after_reads(annotate.prepared(V.trace(s, d))))
query("wn2_success_after_failure", f"with {H}, {M4} select * from m4")(lambda s, d: annotate.success_after_failure(annotate.prepared(V.trace(s, d))))
query("wn3_repeated_failure", f"with {H}, {E1} select * from e1")(lambda s, d: annotate.repeated_failure(annotate.prepared(V.trace(s, d))))
query("wn4_explicit_rollback", f"with {H}, {E2} select * from e2")(lambda s, d: annotate.explicit_rollback(annotate.prepared(V.trace(s, d))))
query("wn5_edit_reverted", f"with {H}, {E3} select * from e3")(lambda s, d: annotate.edit_reverted(annotate.prepared(V.trace(s, d))))
query("wn6_stale_outputs", f"with {V.TRACE}, {EXP} select * from ex")(lambda s, d: annotate.stale_outputs(V.trace(s, d)))
query("wn7_annotate", f"with {ALL} select * from ann")(lambda s, d: annotate.annotate(V.trace(s, d)))
query("wn11_checkpoint_texts", f"with {ALL} select session_id, after_step, case progress_type when 'approach_eliminated' then 'Approach eliminated' else 'Milestone' end || ': ' || finding || '. Evidence: ' || evidence || '. Next: ' || next_direction as summary from ann")(
    lambda s, d: annotate.annotate(V.trace(s, d)).select("session_id", "after_step", text.summary_text(F.col("progress_type"), F.col("finding"), F.col("evidence"), F.col("next_direction"), F.lit(None).cast("string")).alias("summary"))
)
query(
    "sl1_merge_labels",
    f"with {ALL}, {EXP}, u as (select session_id, expire as step, 'expire' as kind from ex union all select session_id, after_step, 'checkpoint' from ann) select *, (row_number() over (partition by session_id order by step, case when kind = 'expire' then 0 else 1 end) - 1)::bigint as seq from u",
)(lambda s, d: annotate.merge_labels(annotate.stale_outputs(V.trace(s, d)), annotate.annotate(V.trace(s, d))))
query("wn9_error_signature", f"with {H} select session_id, idx, sig, err, has_error from h")(lambda s, d: annotate.prepared(V.trace(s, d)).select("session_id", "idx", "sig", "err", "has_error"))
query("flt4_error_text", f"with d as (select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') as t from documents) select doc_id, regexp_matches(t, '{ERR}') as has_error, regexp_matches(t, '{BACK}') as rollback, regexp_matches(t, '{GOOD}') as success from d")(
    lambda s, d: V.load(s, d, "documents").select("doc_id", text.has_error(F.col("text")).alias("has_error"), text.is_rollback(F.col("text")).alias("rollback"), text.has_success(F.col("text")).alias("success"))
)
query("flt5_outputs", f"with {V.TRACE} select session_id, idx, regexp_matches(output, '{ERR}') as has_error, regexp_matches(output, '{GOOD}') as success from trace")(
    lambda s, d: V.trace(s, d).select("session_id", "idx", text.has_error(F.col("output")).alias("has_error"), text.has_success(F.col("output")).alias("success"))
)
query("nrm5_tool_class", f"with {V.TRACE} select session_id, idx, case when tool_name in ('Bash', 'bash') then 'bash' when tool_name in ('Read', 'view') then 'view' when tool_name in ('Edit', 'Write', 'MultiEdit') then 'edit' when tool_name in ('Grep', 'Glob') then 'search' else 'other' end as kind from trace where role = 'tool'")(
    lambda s, d: V.trace(s, d).where("role = 'tool'").select("session_id", "idx", text.tool_class(F.col("tool_name")).alias("kind"))
)
RENDERED = f"""with {V.TRACE}, r as (select *, string_split(output, chr(10)) as l from trace), t as (select *, case when len(l) <= 28 then output else array_to_string(l[1:15], chr(10)) || chr(10) || '[... ' || (len(l) - 25) || ' lines omitted ...]' || chr(10) || array_to_string(l[len(l) - 9:len(l)], chr(10)) end as o from r)
    select session_id, idx, '[' || lpad(idx::varchar, greatest(3, length(idx::varchar))::int, ' ') || '] ' || case role when 'tool' then 'TOOL ' || tool_name || ': ' || left(cmd, 200) || case when length(cmd) > 200 then ' (…' || (length(cmd) - 200) || ')' else '' end || chr(10) || '     → ' || left(o, 2000) || case when length(o) > 2000 then chr(10) || '[... ' || (length(o) - 2000) || ' chars truncated ...]' else '' end
      else case role when 'user_text' then 'USER: ' else 'ASST: ' end || left(text, 500) || case when length(text) > 500 then '  (…' || (length(text) - 500) || ' more chars)' else '' end end as entry from t"""
query("rn1_render_step", RENDERED)(lambda s, d: V.trace(s, d).select("session_id", "idx", text.render_step(*map(F.col, ("idx", "role", "tool_name", "cmd", "output", "text"))).alias("entry")))
query("rn2_step_transcript", f"select session_id, string_agg(entry, chr(10) order by idx) as transcript from ({RENDERED}) group by session_id")(
    lambda s, d: render.transcript(V.trace(s, d).withColumn("entry", text.render_step(*map(F.col, ("idx", "role", "tool_name", "cmd", "output", "text")))), "session_id", "idx", "entry")
)


def _label_events(s, d):
    """Every step makes an event; a checkpoint, without expire, at each tenth k."""
    t = V.trace(s, d)
    return labels.filter_events(t.select("session_id", F.when(F.col("k") % 10 != 0, F.col("idx") + F.col("k") % 9).alias("expire"), F.col("idx").alias("event_no")), t.select("session_id", "idx", "role", "tool_name"))


FLT2 = f"""with {V.TRACE}, e as (select session_id, case when k % 10 <> 0 then idx + k % 9 end as expire, idx as event_no from trace),
  f as (select e.session_id, expire, event_no, case when expire is null then null when r.idx is null then 'out_of_range' when role <> 'tool' then 'non_tool' when tool_name in ('Read', 'read_file', 'read_many_files', 'list_directory', 'Edit', 'Write', 'MultiEdit', 'replace', 'write_file', 'apply_patch') then 'file_based' end as reason
    from e left join trace r on e.session_id = r.session_id and e.expire = r.idx)"""
query("flt2_filter_events", FLT2 + " select * from f")(_label_events)
query("ag20_drop_totals", FLT2 + " select count(*) as before, count(*) filter (reason is null) as after, count(*) filter (reason = 'out_of_range') as out_of_range, count(*) filter (reason = 'non_tool') as non_tool, count(*) filter (reason = 'file_based') as file_based from f")(lambda s, d: labels.drop_totals(_label_events(s, d)))


def _audit(s, d):
    t = annotate.prepared(V.trace(s, d))
    m4, e1, e3 = (f(t).select("session_id", "after_step") for f in (annotate.success_after_failure, annotate.repeated_failure, annotate.edit_reverted))
    return labels.audit(m4.unionByName(e3), m4.unionByName(e1))


AUD = f"""with {H}, {M4}, {E1}, {E3}, o as (select session_id, list(distinct after_step) as o from (select session_id, after_step from m4 union all select session_id, after_step from e3) group by 1), t as (select session_id, list(distinct after_step) as s from (select session_id, after_step from m4 union all select session_id, after_step from e1) group by 1),
  b as (select session_id, coalesce(o, []) as o, coalesce(s, []) as s from o full join t using (session_id)),
  a as (select session_id, len(o)::bigint as n_original, len(s)::bigint as n_strict, list_sort(list_filter(s, lambda x: not list_contains(o, x))) as added, list_sort(list_filter(s, lambda x: list_contains(o, x))) as kept, list_sort(list_filter(o, lambda x: not list_contains(s, x))) as dropped from b)"""
query("so1_audit", AUD + " select * from a")(_audit)
query("ag19_audit_totals", AUD + " select count(*) as n_sessions, sum(n_original)::bigint as original, sum(n_strict)::bigint as strict, sum(n_strict) / sum(n_original) as ratio from a")(lambda s, d: labels.audit_totals(_audit(s, d)))

# Messages. Each helper gives the CTEs that turn table t into table out; names start with out.


def blocks_sql(t: str, out: str) -> str:
    return f"{out} as (select req, idx, role, unnest(l) as b, generate_subscripts(l, 1) - 1 as pos from (select req, idx, role, from_json(case when content like '[%' then content else '[]' end, '[\"json\"]') as l from {t}))"


def checkpoints_sql(t: str, out: str) -> str:
    g = lambda k: f"coalesce(b->>'$.input.{k}', '')"
    return f"""{blocks_sql(t, out + "_b")}, {out} as (select req, idx, case when {g("finding")} <> '' or {g("evidence")} <> '' or {g("next_direction")} <> '' then case when {g("progress_type")} = 'approach_eliminated' then 'Approach eliminated: ' else 'Milestone: ' end || {g("finding")} || case when {g("evidence")} <> '' then '. Evidence: ' || {g("evidence")} else '' end || case when {g("next_direction")} <> '' then '. Next: ' || {g("next_direction")} else '' end else {g("summary")} end as summary
    from {out}_b where role = 'assistant' and b->>'$.type' = 'tool_use' and (b->>'$.name' = 'checkpoint_progress' or ends_with(b->>'$.name', '__checkpoint_progress')))"""


def gaps_sql(t: str, out: str) -> str:
    return f"""{checkpoints_sql(t, out + "_c")}, {out}_a as (select c.*, case when n.role = 'user' then c.idx + 1 else c.idx end as pair_end from {out}_c c left join {t} n on n.req = c.req and n.idx = c.idx + 1),
    {out} as (select *, coalesce(lag(pair_end) over (partition by req order by idx) + 1, 1) as cursor from {out}_a)"""


def renumber_sql(t: str, out: str) -> str:
    return f"{out} as (select req, (row_number() over (partition by req order by ord) - 1)::bigint as idx, role, content from {t})"


TEXT = """'[{{"type":"text","text":' || to_json({})::varchar || '}}]'"""


def rewind_sql(t: str, out: str) -> str:
    note = TEXT.format("'[Previous exploration elided — agent summary: ' || summary || ']'")
    return f"""{gaps_sql(t, out + "_g")}, {out} as (select m.req, m.idx::double as ord, m.role, m.content from {t} m where not exists (select 1 from {out}_g g where g.req = m.req and m.idx >= g.cursor and m.idx < g.idx) union all select req, idx - 0.5, 'user', {note} from {out}_g where idx > cursor)"""


def judge_sql(t: str, out: str) -> str:
    note = TEXT.format("'[Checkpoint note from your prior reasoning — prior exploration elided]' || chr(10) || said || chr(10) || chr(10) || 'The next messages show the most-recent verification evidence. Continue with any remaining work from the original task.'")
    return f"""{blocks_sql(t, out + "_b")}, {out}_l as (select req, max(idx) as l from {out}_b where role = 'user' and b->>'$.type' = 'tool_result' group by req),
    {out}_n as (select req, count(*) as n, case when req % 4 <> 0 then 's' || req end as said from {t} group by req),
    {out}_f as (select l.req, l, said from {out}_l l join {out}_n n using (req) join {t} p on p.req = l.req and p.idx = l.l - 1 and p.role = 'assistant' where n >= 4 and l >= 3 and said <> '' and not exists (select 1 from {out}_b u where u.req = l.req and u.idx = l.l - 1 and u.b->>'$.type' = 'tool_use' and not exists (select 1 from {out}_b r where r.req = l.req and r.idx = l.l and r.b->>'$.type' = 'tool_result' and r.b->>'$.tool_use_id' = u.b->>'$.id'))),
    {out} as (select m.req, m.idx::double as ord, m.role, m.content, coalesce(l - 2, 0)::bigint as n_elided from {t} m left join {out}_f f using (req) where f.l is null or m.idx = 0 or m.idx >= f.l - 1 union all select req, 0.5, 'user', {note}, l - 2 from {out}_f)"""


def compact_sql(t: str, out: str) -> str:
    return f"""{blocks_sql(t, out + "_b")}, {out}_u as (select req, b->>'$.id' as id, arg_max(b->>'$.name', idx) as name from {out}_b where role = 'assistant' and b->>'$.type' = 'tool_use' group by 1, 2),
    {out}_a as (select req, idx, count(*) filter (role = 'assistant') over (partition by req) - count(*) filter (role = 'assistant') over (partition by req order by idx) as age from {t}),
    {out}_t as (select b.*, age, name, case when json_type(b.b->'$.content') = 'ARRAY' then array_to_string(list_transform(list_filter(from_json(b.b->'$.content', '["json"]'), lambda x: x->>'$.type' = 'text'), lambda x: x->>'$.text'), chr(10)) else b.b->>'$.content' end as txt from {out}_b b join {out}_a a on a.req = b.req and a.idx = b.idx left join {out}_u u on u.req = b.req and u.id = b.b->>'$.tool_use_id' and b.b->>'$.type' = 'tool_result'),
    {out}_k as (select *, string_split(txt, chr(10)) as l from {out}_t),
    {out}_z as (select *, '[COMPACTED — ' || len(l) || ' lines → 40]' || chr(10) || array_to_string(l[1:30], chr(10)) || chr(10) || chr(10) || '[... ' || (len(l) - 40) || ' lines compacted ...]' || chr(10) || chr(10) || array_to_string(l[len(l) - 9:len(l)], chr(10)) as z from {out}_k),
    {out}_g as (select *, coalesce(role = 'user' and name = 'Bash' and age >= 2 and len(l) >= 50 and not starts_with(txt, '[COMPACTED') and length(txt) > length(z), false) as goes from {out}_z),
    {out}_m as (select req, idx, '[' || string_agg(case when goes then replace(b::varchar, '"content":' || (b->'$.content')::varchar || case when (b->'$.meta') is null then '}}' else ',"is_error"' end, '"content":' || to_json(z)::varchar || case when (b->'$.meta') is null then '}}' else ',"is_error"' end) else b::varchar end, ',' order by pos) || ']' as content, count(*) filter (goes) as n, sum(case when goes then floor((length(txt) - length(z)) / 4 + 0.5) else 0 end)::bigint as saved from {out}_g group by 1, 2),
    {out} as (select m.req, m.idx, m.role, coalesce(c.content, m.content) as content, coalesce(n, 0) as n_compacted, coalesce(saved, 0)::bigint as tokens_saved from {t} m left join {out}_m c on c.req = m.req and c.idx = m.idx)"""


def _summaries(m):
    return m.select("req").distinct().withColumn("summary", F.when(F.col("req") % 4 != 0, F.concat(F.lit("s"), F.col("req").cast("string"))))


R = V.REQUESTS
query("rw1_compact", f"with {R}, {compact_sql('messages', 'z')} select * from z")(lambda s, d: rewrite.compact(V.requests(s, d)))
query("rw2_rewind", f"with {R}, {rewind_sql('messages', 'z')} select * from z")(lambda s, d: rewrite.rewind(V.requests(s, d)))
query(
    "rw2_elisions",
    f"with {R}, {gaps_sql('messages', 'g')} select g.req, g.idx as anchor_idx, summary, count(*) as turns_elided, (sum(length('{{\"role\":\"' || role || '\",\"content\":' || case when content like '[%' then content else to_json(content)::varchar end || '}}')) + count(*) + 1)::bigint as bytes_saved from g join messages m on m.req = g.req and m.idx >= cursor and m.idx < g.idx group by all",
)(lambda s, d: rewrite.elisions(V.requests(s, d)))
query("rw3_checkpoint_summaries", f"with {R}, {checkpoints_sql('messages', 'c')} select * from c")(lambda s, d: rewrite.with_checkpoints(V.requests(s, d)).where("summary is not null").select("req", "idx", "summary"))
query("rw4_judge_rewind", f"with {R}, {judge_sql('messages', 'z')} select * from z")(lambda s, d: rewrite.judge_rewind(V.requests(s, d), _summaries(V.requests(s, d))))


def _harness(s, d):
    role = F.when(F.col("idx") == 0, "system").when(F.col("idx") == 1, "user").when(F.startswith("content", F.lit('[{"type":"tool_result')), "tool").otherwise(F.col("role"))
    return V.requests(s, d).withColumn("role", role)


query(
    "rw6_harness_rewind",
    f"""with {R}, m as (select req, idx, case when idx = 0 then 'system' when idx = 1 then 'user' when starts_with(content, '[{{"type":"tool_result') then 'tool' else role end as role, content from messages), f as (select req, max(idx) filter (role = 'tool') as l from m group by req having count(*) >= 4 and max(idx) filter (role = 'tool') >= 3)
    select m.req, m.idx::double as ord, role, content, coalesce(l - 3, 0)::bigint as n_elided from m left join f using (req) where l is null or idx in (0, 1) or idx in (l - 1, l)
    union all select req, l + 0.5, 'user', '[Checkpoint note from your prior reasoning]' || chr(10) || 's' || req || chr(10) || chr(10) || 'The turn immediately above shows the verification evidence. Continue with any remaining work from the original task.', l - 3 from f""",
)(lambda s, d: rewrite.harness_rewind(_harness(s, d), _harness(s, d).select("req").distinct().withColumn("summary", F.concat(F.lit("s"), F.col("req").cast("string")))))
query(
    "rw8_cache_mark",
    f"""with {R}, n as (select *, count(*) over (partition by req) as n from messages), w as (select *, idx = greatest(n - 2, 0) as here from n) select req, idx, role, case when not here then content when content like '[%' then left(content, length(content) - 2) || ',"cache_control":{{"type":"ephemeral"}}}}]' else '[{{"type":"text","text":' || to_json(content)::varchar || ',"cache_control":{{"type":"ephemeral"}}}}]' end as content from w""",
)(lambda s, d: rewrite.cache_mark(V.requests(s, d)))
CHAIN = f"{rewind_sql('messages', 'a')}, {renumber_sql('a', 'a1')}, {judge_sql('a1', 'b')}, {renumber_sql('b', 'b1')}, {compact_sql('b1', 'z')}"
query("rw9_request_chain", f"with {R}, {CHAIN} select req, idx, role, content from z")(lambda s, d: rewrite.rewrite(V.requests(s, d), _summaries(V.requests(s, d))))


def _whole_bodies(s, d):
    """Bodies around the messages: without edits, with others, or with the edit that is added."""
    m = wire.bodies(V.requests(s, d)).select("req", F.expr("substr(body, 13, length(body) - 13)").alias("m"))
    edits = F.when(F.col("req") % 3 == 0, ',"context_management":{"edits":[{"type":"clear_thinking_20251015"}],"x":[1, 2]}').when(F.col("req") % 3 == 1, ',"context_management":{"edits":[{"type":"clear_tool_uses_20250919","keep":1}]}').otherwise("")
    return m.select("req", F.concat(F.lit('{"model":"m","messages":'), "m", F.lit(',"max_tokens" : 5'), edits, F.lit("}")).alias("body"))


ADDED = '{"type":"clear_tool_uses_20250919","trigger":{"type":"input_tokens","value":30000},"keep":{"type":"tool_uses","value":3},"clear_at_least":{"type":"input_tokens","value":5000},"exclude_tools":["Read","Grep","Glob"]}'
query(
    "rw9_forwarded_bodies",
    f"""with {R}, {CHAIN}, f as (select req, '[' || string_agg('{{"role":"' || role || '","content":' || case when starts_with(content, '[') then content else to_json(content)::varchar end || '}}', ',' order by idx) || ']' as m from z group by req)
    select req, '{{"model":"m","messages":' || m || ',"max_tokens" : 5,"context_management":' || case req % 3 when 0 then '{{"edits":[{{"type":"clear_thinking_20251015"}},{ADDED}],"x":[1, 2]}}' when 1 then '{{"edits":[{{"type":"clear_tool_uses_20250919","keep":1}}]}}' else '{{"edits":[{ADDED}]}}' end || '}}' as body from f""",
)(lambda s, d: rewrite.forward(_whole_bodies(s, d), _summaries(V.requests(s, d))))
query("rw7_inject", f"""select doc_id as req, '{{"text":' || to_json(text)::varchar || ',"context_management":{{"edits":[{ADDED}]}}}}' as body from documents where text is not null""")(
    lambda s, d: V.load(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("req"), rewrite.inject(F.concat(F.lit('{"text":'), rewrite.quoted(F.col("text")), F.lit("}"))).alias("body"))
)
query("ag16_distinct_rewinds", f"with {R}, {gaps_sql('messages', 'g')}, e as (select g.req, g.idx, g.summary from g where exists (select 1 from messages m where m.req = g.req and m.idx >= cursor and m.idx < g.idx)) select req as run, count(*) as rewinds, 2 * count(*) as events from e group by req")(
    lambda s, d: (lambda e: runs.distinct_rewinds(e.unionByName(e).withColumnRenamed("req", "run")))(rewrite.elisions(V.requests(s, d)))
)
query("nrm11_tool_names", f"with {R}, {blocks_sql('messages', 'x')} select req, b->>'$.id' as id, b->>'$.name' as name from x where role = 'assistant' and b->>'$.type' = 'tool_use'")(lambda s, d: normalize.tool_names(V.requests(s, d)))
RESULT = "case when json_type(b->'$.content') = 'ARRAY' then array_to_string(list_transform(from_json(b->'$.content', '[\"json\"]'), lambda x: x->>'$.text'), chr(10)) else b->>'$.content' end"
query(
    "nrm3_last_turn_calls",
    f"with {R}, {blocks_sql('messages', 'x')}, l as (select req, max(idx) as idx from messages where role = 'assistant' group by req), r as (select req, b->>'$.tool_use_id' as id, {RESULT} as output from x where role = 'user' and b->>'$.type' = 'tool_result') select x.req, x.pos::bigint as pos, b->>'$.id' as id, b->>'$.name' as name, (b->'$.input')::varchar as input, coalesce(output, '') as output from x join l using (req, idx) left join r on r.req = x.req and r.id = b->>'$.id' where b->>'$.type' = 'tool_use'",
)(lambda s, d: normalize.last_turn_calls(V.requests(s, d)))
query(
    "nrm2_tool_calls",
    f"with {R}, {blocks_sql('messages', 'x')}, u as (select req, idx, b from x where role = 'assistant' and b->>'$.type' = 'tool_use'), r as (select req, idx, b->>'$.tool_use_id' as id, {RESULT} as output from x where role = 'user' and b->>'$.type' = 'tool_result') select u.req, (row_number() over (partition by u.req order by r.idx) - 1)::bigint as seq, b->>'$.id' as id, b->>'$.name' as name, coalesce(nullif(coalesce(b->>'$.input.command', b->>'$.input.file_path', b->>'$.input.pattern'), ''), '') as cmd, output from u join r on r.req = u.req and r.id = u.b->>'$.id'",
)(lambda s, d: normalize.tool_calls(V.requests(s, d)).select("req", "seq", "id", "name", "cmd", "output"))
query(
    "ag1_tally_results",
    f"with {R}, {blocks_sql('messages', 'x')}, t as (select req, {RESULT} as t from x where role = 'user' and b->>'$.type' = 'tool_result'), s as (select req, count(*) as count, sum(length(t))::bigint as total_chars, max(length(t))::bigint as max_chars, list(length(t)::bigint order by length(t)) as l, count(*) filter (length(t) < 4096 and regexp_matches(t, '(?i)\\bsaved to [\\w/.-]+|offloaded|\\[truncated\\]')) as offloaded_markers from t group by req) select req, coalesce(count, 0) as count, total_chars, max_chars, l[1 + (len(l) // 2)] as p50_chars, l[1 + floor(len(l) * 0.9)::int] as p90_chars, offloaded_markers from (select distinct req from messages) left join s using (req)",
)(lambda s, d: normalize.tally_results(V.requests(s, d)))


def _bodies(s, d):
    q = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    k = F.col("doc_id")
    system = F.when(k % 3 == 0, q('"rules ', k, '"')).when(k % 3 == 1, q('[{"type":"text","text":"a', k, '"},{"type":"text","text":"bb"},{"type":"x"}]')).otherwise("null")
    edits = F.when(k % 4 == 0, q(',"context_management":{"edits":[{"type":"clear_tool_uses_20250919","trigger":{"type":"input_tokens","value":', k, '},"exclude_tools":["Read","Grep"]},{"type":"other","keep":2}]}')).when(k % 4 == 1, ',"context_management":{}').otherwise("")
    result = F.when(k % 5 == 0, q('[{"type":"tool_result","tool_use_id":"t","content":"', F.repeat(F.lit("y"), (k % 50).cast("int")), '"},{"type":"text","text":"z"}]')).otherwise('"x"')
    body = q('{"model":"m', k % 5, '","stream":', F.when(k % 2 == 0, "true").otherwise("false"), ',"max_tokens":', k, ',"system":', system, ',"messages":[{"role":"user","content":', result, '},{"role":"user","content":[]}],"tools":[{},{},{}]', edits, "}")
    return V.load(s, d, "documents").select(F.col("doc_id").alias("req"), body.alias("body"), F.when(k % 6 != 0, q("beta-", k, ", ,b2 ")).alias("betas"))


query(
    "ag2_request_summary",
    """with q as (select doc_id as req, doc_id as k, '{"model":"m' || (doc_id % 5) || '","stream":' || case when doc_id % 2 = 0 then 'true' else 'false' end || ',"max_tokens":' || doc_id || ',"system":' || case doc_id % 3 when 0 then '"rules ' || doc_id || '"' when 1 then '[{"type":"text","text":"a' || doc_id || '"},{"type":"text","text":"bb"},{"type":"x"}]' else 'null' end || ',"messages":[{"role":"user","content":' || case when doc_id % 5 = 0 then '[{"type":"tool_result","tool_use_id":"t","content":"' || repeat('y', (doc_id % 50)::int) || '"},{"type":"text","text":"z"}]' else '"x"' end || '},{"role":"user","content":[]}],"tools":[{},{},{}]' || case doc_id % 4 when 0 then ',"context_management":{"edits":[{"type":"clear_tool_uses_20250919","trigger":{"type":"input_tokens","value":' || doc_id || '},"exclude_tools":["Read","Grep"]},{"type":"other","keep":2}]}' when 1 then ',"context_management":{}' else '' end || '}' as body from documents)
    select req, 'm' || (k % 5) as model, k % 2 = 0 as stream, k::bigint as max_tokens, case when k % 6 <> 0 then ['beta-' || k, 'b2'] else []::varchar[] end as betas, 2::bigint as message_count, 3::bigint as tool_count, (case k % 3 when 0 then length('rules ' || k) when 1 then length('a' || k) + 2 else 0 end)::bigint as system_size_chars,
      case k % 4 when 0 then 2 when 1 then 0 end::bigint as edit_count, case k % 4 when 0 then 'clear_tool_uses_20250919|{"type":"input_tokens","value":' || k || '}|-|-|["Read","Grep"]' || chr(10) || 'other|-|2|-|-' when 1 then '' end as strategies, case when k % 5 = 0 then k % 50 end as result_chars, case when k % 5 = 0 then 1 end::bigint as results, length(body)::bigint as body_size_chars from q""",
)(lambda s, d: _summary(normalize.request_summary(_bodies(s, d))))


def _summary(r):
    line = lambda e: F.concat_ws("|", *[F.coalesce(e[k], F.lit("-")) for k in ("type", "trigger", "keep", "clear_at_least", "exclude_tools")])
    flat = F.array_join(F.transform("context_management.strategies", line), "\n")
    return r.withColumns({"edit_count": F.col("context_management.edit_count"), "strategies": flat, "result_chars": F.col("tool_results.total_chars").cast("bigint"), "results": F.col("tool_results.count")}).drop("context_management", "tool_results")


# Training chunks. Token counts are the estimate of four characters a token.
CM = """c0 as (select *, unnest(case when role = 'tool' then [0, 1] else [0] end) as part from trace),
  cm as (select session_id, (row_number() over (partition by session_id order by idx, part) - 1)::bigint as idx, idx as step, case when role = 'user_text' then 'user' when part = 1 then 'tool' else 'assistant' end as role, case when role <> 'tool' then text when part = 1 then output end as content, case when role = 'tool' then tool_name end as tool, case when role = 'tool' then 'call_' || idx end as call_id,
    case when role = 'tool' and part = 0 then case when tool_name = 'Bash' then '{"command":"' || cmd || '"}' when tool_name = 'Read' then '{"file_path":"' || coalesce(input_file, cmd) || '"}' when tool_name in ('Edit', 'Write', 'MultiEdit') then '{"file_path":"' || coalesce(input_file, cmd) || '","content":"[elided]"}' when tool_name in ('Grep', 'Glob') then '{"pattern":"' || cmd || '"}' else '{"input":"' || cmd || '"}' end end as arguments from c0),
  @ct@,
  us as (select *, sum(n_tokens) over (partition by session_id order by idx) as upto from ct),
  ca as (select ann.*, m.idx as anchor_idx, row_number() over (partition by ann.session_id order by after_step) - 1 as chunk, '{"progress_type":"' || progress_type || '","finding":"' || finding || '","evidence":"' || evidence || '","next_direction":"' || next_direction || '"}' as call from ann join (select session_id, step, max(idx) as idx from cm group by 1, 2) m on m.session_id = ann.session_id and m.step = ann.after_step),
  nc as (select ca.session_id, ca.chunk, min(m.idx) as call_idx from ca join cm m on m.session_id = ca.session_id and m.idx > ca.anchor_idx and m.role = 'assistant' and m.arguments is not null group by 1, 2)"""


PLAIN = """ct as (select *, floor(length(coalesce(content, '') || coalesce(arguments, '')) / 4)::bigint as n_tokens, floor(length(case when length(content) > 500 then left(content, 500) || chr(10) || '[truncated]' else coalesce(content, '') end || coalesce(arguments, '')) / 4)::bigint as capped_tokens, case when length(content) > 500 then left(content, 500) || chr(10) || '[truncated]' else content end as capped from cm)"""
# The same by turns of a template, as text.
_turn = lambda role, said: f"'<|im_start|>' || {role} || chr(10) || {said} || '<|im_end|>' || chr(10)"
_call = lambda tool, arguments: f"""'<tool_call>' || chr(10) || '{{"name": "' || {tool} || '", "arguments": ' || {arguments} || '}}' || chr(10) || '</tool_call>'"""
_said = lambda content: f"case when arguments is null then coalesce({content}, '') when coalesce({content}, '') = '' then {_call('tool', 'arguments')} else {content} || chr(10) || {_call('tool', 'arguments')} end"
TURNS = f"""ct0 as (select *, case when length(content) > 500 then left(content, 500) || chr(10) || '[truncated]' else content end as capped from cm),
  ct as (select *, {_turn("role", _said("content"))} as turn, {_turn("role", _said("capped"))} as capped_turn, floor(length({_turn("role", _said("content"))}) / 4)::bigint as n_tokens, floor(length({_turn("role", _said("capped"))}) / 4)::bigint as capped_tokens from ct0)"""
CALL_TURN, ACK_TURN = _turn("'assistant'", _call("'mcp__bookmarks__checkpoint_progress'", "call")), _turn("'tool'", "'Checkpoint saved. Prior exploration may now be condensed.'")
CM0, CM = CM, CM.replace("@ct@", PLAIN)


def fill_sql(targets: str, out: str, budget: int, fixed: int) -> str:
    return f"""{out}_g as (select t.*, g.n_tokens + {fixed} as goal_tokens, {budget} - g.n_tokens - {fixed} - t.completion_tokens as room from {targets} t join ct g on g.session_id = t.session_id and g.idx = 0 and g.role = 'user' and floor(length(coalesce(g.content, '')) / 4) <= 2048 where {budget} - g.n_tokens - {fixed} - t.completion_tokens >= 512),
  {out}_i as (select g.*, (select min(u.idx) from us u where u.session_id = g.session_id and u.idx between 1 and g.end_idx and e.upto - u.upto + u.n_tokens <= g.room) as first_idx, e.upto as total from {out}_g g join us e on e.session_id = g.session_id and e.idx = g.end_idx),
  {out} as (select i.*, (end_idx - first_idx + 1)::bigint as n_context, (goal_tokens + completion_tokens + total - (u.upto - u.n_tokens))::bigint as n_tokens from {out}_i i join us u on u.session_id = i.session_id and u.idx = i.first_idx where end_idx - first_idx + 1 >= 10)"""


def chunks_sql(budget: int, ct: str = PLAIN, own: str = "floor(length(call) / 4) + 14", fixed: int = 0) -> str:
    return f"""{CM0.replace("@ct@", ct)}, pt as (select ca.session_id, ca.chunk, anchor_idx as end_idx, after_step, progress_type, call, {own} + coalesce(c.n_tokens, 0) + coalesce(r.capped_tokens, 0) as completion_tokens from ca left join nc on nc.session_id = ca.session_id and nc.chunk = ca.chunk left join ct c on c.session_id = ca.session_id and c.idx = nc.call_idx left join ct r on r.session_id = ca.session_id and r.idx = nc.call_idx + 1 and r.role = 'tool'),
  {fill_sql("pt", "pf", budget, fixed)}, qt as (select session_id, count(*) as quota from pf group by 1),
  ng as (select c.session_id, c.idx, row_number() over (partition by c.session_id order by md5(c.session_id || '/' || c.idx || '/42'), c.idx) as rank from ct c join ct p on p.session_id = c.session_id and p.idx = c.idx - 1 and p.role in ('tool', 'user') where c.role = 'assistant' and c.arguments is not null and not exists (select 1 from ca where ca.session_id = c.session_id and ca.anchor_idx = c.idx - 1)),
  nt as (select ng.session_id, ng.idx as anchor_idx, ng.idx - 1 as end_idx, rank, quota, c.n_tokens + coalesce(r.capped_tokens, 0) as completion_tokens from ng join qt using (session_id) join ct c on c.session_id = ng.session_id and c.idx = ng.idx left join ct r on r.session_id = ng.session_id and r.idx = ng.idx + 1 and r.role = 'tool' where rank <= quota * 3),
  {fill_sql("nt", "nf", budget, fixed)}, nb as (select * from (select *, row_number() over (partition by session_id order by rank) as n from nf) where n <= quota),
  cs as (select g.session_id, f.idx as call_idx, g.n_tokens + {fixed} + c.n_tokens + coalesce(r.capped_tokens, 0) as n_tokens from ct g join (select session_id, min(idx) as idx from ct where role = 'assistant' and arguments is not null and idx > 0 group by 1) f using (session_id) join ct c on c.session_id = g.session_id and c.idx = f.idx left join ct r on r.session_id = g.session_id and r.idx = f.idx + 1 and r.role = 'tool' where g.idx = 0 and g.role = 'user'),
  ch as (select session_id, 'positive' as label, after_step as at, progress_type, first_idx, end_idx, n_context, n_tokens from pf union all select session_id, 'negative', anchor_idx, null, first_idx, end_idx, n_context, n_tokens from nb union all select session_id, 'cold_start', call_idx, null, 1, 0, 0, n_tokens from cs)"""


def _chat(s, d):
    return render.chat_messages(V.trace(s, d))


def _chunks(s, d, **limits):
    return render.chunks(*_inputs(s, d), **limits)


def _inputs(s, d):
    """Messages and checkpoints are read several times, so they are made once: both from one stored trace."""
    t = stored_large(V.trace(s, d))
    return stored_large(render.chat_messages(t)), stored_large(annotate.annotate(t))


def _rows(s, d):
    template = prompts.Template(preamble="<|im_start|>system\nTools: Bash, Read, Edit, Grep<|im_end|>\n")
    r = chunk_rows.chunk_rows(*_inputs(s, d), template=template)
    cut = lambda c: F.coalesce(c, F.lit("-"))
    call = lambda m: F.get(m["tool_calls"], F.lit(0))
    line = lambda m: F.concat_ws("|", m["role"], cut(m["content"]), cut(call(m)["id"]), cut(call(m)["name"]), cut(call(m)["arguments"]), cut(m["tool_call_id"]), cut(m["name"]))
    return r.select("prompt", "completion", F.array_join(F.transform("messages", line), "\n").alias("messages"), "meta.*")


ROWS = f"""ch1 as (select session_id, 'positive' as label, chunk as n, after_step as at, progress_type, call, first_idx, end_idx, n_context, n_tokens from pf union all select session_id, 'negative', anchor_idx, anchor_idx, null, null, first_idx, end_idx, n_context, n_tokens from nb union all select session_id, 'cold_start', call_idx, call_idx, null, null, 1, 0, 0, n_tokens from cs),
  pm as (select x.session_id, label, n, false as done, m.idx as ord, turn, m.role, content, tool, m.call_id, arguments from ch1 x join ct m on m.session_id = x.session_id and (m.idx = 0 or m.idx between first_idx and end_idx)
    union all select x.session_id, label, n, true, m.idx, capped_turn, m.role, case when m.role = 'tool' then coalesce(capped, '') else content end, tool, m.call_id, arguments from ch1 x join ct m on m.session_id = x.session_id and label <> 'positive' and (m.idx = n and arguments is not null or m.idx = n + 1 and m.role = 'tool')
    union all select session_id, label, n, true, -2, {CALL_TURN}, 'assistant', null, 'mcp__bookmarks__checkpoint_progress', 'call_ckpt_' || n, call from ch1 where label = 'positive'
    union all select session_id, label, n, true, -1, {ACK_TURN}, 'tool', 'Checkpoint saved. Prior exploration may now be condensed.', 'mcp__bookmarks__checkpoint_progress', 'call_ckpt_' || n, null from ch1 where label = 'positive'
    union all select x.session_id, label, n, true, m.idx, capped_turn, m.role, case when m.role = 'tool' then capped else content end, tool, m.call_id, arguments from ch1 x join nc on nc.session_id = x.session_id and nc.chunk = n join ct m on m.session_id = x.session_id and label = 'positive' and (m.idx = nc.call_idx or m.idx = nc.call_idx + 1 and m.role = 'tool')),
  pl as (select session_id, label, n, '<|im_start|>system' || chr(10) || 'Tools: Bash, Read, Edit, Grep<|im_end|>' || chr(10) || string_agg(turn, '' order by ord) filter (not done) || '<|im_start|>assistant' || chr(10) as prompt, substr(string_agg(turn, '' order by ord) filter (done), 23) as completion,
    string_agg(role || '|' || coalesce(content, '-') || '|' || case when arguments is null then '-|-|-' else call_id || '|' || tool || '|' || arguments end || '|' || case when role = 'tool' then call_id || '|' || tool else '-|-' end, chr(10) order by done, ord) as messages from pm group by 1, 2, 3)
  select prompt, completion, messages, label, session_id as source_session, case label when 'positive' then ch1.at end as checkpoint_step, progress_type, case label when 'negative' then ch1.at end as negative_anchor_idx, n_tokens, n_context as n_context_msgs from ch1 join pl using (session_id, label, n)"""


query("rn5_chat_messages", f"with {ALL}, {CM} select session_id, idx, role, content, tool, call_id, arguments, step from cm")(_chat)
query("rn8_completions", f"with {ALL}, {CM} select session_id, chunk, -2::bigint as idx, 'assistant' as role, null as content, call as arguments, 'mcp__bookmarks__checkpoint_progress' as tool from ca union all select session_id, chunk, -1, 'tool', 'Checkpoint saved. Prior exploration may now be condensed.', null, 'mcp__bookmarks__checkpoint_progress' from ca union all select nc.session_id, chunk, m.idx, m.role, case when m.role = 'tool' then capped else content end, arguments, tool from nc join ct m on m.session_id = nc.session_id and (m.idx = nc.call_idx or m.idx = nc.call_idx + 1 and m.role = 'tool')")(
    lambda s, d: render.completion_messages(_chat(s, d), annotate.annotate(V.trace(s, d)))
)
query("rn6_chunk_rows", f"with {ALL}, {chunks_sql(8192, TURNS, f'floor(length({CALL_TURN}) / 4) + floor(length({ACK_TURN}) / 4)', 14)}, {ROWS}")(_rows)
query("rn7_chunks", f"with {ALL}, {chunks_sql(8192)} select * from ch")(_chunks)
query("rn11_chunks_small_budget", f"with {ALL}, {chunks_sql(1500)} select * from ch")(lambda s, d: _chunks(s, d, budget=1500))
query("rn10_cold_starts", f"with {ALL}, {chunks_sql(8192)} select * from cs")(lambda s, d: render.cold_starts(_chat(s, d)))
query("sl7_negative_anchors", f"with {ALL}, {chunks_sql(8192)} select * from ng")(lambda s, d: (lambda m, c: render.negative_candidates(m, render.anchors(m, c)))(*_inputs(s, d)))
query("jn5_anchor_messages", f"with {ALL}, {CM} select session_id, after_step, progress_type, anchor_idx, chunk from ca")(lambda s, d: render.anchors(_chat(s, d), annotate.annotate(V.trace(s, d))).select("session_id", "after_step", "progress_type", "anchor_idx", "chunk"))
query("ag21_chunk_totals", f"with {ALL}, {chunks_sql(8192)}, l as (select list(n_tokens order by n_tokens) as l, count(*) filter (label = 'positive') as positive, count(*) filter (label = 'negative') as negative, count(*) filter (label = 'cold_start') as cold_start from ch) select positive, negative, cold_start, l[1] as min, l[1 + floor(len(l) * 0.25)::int] as p25, l[1 + floor(len(l) * 0.5)::int] as p50, l[1 + floor(len(l) * 0.75)::int] as p75, l[1 + floor(len(l) * 0.95)::int] as p95, l[len(l)] as max from l")(
    lambda s, d: render.chunk_totals(_chunks(s, d))
)
query("rn9_chunk_messages", f"with {ALL}, {chunks_sql(8192)}, x as (select *, case label when 'negative' then end_idx + 1 when 'cold_start' then ch.at end as call from ch) select x.session_id, label, x.at, m.idx, false as done, m.role, m.content, m.arguments from x join ct m on m.session_id = x.session_id and (m.idx = 0 or m.idx between x.first_idx and x.end_idx) union all select x.session_id, label, x.at, m.idx, true, m.role, case when m.role = 'tool' then capped else content end, m.arguments from x join ct m on m.session_id = x.session_id and (m.idx = x.call and m.arguments is not null or m.idx = x.call + 1 and m.role = 'tool')")(
    lambda s, d: (lambda m, c: render.chunk_messages(m, render.chunks(m, c)))(*_inputs(s, d))
)
query("flt11_unknown_tools", f"with {V.TRACE} select session_id, list_sort(list(distinct tool_name) filter (tool_name not in ('Bash', 'Read', 'Edit', 'Grep', 'Glob', 'mcp__bookmarks__checkpoint_progress'))) as unknown from trace where role = 'tool' group by 1")(
    lambda s, d: render.unknown_tools(_chat(s, d), ["Bash", "Read", "Edit", "Grep", "Glob", "mcp__bookmarks__checkpoint_progress"])
)
# Greedy wrap of lines whose words are short and stand apart by one space, as those of the traces do.
_line = lambda c: f"case when length({c}) <= 110 then {c} else list_reduce(string_split({c}, ' '), lambda a, w: case when length(regexp_extract(a, '[^' || chr(10) || ']*$')) + 1 + length(w) <= 110 then a || ' ' || w else a || chr(10) || w end) end"
_wrap = lambda c, n: f"replace(array_to_string(list_transform(string_split(regexp_replace({c}, chr(10) || '$', ''), chr(10)), lambda x: {_line('x')}), chr(10)), chr(10), chr(10) || repeat(' ', {n}))"
_over = lambda c, n, what: f"left({c}, {n}) || case when length({c}) > {n} then '  (…' || (length({c}) - {n}) || ' more{what})' else '' end"
REVIEW = f"""v as (select t.session_id, t.idx, role, tool_name, '[' || lpad(t.idx::varchar, greatest(3, length(t.idx::varchar))::int, ' ') || '] ' as n, case when ex.expire is not null then '  ◀── EXPIRE (step ' || t.idx || ')' else '' end as badge, {_over("text", 300, "")} as text, {_over("cmd", 200, "")} as cmd, {_over("output", 300, " chars")} as output from trace t left join ex on ex.session_id = t.session_id and ex.expire = t.idx),
  b as (select session_id, after_step as idx, '━━━━━━━━━━  CHECKPOINT after step ' || after_step || '  [' || progress_type || ']  ━━━━━━━━━━' as head, finding, evidence, next_direction from ann),
  f as (select session_id, idx, string_agg(chr(10) || head || chr(10) || '  finding:   ' || {_wrap("finding", 13)} || chr(10) || '  evidence:  ' || {_wrap("evidence", 13)} || chr(10) || '  next:      ' || {_wrap("next_direction", 13)} || chr(10) || repeat('━', length(head)) || chr(10), '') as fires from b group by 1, 2)"""
query("rn12_review", f"with {ALL}, {EXP}, {REVIEW} select session_id, idx, n || case role when 'tool' then 'TOOL  ' || tool_name || badge || chr(10) || '    cmd: ' || {_wrap('cmd', 4)} || case when output <> '' then chr(10) || '    out: ' || {_wrap('output', 4)} else '' end else case role when 'user_text' then 'USER' else 'ASST' end || ' TEXT' || badge || chr(10) || '    ' || {_wrap('text', 4)} end as entry, fires from v left join f using (session_id, idx)")(
    lambda s, d: (lambda t: render.review(t, annotate.annotate(t), annotate.stale_outputs(t)))(stored(V.trace(s, d)))
)


def _dataset(s, d):
    """Traces in the shape of datasets with paired tool uses."""
    t = V.trace(s, d)
    q = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    k = F.col("k").cast("string")
    out = F.when(F.col("k") % 3 == 0, q('{"text":"t', k, '"}')).when(F.col("k") % 3 == 1, q('["l', k, '",{"content":"c"},{"text":"x"}]')).otherwise(q('"plain ', k, '"'))
    given = F.when(F.col("k") % 4 == 0, q('{"command":"","path":"p', k, '"}')).when(F.col("k") % 4 == 1, q('{"other":', k, "}")).otherwise(q('{"file_path":"f', k, '","command":"c', k, '"}'))
    message = F.when(F.col("role") == "tool", q('{"role":"assistant","content":"left out","tool_uses":[{"tool":"', F.col("tool_name"), '","input":', given, ',"output":', out, "}]}")).otherwise(q('{"role":"', F.when(F.col("role") == "user_text", "user").otherwise("model"), '","content":"', F.when(F.col("k") % 5 == 0, "  ").otherwise(q(" say ", k, " ")), '"}'))
    rows = t.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", message.alias("m")))), lambda x: x["m"]), ",").alias("m"))
    return rows.select("session_id", q("[", F.col("m"), "]").alias("messages"))


query(
    "nrm9_tool_use_sessions",
    f"""with {V.TRACE}, v as (select *, (row_number() over (partition by session_id order by idx) - 1)::bigint as n, bool_or(role = 'tool') over (partition by session_id) as any_tool from trace where role = 'tool' or k % 5 <> 0)
    select session_id, n as idx, role, tool_name, case when role <> 'tool' then '' when k % 4 = 0 then 'p' || k when k % 4 = 1 then '{{"other":' || k || '}}' else 'c' || k end as cmd, case when role <> 'tool' then '' when k % 3 = 0 then 't' || k when k % 3 = 1 then 'l' || k || chr(10) || 'c' || chr(10) || 'x' else 'plain ' || k end as output,
      case when role = 'tool' and k % 4 = 0 then 'p' || k when role = 'tool' and k % 4 > 1 then 'f' || k end as input_file, case when role = 'tool' then '' else 'say ' || k end as text from v where any_tool""",
)(lambda s, d: sessions.from_tool_uses(_dataset(s, d)))


def _replies(s, d):
    """A reply per step, fenced or broken by k."""
    q = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    k, i = F.col("k").cast("string"), F.col("idx").cast("string")
    events = q('{"events":[{"expire":', i, '},{"expire":"', k, '"},{"expire":"x"},{"expire":1,"checkpoint":{}},{"other":1},{"checkpoint":{"after_step":"', i, '","progress_type":"p","finding":"f', k, '"}},{"checkpoint":{"after_step":2}},{"checkpoint":7},5]}')
    return V.trace(s, d).select(q(F.col("session_id").cast("string"), "/", i).alias("session_id"), F.when(F.col("k") % 4 == 0, q("no JSON ", k)).when(F.col("k") % 4 == 1, q("```json\n", events, "\n```")).when(F.col("k") % 4 == 2, q("{broken ", k, "}")).otherwise(events).alias("reply"))


query(
    "nrm17_reply_events",
    f"with {V.TRACE}, v as (select session_id || '/' || idx as session_id, idx, k from trace where k % 4 in (1, 3)), n as (select null::varchar as z) select session_id, 0::bigint as pos, idx as expire, null::bigint as after_step, z as progress_type, z as finding, z as evidence, z as next_direction from v, n union all select session_id, 1, k, null, z, z, z, z from v, n union all select session_id, 5, null, idx, 'p', 'f' || k, '', '' from v",
)(lambda s, d: sessions.reply_events(_replies(s, d)))


def _calls(s, d):
    """Checkpoint calls with gaps by k."""
    k = F.col("k")
    part = lambda p, n: F.when(k % p != 0, F.concat(F.lit(n), k.cast("string")))
    return V.trace(s, d).select("session_id", "idx", F.when(k % 6 == 0, "other").when(k % 6 == 1, None).when(k % 6 < 4, "milestone_achieved").otherwise("approach_eliminated").alias("kind"), F.coalesce(part(5, "f"), F.lit(" \n")).alias("finding"), part(7, "e").alias("evidence"), F.coalesce(part(4, "n"), F.lit("")).alias("next_direction"))


query(
    "flt13_checkpoint_calls",
    f"""with {V.TRACE}, v as (select session_id, idx, k % 6 > 1 as kind, k % 5 <> 0 as f, k % 7 <> 0 as e, k % 4 <> 0 as n, k from trace), w as (select session_id, idx, list_filter([case when not kind then 'progress_type' end, case when not f then 'finding' end, case when not e then 'evidence' end, case when not n then 'next_direction' end], lambda x: x is not null) as missing, k from v)
    select session_id, idx, missing, case when len(missing) = 0 then case when k % 6 < 4 then 'Milestone' else 'Approach eliminated' end || ': f' || k || '. Evidence: e' || k || '. Next: n' || k || '. Prior exploration will be condensed for focus; the full history remains accessible via bookmark_recall.' end as ack from w""",
)(lambda s, d: (lambda c, m: c.select("session_id", "idx", m.alias("missing"), F.when(F.size(m) == 0, text.checkpoint_ack(*map(F.col, ("kind", "finding", "evidence", "next_direction")))).alias("ack")))(_calls(s, d), text.missing_fields(*map(F.col, ("kind", "finding", "evidence", "next_direction")))))


def _bookmark_events(s, d):
    k = F.col("k")
    return V.trace(s, d).select(F.col("session_id").alias("session"), F.col("idx").alias("seq"), F.when(k % 3 == 0, "mark").when(k % 3 == 1, "list").otherwise("recall").alias("kind"), F.concat(F.lit("n"), (k % 5).cast("string")).alias("name"), F.concat(F.lit("s"), k.cast("string")).alias("summary"))


query(
    "st8_bookmark_lists",
    f"with {V.TRACE}, m as (select session_id, idx, 'n' || (k % 5) as name, 's' || k as summary from trace where k % 3 = 0), l as (select session_id, idx from trace where k % 3 = 1), b as (select l.session_id, l.idx, name, arg_max(summary, m.idx) as summary, min(m.idx) as born from l join m on m.session_id = l.session_id and m.idx < l.idx group by 1, 2, 3), a as (select session_id, idx, count(*)::int as count, string_agg('- ' || name || ': ' || summary, chr(10) order by born) as listed from b group by 1, 2) select l.session_id as session, l.idx as seq, coalesce(count, 0) as count, coalesce(listed, '(no bookmarks saved yet)') as listed from l left join a using (session_id, idx)",
)(lambda s, d: state.bookmark_lists(_bookmark_events(s, d)))
query("so5_distinct_expires", f"with {V.TRACE}, {EXP} select session_id, list_sort(list(distinct expire)) as expires from ex group by 1")(lambda s, d: annotate.stale_outputs(V.trace(s, d)).groupBy("session_id").agg(F.array_sort(F.collect_set("expire")).alias("expires")))
query("jn4_step_checkpoints", f"with {ALL} select t.session_id, t.idx, list(progress_type order by progress_type) filter (progress_type is not null) as fires from trace t left join ann on ann.session_id = t.session_id and ann.after_step = t.idx group by 1, 2 having count(progress_type) > 0")(
    lambda s, d: V.trace(s, d).select("session_id", "idx").join(annotate.annotate(V.trace(s, d)).withColumnsRenamed({"after_step": "idx"}), ["session_id", "idx"]).groupBy("session_id", "idx").agg(F.array_sort(F.collect_list("progress_type")).alias("fires"))
)
