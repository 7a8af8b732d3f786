"""Shapes of messages, replies and bodies, and state machines against step-by-step simulations."""

import datetime
import json
import random

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import annotate, normalize, render, rewrite, runs, state
from tracewright.sources import readers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_usage(spark):
    assert one(spark, '{"usage":{"input_tokens":5,"output_tokens":2}}', text.extract_usage).input_tokens == 5
    body = 'event: x\ndata: {"type":"message_start","message":{"usage":{"input_tokens":7,"cache_read_input_tokens":3}}}\ndata: {"usage":{"output_tokens":9}}\ndata: [DONE]'
    got = one(spark, body, text.extract_usage)
    assert (got.input_tokens, got.cache_read, got.output_tokens) == (7, 3, None)
    assert one(spark, "data: {broken", text.extract_usage) is None
    assert one(spark, None, text.extract_usage) is None
    long = '{"content":"' + "x" * 40000 + '","usage":{"input_tokens":8}}'
    assert one(spark, long, text.extract_usage).input_tokens == 8
    assert one(spark, long, lambda c: text.extract_usage(c, most=32768)) is None
    assert one(spark, 'data: {"usage":3}\ndata:  {"usage":{"output_tokens":2}} ', text.extract_usage).output_tokens == 2


def test_tool_call(spark):
    got = one(spark, "x <tool_call>\n<function=Bash>\n<parameter=command>\n ls \n</parameter><parameter=a>1</parameter><parameter=a>2</parameter></function></tool_call>", text.parse_tool_call)
    assert (got.name, got.arguments) == ("Bash", {"command": "ls", "a": "2"})
    assert one(spark, "none", text.parse_tool_call) is None


def test_verdict(spark):
    got = one(spark, "should_checkpoint: yes\nREASON: because\nSUMMARY: a\nb ", text.parse_verdict)
    assert (got.should, got.reason, got.summary) == ("YES", "because", "a\nb")
    assert one(spark, "SHOULD_CHECKPOINT: YESTERDAY", text.parse_verdict).should is None


def test_utf16(spark):
    assert one(spark, "a\U0001d4b3", text.utf16_length) == 3


def test_tool_class(spark):
    assert [one(spark, n, text.tool_class) for n in ("Bash", "Glob", "Other", None)] == ["bash", "search", "other", "other"]


def test_tool_calls(spark):
    use = lambda i, c: {"type": "tool_use", "id": i, "name": "Bash", "input": {"command": c}}
    res = lambda i, t: {"type": "tool_result", "tool_use_id": i, "content": [{"type": "text", "text": t}]}
    msgs = [
        ("user", "fix it"), ("assistant", json.dumps([{"type": "thinking", "thinking": "hm"}, use("a", "make"), use("b", "ls"), use("c", "pwd")])),
        ("user", json.dumps([res("b", "files"), res("a", "fail"), res("zz", "ignored")])),
    ]
    df = spark.createDataFrame([(1, i, r, c) for i, (r, c) in enumerate(msgs)], "req int, idx int, role string, content string")
    got = [(r.seq, r.id, r.cmd, r.output, r.thinking) for r in normalize.tool_calls(df).orderBy("seq").collect()]
    assert got == [(0, "b", "ls", "files", None), (1, "a", "make", "fail", "hm"), (2, "c", "pwd", "", None)]
    assert normalize.recent_tools(df).first().tools == ["Bash: make", "Bash: ls", "Bash: pwd"]


def test_pairing_simulation(spark):
    rng = random.Random(1)
    rows, want = [], []
    for req in range(60):
        pending, out = {}, []
        for o in range(rng.randint(0, 12)):
            i, kind = rng.choice("ab"), rng.choice(["use", "result"])
            rows.append((req, i, o, kind))
            if kind == "use":
                pending[i] = o
            elif i in pending:
                out.append((i, pending.pop(i), o))
        out += [(i, o, None) for i, o in pending.items()]
        want += [(req, n, *x) for n, x in enumerate(out)]
    df = spark.createDataFrame(rows, "req int, id string, ord long, kind string")
    assert sorted(tuple(r) for r in normalize.pair_calls(df).collect()) == sorted(want)


def test_deduplicate_simulation(spark):
    rng = random.Random(2)
    rows, want = [], []
    for s in range(60):
        at = sorted({rng.randint(0, 15) for _ in range(rng.randint(1, 9))})
        rows += [(s, a, "milestone_achieved", "M1") for a in at]
        last = None
        for a in at:
            if last is None or a - last > 1:
                want.append((s, a))
                last = a
    df = spark.createDataFrame(rows, "session_id int, after_step long, progress_type string, detector string")
    assert sorted((r.session_id, r.after_step) for r in annotate.deduplicate(df).collect()) == sorted(want)


MESSAGE = "req int, idx long, role string, content string"


def use(i, name="Bash", **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(i, content, **more):
    return {"type": "tool_result", "tool_use_id": i, "content": content, **more}


def table(spark, *requests):
    rows = [(n, i, role, c if c is None or isinstance(c, str) else json.dumps(c, separators=(",", ":"), ensure_ascii=False)) for n, messages in enumerate(requests) for i, (role, c) in enumerate(messages)]
    return spark.createDataFrame(rows, MESSAGE)


def read(df, order="idx"):
    out = {}
    for r in df.orderBy("req", order).collect():
        out.setdefault(r.req, []).append((r.role, json.loads(r.content) if (r.content or "").startswith(("[{", "[]")) else r.content))
    return out


LONG = "\n".join(f"line {i}" for i in range(200))
SHORT = "[COMPACTED — 200 lines → 40]\n" + "\n".join(f"line {i}" for i in range(30)) + "\n\n[... 160 lines compacted ...]\n\n" + "\n".join(f"line {i}" for i in range(190, 200))


def test_compact(spark):
    old = [("user", "go"), ("assistant", [use("a"), use("b", "Read"), use("c")]), ("user", [result("a", LONG, is_error=False, cache_control={"type": "ephemeral"}), result("b", LONG), result("c", [{"type": "text", "text": LONG}]), result("zz", LONG)])]
    df = table(spark, [*old, ("assistant", "x"), ("assistant", [use("d")]), ("user", [result("d", LONG)])], [*old, ("assistant", "x")], [("user", None), ("assistant", "[not json")])
    out = rewrite.compact(df)
    got = read(out)
    assert got[0][2][1] == [result("a", SHORT, is_error=False, cache_control={"type": "ephemeral"}), result("b", LONG), result("c", SHORT), result("zz", LONG)]
    assert got[0][5] == ("user", [result("d", LONG)]) and got[1] == read(df)[1] and got[2][0] == ("user", None)
    row = out.where("n_compacted > 0").first()
    assert (row.n_compacted, row.tokens_saved) == (2, 2 * int((len(LONG) - len(SHORT)) / 4 + 0.5))
    assert read(rewrite.compact(out)) == got
    assert rewrite.compact(df.limit(0)).count() == 0


def test_rewind(spark):
    mark = lambda i, **given: use(i, "mcp__any__checkpoint_progress", **given)
    step = lambda i: [("assistant", [use(i)]), ("user", [result(i, "r")])]
    first = [mark("k", progress_type="milestone_achieved", finding="F", evidence="", next_direction="N")]
    second = [{"type": "text", "text": "so"}, use("q", "checkpoint_progress", summary="old")]
    df = table(
        spark,
        [("user", "goal"), *step("a"), *step("b"), ("assistant", first), ("user", [result("k", "ok")]), *step("c"), ("assistant", second), ("assistant", "end")],
        [("user", "goal"), *step("a")],
        [("user", "goal"), ("assistant", first), ("user", "ok"), ("assistant", [mark("z", finding="only")])],
        [("user", "g"), *step("a"), ("assistant", [use("n", "xcheckpoint_progress")])],
    )
    got = read(rewrite.renumber(rewrite.rewind(df)))
    note = lambda t: ("user", [{"type": "text", "text": f"[Previous exploration elided — agent summary: {t}]"}])
    assert got[0] == [("user", "goal"), note("Milestone: F. Next: N"), ("assistant", first), ("user", [result("k", "ok")]), note("old"), ("assistant", second), ("assistant", "end")]
    assert all(got[i] == read(df)[i] for i in (1, 2, 3))
    gone = sorted((r.req, r.anchor_idx, r.turns_elided, r.bytes_saved, r.summary) for r in rewrite.elisions(df).collect())
    sent = [{"role": r, "content": c} for r, c in read(df)[0]]
    size = lambda a, b: len(json.dumps(sent[a:b], separators=(",", ":")))
    assert gone == [(0, 5, 4, size(1, 5), "Milestone: F. Next: N"), (0, 9, 2, size(7, 9), "old")]


def test_judge_rewind(spark):
    step = lambda i: [("assistant", [use(i)]), ("user", [result(i, "r")])]
    cases = [
        [("user", "goal"), *step("a"), *step("b"), ("assistant", "done")],
        [("user", "goal"), *step("a"), ("assistant", "x")],
        [("user", "goal"), *step("a"), ("assistant", [use("b"), use("c")]), ("user", [result("b", "r")])],
        [("user", "goal"), ("assistant", "a"), ("user", "b"), ("assistant", "c")],
        [("user", "goal"), *step("a"), ("user", [result("b", "r")])],
        [("user", "goal"), *step("a"), *step("b")],
    ]
    df = table(spark, *cases)
    said = spark.createDataFrame([(i, "S" if i < 5 else "") for i in range(6)], "req int, summary string")
    out = rewrite.judge_rewind(df, said)
    got = read(rewrite.renumber(out))
    text_ = "[Checkpoint note from your prior reasoning — prior exploration elided]\nS\n\nThe next messages show the most-recent verification evidence. Continue with any remaining work from the original task."
    assert got[0] == [("user", "goal"), ("user", [{"type": "text", "text": text_}]), *step("b"), ("assistant", "done")]
    assert all(got[i] == cases[i] for i in range(1, 6))
    assert {r.req: r.n_elided for r in out.collect()} == {0: 2, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}


def test_harness_rewind(spark):
    many = [("system", "s"), ("user", "goal"), ("assistant", "1"), ("tool", "r1"), ("assistant", "2"), ("tool", "r2"), ("assistant", "tail")]
    df = table(spark, many, many[:3], many[:4])
    said = spark.createDataFrame([(i, "S") for i in range(3)], "req int, summary string")
    out = rewrite.harness_rewind(df, said)
    got = read(rewrite.renumber(out))
    note = ("user", None)
    assert [r for r, _ in got[0]] == ["system", "user", "assistant", "tool", "user"] and [c for _, c in got[0]][:4] == ["s", "goal", "2", "r2"] and note[1] is None
    assert rewrite.renumber(out).where("req = 0 and idx = 4").first().content.startswith("[Checkpoint note from your prior reasoning]\nS\n\nThe turn immediately above")
    assert got[1] == many[:3] and len(got[2]) == 5
    assert {r.req: r.n_elided for r in out.collect()} == {0: 2, 1: 0, 2: 0}


def test_cache_mark(spark):
    cc = {"cache_control": {"type": "ephemeral"}}
    df = table(spark, [("user", "a"), ("assistant", "b"), ("user", "c")], [("user", [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]), ("user", "z")], [("user", "only")], [("user", []), ("user", "z")])
    got = read(rewrite.cache_mark(df))
    assert got[0] == [("user", "a"), ("assistant", [{"type": "text", "text": "b", **cc}]), ("user", "c")]
    assert got[1][0] == ("user", [{"type": "text", "text": "x"}, {"type": "text", "text": "y", **cc}])
    assert got[2] == [("user", [{"type": "text", "text": "only", **cc}])] and got[3][0] == ("user", [])


def test_last_turn_calls(spark):
    df = table(spark, [("user", "g"), ("assistant", [use("a"), use("b")]), ("user", [result("a", "1"), result("a", "2")])], [("assistant", [use("a")]), ("assistant", "text")])
    got = sorted((r.req, r.id, r.name, r.output) for r in normalize.last_turn_calls(df).collect())
    assert got == [(0, "a", "Bash", "2"), (0, "b", "Bash", "")]


def test_inject(spark):
    t = "array<struct<type:string,trigger:bigint,keep:bigint,clear_at_least:bigint,exclude_tools:array<string>>>"
    df = spark.createDataFrame([(None,), ([("other", 1, 1, 1, None)],)], f"e {t}")
    out = [r.x for r in df.select(rewrite.inject_clear(F.col("e")).alias("x")).collect()]
    assert [len(x) for x in out] == [1, 2]
    assert out[1][0].type == "other"


def test_patch_verdict(spark):
    p = spark.createDataFrame([("a", "+++ b/x.c\n+good"), ("a", ""), ("a", "+++ b/y.c"), ("z", "d")], "task string, diff string")
    h = spark.createDataFrame([("a", ["x.c"], ["good"])], "task string, files array<string>, keywords array<string>")
    assert sorted(r.verdict for r in runs.patch_verdict(p, h).collect()) == ["no_heuristic", "no_patch", "ok", "wrong_area"]


def test_readers(spark, tmp_path):
    d = tmp_path / "run_001"
    (d / "t1").mkdir(parents=True)
    (d / "run.log").write_text("hello\n[1] run_id=run_001 proxy=on rewind=off rewind_hint=off\n")
    (d / "t1" / "summary_2.json").write_text(json.dumps({"task_id": "t1", "total_cost_usd": 0.5, "num_turns": 3}, indent=1))
    (d / "t1" / "transcript_2.jsonl").write_text('{"type":"x"}\nbad\n{"type":"result","num_turns":4}\n{"type":"result","num_turns":5}\n')
    ev = tmp_path / "events.jsonl"
    ev.write_text('{"type":"cache_stats","timestamp":1,"input_tokens":3}\n\nbroken\n{"type":"compact","timestamp":2}\n')
    root = str(tmp_path)
    assert readers.run_config(spark, root).first().proxy == "on"
    s = readers.summaries(spark, root).first()
    assert (s.run, s.task, s.rep, s.num_turns) == ("run_001", "t1", 2, 3)
    assert readers.last_result(spark, root).first().num_turns == 5
    assert [r.type for r in readers.telemetry(spark, str(ev)).orderBy("line").collect()] == ["cache_stats", "compact"]
    f = tmp_path / "s.jsonl"
    f.write_text('{"session_id":"a","steps":[],"checkpoints":[{"after_step":2}],"expire_step_ids":[2,1]}\n')
    e = readers.sessions(spark, str(f)).first().events
    assert [(x.expire, x.checkpoint and x.checkpoint.after_step) for x in e] == [(1, None), (2, None), (None, 2)]


STEP = "session_id int, idx long, role string, tool_name string, cmd string, output string, input_file string"


def simulate(steps):
    """The annotator step by step."""
    import re

    rx = re.compile(r"\b(error|exception|traceback|undefined|cannot find|failed|fatal|not found|syntax error|unresolved|permission denied|no such file|abort|segmentation fault|command not found)\b", re.I)
    bad = lambda t: bool(rx.search(t))
    err = lambda t: next((x.strip()[:120] for x in t.split("\n") if x.strip() and bad(x)), next((x.strip()[:120] for x in t.split("\n") if x.strip()), ""))
    raw, reads, fired, history, seen, edited = [], [], False, {}, {}, {}
    for idx, role, tool, cmd, out, file in steps:
        if role != "tool":
            continue
        if tool in ("Read", "Grep", "Glob"):
            reads.append(file or cmd)
        if tool in ("Edit", "Write", "MultiEdit"):
            f = file or cmd
            if len(reads) >= 2 and not fired:
                fired = True
                raw.append((idx, 0, 0, f"First edit to {f} after exploring {len(reads)} file(s) — likely identified fix location.", f"Read/Grep steps: {'; '.join(reads[-5:][:3])}. Edit target: {f}."[:400]))
            if f:
                if f in edited and idx - edited[f] <= 4:
                    raw.append((idx, 1, 4, f"Re-edited {f} within {idx - edited[f]} steps — prior attempt wasn't right.", "Same file edited twice in short succession"))
                edited[f] = idx
        if tool == "Bash":
            sig = " ".join(cmd.split()[:3])[:80]
            if sig:
                h = history.setdefault(sig, [])
                if any(map(bad, h)) and not bad(out):
                    raw.append((idx, 0, 1, f"`{sig}` now succeeds after {len(h)} prior failure(s).", err(h[-1])[:300]))
                    h.clear()
                h.append(out)
            if bad(out) and sig and err(out):
                key = (sig, err(out)[:60])
                seen[key] = seen.get(key, 0) + 1
                if seen[key] == 2:
                    raw.append((idx, 1, 2, f"Same error from `{sig}` repeated — current approach isn't fixing it.", f"Error signature: {err(out)[:200]}"))
            if re.search(r"\bgit (revert|reset --?hard|stash|checkout --? )|\bundo\b|rollback", cmd, re.I):
                raw.append((idx, 1, 3, "Explicit rollback — prior edits didn't work.", f"Rollback command: {cmd[:200]}"))
    kept = []
    for c in sorted(raw, key=lambda c: c[:3]):
        if not kept or c[0] - kept[-1][0] > 1:
            kept.append(c)
    return [(c[0], c[3], c[4]) for c in kept]


def test_annotate_simulation(spark):
    rng = random.Random(11)
    cmds = ["make all", "make  all", "", "git stash", "ls a b c d", "x" * 300]
    outs = ["ok", "boom\n error: cannot find it", "failed", "", "panic", "y" * 200 + " error", "no such file\n"]
    rows, want = [], []
    for s in range(120):
        steps, idx = [], 0
        for _ in range(rng.randint(0, 25)):
            tool = rng.choice(["Bash", "Bash", "Bash", "Read", "Grep", "Edit", "Write", "Other"])
            steps.append((idx, rng.choice(["tool"] * 9 + ["user_text"]), tool, rng.choice(cmds) if tool == "Bash" else rng.choice(["p", "q", ""]), rng.choice(outs), rng.choice([None, "f.py", ""])))
            idx += rng.choice([1, 1, 1, 2])
        rows += [(s, *x) for x in steps]
        want += [(s, *x) for x in simulate(steps)]
    got = [(r.session_id, r.after_step, r.finding, r.evidence) for r in annotate.annotate(spark.createDataFrame(rows, STEP)).collect()]
    assert sorted(got) == sorted(want)


def test_sessions_of_other_shapes(spark):
    from tracewright.operators import sessions

    messages = json.dumps([{"role": "user", "content": " go "}, {"role": "assistant", "content": "x", "tool_uses": [{"tool": "Bash", "input": {"command": "ls"}, "output": {"text": "a"}}, "bad", {"tool": "Read", "input": {"path": "p"}, "output": [{"content": "1"}, "2"]}]}, {"role": "user", "content": " "}, {"role": "bot", "content": "done", "tool_uses": []}])
    df = spark.createDataFrame([(1, messages), (2, '[{"role":"user","content":"only"}]'), (3, "broken"), (4, None)], "session_id int, messages string")
    got = [tuple(r) for r in sessions.from_tool_uses(df).orderBy("idx").collect()]
    assert got == [(1, 0, "user_text", "", "", "", None, "go"), (1, 1, "tool", "Bash", "ls", "a", None, ""), (1, 2, "tool", "Read", "p", "1\n2", "p", ""), (1, 3, "assistant_text", "", "", "", None, "done")]
    reply = 'Sure:\n{"events": [{"expire": 3}, {"expire": 4.7}, {"expire": "a"}, {"checkpoint": {"after_step": 5, "progress_type": "m", "evidence": 2}}]} ok'
    replies = spark.createDataFrame([(1, reply), (2, "none"), (3, None), (4, '{"events": 3}')], "session_id int, reply string")
    got = [tuple(r) for r in sessions.reply_events(replies).orderBy("pos").collect()]
    assert got == [(1, 0, 3, None, None, None, None, None), (1, 1, 4, None, None, None, None, None), (1, 3, None, 5, "m", "", "2", "")]


def test_headers(spark):
    df = spark.createDataFrame([({"Authorization": "a", "Cookie": "c", "x-api-key": "k"},), (None,)], "h map<string,string>")
    got = [r.o for r in df.select(text.passed_headers(F.col("h")).alias("o")).collect()]
    own = {"content-type": "application/json", "accept": "application/json", "accept-encoding": "identity"}
    assert got == [own | {"Authorization": "a", "x-api-key": "k"}, own]


def test_formatters(spark):
    from tracewright.functions import stats

    rows = [(None,), (float("nan"),), (0.0,), (59.4,), (63.0,), (90.0,), (2500.0,), (1234567.0,), (-0.3,), (-1500.0,)]
    v = F.col("v")
    got = spark.createDataFrame(rows, "v double").select(*[f(v) for f in (stats.fmt_duration, stats.fmt_int, stats.money, stats.fmt_usd, stats.fmt_seconds, stats.fmt_k)]).collect()
    miss = lambda x: x is None or x != x

    def k(x):
        return f"{x / 1e6:.2f}M" if abs(x) >= 1e6 else f"{x / 1e3:.0f}K" if abs(x) >= 1e3 else f"{x:.0f}"

    for (x,), r in zip(rows, got):
        want = ["—"] * 6 if miss(x) else [f"{x:.0f}s" if x < 60 else f"{x / 60:.1f}m", f"{x / 1000:.0f}k" if x >= 1000 else f"{x:.0f}", f"${x:.2f}", f"${x:.3f}", f"{x / 1000:.0f}s", k(x)]
        assert list(r) == want, x
    pairs = [(100.0, 99.7), (100.0, 150.0), (0.0, 5.0), (None, 5.0), (3.0, 1.0), (8.0, 9.0)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a double, b double").select(stats.delta_pct(F.col("a"), F.col("b"))).collect()]
    assert got == [f"{(b - a) / a * 100:+.0f}%" if a else "—" for a, b in pairs]
    assert one(spark, "1234567", lambda x: stats.thousands(x.cast("double"))) == "1.23M" and one(spark, "12345", lambda x: stats.thousands(x.cast("double"))) == "12.3K"


def test_runs_of_task(spark):
    r = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (None, "a"), (3, None)], "run int, task string")
    assert sorted((x.run, x.task) for x in runs.of_task(r, "a").collect()) == [(1, "a"), (1, "b")]
    assert {x.task for x in runs.task_names(r, r.where("run = 2")).collect()} == {"a", "b", None}
    assert runs.task_names(r.limit(0), r.limit(0)).count() == 0


def test_sessions_without_unknown_tools_have_null(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "Bash"), (1, 2, "tool", "Bash"), (2, 1, "assistant", "Glob"), (2, 2, "tool", "Glob"), (2, 3, "assistant", "Abc"), (3, 0, "user", None), (4, 0, "tool", None)]
    df = spark.createDataFrame(rows, "session_id long, idx long, role string, tool string")
    got = {r.session_id: r.unknown for r in render.unknown_tools(df, ["Bash", "Read"]).collect()}
    assert got == {1: None, 2: ["Abc", "Glob"], 4: None}


def test_unknown_tools_equal_their_sql_where_all_are_known(spark, tmp_path):
    """A session whose tools are all known, and one of a single text: as the SQL says, null and no row."""
    import duckdb

    from tracewright.plans import registry

    day = datetime.datetime(2024, 1, 1)
    events = [(i, day + datetime.timedelta(minutes=i), u, kind, 0.0, json.dumps({"k": k})) for i, (u, kind, k) in enumerate([(1, "click", 1), (1, "click", 2), (2, "view", 1), (2, "view", 2), (3, "view", 1)])]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(registry.ORACLES["flt11_unknown_tools"]).fetchall())
    got = sorted((r.session_id, r.unknown) for r in registry.QUERIES["flt11_unknown_tools"](spark, str(tmp_path)).select("session_id", "unknown").collect())
    assert got == want == [(1, None), (2, ["read_file"])]
