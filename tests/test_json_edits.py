"""Edits of JSON texts, lossless; the small parsers' rules; wrapped reviews."""

import json
import random

from pyspark.sql import functions as F

from tracewright.functions import jsontext, text
from tracewright.operators import normalize, rewrite, runs
from tracewright.sources import wire


def any_json(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind < 2:
        return rng.choice(["", "a", 'q"', "\\", "{", "}]", ",", ":", '"content":', "é𝒳", "\n"]) * rng.randint(0, 3)
    if kind < 5:
        return rng.choice([1, -2.5, 1e30, True, None, 0])
    if kind == 5:
        return [any_json(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["content", "a", "b", "type", ""]): any_json(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def test_a_member_is_set_and_all_else_stays(spark):
    rng = random.Random(4)
    objects = [{k: any_json(rng) for k in rng.sample(["content", "a", "type", "b", "content "], rng.randint(0, 4))} for _ in range(400)]
    texts = [json.dumps(o, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]), separators=rng.choice([(",", ":"), (" , ", " : ")])) for o in objects]
    new = '{"x":[1.50,"\\u0041"]}'
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("o", jsontext.with_member(F.col("t"), "content", F.lit(new))).withColumn("m", jsontext.member(F.col("t"), "content"))
    for r in df.collect():
        want = objects[r.i] | {"content": json.loads(new)}
        assert json.loads(r.o) == want and list(json.loads(r.o)) == list(want)
        if "content" in objects[r.i]:
            assert json.loads(r.m) == objects[r.i]["content"] and r.m in r.t
            head, tail = r.o.split(new)
            assert r.t.startswith(head) and r.t.endswith(tail) and len(head) + len(tail) + len(r.m) <= len(r.t)
        else:
            assert r.m is None
    odd = spark.createDataFrame([(None,), ("",), ("[1]",), ("7",)], "t string").select("t", jsontext.with_member(F.col("t"), "a", F.lit("1")).alias("o"))
    assert all(r.t == r.o for r in odd.collect())


def test_compaction_keeps_unknown_fields(spark):
    long = "\\n".join(["line"] * 80)
    use = '[{"type":"tool_use","id":"c","name":"Bash","input":{}}]'
    block = '{"z":1.50,"type":"tool_result" , "content":"%s","tool_use_id":"c","extra":{"content":["a",{}]},"is_error":null}' % long
    rows = [(1, 0, "assistant", use), (1, 1, "user", f"[{block}]"), (1, 2, "assistant", "x"), (1, 3, "assistant", "y"), (1, 4, "user", "z")]
    df = spark.createDataFrame(rows, "req int, idx int, role string, content string")
    got = json.loads({r.idx: r.content for r in rewrite.compact(df).collect()}[1])[0]
    want = json.loads(block)
    assert list(got) == list(want) and {k: v for k, v in got.items() if k != "content"} == {k: v for k, v in want.items() if k != "content"}
    assert got["content"].startswith("[COMPACTED — 80 lines → 40]\nline\n")
    again = spark.createDataFrame([(r.req, r.idx, r.role, r.content) for r in rewrite.compact(df).collect()], df.schema)
    assert sorted(rewrite.compact(again).select(df.columns).collect()) == sorted(again.collect())


def test_inject(spark):
    edit = json.loads(rewrite.inject_text())
    old = {"type": "clear_thinking_20251015"}
    cases = [({}, [edit]), ({"context_management": {"edits": [old], "k": 1}}, [old, edit]), ({"context_management": {"edits": []}}, [edit]), ({"context_management": None}, [edit]), ({"context_management": {"edits": 5}}, [edit]), ({"context_management": {"edits": [{"type": edit["type"], "keep": 9}]}}, None), ({"m": {"context_management": {}}, "a": "}"}, [edit])]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, "no json"), (98, None)], "i int, body string").withColumn("o", rewrite.inject(F.col("body")))
    got = {r.i: r for r in df.collect()}
    assert got[99].o == "no json" and got[98].o is None
    for i, (c, edits) in enumerate(cases):
        if edits is None:
            assert got[i].o == got[i].body
        else:
            out = json.loads(got[i].o)
            assert out["context_management"]["edits"] == edits
            assert {k: v for k, v in out.items() if k != "context_management"} == {k: v for k, v in c.items() if k != "context_management"}
            assert (out["context_management"] or {}).get("k") == (c.get("context_management") or {}).get("k")


def test_forwarded_bodies_keep_what_is_not_rewritten(spark):
    body = json.dumps({"model": "m", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a", "n": 1}]}], "metadata": {"x": [1, 2]}})
    df = spark.createDataFrame([(1, body), (2, '{"model":"other"}'), (3, "broken")], "req int, body string")
    got = {r.req: r.body for r in rewrite.forward(df).collect()}
    out = json.loads(got[1])
    assert {k: out[k] for k in ("model", "messages", "metadata")} == json.loads(body) and len(out["context_management"]["edits"]) == 1
    assert json.loads(got[2])["model"] == "other" and got[3] == "broken"


def test_summary_has_settings_and_results(spark):
    body = {"messages": [{"role": "user", "content": [{"type": "tool_result", "tool_use_id": "a", "content": "12345"}]}], "max_tokens": 7.5, "context_management": {"edits": [{"type": "t", "trigger": {"value": 3}, "keep": 2}, {"type": "u", "exclude_tools": ["R"], "clear_at_least": None}]}}
    df = spark.createDataFrame([(1, json.dumps(body), None), (2, "{}", "a, b"), (3, "broken", None)], "req int, body string, betas string")
    got = {r.req: r for r in normalize.request_summary(df).collect()}
    assert got[1].context_management.edit_count == 2 and [tuple(s) for s in got[1].context_management.strategies] == [("t", '{"value":3}', "2", None, None), ("u", None, None, None, '["R"]')]
    assert (got[1].tool_results["count"], got[1].tool_results.total_chars, got[1].max_tokens) == (1, 5, 7)
    assert got[2].context_management is None and got[2].tool_results is None and got[2].betas == ["a", "b"] and got[3].message_count == 0


def test_replies(spark):
    replies = ["SHOULD_CHECKPOINT: yes\nREASON:\nnext line\nSUMMARY: s\n t ", "should_checkpoint: NO\nreason: low\nsummary: low", "REASON:   \nSUMMARY:x", "REASON: ", "SHOULD_CHECKPOINT: YESX", "", "REASON: a\r\nb"]
    df = spark.createDataFrame([(t,) for t in replies], "t string").select(text.parse_verdict(F.col("t")).alias("v"))
    got = [tuple(r.v) for r in df.collect()]
    assert got == [("YES", "next line", "s\n t"), ("NO", None, None), (None, "SUMMARY:x", "x"), (None, "", None), (None, None, None), (None, None, None), (None, "a", None)]
    calls = ["<tool_call><function=a-b><parameter=x>1</parameter></function></tool_call>", "<tool_call> <function=é_1> <parameter=k-k>0</parameter><parameter=k> \n1\n </parameter></function> </tool_call>"]
    df = spark.createDataFrame([(t,) for t in calls], "t string").select(text.parse_tool_call(F.col("t")).alias("c"))
    assert [r.c and (r.c.name, r.c.arguments) for r in df.collect()] == [None, ("é_1", {"k": "1"})]


def test_usage_with_odd_counts(spark):
    bodies = ['{"usage":{"input_tokens":"x","output_tokens":1.5}}', '{"usage":{"input_tokens":3}}', 'data: {"usage":{"output_tokens":[1]}}']
    df = spark.createDataFrame([(b,) for b in bodies], "b string").select(text.extract_usage(F.col("b")).alias("u"))
    assert [(r.u.input_tokens, r.u.output_tokens) for r in df.collect()] == [(None, 1), (3, None), (None, None)]


def test_commands_by_presence(spark):
    inputs = [{"description": "", "prompt": "p"}, {"prompt": "p"}, {"command": "", "file_path": "f", "description": "d" * 300}, {"file_path": "f"}, {}]
    df = spark.createDataFrame([(i,) for i in inputs], "i map<string,string>").select(normalize.command(F.col("i")).alias("c"))
    assert [r.c for r in df.collect()] == ["", "p", "d" * 200, "f", ""]


def test_prefixes(spark):
    keys = spark.createDataFrame([("",), ("ab",), ("abcdef",), ("zz",), (None,)], "key string")
    prompts = spark.createDataFrame([("t2", "abc"), ("t1", "abc"), ("t3", "abcdefg"), ("t0", "x"), ("t9", None)], "task string, prompt string")
    assert sorted(tuple(r) for r in runs.prefix_match(keys, prompts).collect()) == [("ab", "t1"), ("abcdef", "t1")]
    assert wire.messages(spark.createDataFrame([(1, None)], "req int, body string")).count() == 0


def test_numbered_lines(spark):
    rows = ["", "a", "a\n", "a\n\n", "a\r\nb", "\n".join("x" * 501)]
    got = [r.o for r in spark.createDataFrame([(t,) for t in rows], "t string").select(text.numbered_lines(F.col("t")).alias("o")).collect()]
    assert got[:5] == ["", "1: a", "1: a", "1: a\n2: ", "1: a\n2: b"] and got[5].endswith("500: x\n501: ... [truncated at 500 lines]")
