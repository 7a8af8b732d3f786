"""Bodies, frames, sinks, prompts and selection: fixtures, round trips, streams."""

import json

from pyspark.sql import functions as F

from tracewright.operators import prompts, state
from tracewright.sources import readers, wire, writers


def test_bodies_round_trip(spark):
    rows = [(1, 0, "user", 'say "a"\n\\ é'), (1, 1, "assistant", '[{"type":"text","text":"x"}]'), (1, 2, "user", None), (1, 3, "user", "[not a list"), (1, 4, "user", ""), (2, 0, "us\"er", "b")]
    df = spark.createDataFrame(rows, "req bigint, idx bigint, role string, content string")
    made = {r.req: r.body for r in wire.bodies(df).collect()}
    want = [{"role": r, "content": json.loads(c) if n == 1 else c} for q, n, r, c in rows if q == 1]
    assert json.loads(made[1]) == {"messages": want}
    back = wire.messages(wire.bodies(df)).orderBy("req", "idx").collect()
    assert [tuple(r) for r in back] == rows


def test_broken_bodies_give_no_messages(spark):
    df = spark.createDataFrame([(1, "POST", "/v1/messages", "{broken"), (2, "POST", "/v1/messages", None), (3, "POST", "/v1/messages", '{"messages":3}'), (4, "GET", "/v1/messages", "{}"), (5, "POST", None, "{}")], "req bigint, method string, url string, body string")
    assert wire.message_requests(df).count() == 3
    assert wire.messages(df).count() == 0


def test_captured_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"req": 1, "method": "POST", "url": "/v1/messages", "body": json.dumps({"messages": [{"role": "user", "content": "hi"}]})}) + "\n" + '{"req": 2, "method": "GET", "url": "/stats"}\n')
    out = wire.messages(wire.message_requests(wire.captured(spark, str(src), streaming=True)))
    q = out.writeStream.format("memory").queryName("captured").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("captured").collect()] == [(1, 0, "user", "hi")]


def test_frames(spark):
    lines = [' {"id": 3, "method": "a", "params": {"x": [1]}} ', "", None, "{cut", "7", "null", "[]", '{"method": null}', "{}"]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "line int, value string")
    assert [tuple(r) for r in wire.frames(df).orderBy("line").collect()] == [(0, "3", "a", '{"x":[1]}'), (7, None, None, None), (8, None, None, None)]


def test_event_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 1700000000000, "a"), ("s", 1700090000000, "b"), ("s", None, "c")], "sessionId string, timestamp bigint, type string")
    writers.append_events(df, str(tmp_path / "log"))
    writers.append_events(df.limit(1), str(tmp_path / "log"))
    got = spark.read.json(str(tmp_path / "log")).groupBy("type", "date").count().collect()
    assert sorted((r.type, str(r.date), r["count"]) for r in got) == [("a", "2023-11-14", 2), ("b", "2023-11-15", 1), ("c", "None", 1)]
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart writes nothing again
        writers.stream_events(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_documents_and_turns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [2, 3]), ("b", None, [])], "log string, turn int, xs array<int>")
    writers.write_documents(df, "log", str(tmp_path / "docs"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "docs" / "log=a")).collect())
    assert json.loads(text) == {"log": "a", "turn": 1, "xs": [2, 3]} and "\n" in text
    for _ in range(2):
        writers.append_turns(df, str(tmp_path / "turns"))
    assert spark.read.json(str(tmp_path / "turns")).groupBy("log").count().orderBy("log").collect() == [("a", 2), ("b", 2)]


def test_selection(spark):
    df = spark.createDataFrame([(n, n % 3) for n in range(30)], "session_id bigint, k bigint")
    done = df.where("session_id < 10").unionByName(df.where("session_id < 2"))
    assert [r.session_id for r in readers.up_to(df, done, 13, ["session_id"]).collect()] == [10, 11, 12]
    assert readers.up_to(df, done, 10, ["session_id"]).count() == readers.up_to(df, done, 3, ["session_id"]).count() == 0
    assert readers.seeded_choice(df, "k", 1).collect() == readers.seeded_choice(df.repartition(5), "k", 1).collect()
    assert readers.nth(df, ["session_id"], 4).first().session_id == 4 and readers.nth(df, ["session_id"], 30).count() == 0


def test_snapshot(spark):
    df = spark.createDataFrame([("a", 1, "fired", 3), ("a", 3, "fired", 3), ("a", 2, "cooldown", 2), ("b", 1, "too_short", 0)], "key string, seq bigint, outcome string, cooldown int")
    assert sorted(map(tuple, state.snapshot(df).collect())) == [("a", 3, 2), ("b", 0, 0)]


MESSAGES = "g string, idx bigint, part string, role string, content string, tool string, arguments string"


def test_prompts(spark):
    rows = [("a", 0, "prompt", "user", "go", None, None), ("a", 1, "completion", "assistant", None, "Bash", '{"command":"ls"}'), ("a", 2, "completion", "tool", None, "Bash", None), ("b", 0, "completion", "user", "x", None, None)]
    got = {r.g: r for r in prompts.prompt_and_completion(spark.createDataFrame(rows, MESSAGES), ["g"]).collect()}
    assert got["a"].prompt == "<|im_start|>user\ngo<|im_end|>\n<|im_start|>assistant\n"
    assert got["a"].completion == '<tool_call>\n{"name": "Bash", "arguments": {"command":"ls"}}\n</tool_call><|im_end|>\n<|im_start|>tool\n<|im_end|>\n'
    assert (got["b"].prompt, got["b"].completion) == ("<|im_start|>assistant\n", "<|im_start|>user\nx<|im_end|>\n")
    other = prompts.rendered(spark.createDataFrame(rows[:1], MESSAGES), ["g"], template=prompts.Template("<%s>%s</>", "<model>"))
    assert other.first().rendered == "<user>go</>"
    fits = spark.createDataFrame([("x" * 40,), ("x" * 44,), (None,)], "c string").select(prompts.goal_fits(F.col("c"), 10).alias("f"))
    assert [r.f for r in fits.collect()] == [True, False, True]


def test_token_check(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"go": 0, "on": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    df = spark.createDataFrame([(1, "go on go"), (2, "unheard words"), (3, None), (4, "")], "id bigint, rendered string")
    got = {r.id: (r.n_tokens, r.whole) for r in prompts.token_check(df, t.to_str()).collect()}
    assert got == {1: (3, True), 2: (2, False), 3: (0, True), 4: (0, True)}
