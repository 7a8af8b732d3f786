"""Cooldown machines: as scans over blocks, against a row by row simulation, and as streams over batches, restarts and expiry."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import state
from tracewright.streaming import run, telemetry

REQUEST = "key string, seq long, n_messages int, verdict string, summary string, can_elide boolean"


def requests(rng, keys, n):
    return [(rng.choice(keys), i, rng.choice([None, 3, 5, 6, 7, 12, 12, 12]), rng.choice(["YES", "YES", "NO", None]), rng.choice(["s", "s", "", None]), rng.choice([True, True, False, None])) for i in range(n)]


def by_rows(rows, cooldown=3, least=6):
    left, out = {}, []
    for key, seq, n, verdict, summary, can in sorted(rows, key=lambda r: r[1]):
        c = left.get(key, 0)
        if n is None or n < least:
            outcome = "too_short"
        elif c > 0:
            outcome, c = "cooldown", c - 1
        else:
            outcome = "shadow_error" if verdict is None else "shadow_no" if verdict != "YES" else "no_summary" if not summary else "fired" if can else "nothing_to_elide"
            c = cooldown if outcome == "fired" else 0
        left[key] = c
        out.append((key, seq, outcome, c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits,cooldown", [(12, 3), (2, 3), (1, 15), (3, 0)])
def test_judge_equals_simulation(spark, monkeypatch, bits, cooldown):
    monkeypatch.setattr(state, "BITS", bits)
    rng = random.Random(bits)
    rows = [(k, s - 150, *r) for k, s, *r in requests(rng, ["a", "a", "b", None, "lone"], 400)]
    df = spark.createDataFrame(rows, REQUEST).repartition(5)
    got = sorted((tuple(r) for r in state.judge(df, cooldown).collect()), key=repr)
    assert got == by_rows(rows, cooldown)
    assert state.judge(df.limit(0)).count() == 0


def test_no_python_in_the_plan_and_no_group_beyond_a_block(spark, monkeypatch):
    df = spark.range(20000).select(F.lit("hot").alias("key"), F.col("id").alias("seq"), F.lit(9).alias("n_messages"), F.lit("YES").alias("verdict"), F.lit("s").alias("summary"), F.lit(True).alias("can_elide"))
    out = state.judge(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()} == {"fired": 5000, "cooldown": 15000}
    with pytest.raises(ValueError):
        state.judge(df, cooldown=16)


def test_harness_equals_simulation(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["YES", "NO", None]), rng.choice(["s", "", None]), rng.choice([0, 1, 5, None])) for i in range(300)]
    left, want, waited = {}, [], {}
    for k, i, v, s, n in rows:
        c, yes = left.get(k, 0), v == "YES" and bool(s)
        if yes and c == 0:
            outcome, c = ("fired", 3) if (n or 0) >= 1 else ("unchanged", 0)
        else:
            waited[k] = waited.get(k, 0) + yes
            outcome, c = "wait", max(c - 1, 0)
        left[k] = c
        want.append((k, i, outcome, c))
    df = spark.createDataFrame(rows, "key string, seq long, verdict string, summary string, n_elided int")
    out = state.harness(df)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert {r.key: r.yes_in_cooldown for r in state.harness_totals(df, out).collect()} == waited


def test_stream_keeps_state_over_batches_restarts_and_forgets_silent_keys(spark, tmp_path):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, s, start + datetime.timedelta(minutes=s), n, v, m, c) for k, s, n, v, m, c in requests(rng, ["a", "b", "c"], 240)]
    # "gone" fires and is silent until long after its time, while others move the watermark on
    rows += [("gone", 1000 + i, start + datetime.timedelta(minutes=m), 9, "YES", "s", True) for i, m in enumerate([0, 1, 2600])]
    schema = "key string, seq long, ts timestamp, n_messages int, verdict string, summary string, can_elide boolean"
    later = [(k, s, start + datetime.timedelta(minutes=s - 3000), n, v, m, c) for k, s, n, v, m, c in [("d", 5000 + i, 9, "NO", "s", True) for i in range(4)]]
    parts = [[r for r in rows if r[2] < start + datetime.timedelta(minutes=90)], [r for r in rows if start + datetime.timedelta(minutes=90) <= r[2] < start + datetime.timedelta(minutes=1000)] + later, [r for r in rows if r[2] >= start + datetime.timedelta(minutes=1000)]]
    path, root = str(tmp_path / "in"), str(tmp_path / "stream")
    ttl = 12 * 3600 * 1000
    for n, part in enumerate(parts):  # the stream is started anew for each part, and goes on
        run.feed(spark.createDataFrame(part, schema), path, ["key"])
        out = run.finished(telemetry.judge(run.stream(spark, path), ttl_ms=ttl), root)
        assert out.count() == sum(map(len, parts[: n + 1]))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    as_fold = [((k, "again") if k == "gone" and ts > start + datetime.timedelta(minutes=2000) else k, s, n, v, m, c) for k, s, ts, n, v, m, c in rows + later]
    want = [(k[0] if isinstance(k, tuple) else k, *r) for k, *r in by_rows(as_fold)]
    assert got == sorted(want, key=repr)
    assert [r for r in got if r[0] == "gone"] == [("gone", 1000, "fired", 3), ("gone", 1001, "cooldown", 2), ("gone", 1002, "fired", 3)]
    kept = {r.key: (r.cooldown_remaining, r.rewind_count) for r in telemetry.kept_state(spark, f"{root}/state").collect()}
    assert kept["gone"] == (3, 1)  # the first rewind was forgotten with the key
    assert "d" in kept and kept["d"] == (0, 0)


STREAM = "key string, seq long, ts timestamp, n_messages int, verdict string, summary string, can_elide boolean"


def test_keys_of_a_slot_share_a_call_and_nothing_else(spark, tmp_path):
    """Many keys, few slots: as the fold, with a state and so a call for each slot, not for each key."""
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = requests(rng, [None, *(f"k{i}" for i in range(800))], 4000)
    timed = [(k, s, start + datetime.timedelta(seconds=s), *r) for k, s, *r in rows]
    path, root = str(tmp_path / "in"), str(tmp_path / "stream")
    for part in (timed[:1500], timed[1500:3000], timed[3000:]):
        run.feed(spark.createDataFrame(part, STREAM), path, ["key"])
    out = run.finished(telemetry.judge(run.stream(spark, path), slots=7), root)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == by_rows(rows)
    assert spark.read.format("statestore").load(f"{root}/state").count() == 7
    fired = {}
    for key, _, outcome, _ in by_rows(rows):
        fired[key] = fired.get(key, 0) + (outcome == "fired")
    assert {r.key: r.rewind_count for r in telemetry.kept_state(spark, f"{root}/state").collect()} == fired


def test_silent_keys_leave_a_slot_that_others_keep_alive(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    ask = lambda key, seq, hours: (key, seq, hours is not None and start + datetime.timedelta(hours=hours) or None, 9, "YES", "s", True)
    parts = [[ask("gone", 0, 0), ask("busy", 0, 0), ask("back", 0, 0)], [ask("busy", 1, 60)], [ask("busy", 2, 61), ask("back", 1, 61)], [ask("busy", 3, 62), ask("untimed", None, None), ask("untimed", 2**53 + 1, None)]]
    path, root = str(tmp_path / "in"), str(tmp_path / "stream")
    for part in parts:
        run.feed(spark.createDataFrame(part, STREAM), path, ["key"])
        out = run.finished(telemetry.judge(run.stream(spark, path), slots=1), root)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(
        [("gone", 0, "fired", 3), ("back", 0, "fired", 3), ("back", 1, "fired", 3), ("busy", 0, "fired", 3), *(("busy", i, "cooldown", 3 - i) for i in (1, 2, 3)), ("untimed", None, "fired", 3), ("untimed", 2**53 + 1, "cooldown", 2)], key=repr
    )
    assert sorted(r.key for r in telemetry.kept_state(spark, f"{root}/state").collect()) == ["back", "busy", "untimed"]


def test_the_session_keeps_its_settings(spark):
    spark.conf.unset(run.PROVIDER)
    before = spark.conf.get(run.PROVIDER)
    with run.with_state(spark):
        assert spark.conf.get(run.PROVIDER) == run.ROCKS
    assert spark.conf.get(run.PROVIDER) == before


def test_bookmark_lists_equal_a_replay(spark):
    rng = random.Random(8)
    events = [(s, i, rng.choice(["mark", "list", "recall"]), f"n{rng.randrange(6)}", rng.choice([f"s{i}", None])) for s in ("x", "y") for i in range(300)]
    df = spark.createDataFrame(events, "session string, seq long, kind string, name string, summary string")
    got = sorted((r.session, r.seq, r["count"], r.listed) for r in state.bookmark_lists(df.where("summary is not null or kind <> 'mark'")).collect())
    kept = {}
    for s, i, kind, name, summary in events:
        if kind == "mark" and summary is not None:
            kept.setdefault(s, {})[name] = summary
        if kind == "list":
            lines = [f"- {n}: {x}" for n, x in kept.get(s, {}).items()]
            assert (s, i, len(lines), "\n".join(lines) or "(no bookmarks saved yet)") == got.pop(0)
    assert not got
