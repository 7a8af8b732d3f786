"""Places and order statistics of large groups; line sources by splits; run folders that are not wanted are not opened."""

import json
import random
import statistics

from pyspark.sql import functions as F

from tracewright.operators import order, runs
from tracewright.sources import readers


def test_places(spark):
    rng = random.Random(1)
    values = [(rng.choice([None, "a", "b", str(rng.randint(0, 500))]), i) for i in range(3000)]
    df = spark.createDataFrame(values, "s string, i int").repartition(7)
    out = order.numbered(df, ["s", "i"])
    got = [r.i for r in sorted(out.collect(), key=lambda r: r.k)]
    assert got == [i for s, i in sorted(values, key=lambda x: (x[0] is not None, x[0] or "", x[1]))]
    assert order.numbered(df.limit(0), ["s"]).count() == 0
    text = runs.positional_pairs(spark.createDataFrame([(1, "off", 1.0), (2, "on", 2.0), (3, "off", None)], "num int, proxy string, dur double"))
    assert "SinglePartition" not in text._jdf.queryExecution().executedPlan().toString() and text.count() == 1


def test_medians_of_few_large_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), rng.choice([None, 1.0, 5.0, rng.random() * 100])) for _ in range(5000)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.median) for r in order.medians(df, ["g"], "v").collect()}
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert got == {g: (len(v), statistics.median(v)) for g, v in want.items()}
    q = order.at_ranks(df, ["g"], "v", {"p90": lambda n: F.floor(n * 0.9)}).collect()
    assert {r.g: r.p90 for r in q} == {g: sorted(v)[int(len(v) * 0.9)] for g, v in want.items()}


def test_a_large_file_is_read_by_several_tasks_in_order(spark, tmp_path):
    path = tmp_path / "events.jsonl"
    with open(path, "w") as f:
        for i in range(30000):
            f.write("broken {\n" if i % 1000 == 7 else "\n" if i % 1000 == 8 else json.dumps({"type": "t", "timestamp": i}) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        events = readers.telemetry(spark, str(path))
        assert events.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        got = [r.timestamp for r in events.repartition(5).orderBy("file", "line").collect()]
        assert got == [i for i in range(30000) if i % 1000 not in (7, 8)]
        bad = readers.malformed(spark, str(path)).collect()
        assert len(bad) == 30 and all(r.raw == "broken {" for r in bad)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_run_folders(spark, tmp_path):
    heads = {"run_001": "x\nrun_id=run_001 proxy=on rewind=off\n", "run_002": "proxy=off\nrun_id=run_002 proxy=on\n", "run_003": "proxy=maybe\n", "run_004": None}
    for run, head in heads.items():
        for task in ("a", "b"):
            d = tmp_path / run / task
            d.mkdir(parents=True)
            (d / "summary_1.json").write_text(json.dumps({"task_id": task, "num_turns": int(run[-1])}))
            (d / "transcript_1.jsonl").write_text('{"type":"result","num_turns":1}\n{"type":"result","num_turns":2,"is_error":true,"usage":{"input_tokens":7}}\nbad\n')
        if head is not None:
            (tmp_path / run / "run.log").write_text(head)
    root = str(tmp_path)
    some = readers.summaries(spark, root, runs=["run_002", "run_009"], tasks=["b"])
    assert len(some.inputFiles()) == 1 and [(r.run, r.task, r.num_turns) for r in some.collect()] == [("run_002", "b", 2)]
    assert len(readers.summaries(spark, root).inputFiles()) == 8
    assert readers.summaries(spark, root, runs=["run_009"]).count() == 0 and readers.patches(spark, root).count() == 0
    got = {r.run: (r.proxy, r.rewind, r.side, r.cached) for r in readers.run_config(spark, root).collect()}
    assert got == {"run_001": ("on", "off", "on", "on"), "run_002": ("on", None, "off", "off"), "run_003": (None, None, None, "off")}
    last = readers.last_result(spark, root, tasks=["a"]).collect()
    assert {(r.run, r.num_turns, r.is_error, r.usage.input_tokens) for r in last} == {(x, 2, True, 7) for x in heads} and len(last) == 4
    assert readers.last_result(spark, root, runs=["none"]).count() == 0
