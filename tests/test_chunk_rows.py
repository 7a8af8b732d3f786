"""Training chunks as rows, and windows that stay linear."""

import glob
import time

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tests.conftest import SF
from tracewright.operators import annotate, chunk_rows, prompts, render, rewrite
from tracewright.plans import registry, views


@pytest.fixture(scope="module")
def inputs(spark):
    t = views.trace(spark, SF).cache()
    return render.chat_messages(t).cache(), annotate.annotate(t).cache()


def test_rows_of_all_labels_cost_what_their_texts_hold(inputs):
    template = prompts.Template(preamble="<tools>\n")
    limits = {"budget": 20000, "goal_budget": 4000, "reserve": 300, "min_context": 4}
    rows = chunk_rows.chunk_rows(*inputs, template=template, measure=render.Measure(F.length, template), cold=2, **limits).collect()
    labels = [r.meta.label for r in rows]
    assert {"positive", "negative", "cold_start"} == set(labels) and labels.count("cold_start") == 2 * len({r.meta.source_session for r in rows if r.meta.label == "cold_start"})
    for r in rows:
        assert len(r.prompt) + len(r.completion) == r.meta.n_tokens
        assert r.prompt.startswith("<tools>\n<|im_start|>user\n") and r.prompt.endswith(template.opening) and not r.completion.startswith(template.opening)
        assert r.messages[0].role == "user" and (r.prompt + r.completion).count("<|im_end|>") == len(r.messages)
        said = r.messages[1 + r.meta.n_context_msgs :]
        assert said[0].role == "assistant" and said[0].tool_calls
        if r.meta.label == "positive":
            assert said[0].tool_calls[0].name == render.CHECKPOINT_TOOL and said[1].content == render.CHECKPOINT_ACK and said[1].tool_call_id == said[0].tool_calls[0].id
        if r.meta.label != "cold_start":
            assert r.meta.n_tokens <= 20000 and r.meta.n_context_msgs >= 4


def test_a_larger_message_before_the_context_would_not_fit(inputs):
    template = prompts.Template()
    measure = render.Measure(F.length, template)
    messages = {(r.session_id, r.idx): r.n_tokens for r in render.token_counts(inputs[0], measure).collect()}
    made = chunk_rows.specs(*inputs, 1.0, 42, 1, 500, measure, budget=9000, goal_budget=4000, reserve=300, min_context=4).where("label <> 'cold_start'").collect()
    assert made
    for r in made:
        inside = sum(messages[r.session_id, i] for i in range(r.first_idx, r.end_idx + 1))
        assert inside < r.n_tokens <= 9000
        assert r.first_idx == 1 or r.n_tokens + messages[r.session_id, r.first_idx - 1] > 9000


def test_counts_by_a_tokenizer(spark, inputs):
    files = sorted(glob.glob("/opt/tokenizers/*byte_bpe_50k*.json"))
    if not files:
        pytest.skip("no tokenizers file")
    vocabulary = open(files[0], encoding="utf-8").read()
    count, template = prompts.tokenizer_count(vocabulary), prompts.Template()
    rows = chunk_rows.chunk_rows(*inputs, template=template, measure=render.Measure(count, template), budget=4000, min_context=4, reserve=100).limit(20).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary)
    for r in rows:
        turns = (r.prompt + r.completion).split("<|im_end|>\n")[:-1]
        assert r.meta.n_tokens == sum(len(t.encode(x + "<|im_end|>\n", add_special_tokens=False).ids) for x in turns)


def test_a_text_that_does_not_begin_with_its_prompt_gives_no_row(inputs):
    other = prompts.Template(opening="<bot>")
    assert chunk_rows.chunk_rows(*inputs, template=other).count() == 0
    assert chunk_rows.chunk_rows(inputs[0].limit(0), inputs[1]).count() == 0


def long_request(spark, n):
    call = '[{"type":"tool_use","id":"c","name":"checkpoint_progress","input":{"finding":"f"}}]'
    return spark.range(n).select(F.lit(1).alias("req"), F.col("id").alias("idx"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.when(F.col("id") % 1000 == 999, call).otherwise("words").alias("content"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_do_not_reach_to_the_end_of_a_group(spark, inputs):
    """A frame from the current row to the end is computed anew for each row; the lookups run from the end instead."""
    frames = [rewrite.rewind(long_request(spark, 10)), rewrite.elisions(long_request(spark, 10)), render.chunks(*inputs)]
    assert not any("currentrow$(), unboundedfollowing$()" in plan(df) for df in frames)


@pytest.mark.parametrize("name", ["rn6_chunk_rows", "rn9_chunk_messages", "ag21_chunk_totals", "rn7_chunks", "rn11_chunks_small_budget"])
def test_no_stored_table_goes_through_the_driver(spark, monkeypatch, name):
    """Files of repetitive texts are small; by their size alone Spark would broadcast the rows."""
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(plan(self._df)), write(self, *a, **k))[1])
    plans.append(plan(registry.QUERIES[name](spark, SF)))
    assert len(plans) > 5  # trace, messages, checkpoints, counted messages, positive chunks, the rest
    assert [p for p in plans if "BroadcastHashJoin" in p] == []
    assert max(p.count("Exchange") for p in plans) < 45


@pytest.mark.parametrize("name", ["rn7_chunks", "rn11_chunks_small_budget"])
def test_chunks_are_joined_by_merges_alone(spark, name):
    made = plan(registry.QUERIES[name](spark, SF))
    assert "SortMergeJoin" in made and "Broadcast" not in made


def test_a_request_twice_as_long_takes_about_twice_the_time(spark):
    def seconds(n):
        best = []
        for _ in range(3):
            t = time.time()
            rewrite.rewind(long_request(spark, n)).write.format("noop").mode("overwrite").save()
            best.append(time.time() - t)
        return min(best)

    seconds(10_000)
    assert seconds(120_000) < 3 * seconds(60_000)
