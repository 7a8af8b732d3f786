"""Wrapped lines against Python's textwrap, and a review as a whole."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from tracewright.functions import wrap
from tracewright.operators import render


def by_library(text, width, indent):
    lines = []
    for para in text.splitlines():
        lines += [para] if len(para) <= width else textwrap.wrap(para, width=width)
    return f"\n{indent}".join(lines)


@pytest.mark.parametrize("width", [110, 24, 7])
def test_wrap_equals_library(spark, width):
    rng = random.Random(width)
    bits = ["word", "a", "well-known", "x-y", "--", "---", "-", "foo--bar", "end.", "1-2-3", "é-ü", " ", "  ", "\n", "\t", "long" * 9, "very-long-hyphened-word-that-goes-on", "_-_", "a-b-c-d-e", "\r\n", "!", '"q"', "ÿÿ"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", " ", ""]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["", "\n", "a\n", "\n\n", "x" * 400, "-" * 300, "word " * 60, "a" * 109 + " b" + " c" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = {r.i: r.o for r in df.select("i", wrap.wrapped(F.col("t"), width, "  ").alias("o")).collect()}
    wrong = [t for i, t in enumerate(texts) if got[i] != by_library(t, width, "  ")]
    assert not wrong, (len(wrong), wrong[0], got[texts.index(wrong[0])], by_library(wrong[0], width, "  "))


def test_review(spark):
    steps = spark.createDataFrame([("s", 0, "user_text", None, None, None, "w " * 200), ("s", 1, "tool", "Bash", "ls", "x" * 310, None), ("s", 2, "tool", "Read", None, "", None), ("s", 3, "assistant_text", None, None, None, "ok")], "session_id string, idx long, role string, tool_name string, cmd string, output string, text string")
    marks = spark.createDataFrame([("s", 1, "milestone_achieved", "f " * 80, "e", None)], "session_id string, after_step long, progress_type string, finding string, evidence string, next_direction string")
    gone = spark.createDataFrame([("s", 2), ("s", 2)], "session_id string, expire long")
    got = {r.idx: r for r in render.review(steps, marks, gone).collect()}
    assert got[0].entry == "[  0] USER TEXT\n    " + by_library(("w " * 200)[:300] + "  (…100 more)", 110, "    ")
    assert got[1].entry == "[  1] TOOL  Bash\n    cmd: ls\n    out: " + by_library("x" * 300 + "  (…10 more chars)", 110, "    ")
    assert got[2].entry == "[  2] TOOL  Read  ◀── EXPIRE (step 2)\n    cmd: " and got[3].entry == "[  3] ASST TEXT\n    ok"
    banner = "━━━━━━━━━━  CHECKPOINT after step 1  [milestone_achieved]  ━━━━━━━━━━"
    assert got[1].fires == f"\n{banner}\n  finding:   {by_library('f ' * 80, 110, ' ' * 13)}\n  evidence:  e\n  next:      \n{'━' * len(banner)}\n"
    assert got[0].fires is None and "out:" not in {r.idx: r for r in render.review(steps, marks, gone, most=0).collect()}[1].entry
