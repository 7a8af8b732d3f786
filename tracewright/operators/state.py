"""Keyed state machines over ordered streams, and event-sourced bookmarks.

A machine's state is a cooldown of a few requests, so each row is a map from state to state, and maps compose: rows go by key into
blocks of consecutive numbers, each block becomes one map, blocks of blocks one more; then the states run down again, from the first
state of a key to that of each block and to its rows. No task holds more of a key than a block, and a key with a third of all
rows is spread over as many tasks as it has blocks. All of it is SQL functions.

Defined results: a null key is a key of its own, as any other; rows without a number come first in their key; equal numbers go in
the order of what the rows say, and repeated rows all count. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers of a block, as a power of two, and levels of blocks: keys with up to 2^36 numbers have no group of more than 4,096 rows.
BITS, LEVELS = 12, 2
#: States have four bits each in a map.
MOST = 15
DIGITS = "0123456789abcdef"


def after(step: Column, state: Column) -> Column:
    """The state that the map ``step`` gives for ``state``."""
    return F.call_function("shiftright", step, (state * 4).cast("int")).bitwiseAND(15).cast("int")


def packed(states: list[Column]) -> Column:
    """The map of the states that follow 0, 1 and so on."""
    out = F.lit(0).cast("bigint")
    for i, s in enumerate(states):
        out = out + F.shiftleft(s.cast("bigint"), 4 * i)
    return out


def composed(steps: Column, states: int) -> Column:
    """One map for all of an array of maps, in order."""
    identity = packed([F.lit(s) for s in range(states)])
    return F.aggregate(steps, identity, lambda f, g: packed([after(g, after(f, F.lit(s))) for s in range(states)]))


def states_before(steps: Column, first: Column) -> Column:
    """The state before each of an array of maps, a digit each."""
    begin = F.struct(first.cast("int").alias("s"), F.lit("").alias("out"))
    digit = lambda s: F.substr(F.lit(DIGITS), s + 1, F.lit(1))
    return F.aggregate(steps, begin, lambda a, m: F.struct(after(m, a["s"]).alias("s"), F.concat(a["out"], digit(a["s"])).alias("out")), lambda a: a["out"])


def state_at(digits: Column, i: Column) -> Column:
    return F.instr(F.lit(DIGITS), F.substr(digits, i + 1, F.lit(1))) - 1


def _machine(rows: DataFrame, cooldown: int, waiting: str) -> DataFrame:
    """(key, seq, passes, outcome, fires) to (key, seq, outcome, cooldown), from no cooldown on.

    A row that ``passes`` leaves the state and has its outcome. Any other counts a cooldown down, with the outcome ``waiting``;
    without one it has its own outcome, and if it ``fires`` the cooldown begins.
    """
    if not 0 <= cooldown <= MOST:
        raise ValueError(f"a cooldown of {cooldown} is over {MOST}")
    n = cooldown + 1
    counts = [F.when(F.col("fires"), F.lit(cooldown)).otherwise(0), *[F.lit(s - 1) for s in range(1, n)]]
    step = F.when(F.col("passes"), packed([F.lit(s) for s in range(n)])).otherwise(packed(counts))
    block = F.coalesce(F.shiftright(F.col("seq").cast("bigint"), BITS), F.lit(-(1 << 60)))
    row = F.struct("seq", "passes", "outcome", "fires", step.alias("m"))
    maps = lambda c: F.transform(c, lambda x: x["m"])
    level = [rows.groupBy("key", block.alias("b")).agg(F.array_sort(F.collect_list(row)).alias("rows"))]
    for _ in range(LEVELS):
        below = level[-1].select("key", F.struct("b", composed(maps("rows"), n).alias("m")).alias("x"))
        level.append(below.groupBy("key", F.shiftright(F.col("x.b"), BITS).alias("b")).agg(F.array_sort(F.collect_list("x")).alias("rows")))
    top = level[-1].select("key", F.struct("b", composed(maps("rows"), n).alias("m")).alias("x")).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("rows"))
    down = F.transform("rows", lambda x, i: F.struct(x["b"].alias("b"), state_at(F.col("digits"), i).alias("first")))
    starts = top.withColumn("digits", states_before(maps("rows"), F.lit(0))).select("key", F.inline(down))
    for blocks in reversed(level[1:]):
        starts = _beside(blocks, starts).withColumn("digits", states_before(maps("rows"), F.col("first"))).select("key", F.inline(down))
    done = _beside(level[0], starts).withColumn("digits", states_before(maps("rows"), F.col("first")))

    def result(x: Column, i: Column) -> Column:
        state = state_at(F.col("digits"), i)
        return F.struct(x["seq"].alias("seq"), F.when(x["passes"] | (state == 0), x["outcome"]).otherwise(waiting).alias("outcome"), after(x["m"], state).alias("cooldown"))

    return done.select("key", F.inline(F.transform("rows", result)))


def _beside(blocks: DataFrame, starts: DataFrame) -> DataFrame:
    s = starts.withColumnsRenamed({"key": "_key", "b": "_b"})
    return blocks.join(s, F.col("key").eqNullSafe(F.col("_key")) & (F.col("b") == F.col("_b"))).drop("_key", "_b")


def judge_outcome(n_messages: Column, verdict: Column, summary: Column, can_elide: Column) -> Column:
    """What a request comes to out of cooldown: a null verdict is an error, a null answer to whether anything goes is no."""
    said = F.when(F.coalesce(summary, F.lit("")) == "", "no_summary").when(F.coalesce(can_elide, F.lit(False)), "fired").otherwise("nothing_to_elide")
    return F.when(verdict.isNull(), "shadow_error").when(verdict != "YES", "shadow_no").otherwise(said)


def too_short(n_messages: Column, min_messages: int) -> Column:
    """Requests of few messages leave the state; so do those without a count."""
    return F.coalesce(n_messages < min_messages, F.lit(True))


def judge(requests: DataFrame, cooldown: int = 3, min_messages: int = 6) -> DataFrame:
    """(key, seq, n_messages, verdict, summary, can_elide) to outcomes, in request order."""
    short = too_short(F.col("n_messages"), min_messages)
    outcome = F.when(short, "too_short").otherwise(judge_outcome(*map(F.col, ("n_messages", "verdict", "summary", "can_elide"))))
    return _machine(requests.select("key", "seq", short.alias("passes"), outcome.alias("outcome"), (outcome == "fired").alias("fires")), cooldown, "cooldown")


def harness(turns: DataFrame, cooldown: int = 3) -> DataFrame:
    """(key, seq, verdict, summary, n_elided): the judge is asked each turn; fires on YES with a summary out of cooldown."""
    yes = F.coalesce((F.col("verdict") == "YES") & (F.col("summary") != ""), F.lit(False))
    outcome = F.when(~yes, "wait").when(F.coalesce(F.col("n_elided") >= 1, F.lit(False)), "fired").otherwise("unchanged")
    return _machine(turns.select("key", "seq", F.lit(False).alias("passes"), outcome.alias("outcome"), (outcome == "fired").alias("fires")), cooldown, "wait")


def harness_totals(turns: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per key of ``harness``: how often it fired, and how often the judge said YES while it waited."""
    same = [F.col("t.key").eqNullSafe(F.col("o.key")), F.col("t.seq") == F.col("o.seq")]
    both = turns.alias("t").join(outcomes.alias("o"), same).select("t.key", "outcome", F.coalesce((F.col("verdict") == "YES") & (F.col("summary") != ""), F.lit(False)).alias("yes"))
    return both.groupBy("key").agg(F.count_if(F.col("outcome") == "fired").alias("fired"), F.count_if(F.col("yes") & (F.col("outcome") == "wait")).alias("yes_in_cooldown"))


def bookmark_lists(events: DataFrame) -> DataFrame:
    """What each list event (session, seq, kind 'list') returns: names in the order they were first marked, each with its latest summary.

    Lists meet the names of their session, and each line takes its summary by one running frame over the marks of its name: the work grows
    with the marks and the lines listed, not with lists times marks.
    """
    marks = events.where("kind = 'mark'").select("session", "name", "seq", "summary")
    lists = events.where("kind = 'list'").select("session", "seq")
    names = marks.groupBy("session", "name").agg(F.min("seq").alias("born"))
    asked = lists.join(names, "session").where("born < seq").withColumn("summary", F.lit(None).cast("string"))  # a row for each line that is listed, no more
    both = asked.select("session", "name", "seq", "summary", "born", F.lit(0).alias("mark")).unionByName(marks.select("*", F.lit(1).alias("mark")), allowMissingColumns=True)
    until_now = W.partitionBy("session", "name").orderBy("seq", "mark").rowsBetween(W.unboundedPreceding, W.currentRow)
    said = F.last(F.when(F.col("mark") == 1, F.struct("summary")), ignorenulls=True).over(until_now)
    live = both.withColumn("summary", said["summary"]).where("mark = 0")
    lines = live.groupBy("session", "seq").agg(F.array_sort(F.collect_list(F.struct("born", F.concat(F.lit("- "), "name", F.lit(": "), "summary").alias("line")))).alias("a"))
    joined = lists.join(lines, ["session", "seq"], "left")
    return joined.select("session", "seq", F.coalesce(F.size("a"), F.lit(0)).alias("count"), F.when(F.size("a") > 0, F.array_join(F.transform("a", lambda x: x["line"]), "\n")).otherwise("(no bookmarks saved yet)").alias("listed"))


def bookmarks(events: DataFrame) -> DataFrame:
    """Replay mark and recall events (session, seq, kind, name, summary): overwrote, found, and what a recall returns."""
    before = W.partitionBy("session", "name").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    marked = F.when(F.col("kind") == "mark", F.col("summary"))
    n = F.count_if(F.col("kind") == "mark").over(before)
    return events.select(
        "session", "seq", "kind", "name", F.when(F.col("kind") == "mark", n > 0).alias("overwrote"), F.when(F.col("kind") == "recall", n > 0).alias("found"), F.when(F.col("kind") == "recall", F.last(marked, ignorenulls=True).over(before)).alias("recalled")
    )


def snapshot(outcomes: DataFrame) -> DataFrame:
    """What a machine knows of each key after its last row: cooldown left and how often it fired."""
    return outcomes.groupBy("key").agg(F.max_by("cooldown", "seq").alias("cooldown_remaining"), F.count_if(F.col("outcome") == "fired").alias("rewind_count"))
