"""Structured Streaming over telemetry: windowed counts with watermarks, and the judge as a keyed state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.operators.state import judge_outcome, too_short

OUTCOMES = "key string, seq long, outcome string, cooldown int"
#: What is kept of a slot's keys, side by side; ``at`` is the latest event time of a key's requests in milliseconds.
KEPT = "key array<string>, left array<int>, rewinds array<long>, at array<long>"
#: Slots that keys are dealt to. A slot's state is written whole when one of its keys has a request; a checkpoint goes on with as many as it began with.
SLOTS = 1024


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and token sums by event type and window; late rows within the watermark count."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "type").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens")).select("window.start", "window.end", "type", "n", "input_tokens")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "run").agg(F.count(F.lit(1)).alias("n")).select("run", "session_window.start", "session_window.end", "n")


class Judge:
    """The judge's cooldown and number of rewinds of each key of a slot, forgotten when the key has been silent for ``ttl_ms`` of event time.

    A call takes all that a batch brings for a slot, many keys, as a call costs far more than the rows of a key. Keys do not touch each other.
    """

    def __init__(self, cooldown: int, ttl_ms: int) -> None:
        self.cooldown, self.ttl_ms = cooldown, ttl_ms

    def __call__(self, slot: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        kept = {k: s for k, *s in zip(*state.get)} if state.exists else {}
        rows = [] if state.hasTimedOut else sorted((r for f in frames for r in zip(*(f[c].tolist() for c in ("numbered", "seq", "short", "outcome", "at", "key")))), key=lambda r: r[:4])
        asked, lefts, outcomes = set(), [], []
        for _, _, short, outcome, at, key in rows:
            at = now if at != at else int(at)  # NaN where there is none
            asked.add(key)
            left, rewinds, last = kept.get(key) or (0, 0, at)
            if not short and left > 0:
                outcome, left = "cooldown", left - 1
            elif not short:
                left = self.cooldown if outcome == "fired" else 0
                rewinds += outcome == "fired"
            kept[key] = (left, rewinds, max(last, at))
            outcomes.append(outcome)
            lefts.append(left)
        kept = {k: s for k, s in kept.items() if k in asked or s[2] + self.ttl_ms >= now}
        if kept:
            state.update((list(kept), *map(list, zip(*kept.values()))))
            state.setTimeoutTimestamp(max(min(at for _, _, at in kept.values()) + self.ttl_ms, now, 1))
        else:
            state.remove()
        if rows:
            seqs = pd.array([seq if numbered else None for numbered, seq, *_ in rows], dtype="Int64")
            yield pd.DataFrame({"key": [r[-1] for r in rows], "seq": seqs, "outcome": outcomes, "cooldown": lefts})


def judge(requests: DataFrame, cooldown: int = 3, min_messages: int = 6, ttl_ms: int = 24 * 3600 * 1000, late: str = "2 hours", slots: int = SLOTS) -> DataFrame:
    """The same machine as the batch one, over a stream of (key, seq, ts, n_messages, verdict, summary, can_elide).

    Cooldown and rewinds live from batch to batch and over restarts; a key without requests for ``ttl_ms``, by the requests' own times and
    the watermark, is forgotten and starts anew, so state does not grow for ever. Requests of a key are in order within a
    micro-batch; a client sends the next one after the answer to the last, so batches are in order too. A request without a time counts as of the watermark.
    Keys are dealt to ``slots`` by a hash; let a slot have some thousands of live keys at most.
    """
    short = too_short(F.col("n_messages"), min_messages)
    outcome = F.when(short, "too_short").otherwise(judge_outcome(*map(F.col, ("n_messages", "verdict", "summary", "can_elide"))))
    numbers = [F.col("seq").isNotNull().alias("numbered"), F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq")]
    rows = requests.withWatermark("ts", late).select(F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot"), "key", *numbers, "ts", F.unix_millis("ts").alias("at"), short.alias("short"), outcome.alias("outcome"))
    return rows.groupBy("slot").applyInPandasWithState(Judge(cooldown, ttl_ms), OUTCOMES, KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def kept_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped judge's checkpoint holds: (key, cooldown_remaining, rewind_count)."""
    kept = spark.read.format("statestore").load(checkpoint).select("value.groupState.*").select(F.inline(F.arrays_zip("key", "left", "rewinds")))
    return kept.select("key", F.col("left").alias("cooldown_remaining"), F.col("rewinds").alias("rewind_count"))
