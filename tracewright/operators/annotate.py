"""Heuristic annotator: detectors over ordered steps, de-duplication, stale outputs, merged labels.

Steps: session_id, idx, role, tool_name, cmd, output, input_file. ``prepared`` deals them by session once; every
detector is a window within a session, so all share that exchange. A detector returns CHECKPOINT rows.

Defined results: null cmd, output or input_file count as empty; steps without a command or an error text never pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import text

READS, EDITS = ["Read", "Grep", "Glob"], ["Edit", "Write", "MultiEdit"]
CHECKPOINT = ["session_id", "after_step", "progress_type", "detector", "finding", "evidence", "next_direction"]
MILESTONE, ELIMINATED = "milestone_achieved", "approach_eliminated"


def prepared(steps: DataFrame) -> DataFrame:
    """Tool steps dealt by session, with has_error, the signatures of command and error, and the file or command they touch."""
    cmd, output = (F.coalesce(F.col(c), F.lit("")) for c in ("cmd", "output"))
    tools = steps.where("role = 'tool'").repartition("session_id")
    return tools.select("session_id", "idx", "tool_name", cmd.alias("cmd"), text.has_error(output).alias("has_error"), text.command_signature(cmd).alias("sig"), text.error_signature(output).alias("err"), F.coalesce(F.nullif("input_file", F.lit("")), cmd).alias("target"))


def _checkpoint(hits: DataFrame, kind: str, detector: str, finding: Column, evidence: Column, next_direction: str) -> DataFrame:
    return hits.select("session_id", F.col("idx").alias("after_step"), F.lit(kind).alias("progress_type"), F.lit(detector).alias("detector"), finding.alias("finding"), evidence.alias("evidence"), F.lit(next_direction).alias("next_direction"))


def edit_after_reads(tools: DataFrame, least: int = 2) -> DataFrame:
    """First edit of a session after ``least`` reads; its evidence names the first 3 of the last 5 reads."""
    before = W.partitionBy("session_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    is_read = F.col("tool_name").isin(READS)
    rows = tools.where(F.col("tool_name").isin(READS + EDITS)).select("session_id", "idx", "target", is_read.alias("is_read"), F.count_if(is_read).over(before).alias("n"))
    first = rows.where(~F.col("is_read") & (F.col("n") >= least)).groupBy("session_id").agg(F.min_by(F.struct("idx", "n", "target"), "idx").alias("h"))
    joined = rows.where("is_read").join(first, "session_id").where("idx < h.idx and n >= greatest(h.n - 5, 0) and n < greatest(h.n - 5, 0) + 3")  # n of a read: its number from 0
    reads = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "target"))), lambda x: x["target"]), "; ")
    hits = joined.groupBy("session_id", "h").agg(reads.alias("reads")).select("session_id", "h.*", "reads")
    finding = F.concat(F.lit("First edit to "), "target", F.lit(" after exploring "), F.col("n").cast("string"), F.lit(" file(s) — likely identified fix location."))
    evidence = F.left(F.concat(F.lit("Read/Grep steps: "), "reads", F.lit(". Edit target: "), "target", F.lit(".")), F.lit(400))
    return _checkpoint(hits, MILESTONE, "M1", finding, evidence, "Verify the edit with a test or build.")


def success_after_failure(tools: DataFrame) -> DataFrame:
    """Commands that succeed right after the same command failed; runs are counted from the previous such success on."""
    order = W.partitionBy("session_id", "sig").orderBy("idx")
    bash = tools.where((F.col("tool_name") == "Bash") & (F.col("sig") != ""))
    rows = bash.select("session_id", "sig", "idx", "has_error", F.lag("has_error").over(order).alias("failed"), F.lag("err").over(order).alias("prev_err"), F.row_number().over(order).alias("rn"))
    hits = rows.where("failed and not has_error").withColumn("n", F.col("rn") - F.coalesce(F.lag("rn").over(order), F.lit(1)))
    finding = F.concat(F.lit("`"), "sig", F.lit("` now succeeds after "), F.col("n").cast("string"), F.lit(" prior failure(s)."))
    evidence = F.coalesce(F.nullif(F.left("prev_err", F.lit(300)), F.lit("")), F.lit("prior runs showed error output"))
    return _checkpoint(hits, MILESTONE, "M4", finding, evidence, "Build is usable; move to next subtask or verify correctness.")


def repeated_failure(tools: DataFrame) -> DataFrame:
    """The second failure of one command with one error, by its first 60 characters, in a session."""
    rows = tools.where((F.col("tool_name") == "Bash") & F.col("has_error") & (F.col("sig") != "") & (F.col("err") != "")).withColumn("head", F.left("err", F.lit(60)))
    hits = rows.withColumn("n", F.row_number().over(W.partitionBy("session_id", "sig", "head").orderBy("idx"))).where("n = 2")
    finding = F.concat(F.lit("Same error from `"), "sig", F.lit("` repeated — current approach isn't fixing it."))
    return _checkpoint(hits, ELIMINATED, "E1", finding, F.concat(F.lit("Error signature: "), F.left("err", F.lit(200))), "Change strategy; the current edits are not addressing the root cause.")


def explicit_rollback(tools: DataFrame) -> DataFrame:
    """Bash steps whose command takes work back."""
    hits = tools.where((F.col("tool_name") == "Bash") & text.is_rollback(F.col("cmd")))
    return _checkpoint(hits, ELIMINATED, "E2", F.lit("Explicit rollback — prior edits didn't work."), F.concat(F.lit("Rollback command: "), F.left("cmd", F.lit(200))), "Revisit the hypothesis; the reverted change was not correct.")


def edit_reverted(tools: DataFrame, max_gap: int = 4) -> DataFrame:
    """A file edited again within ``max_gap`` steps."""
    order = W.partitionBy("session_id", "target").orderBy("idx")
    rows = tools.where(F.col("tool_name").isin(EDITS) & (F.col("target") != "")).withColumn("gap", F.col("idx") - F.lag("idx").over(order))
    finding = F.concat(F.lit("Re-edited "), "target", F.lit(" within "), F.col("gap").cast("string"), F.lit(" steps — prior attempt wasn't right."))
    return _checkpoint(rows.where(F.col("gap") <= max_gap), ELIMINATED, "E3", finding, F.lit("Same file edited twice in short succession"), "Settle on an approach before making more edits.")


def stale_outputs(steps: DataFrame, stale_after: int = 3, min_chars: int = 500) -> DataFrame:
    """Long Bash outputs at least ``stale_after`` steps before the session's last."""
    last = F.max("idx").over(W.partitionBy("session_id"))
    rows = steps.select("session_id", "idx", "role", "tool_name", F.length("output").alias("n_chars"), last.alias("last"))
    return rows.where((F.col("role") == "tool") & (F.col("tool_name") == "Bash") & (F.col("n_chars") >= min_chars) & (F.col("last") - F.col("idx") >= stale_after)).select("session_id", F.col("idx").alias("expire"))


def deduplicate(events: DataFrame) -> DataFrame:
    """Per session, events by position with milestones first; one within a step of the last kept goes.

    Keeping greedily equals keeping the even offsets of each run of neighbouring positions.
    """
    by = W.partitionBy("session_id", "after_step").orderBy(F.when(F.col("progress_type") == "milestone_achieved", 0).otherwise(1), "detector")
    one = events.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")
    order = W.partitionBy("session_id").orderBy("after_step")
    cut = F.when(F.col("after_step") - F.lag("after_step").over(order) <= 1, 0).otherwise(1)
    islands = one.withColumn("cut", cut).withColumn("island", F.sum("cut").over(order))
    start = F.min("after_step").over(W.partitionBy("session_id", "island"))
    return islands.withColumn("start", start).where((F.col("after_step") - F.col("start")) % 2 == 0).select(*events.columns)


def annotate(steps: DataFrame) -> DataFrame:
    """All detectors, de-duplicated."""
    tools = prepared(steps)
    found = edit_after_reads(tools)
    for detector in (success_after_failure, repeated_failure, explicit_rollback, edit_reverted):
        found = found.unionByName(detector(tools))
    return deduplicate(found)


def merge_labels(expires: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Expiries and checkpoints of a session in step order, expiries first on ties; seq numbers them."""
    a = expires.select("session_id", F.col("expire").alias("step"), F.lit("expire").alias("kind"))
    b = checkpoints.select("session_id", F.col("after_step").alias("step"), F.lit("checkpoint").alias("kind"))
    order = W.partitionBy("session_id").orderBy("step", F.when(F.col("kind") == "expire", 0).otherwise(1))
    return a.unionByName(b).withColumn("seq", (F.row_number().over(order) - 1).cast("bigint"))
