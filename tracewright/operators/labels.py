"""Label filter and label audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tools whose outputs name files; expiring them is not learned. Fixed values.
FILE_BASED = ["Read", "read_file", "read_many_files", "list_directory", "Edit", "Write", "MultiEdit", "replace", "write_file", "apply_patch"]


def filter_events(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Events with ``reason``: null if kept, else out_of_range, non_tool or file_based; checkpoints pass."""
    known = steps.groupBy("session_id", "idx").agg(F.max_by(F.struct("role", "tool_name"), "idx").alias("s"))
    joined = events.join(known, (events.session_id == known.session_id) & (events.expire == known.idx), "left").select(events["*"], "s")
    reason = (
        F.when(F.col("expire").isNull(), F.lit(None)).when(F.col("s").isNull(), "out_of_range").when(F.col("s.role") != "tool", "non_tool").when(F.col("s.tool_name").isin(FILE_BASED), "file_based")
    )
    return joined.withColumn("reason", reason).drop("s")


def drop_totals(filtered: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c).alias
    r = F.col("reason")
    return filtered.agg(F.count(F.lit(1)).alias("before"), n(r.isNull())("after"), n(r == "out_of_range")("out_of_range"), n(r == "non_tool")("non_tool"), n(r == "file_based")("file_based"))


def audit(original: DataFrame, strict: DataFrame) -> DataFrame:
    """Per session: added, kept and dropped positions of the strict labels against the original ones."""
    a = original.groupBy("session_id").agg(F.collect_set("after_step").alias("o"))
    b = strict.groupBy("session_id").agg(F.collect_set("after_step").alias("s"))
    none = F.array().cast("array<bigint>")
    both = a.join(b, "session_id", "full_outer").select("session_id", F.coalesce("o", none).alias("o"), F.coalesce("s", none).alias("s"))
    return both.select(
        "session_id", F.size("o").cast("bigint").alias("n_original"), F.size("s").cast("bigint").alias("n_strict"),
        F.array_sort(F.array_except("s", "o")).alias("added"), F.array_sort(F.array_intersect("s", "o")).alias("kept"), F.array_sort(F.array_except("o", "s")).alias("dropped"),
    )


def audit_totals(audited: DataFrame) -> DataFrame:
    o, s = F.sum("n_original"), F.sum("n_strict")
    return audited.agg(F.count(F.lit(1)).alias("n_sessions"), o.alias("original"), s.alias("strict"), F.try_divide(s, o).alias("ratio"))
