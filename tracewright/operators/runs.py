"""Benchmark run analytics: pairings, cache costs, per-task comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators import order


def adjacent_pairs(runs: DataFrame) -> DataFrame:
    """Per task: an off run directly followed by the on run with the next number."""
    in_task = W.partitionBy("task").orderBy("num")
    extra = [c for c in ("exit_code", "verify_exit") if c in runs.columns]
    rows = runs.where(F.col("proxy").isin("off", "on")).select("*", *[F.lead(c).over(in_task).alias(f"next_{c}") for c in ["proxy", "num", "dur", *extra]])
    hit = (F.col("proxy") == "off") & (F.col("next_proxy") == "on") & (F.col("next_num") == F.col("num") + 1)
    return rows.where(hit).select("task", F.col("num").alias("off_num"), F.col("next_num").alias("on_num"), F.col("dur").alias("off_dur"), F.col("next_dur").alias("on_dur"), *[x for c in extra for x in (F.col(c).alias(f"off_{c}"), F.col(f"next_{c}").alias(f"on_{c}"))])


def pass_counts(pairs: DataFrame) -> DataFrame:
    """Per task of ``adjacent_pairs``: pairs, runs of either side that ended with 0, and that passed verification with 0; null where no off run was verified."""
    passed = lambda c: F.count_if(F.col(c) == 0)
    verified = F.count("off_verify_exit") > 0
    return pairs.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), passed("off_exit_code").alias("off_pass"), passed("on_exit_code").alias("on_pass"),
        F.when(verified, passed("off_verify_exit")).alias("off_verify_pass"), F.when(verified, passed("on_verify_exit")).alias("on_verify_pass"),
    )


def distinct_rewinds(elisions: DataFrame) -> DataFrame:
    """Per run how many different rewinds (by place and summary) its telemetry holds: each later request repeats the earlier ones."""
    return elisions.groupBy("run").agg(F.count_distinct("anchor_idx", F.coalesce("summary", F.lit(""))).alias("rewinds"), F.count(F.lit(1)).alias("events"))


def positional_pairs(runs: DataFrame) -> DataFrame:
    """The k-th off run with the k-th on run, in the order of their names, over all runs; the longer side's rest goes."""
    side = lambda p: order.numbered(runs.where(F.col("proxy") == p).select(F.col("num").alias(f"{p}_num"), F.col("dur").alias(f"{p}_dur")), [F.col(f"{p}_num").cast("string")])
    return side("off").join(side("on"), "k").select("k", "off_num", "off_dur", "on_num", "on_dur")


def compare(runs: DataFrame) -> DataFrame:
    """Per task: medians of either side, change in percent; tasks of one side only stay."""
    sides = runs.where(F.col("proxy").isin("off", "on"))
    names = sides.groupBy("task").agg(*[F.max(F.col("proxy") == p).alias(f"has_{p}") for p in ("off", "on")])
    m = order.medians(sides, ["task", "proxy"], "dur")
    side = lambda p: m.where(F.col("proxy") == p).select("task", F.col("n").alias(f"n_{p}"), F.col("median").alias(f"median_{p}"))
    both = names.join(side("off"), "task", "left").join(side("on"), "task", "left")
    both = both.withColumns({f"n_{p}": F.when(F.col(f"has_{p}"), F.coalesce(f"n_{p}", F.lit(0))) for p in ("off", "on")}).select("task", "n_off", "median_off", "n_on", "median_on")
    return both.withColumn("delta_pct", F.try_divide((F.col("median_on") - F.col("median_off")) * 100, F.col("median_off")))


def condition(rewind: Column, hint: Column) -> Column:
    return (
        F.when((rewind == "on") & (hint == "on"), "rewind+hint").when((rewind == "on") & (hint == "off"), "rewind-only").when(F.coalesce(rewind, F.lit("?")).isin("off", "?"), "baseline")
        .otherwise(F.concat(F.lit("rewind="), F.coalesce(rewind, F.lit("?")), F.lit("/hint="), F.coalesce(hint, F.lit("?"))))
    )


def by_condition(runs: DataFrame) -> DataFrame:
    """Per (task, condition): number of runs, medians of cost, duration, turns and saved bytes, rates of runs with checkpoints and with verdict ok; the same (``_ok``) over ok runs alone.

    ``runs``: task, condition, cost, dur_ms, turns, bytes_saved, checkpoints, verdict. Groups without an ok run stay, with n_ok 0.
    """
    ok = F.coalesce(F.col("verdict") == "ok", F.lit(False))
    values = {"cost": "cost", "dur": "dur_ms", "turns": "turns", "saved": "bytes_saved"}
    has = (F.col("checkpoints") > 0).cast("int")
    rates = runs.groupBy("task", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg(has).alias("checkpoint_rate"), F.avg(ok.cast("int")).alias("ok_rate"), F.count_if(ok).alias("n_ok"), F.avg(F.when(ok, has)).alias("checkpoint_rate_ok"))
    each = [F.struct(F.lit(f"median_{n}").alias("metric"), F.col(c).cast("double").alias("value")) for n, c in values.items()] + [F.struct(F.lit(f"median_{n}_ok").alias("metric"), F.when(ok, F.col(c)).cast("double").alias("value")) for n, c in values.items()]
    m = order.medians(runs.select("task", "condition", F.inline(F.array(*each))), ["task", "condition", "metric"], "value")
    names = [f"median_{n}{end}" for end in ("", "_ok") for n in values]
    wide = m.groupBy(F.col("task").alias("_t"), F.col("condition").alias("_c")).agg(*[F.max(F.when(F.col("metric") == x, F.col("median"))).alias(x) for x in names])
    both = rates.join(wide, F.col("task").eqNullSafe(F.col("_t")) & F.col("condition").eqNullSafe(F.col("_c")), "left")
    return both.select("task", "condition", "n", *names[:4], "checkpoint_rate", "ok_rate", "n_ok", *names[4:], "checkpoint_rate_ok")


def rewind_totals(telemetry: DataFrame) -> DataFrame:
    """Per run the number of rewinds and the bytes they saved, null as 0; runs without one stay."""
    hit = F.col("type") == "rewind_applied"
    return telemetry.groupBy("run").agg(F.count_if(hit).alias("rewinds"), F.coalesce(F.sum(F.when(hit, F.coalesce("bytes_saved", F.lit(0)))), F.lit(0)).cast("bigint").alias("bytes_saved"))


def with_rewinds(tasks: DataFrame, totals: DataFrame) -> DataFrame:
    """A run's totals beside each of its tasks; runs without telemetry count 0."""
    j = tasks.join(totals, "run", "left")
    return j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rewinds", "bytes_saved")})


METRICS = ["duration_seconds", "input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "total_cost_usd", "num_turns"]


def task_metrics(summaries: DataFrame) -> DataFrame:
    """Per task and metric: how many runs have a number for it and its median; tasks without any number give no row."""
    values = [F.struct(F.lit(m).alias("metric"), F.col(m).try_cast("double").alias("value")) for m in METRICS]
    return order.medians(summaries.select("task", F.inline(F.array(*values))), ["task", "metric"], "value")


def harness_totals(turns: DataFrame) -> DataFrame:
    """Per turn log: steps, tool calls, the judge's YES answers, rewinds, input tokens and seconds."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return turns.groupBy("log").agg(
        (F.max("turn") + 1).alias("steps"), F.count_if(F.col("tool_call").isNotNull()).alias("n_tool_calls"), F.count_if(F.col("shadow.should") == "YES").alias("n_shadow_yes"), F.count_if("rewind_applied").alias("n_rewinds"),
        total("agent_prompt_tokens").cast("bigint").alias("total_input_tokens"), total("t_turn_s").alias("turn_seconds"),
    )


def cache_run(telemetry: DataFrame) -> DataFrame:
    """Per run: token totals, weighted cost, hit rate, compactions and the spike after them."""
    lines = W.partitionBy("run").orderBy("line")
    grp = F.count_if(F.col("type") == "cache_stats").over(lines.rowsBetween(W.unboundedPreceding, -1))
    rows = telemetry.where(F.col("type").isin("cache_stats", "compact")).withColumn("grp", grp)
    follow = F.max(F.col("type") == "compact").over(W.partitionBy("run", "grp"))
    rows = rows.withColumn("follow_up", (F.col("type") == "cache_stats") & follow)
    stats = F.col("type") == "cache_stats"
    total = lambda c: F.coalesce(F.sum(F.when(stats, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("bigint").alias(c)
    creation = F.when(stats, F.coalesce("cache_creation", F.lit(0)))
    after = F.when(F.col("follow_up"), F.coalesce("cache_creation", F.lit(0)))
    out = rows.groupBy("run").agg(
        F.count_if(stats).alias("n_requests"), F.count_if(~stats).alias("n_compact"), F.count_if("follow_up").alias("n_follow_up"), F.coalesce(F.sum(F.when(~stats, F.coalesce("saved", F.lit(0)))), F.lit(0)).cast("bigint").alias("compact_tokens_saved_est"), total("input_tokens"), total("cache_creation"), total("cache_read"), total("output_tokens"),
        F.when((F.count(after) > 0) & (F.count(creation) >= 3), F.median(after) - F.median(creation)).alias("creation_spike"),
    )
    cost = F.col("input_tokens") + 1.25 * F.col("cache_creation") + 0.1 * F.col("cache_read")
    rate = F.coalesce(F.try_divide(F.col("cache_read").cast("double"), F.col("input_tokens") + F.col("cache_creation") + F.col("cache_read")), F.lit(0.0))
    return out.withColumn("weighted_cost", F.round(cost, 4)).withColumn("hit_rate", F.round(rate, 6))


def prefix_match(keys: DataFrame, prompts: DataFrame, most: int = 64) -> DataFrame:
    """Event keys to tasks whose prompt starts with the key, or the reverse, on ``most`` characters; the smallest task counts, an empty key has none.

    Prompts are first reduced to one task for each text, then for each prefix of it; so a key meets one row for itself and one for
    each of its own prefixes, however many prompts begin alike. The two joins are by hash, on texts of ``most`` characters at most.
    """
    heads = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.left(c, n))).alias("x")
    k = keys.where("key <> ''").select("key", F.left("key", F.lit(most)).alias("k"))
    p = prompts.where("prompt is not null").groupBy(F.left("prompt", F.lit(most)).alias("p")).agg(F.min("task").alias("task"))
    longer = k.select("key", heads(F.col("k"))).join(p.withColumnRenamed("p", "x"), "x")
    began = p.select("task", heads(F.col("p"))).groupBy("x").agg(F.min("task").alias("task"))
    shorter = k.select("key", F.col("k").alias("x")).join(began, "x")
    return longer.select("key", "task").unionByName(shorter.select("key", "task")).groupBy("key").agg(F.min("task").alias("task"))


def of_task(runs: DataFrame, task: str) -> DataFrame:
    """All rows of the runs that have the task."""
    return runs.join(runs.where(F.col("task") == task).select("run").distinct(), "run", "left_semi")


def task_names(*sides: DataFrame) -> DataFrame:
    """The tasks of any side, each once."""
    out = sides[0].select("task")
    for s in sides[1:]:
        out = out.unionByName(s.select("task"))
    return out.distinct()


def patch_verdict(patches: DataFrame, heuristics: DataFrame) -> DataFrame:
    """(task, diff) against (task, files, keywords): no_heuristic, no_patch, wrong_area or ok; keyword_hit beside it."""
    j = patches.join(heuristics, "task", "left")
    touched = F.exists("files", lambda f: F.contains(F.col("diff"), F.concat(F.lit("diff --git a/"), f)) | F.contains(F.col("diff"), F.concat(F.lit("+++ b/"), f)))
    added = F.filter(F.split("diff", "\n"), lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++")))
    hit = F.exists("keywords", lambda k: F.exists(added, lambda x: F.contains(x, k)))
    verdict = F.when(F.col("files").isNull(), "no_heuristic").when(F.coalesce("diff", F.lit("")) == "", "no_patch").when(~touched, "wrong_area").otherwise("ok")
    return j.withColumn("verdict", verdict).withColumn("keyword_hit", F.coalesce(hit, F.lit(False)))
