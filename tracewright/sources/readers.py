"""Readers of sessions, telemetry, run directories and manifests; writers of labelled sessions. Explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "struct<idx:bigint,role:string,tool_name:string,cmd:string,output:string,input_file:string,text:string>"
CHECKPOINT = "struct<after_step:bigint,progress_type:string,finding:string,evidence:string,next_direction:string>"
SESSION = f"session_id string, source string, steps array<{STEP}>, events array<struct<expire:bigint,checkpoint:{CHECKPOINT}>>, checkpoints array<{CHECKPOINT}>, expire_step_ids array<bigint>"
EVENT = "sessionId string, timestamp bigint, type string, url string, input_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, output_tokens bigint, anchorIdx bigint, turnsElided bigint, bytesSaved bigint, summary string, toolName string, tokensSavedEstimate bigint, name string, progress_type string, finding string, evidence string, next_direction string, sessionKey string, should string, reason string, elided bigint, rewindCount bigint, remaining bigint, attempt bigint, status bigint, delayMs bigint, compactCount bigint, overwrote boolean, found boolean, count bigint, bookmark_count bigint"
SUMMARY = "task_id string, mode string, model string, max_turns bigint, duration_seconds bigint, exit_code bigint, run_suffix string, input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, total_cost_usd double, num_turns bigint, claude_duration_ms bigint, claude_duration_api_ms bigint, stop_reason string, is_error boolean, error string"
MANIFEST = "schema_version bigint, default_model string, default_max_turns bigint, tasks array<struct<id:string,tier:bigint,max_turns:bigint,model:string,fixture:struct<url:string,ref:string,shallow:boolean,submodules:boolean,submodule_pins:map<string,string>,build_cmd:string>>>"
TURN = "turn bigint, t_turn_s double, agent_prompt_tokens bigint, agent_raw_output string, tool_call struct<name:string,arguments:map<string,string>>, shadow struct<should:string,reason:string,summary:string,raw:string>, rewind_applied boolean, rewind_n_elided bigint, tool_result string"
META = "stop_reason string, steps bigint, n_tool_calls bigint, n_shadow_yes bigint, n_rewinds bigint, act_on_shadow boolean, total_input_tokens bigint, wall_time_s double, fixture string, model string, success boolean, validation_tail string, log_path string, stamp string"


def sessions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One session a line; strict fails on a bad line, else bad lines are skipped. Legacy label columns become events."""
    df = spark.read.schema(SESSION).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return upgrade(df)


def upgrade(df: DataFrame) -> DataFrame:
    """Events from legacy checkpoints and expire_step_ids where there are none, by step, expiries first on ties."""
    ev = f"array<struct<k:bigint,o:int,i:int,e:struct<expire:bigint,checkpoint:{CHECKPOINT}>>>"
    none = F.array().cast(ev)
    expires = F.coalesce(F.transform("expire_step_ids", lambda x, i: F.struct(x.alias("k"), F.lit(0).alias("o"), i.alias("i"), F.struct(x.alias("expire"), F.lit(None).cast(CHECKPOINT).alias("checkpoint")).alias("e"))), none)
    marks = F.coalesce(F.transform("checkpoints", lambda c, i: F.struct(c["after_step"].alias("k"), F.lit(1).alias("o"), i.alias("i"), F.struct(F.lit(None).cast("bigint").alias("expire"), c.alias("checkpoint")).alias("e"))), none)
    merged = F.transform(F.array_sort(F.concat(expires, marks)), lambda x: x["e"])
    return df.withColumn("events", F.when(F.coalesce(F.size("events"), F.lit(0)) <= 0, merged).otherwise(F.col("events"))).drop("checkpoints", "expire_step_ids")


def explode_steps(df: DataFrame) -> DataFrame:
    return df.select("session_id", F.inline("steps"))


def lines(spark: SparkSession, path: str | list[str], **options: object) -> DataFrame:
    """(file, line, raw): the lines of text files, read by splits, so a large file is read by many tasks. ``line`` tells the order in a file: the split's first byte, then the
    place in the task that read it, which reads a split from begin to end."""
    found = spark.read.text(path, **options)
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return found.select(F.col("_metadata.file_path").alias("file"), at.alias("line"), F.col("value").alias("raw"))


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    broken = "_broken string"
    return raw.withColumn("e", F.from_json("raw", f"{schema}, {broken}", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Event files, malformed lines skipped (``malformed`` has them), with file and line order as written."""
    return _parsed(lines(spark, path), EVENT).where("e.type is not null and e._broken is null").select("file", "line", "e.*").drop("_broken")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """The lines of event files that are not blank and no JSON object: (file, line, raw)."""
    return _parsed(lines(spark, path), EVENT).where((F.trim("raw") != "") & (F.col("e._broken").isNotNull() | F.col("e").isNull())).select("file", "line", "raw")


def with_run(df: DataFrame, path: str = "_metadata.file_path") -> DataFrame:
    """run, task and rep from the path."""
    p = F.col(path)
    part = lambda rx: F.nullif(F.regexp_extract(p, rx, 1), F.lit(""))
    return df.select("*", part(r"(run_\d+)").alias("run"), part(r"run_\d+/([^/]+)/").alias("task"), part(r"_(\d+)\.[a-z]+$").cast("bigint").alias("rep"))


def run_files(spark: SparkSession, root: str, name: str, runs: list[str] | None = None, tasks: list[str] | None = None) -> list[str]:
    """Paths of a run directory's files, by globs over the run and task folders wanted, so no other folder is listed or read; none where there is none.

    ``tasks``: [] for files of the run itself.
    """
    any_of = lambda names, every: every if names is None else "{" + ",".join(names) + "}"
    glob = "/".join([root.rstrip("/"), any_of(runs, "run_*"), *([] if tasks == [] else [any_of(tasks, "*")]), name])
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [glob] if found is not None and len(found) else []


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("run", "string"), ("task", "string"), ("rep", "bigint"))])


def summaries(spark: SparkSession, root: str, runs: list[str] | None = None, tasks: list[str] | None = None) -> DataFrame:
    """Summaries of all runs, or of those named; folders of others are not opened."""
    paths = run_files(spark, root, "summary_*.json", runs, tasks)
    return with_run(spark.read.schema(SUMMARY).option("multiLine", True).json(paths)) if paths else _empty(spark, SUMMARY)


def verify_results(spark: SparkSession, root: str, runs: list[str] | None = None, tasks: list[str] | None = None) -> DataFrame:
    paths = run_files(spark, root, "verify_*.json", runs, tasks)
    return with_run(spark.read.schema("verify_exit bigint").option("multiLine", True).json(paths)) if paths else _empty(spark, "verify_exit bigint")


def run_config(spark: SparkSession, root: str, runs: list[str] | None = None) -> DataFrame:
    """A row per run with a run.log: key=value pairs of its first line that holds run_id= and proxy=; and of its first line that holds proxy= what the two analyses take for the
    proxy's state: ``side``, off before on, null where neither (the run counts on no side), and ``cached``, on or else off."""
    keys = ["run_id", "proxy", "bookmarks", "rewind", "rewind_hint", "shadow"]
    paths = run_files(spark, root, "run.log", runs, [])
    if not paths:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ["run", *keys, "side", "cached"]))
    raw = with_run(lines(spark, paths), "file").select("run", "line", "raw")
    named = F.contains("raw", F.lit("proxy="))
    first = lambda c: F.coalesce(F.min_by(F.when(c, F.col("raw")), F.when(c, F.col("line"))), F.lit(""))
    heads = raw.groupBy("run").agg(first(named & F.contains("raw", F.lit("run_id="))).alias("head"), first(named).alias("any"))
    get = lambda k: F.nullif(F.regexp_extract("head", rf"\b{k}=(\S+)", 1), F.lit("")).alias(k)
    on, off = (F.contains("any", F.lit(f"proxy={x}")) for x in ("on", "off"))
    return heads.select("run", *map(get, keys), F.when(off, "off").when(on, "on").alias("side"), F.when(on, "on").otherwise("off").alias("cached"))


RESULT = "type string, num_turns bigint, total_cost_usd double, duration_ms bigint, duration_api_ms bigint, stop_reason string, is_error boolean, usage struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"


def last_result(spark: SparkSession, root: str, runs: list[str] | None = None, tasks: list[str] | None = None) -> DataFrame:
    """The last record of type result of each transcript, with its usage and line; lines that are no JSON go. A transcript is read by splits, its last record found by a maximum."""
    paths = run_files(spark, root, "transcript_*.jsonl", runs, tasks)
    if not paths:
        return _empty(spark, f"{RESULT}, line struct<split:bigint,row:bigint>").select("run", "task", "rep", "line", *[c.split()[0] for c in RESULT.split(", ")])
    parsed = _parsed(with_run(lines(spark, paths), "file"), RESULT).where("e.type = 'result' and e._broken is null")
    last = parsed.groupBy("file", "run", "task", "rep").agg(F.max("line").alias("line"), F.max_by("e", "line").alias("r"))
    return last.select("run", "task", "rep", "line", "r.*").drop("_broken")


def patches(spark: SparkSession, root: str, runs: list[str] | None = None, tasks: list[str] | None = None) -> DataFrame:
    """A patch is one value, so its file is read whole."""
    paths = run_files(spark, root, "patch_*.diff", runs, tasks)
    return with_run(spark.read.text(paths, wholetext=True)).withColumnRenamed("value", "diff") if paths else _empty(spark, "diff string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return m.select("default_model", "default_max_turns", F.inline("tasks")).select("id", "tier", F.coalesce("max_turns", "default_max_turns").alias("max_turns"), F.coalesce("model", "default_model").alias("model"), "fixture")


def harness_turns(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(TURN).option("pathGlobFilter", "*.jsonl").json(root).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl$", 1).alias("log"), "*")


def harness_meta(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(META).option("multiLine", True).option("pathGlobFilter", "*.meta.json").json(root).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.meta\.json$", 1).alias("log"), "*")


def candidates(parts: list[DataFrame], most: int = 30000, least_steps: int = 20, most_steps: int = 150) -> DataFrame:
    """Datasets in order, each one's first ``most`` sessions by id, of a number of tool steps in range."""
    out = None
    for n, p in enumerate(parts):
        first = p.withColumn("source_ord", F.lit(n))
        first = first.orderBy("session_id").limit(most) if most else first  # a bounded top-k: no window over the whole dataset
        out = first if out is None else out.unionByName(first, allowMissingColumns=True)
    n_tools = F.size(F.filter("steps", lambda s: s["role"] == "tool"))
    return out.where((n_tools >= least_steps) & (n_tools <= most_steps))


def unfinished(sessions_: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: sessions whose ids are not written yet."""
    return sessions_.join(done.select("session_id").distinct(), "session_id", "left_anti")


def up_to(sessions_: DataFrame, done: DataFrame, target: int, order: list[str]) -> DataFrame:
    """Resume to a target count: in order, as many unfinished sessions as are missing; none where it is reached."""
    left = target - done.select("session_id").distinct().count()
    return unfinished(sessions_, done).orderBy(*order).limit(max(left, 0))


def seeded_choice(sessions_: DataFrame, order: str, seed: int = 42, of_first: int = 20) -> DataFrame:
    """One of the first ``of_first`` sessions, by a hash of id and seed: the same on every run and at every partitioning."""
    first = sessions_.orderBy(order, "session_id").limit(of_first)
    return first.orderBy(F.md5(F.concat_ws(":", F.col("session_id").cast("string"), F.lit(seed).cast("string"))), "session_id").limit(1)


def nth(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The row at the 0-based position; none where there are fewer. Places are given by ranges, so no task reads all rows before it."""
    from tracewright.operators.order import numbered

    return numbered(rows, order, "_nth").where(F.col("_nth") == n + 1).drop("_nth")


def write_sessions(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)
