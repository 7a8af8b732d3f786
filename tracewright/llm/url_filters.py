"""URL filters (native): a sort-merge range join between reversed-host keys and prefix rules.

A host ``www.example.com`` has the canonical key ``com.example.www.``; the hosts that a rule
covers are then exactly the keys that start with the rule's key, that is one interval of the
sort order, and the intervals of two rules are nested or disjoint. Keys and rules are sorted
together and swept once. The sweep keeps the stack: a slot per number of labels holds the last rule
host of that depth that was passed, since two of one depth never nest, a new one ends the old. A
URL's row pops what no longer covers its key and takes the deepest rule that is left and fits its path.

Skew: the sweep runs in ``lanes`` independent lanes. URLs go to a lane by their row's own number
rather than by host, so one host or URL with a third of all rows spreads evenly; each lane gets
a copy of the rules (rules x lanes small rows). Nothing is broadcast; of the rules only the numbers of labels that their hosts have are collected.

Defined results
  null url, or no ``://``: host and path empty, no rule, default verdict.
  several rules of one (host, path): the blocking one, then the smallest string, counts.
  longest rule: the longest host first, then the longest path.
  rules with a null host, path or verdict are ignored; an empty host fits every non-empty host.
  many rules of one host travel together: each URL below it looks through all their paths.
  no rules / no URLs: every URL gets the default verdict / an empty result.
  Extra columns pass through; ``host, path, rule, verdict`` replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import kept_columns, load, lower_ascii, quoted

#: (host, path, verdict) of the registered query; fixed values.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``a.b.c`` to ``c.b.a.``; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_nodes(rules: DataFrame) -> DataFrame:
    """One row per rule host: ``key``, its ``depth`` in labels, and ``entries``, its paths with rules and verdicts, longest path first."""
    r = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.min(F.struct(F.when(F.col("verdict") == "block", 0).otherwise(1), F.col("verdict"))).getField("verdict").alias("verdict"))
        .withColumn("key", host_key(F.col("host")))
    )
    entry = F.struct(F.length("path").alias("path_len"), F.col("key").alias("prefix"), "path", F.concat("host", "path").alias("rule"), "verdict")
    depth = F.when(F.col("key") == "", 0).otherwise(F.size(F.split("key", r"\.")) - 1)
    return r.groupBy("key").agg(F.sort_array(F.collect_list(entry), asc=False).alias("entries")).withColumn("depth", depth)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", lanes: int | None = None) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``: the longest rule's verdict, else ``default``."""
    lanes = lanes or max(64, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = kept_columns(pages, ["host", "path", "rule", "verdict"])
    host, path = host_and_path(F.col(url))
    row = F.struct(*map(quoted, kept))
    urls = pages.select(row.alias("_row"), host.alias("_host"), path.alias("_path")).select(
        "_row", "_host", "_path", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes)).cast("int").alias("_lane"), host_key(F.col("_host")).alias("_key"), F.lit(1).alias("_kind")
    )
    nodes = rule_nodes(rules)
    depths = sorted((x.depth for x in nodes.select("depth").distinct().collect()), reverse=True)  # labels of a host: a few dozen at most
    starts = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_lane"), F.col("key").alias("_key"), F.lit(0).alias("_kind"), F.col("entries").alias("_entries"), F.col("depth").alias("_depth"))
    both = urls.unionByName(starts, allowMissingColumns=True)
    sweep = W.partitionBy("_lane").orderBy("_key", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    passed = lambda d: F.last(F.when(F.col("_depth") == d, F.col("_entries")), ignorenulls=True).over(sweep)
    swept = both.select("*", *[passed(d).alias(f"_at{d}") for d in depths]).where("_kind = 1")
    fits = lambda e: (F.col("_key") != "") & F.col("_key").startswith(e["prefix"]) & F.col("_path").startswith(e["path"])
    # deepest slot first; a slot's entries are the longest path first
    found = [F.get(F.filter(f"_at{d}", fits), F.lit(0)) for d in depths]
    rule = F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")
    return swept.withColumn("_rule", rule).select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(load(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
with r(h, p, v) as (values ('com','/en/','block'), ('example.com','/en/7','allow'), ('net','/de/','allow'), ('example.net','/de/8','block'), ('org','/es/','block')),
u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
s as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select s.*, (select max(struct_pack(hl := length(r.h), pl := length(r.p), rule := r.h || r.p, v := r.v)) from r
      where (s.host = r.h or s.host like '%.' || r.h) and starts_with(s.path, r.p)) as hit from s)
select page_id, host, path, hit.rule as rule, coalesce(hit.v, 'allow') as verdict from m
"""
