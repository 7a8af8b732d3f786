"""Sharding (native): rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a number u in (0, 1) from an md5 of both; the row goes to the shard
with the largest ``-weight / ln(u)`` (with equal weights: the largest u). Only the key and the
shards decide, so adding a shard moves rows into the new one only, and none between old ones.
``assign`` is a projection: no shuffle, whatever the rows hold.

``place`` also numbers the rows of each shard. Equal rows are counted before the shuffle (one
row per distinct key, size and checksum), shards are cut into ``buckets`` by the hash of those
three, rows are numbered inside a bucket, and the buckets' totals (shards x buckets rows, a
fixed bound) give the offsets. No task holds a shard, and no key's repeats meet in one task.

Defined results
  null key: hashed as the empty string. null text: size 8, checksum 0.
  repeated rows: each gets its own slot; slots go by (bucket, key, checksum, size).
  empty input: an empty result. Clashing column names: ``assign`` replaces ``shard``; ``place`` returns a key that is named
  like one of its outputs, in any case, with an underscore before it. Very long texts: only their size and checksum travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import fresh, load, quoted

SHARDS = 24


def unit_hex(key: Column, shard: int) -> Column:
    """13 hex digits (52 bits) of the pair's md5."""
    return F.left(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{shard}")).cast("binary")), F.lit(13))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``; shards are 0 to len(weights) - 1. A weight of 0 takes nothing; ties go to the higher shard."""
    if len(weights) == 0 or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights: one at least above 0, none below")
    if len(set(weights)) == 1:
        scored = [F.struct(unit_hex(key, j).alias("score"), F.lit(j).alias("shard")) for j in range(len(weights))]
    else:
        u = lambda j: (F.conv(unit_hex(key, j), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
        scored = [F.struct((F.lit(-float(w)) / F.log(u(j))).alias("score"), F.lit(j).alias("shard")) for j, w in enumerate(weights) if w > 0]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0]).getField("shard")


def assign(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """``df`` with the column ``shard``; no shuffle."""
    return df.withColumn(shard, rendezvous(F.col(key), weights))


def place(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", overhead: int = 8, buckets: int = 256) -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot, grown_shard (with one more shard of mean weight)."""
    body = F.coalesce(quoted(text), F.lit(""))
    outputs = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    name = fresh(outputs, key)[0] if key.lower() in outputs else key
    rows = docs.select(quoted(key).alias("_k"), (F.octet_length(body) + overhead).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    distinct = rows.groupBy("_k", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    grown = [*weights, sum(weights) / len(weights)]
    placed = distinct.select("*", rendezvous(F.col("_k"), weights).alias("shard"), F.pmod(F.xxhash64("_k", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("_b"))
    before = (
        placed.groupBy("shard", "_b")
        .agg(F.sum("_n").alias("_t"))
        .select("shard", "_b", (F.sum("_t").over(W.partitionBy("shard").orderBy("_b")) - F.col("_t")).alias("_from"))
    )
    inside = W.partitionBy("shard", "_b").orderBy("_k", "text_crc32", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = placed.withColumn("_first", F.sum("_n").over(inside) - F.col("_n")).join(F.broadcast(before), ["shard", "_b"])
    step = 10_000  # repeats are listed in pieces of this many, to keep arrays short
    pieces = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), ((F.col("_n") - 1) / step).cast("bigint"))).alias("_piece"))
    listed = pieces.select("*", F.explode(F.sequence(F.col("_piece") * step, F.least(F.col("_n"), (F.col("_piece") + 1) * step) - 1)).alias("_i"))
    return listed.select(
        F.col("_k").alias(name),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_from") + F.col("_first") + F.col("_i")).alias("slot"),
        rendezvous(F.col("_k"), grown).alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(load(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * SHARDS)


#: DuckDB has no crc32 and no xxhash64; the test compares those and the slots with brute force.
ORACLE = None
