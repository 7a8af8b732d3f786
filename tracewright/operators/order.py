"""Places in a whole order, and exact order statistics of groups of any size: by a range sort, never in one task.

Rows are dealt into ranges, sorted within them and written once with their place in the range; the counts of the ranges, one row
each, are summed up, and a row's place is its range's offset and its own. Statistics of a group are the values at places of the
order by group and value, so a group with a third of all rows is sorted by many tasks and none holds it. Equal values of one
group are dealt by the place they were read at.

Defined results: null values count for no statistic; groups without any give no row; a null group is a group. Nulls of an
order come first, ties are broken by nothing else than the order given. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.sources.shared import stored


def numbered(rows: DataFrame, order: list[str | Column], name: str = "k") -> DataFrame:
    """``rows`` with their place in the order, from 1."""
    laid = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r["count"]) for r in laid.groupBy(part.alias("part")).count().collect())  # a row for each range
    offsets, before = [], 0
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    out = laid.withColumn("_part", part).join(F.broadcast(table), "_part")  # as many rows as there are ranges
    return out.withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group the count ``n`` and, for each name, the value at the rank (from 0) that it gives for the count."""
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    laid = numbered(known, [*by, F.col("_v"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))], "_k")
    groups = laid.groupBy(*by).agg(F.min("_k").alias("_first"), F.count(F.lit(1)).alias("n"))
    wanted = [F.struct(F.lit(name).alias("_name"), (F.col("_first") + rank(F.col("n"))).cast("bigint").alias("_k")) for name, rank in ranks.items()]
    places = groups.select(*by, "n", F.inline(F.array(*wanted)))
    found = places.join(laid.select("_k", "_v"), "_k")
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])


def medians(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Per group the count ``n`` and the median, the mean of the two middle values of an even count."""
    both = at_ranks(rows, by, value, {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)})
    return both.withColumn(name, (F.col("_lo").cast("double") + F.col("_hi").cast("double")) / 2).drop("_lo", "_hi")
