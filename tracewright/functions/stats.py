"""Statistics of paired runs and rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Two-sided 5 % points of Student's t by degrees of freedom; fixed values.
T_TABLE = [
    (1, 12.71), (2, 4.30), (3, 3.18), (4, 2.78), (5, 2.57), (6, 2.45), (7, 2.36), (8, 2.31), (9, 2.26), (10, 2.23), (11, 2.20), (12, 2.18), (13, 2.16), (14, 2.14), (15, 2.13),
    (16, 2.12), (17, 2.11), (18, 2.10), (19, 2.09), (20, 2.09), (21, 2.08), (22, 2.07), (23, 2.07), (24, 2.06), (25, 2.06), (30, 2.04), (40, 2.02), (60, 2.00), (120, 1.98),
]


def t_critical(df: Column) -> Column:
    """Floor look-up: the entry of the largest tabled df not above; infinite for df <= 0."""
    out = F.lit(float("inf"))
    for d, t in T_TABLE:
        out = F.when(df >= d, t).otherwise(out)
    return out


def floor_percentiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """sorted[floor(n * q)] per group. Equal values are counted first, so a task holds a group's distinct values and no more."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*by)
    rows = counts.select("*", F.sum("_c").over(w.orderBy(value)).alias("_end"), F.sum("_c").over(w).alias("_n"))
    at = lambda q: F.least(F.floor(F.col("_n") * q), F.col("_n") - 1)
    pick = lambda q: F.max(F.when((F.col("_end") > at(q)) & (F.col("_end") - F.col("_c") <= at(q)), F.col(value)))
    return rows.groupBy(*by).agg(F.sum("_c").alias("count"), F.sum(F.col(value) * F.col("_c")).alias("total"), F.max(value).alias("max"), *[pick(q).alias(k) for k, q in quantiles.items()])


def paired(pairs: DataFrame, by: list[str], off: str, on: str) -> DataFrame:
    """Per group: n, mean difference, sample deviation, t, Cohen's d, critical t, significance, runs for 80 % power."""
    d = F.col(on) - F.col(off)
    s = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("sd"), F.median(off).alias("median_off"), F.median(on).alias("median_on")).where("n >= 2")
    flat = F.col("sd") == 0
    s = s.withColumn("t", F.when(flat, 0.0).otherwise(F.col("mean_delta") / (F.col("sd") / F.sqrt(F.col("n").cast("double")))))
    s = s.withColumn("d", F.when(flat, 0.0).otherwise(F.col("mean_delta") / F.col("sd"))).withColumn("t_crit", t_critical(F.col("n") - 1))
    power = F.greatest(F.ceil(F.pow(F.lit(2.8) / F.abs(F.col("d")), F.lit(2))), F.lit(1)).cast("bigint")
    return s.withColumn("significant", F.abs("t") > F.col("t_crit")).withColumn("n_for_power", F.when(F.abs("d") > 0.05, power))


def mean(c: Column | str) -> Column:
    """Mean of the values there are; null without any."""
    return F.avg(c)


def fixed(v: Column, digits: int) -> Column:
    """A number with so many decimals, rounded half to even on its exact binary value, without grouping."""
    return F.replace(F.format_number(v.cast("double"), digits), F.lit(","), F.lit(""))


def dash(v: Column, shown: Column) -> Column:
    """``shown``, or a dash where ``v`` is null or not a number."""
    return F.when(v.isNull() | F.isnan(v.cast("double")), "—").otherwise(shown)


def money(v: Column) -> Column:
    return dash(v, F.concat(F.lit("$"), fixed(v, 2)))


def thousands(v: Column) -> Column:
    """Millions with two decimals, thousands with one."""
    size = F.abs(v)
    return F.when(size >= 1e6, F.concat(fixed(v / 1e6, 2), F.lit("M"))).when(size >= 1e3, F.concat(fixed(v / 1e3, 1), F.lit("K"))).otherwise(fixed(v, 0))


def fmt_usd(v: Column) -> Column:
    return dash(v, F.concat(F.lit("$"), fixed(v, 3)))


def fmt_seconds(ms: Column) -> Column:
    return dash(ms, F.concat(fixed(ms / 1000, 0), F.lit("s")))


def fmt_k(v: Column) -> Column:
    """Millions with two decimals, thousands and less without; a dash for null."""
    size = F.abs(v)
    return dash(v, F.when(size >= 1e6, F.concat(fixed(v / 1e6, 2), F.lit("M"))).when(size >= 1e3, F.concat(fixed(v / 1e3, 0), F.lit("K"))).otherwise(fixed(v, 0)))


def fmt_duration(seconds: Column) -> Column:
    """Seconds below a minute, else minutes with one decimal."""
    return dash(seconds, F.when(seconds < 60, F.concat(fixed(seconds, 0), F.lit("s"))).otherwise(F.concat(fixed(seconds / 60, 1), F.lit("m"))))


def fmt_int(v: Column) -> Column:
    return dash(v, F.when(v >= 1000, F.concat(fixed(v / 1000, 0), F.lit("k"))).otherwise(fixed(v, 0)))


def delta_pct(before: Column, after: Column) -> Column:
    """Signed change in whole percent; a dash where a side is missing or the first is 0."""
    x = F.try_divide(after.cast("double") - before, before) * 100
    shown = fixed(x, 0)
    return dash(x, F.concat(F.when(F.startswith(shown, F.lit("-")), "").otherwise("+"), shown, F.lit("%")))
