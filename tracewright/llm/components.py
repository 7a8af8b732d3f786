"""Connected components of an edge table, by min-neighbour hooking, pointer jumping and contraction.

Each round hooks every node to its smallest neighbour, jumps pointers until all point at roots, and
keeps only edges between different roots. Rounds and jumps are logarithmic; labels live in
tables in the shared folder, never on the driver. The component's label is its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Stored


def components(edges: DataFrame, stored: Stored) -> DataFrame:
    """``edges`` (u, v bigint) to (node, component), a row per node of an edge."""
    e = stored.keep(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = stored.keep(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:
            up = p.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stored.keep(p.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            p = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        rounds.append(p)
        e = stored.keep(
            e.join(p.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
            .join(p.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .where("u < v")
            .distinct()
        )
    if not rounds:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = rounds[0]
    for p in rounds[1:]:
        out = out.join(p.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out.select("node", F.col("root").alias("component"))
