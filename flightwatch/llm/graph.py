"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwatch.llm.tables import settled


#: Edges (16 bytes each) up to which they stay in one partition, so that the steps exchange nothing.
FEW_EDGES = 100_000


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges`` (``u``, ``v``, longs).

    Large-star and small-star steps by turns (Kiveris et al.) until nothing changes. A node's neighbours are never
    gathered: each step takes a minimum per node and joins it to the edges. Loops and repeated edges do no harm.
    FEW_EDGES at most are kept in one partition; beyond, every step is dealt out by node.
    """
    now = settled(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(now)
    few = seen[0] <= FEW_EDGES
    near = lambda df: df.coalesce(1) if few else df
    for _ in range(rounds):
        if not seen[0]:
            break
        both = near(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = near(large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v")))).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        below = down.groupBy("u").agg(F.min("v").alias("m"))
        small = near(down.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(below.select("u", F.col("m").alias("v")))).distinct()
        now = settled(small)
        last, seen = seen, _mark(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
