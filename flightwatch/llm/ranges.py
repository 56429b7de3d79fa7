"""Running sums over a whole table in order, without ever putting the table into one task.

Rows are put in order by a range exchange and written once. One row per partition holds its totals; sums
over these rows tell what lies before a partition, and a running sum inside the partition does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightwatch.llm.tables import settled

#: Rows equal in all of the order are spread over so many numbers, so that they may lie in several partitions.
SPREAD = 4096


def running(df: DataFrame, order: list[Column], *sums: str) -> DataFrame:
    """``df`` with ``part``, ``nth`` (rows before the row, from 0) and, for each column of ``sums``, ``<name>_before``.

    Rows equal in all of ``order`` are interchangeable. ``df`` is read twice (once to sample the ranges), so give a
    written table. The sums may not contain nulls. An empty table stays empty.
    """
    rows = settled(df.withColumn("_spread", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
                   .repartitionByRange(*order, "_spread").drop("_spread")
                   .withColumn("part", F.spark_partition_id()).withColumn("_one", F.lit(1).cast("long")))
    columns = {"_one": "nth", **{c: f"{c}_before" for c in sums}}
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = (rows.groupBy("part").agg(*[F.sum(c).alias(c) for c in columns])
              .select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_begin_{c}") for c in columns]))
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(begins, "part")
    return out.select(*[c for c in rows.columns if c != "_one"],
                      *[(F.col(f"_begin_{c}") + F.sum(c).over(upto) - F.col(c)).alias(name) for c, name in columns.items()])
