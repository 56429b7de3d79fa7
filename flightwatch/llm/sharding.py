"""Contiguous shards of nearly equal bytes.

Rows are put in order of their id by a range exchange and written once. Every partition then has a
byte total; a prefix sum over these totals (one row per partition) tells where a partition begins in
the whole, and a running sum inside the partition does the rest. Cuts lie at equal byte targets, so a
shard is off its share by at most one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightwatch.llm.registry import query
from flightwatch.llm.tables import settled, table

SHARDS = 16


def with_prefix_sums(ordered: DataFrame, size: str, order: list[str], part: str = "part") -> DataFrame:
    """Add ``start`` (sum of ``size`` before the row), ``nth`` (rows before it) and ``total``.

    ``ordered`` has its rows range-partitioned by ``order`` with the partition's number in ``part``.
    """
    along = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begins = (ordered.groupBy(part).agg(F.sum(size).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
              .select(part, F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_sum_before"),
                      F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_rows_before"),
                      F.sum("_sum").over(everything).alias("total")))
    inside = Window.partitionBy(part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ordered.join(begins, part)
            .withColumn("start", F.col("_sum_before") + F.sum(size).over(upto) - F.col(size))
            .withColumn("nth", F.col("_rows_before") + F.row_number().over(inside) - 1)
            .drop("_sum_before", "_rows_before"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1, checksum 0). Order is by id; equal ids by
    checksum and size, null ids first. Rows equal in all three are interchangeable, so repeated rows
    give a defined multiset of results; they are spread over partitions. An empty table gives no rows,
    shards may be empty when there are few rows. Other columns of ``docs`` are not read.
    """
    if not 0 < shards <= 100_000:
        raise ValueError("shards must be within 1 and 100000")
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    ordered = settled(narrow.withColumn("_spread", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
                      .repartitionByRange(*order, "_spread").drop("_spread")
                      .withColumn("part", F.spark_partition_id()))
    middle = (2 * F.col("start") + F.col("size")) * shards
    placed = (with_prefix_sums(ordered, "size", order)
              .withColumn("shard", F.least(F.floor(middle / (2 * F.col("total"))).cast("int"), F.lit(shards - 1))))
    # At most one row per shard: the bound on ``shards`` bounds what is broadcast.
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("_first"))
    return (placed.join(F.broadcast(firsts), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("_first")).alias("slot")))


@query("op5_sharding", """
WITH sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, coalesce(text, '') AS t FROM documents),
run AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS start,
         sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id) - 1 AS nth FROM sized),
cut AS (SELECT *, CAST(least(floor((2 * start + size) * 16 / (2 * total)), 15) AS INTEGER) AS shard FROM run),
bytes AS (
  -- Table-driven CRC-32 has no SQL function here: the register is folded over the bytes of the text.
  SELECT doc_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(t)),
    lambda i: CAST(('0x' || substr(h, 2 * i::INT + 1, 2)) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c
  FROM (SELECT doc_id, t, hex(encode(t)) AS h FROM sized))
SELECT cut.doc_id, size, xor(c, 4294967295) AS text_crc32, 'bytes' AS law, shard,
       CAST(nth - min(nth) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut JOIN bytes USING (doc_id)
""")
def op5_sharding(spark, sf_dir):
    out = balanced_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
