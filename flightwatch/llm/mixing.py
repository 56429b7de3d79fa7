"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of a source, documents in order of their id, are one stream that is cut into blocks of equally many
words; runs of ``shard_blocks`` blocks are shards. All blocks that the mix has are dealt to the sources by
highest quotients target / (2 seats + 1), and a source's blocks to its shards likewise by their words. A shard's
quota is met by whole rounds over all of its blocks, then by blocks in a seeded order; the last one is cut where
the quota ends. So a block is taken at most ``repeats`` times, and a document as often as the blocks it lies in.

Nothing is done in one task but sums over one row per partition: order, prefix sums and ranks of quotients come
from ranges of rows, and only the quotients near the last one dealt are ever listed.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightwatch.llm.ranges import running
from flightwatch.llm.registry import query
from flightwatch.llm.tables import settled, table

#: Words of a block. Small, so that sources of a few words come near their target too; for large corpora the length
#: of a training sequence will do.
BLOCK_WORDS = 16
SHARD_BLOCKS = 4096
REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Greater than any hexadecimal hash.
_ALL = "g"


def _row(frame: DataFrame, *sums: str):
    """The sums of some columns: one row, whatever the table's size."""
    return frame.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums]).first()


def targets(sources: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size`` (one row per source, sizes not null) with ``place``, ``begin`` and ``target``.

    Sources in order by code point, null last (``place`` from 0; ``begin`` is the size of those before), weigh
    ``weights`` repeating. They share the sum of all sizes; no target is above ``repeats`` times its source's size,
    and what is cut off goes to the others by weight, until none is above. In order of size per weight the capped
    sources come first, so prefix sums of sizes and weights give the share of the first that is not capped.
    """
    if not weights or min(weights) <= 0 or any(int(w) != w for w in weights) or repeats < 1:
        raise ValueError("weights must be whole numbers above 0, repeats at least 1")
    placed = running(sources, [F.asc_nulls_last("source")], "source_size")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    placed = settled(placed.select("source", "source_size", F.col("nth").alias("place"), F.col("source_size_before").alias("begin"),
                                   weight.alias("weight"), (F.col("source_size") * repeats).alias("most")))
    whole = _row(placed, "source_size", "weight")
    ranked = running(placed, [(F.col("most") / F.col("weight")).asc(), F.col("place").asc()], "most", "weight")
    rest = F.lit(Decimal(whole["source_size"] or 0)).cast("decimal(20,0)") - F.col("most_before")
    left = F.lit(Decimal(whole["weight"] or 0)).cast("decimal(17,0)") - F.col("weight_before")
    free = ranked.filter(F.col("most") * left.cast("decimal(17,0)") > F.col("weight") * rest.cast("decimal(20,0)"))
    first = free.agg(F.min(F.struct("weight_before", "most_before")).alias("first")).first()["first"]
    target = F.col("most").cast("double")
    if first is not None:
        share = (F.col("weight") * F.lit(whole["source_size"] - first["most_before"])).cast("double")
        target = F.least(target, share / F.lit(float(whole["weight"] - first["weight_before"])))
    return placed.withColumn("target", target).drop("weight", "most")


def apportion(parties: DataFrame, seats: int, votes: str, order: str) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` go to the highest of all quotients votes / (2 j + 1), j = 0, 1, ..., ties
    to the smaller ``order`` (unique), then to the smaller j. Parties without votes get none.

    With n parties, those seats that the divisors for ``seats`` less n/2 give are sure, and those for ``seats`` plus
    n/2 are enough (each with one to spare for rounding): about 4 n quotients between them are put in order.
    """
    whole = _row(parties.filter(F.col(votes) > 0), votes)
    if not whole["n"] or seats < 1:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    few, many = max(0.0, seats - whole["n"] / 2 - 1), seats + whole["n"] / 2 + 1

    def rounded(to):
        return F.floor(F.col(votes) * F.lit(to / whole[votes]) + 0.5)

    sure = F.greatest(F.lit(0).cast("long"), rounded(few) - 1)
    parties = parties.withColumn("_sure", F.when(F.col(votes) > 0, sure).otherwise(0))
    near = settled(parties.filter(F.col(votes) > 0).select(F.col(order).alias("_party"), F.col(votes).alias("_votes"),
                   F.explode(F.sequence("_sure", rounded(many) + 1)).alias("_j"))
                   .select("_party", "_j", (F.col("_votes") / (2 * F.col("_j") + 1)).alias("_quotient")))
    open_seats = seats - (_row(parties, "_sure")["_sure"] or 0)
    won = (running(near, [F.desc("_quotient"), F.asc("_party"), F.asc("_j")]).filter(F.col("nth") < open_seats)
           .groupBy("_party").agg(F.count(F.lit(1)).alias("_won")))
    return (parties.join(won, F.col(order) == F.col("_party"), "left")
            .withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_sure", "_party", "_won"))


def shard_quota(quota: Column, words: Column, shard: Column, full: int) -> Column:
    """What shard number ``shard`` of a source of ``words`` gets of its source's ``quota`` of blocks, by highest quotients
    words / (2 j + 1), ties to the smaller shard.

    All shards but the last have ``full`` words, so seats are dealt to them in whole rows. Seat l of the last shard,
    of e words, comes after l own ones and those of the full shards whose quotient is not smaller; these are the
    (full (2 l + 1) - e) div (2 e) + 1 first of each.
    """
    count = F.floor(words / full)
    rest = words % full
    guess = F.greatest(F.lit(0).cast("long"), F.floor(quota * rest / words) - 4)

    def comes_after(seat):
        return seat + count * (F.floor((full * (2 * seat + 1) - rest) / (2 * rest)) + 1)

    last = (F.when(rest == 0, 0).when(count == 0, quota)
            .otherwise(guess + F.size(F.filter(F.sequence(guess, guess + 8), lambda seat: comes_after(seat) < quota))))
    others = quota - last
    return (F.when(shard == count, last)
            .otherwise(F.floor(others / count) + F.when(shard < others % count, 1).otherwise(0)).cast("long"))


def _hash(seed: str, place: Column, block: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), place.cast("string"), block.cast("string")).cast("binary"))


def _plans(shards: DataFrame, block: int, shard_blocks: int, repeats: int, seed: str) -> DataFrame:
    """How each shard (``place, shard, source_size, quota``) meets its quota: ``rounds`` over all its blocks, then blocks
    whose hash is below ``limit``, then ``cut`` words of the block whose hash is ``limit``. A short block at the
    source's end comes last (from block ``short`` on)."""
    full = block * shard_blocks
    words = F.least(F.lit(full).cast("long"), F.col("source_size") - F.col("shard") * full)
    owed = F.least(shard_quota(F.col("quota"), F.col("source_size"), F.col("shard"), full) * block, words * repeats)
    out = (shards.withColumn("_words", words).withColumn("_owed", owed)
           .withColumn("rounds", F.floor(F.col("_owed") / F.col("_words")))
           .withColumn("_rest", F.col("_owed") % F.col("_words"))
           .withColumn("_first", F.col("shard") * shard_blocks)
           .withColumn("short", F.col("_first") + F.floor(F.col("_words") / block)))
    hashes = F.array_sort(F.transform(F.sequence("_first", F.col("short") - 1), lambda k: _hash(seed, F.col("place"), k)))
    chosen = F.floor(F.col("_rest") / block).cast("int")
    limit = (F.when(F.col("_rest") == 0, "").when(chosen >= F.col("short") - F.col("_first"), _ALL)
             .otherwise(F.element_at(hashes, chosen + 1)))
    return out.select("place", "shard", "rounds", "short", limit.alias("limit"), (F.col("_rest") % block).alias("cut"))


def mix(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, repeats: int = REPEATS,
        seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, source, size, source_size, target, spans`` of every row of ``docs``.

    ``size`` counts the words of the whole text (null: 0). ``spans`` are the parts that the mix takes: words ``from``
    (from 0) to ``to`` (exclusive), ``times`` times; parts may overlap, their times add up, none is taken more than
    ``repeats`` times. What is taken of a source is its target but for half a block, as far as its quota in whole
    blocks can tell (a block more in a source whose last shard is shorter than a block). The same rows, parameters
    and seed give the same result, however they are partitioned. Null sources are a source of their own; equal
    rows are interchangeable; null ids come first. Other columns are not read. Without words all targets are 0;
    an empty table gives no rows.
    """
    if block < 1 or shard_blocks < 1:
        raise ValueError("block and shard_blocks must be at least 1")
    sizes = settled(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    words = _row(sizes, "size")["size"] or 0
    dealt = settled(apportion(sources, (2 * words + block) // (2 * block) or min(words, 1), "target", "place"))
    rows = running(sizes, [F.asc_nulls_last("source"), F.col("doc_id"), F.col("size")], "size")
    # Facts of sources join per part of the range exchange: a source of a third of all rows is as many keys as parts.
    heads = (rows.select(F.col("part").alias("_part"), F.col("source").alias("_source")).distinct()
             .join(dealt.withColumnRenamed("source", "_own"), F.col("_source").eqNullSafe(F.col("_own"))).drop("_own"))
    full = block * shard_blocks
    begin = F.col("size_before") - F.col("begin")
    known = (rows.join(heads, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
             .select("nth", "doc_id", "source", "size", "source_size", "target", "quota", "place", begin.alias("begin"),
                     F.explode(F.sequence(F.floor(begin / full), F.floor((begin + F.greatest(F.col("size"), F.lit(1)) - 1) / full)))
                     .alias("shard")))
    known = settled(known)
    # Few bytes, much work: a stated number of partitions is not put together again by size.
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = known.filter("size > 0").groupBy("place", "shard").agg(
        F.first("source_size").alias("source_size"), F.first("quota").alias("quota"))
    plans = settled(_plans(shards.repartition(spread, "place", "shard"), block, shard_blocks, repeats, seed))
    known = known.repartition(spread, "place", "shard")
    plans = plans.withColumnsRenamed({"place": "_place", "shard": "_shard"})
    low = F.greatest(F.col("begin"), F.col("shard") * full)
    high = F.least(F.col("begin") + F.col("size"), (F.col("shard") + 1) * full)

    def span(start, end, times):
        return F.struct((start - F.col("begin")).alias("from"), (end - F.col("begin")).alias("to"), times.cast("long").alias("times"))

    def chosen(k):
        of = _hash(seed, F.col("place"), k)
        whole = (k < F.col("short")) & (of < F.col("limit"))
        cut = F.when(k < F.col("short"), of == F.col("limit")).otherwise(F.col("limit") == _ALL)
        start = F.greatest(low, k * block)
        end = F.least(high, F.when(whole, (k + 1) * block).when(cut, k * block + F.col("cut")).otherwise(0))
        return span(start, end, F.lit(1))

    kept = F.filter(F.transform(F.sequence(F.floor(low / block), F.floor((high - 1) / block)), chosen), lambda x: x["to"] > x["from"])
    spans = F.concat(F.when(F.col("rounds") > 0, F.array(span(low, high, F.col("rounds")))).otherwise(F.array()),
                     F.when(F.col("limit") != "", kept).otherwise(F.array()))
    pieces = known.join(plans, (F.col("place") == F.col("_place")) & (F.col("shard") == F.col("_shard")) & (F.col("size") > 0), "left")
    return (pieces.withColumn("_spans", F.when(F.col("rounds").isNotNull(), spans))
            .groupBy("nth", "doc_id", "source", "size", "source_size", "target")
            .agg(F.array_sort(F.flatten(F.collect_list("_spans"))).alias("spans")).drop("nth"))


def taken(spans: Column) -> Column:
    """Words that the mix takes, repeats counted."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + (x["to"] - x["from"]) * x["times"])


_ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, place % 3 + 1 AS weight, 3 * source_size AS most, sum(source_size) OVER () AS t, sum(place % 3 + 1) OVER () AS w FROM src),
before AS (
  SELECT *, sum(most) OVER o - most AS mb, sum(weight) OVER o - weight AS wb FROM weighed
  WINDOW o AS (ORDER BY most / weight, place ROWS UNBOUNDED PRECEDING)),
share AS (SELECT min_by(t - mb, wb) AS rest, min_by(w - wb, wb) AS free FROM before WHERE most * (w - wb) > weight * (t - mb)),
aim AS (SELECT source, source_size, place, t, least(CAST(most AS DOUBLE), CAST(weight * rest AS DOUBLE) / free) AS target FROM weighed, share),
quotient AS (
  SELECT place, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, place, j) AS nth, t
  FROM (SELECT *, unnest(range(3 * (source_size + 15) // 16 + 2)) AS j FROM aim) WHERE target > 0),
quota AS (SELECT place, count(*) AS quota FROM quotient WHERE nth <= greatest(1, (2 * t + {BLOCK_WORDS}) // {2 * BLOCK_WORDS}) GROUP BY place),
shard AS (
  SELECT place, quota, shard, least({BLOCK_WORDS * SHARD_BLOCKS}, source_size - shard * {BLOCK_WORDS * SHARD_BLOCKS}) AS words
  FROM (SELECT *, unnest(range((source_size + {BLOCK_WORDS * SHARD_BLOCKS - 1}) // {BLOCK_WORDS * SHARD_BLOCKS})) AS shard
        FROM aim JOIN quota USING (place))),
seat AS (
  SELECT place, shard, quota, row_number() OVER (PARTITION BY place ORDER BY words / (2 * j + 1) DESC, shard, j) AS nth
  FROM (SELECT *, unnest(range(quota)) AS j FROM shard)),
dealt AS (
  SELECT place, shard, words, least({REPEATS} * words, {BLOCK_WORDS} * count(seat.nth)) AS owed
  FROM shard LEFT JOIN (SELECT * FROM seat WHERE nth <= quota) seat USING (place, shard) GROUP BY place, shard, words),
block AS (
  SELECT *, row_number() OVER (PARTITION BY place, shard ORDER BY short, md5(concat_ws(':', '{SEED}', place, k))) - 1 AS nth
  FROM (SELECT place, shard, k, owed // words AS rounds, owed % words AS rest, (k + 1) * {BLOCK_WORDS} > {BLOCK_WORDS * SHARD_BLOCKS} * shard + words AS short
        FROM (SELECT *, unnest(range({SHARD_BLOCKS} * shard, {SHARD_BLOCKS} * shard + (words + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})) AS k FROM dealt))),
take AS (SELECT *, greatest(0, least({BLOCK_WORDS}, rest - {BLOCK_WORDS} * nth)) AS extra FROM block),
doc AS (
  SELECT *, row_number() OVER () AS who, sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS a
  FROM sized),
part AS (
  SELECT who, place, a, a + size AS z, unnest(range(CAST(a AS BIGINT) // {BLOCK_WORDS}, (CAST(a + size AS BIGINT) + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})) AS k
  FROM doc JOIN src ON doc.source IS NOT DISTINCT FROM src.source WHERE size > 0),
got AS (
  SELECT who, sum(rounds * (least(z, (k + 1) * {BLOCK_WORDS}) - greatest(a, k * {BLOCK_WORDS}))
                  + greatest(0, least(z, k * {BLOCK_WORDS} + extra) - greatest(a, k * {BLOCK_WORDS}))) AS taken
  FROM part JOIN take USING (place, k) GROUP BY who)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM doc JOIN aim ON doc.source IS NOT DISTINCT FROM aim.source LEFT JOIN got USING (who)
"""


@query("op12_mixing", _ORACLE)
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken(F.col("spans")).alias("taken"))
