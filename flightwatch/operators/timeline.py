"""Ordered per-flight computation that never puts a whole flight into one task.

A flight may hold a large share of all rows, so nothing here partitions a window by
flight alone. Rows are cut into chunks of bounded time (or row-number) width, windows
run per (flight, chunk), and what has to cross a chunk border travels in one of two ways:

* ``with_halo`` copies the few rows just before and after each chunk into it, so that
  bounded frames (lag, lead, rolling statistics) are plain window functions;
* ``with_prefix`` reduces every chunk to one row, runs the prefix over those rows, and
  joins the carried value back, so that running sums, row numbers and latest values are
  exact over any length.

Only the one-row-per-chunk table is ever windowed by flight.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
HALO = "_halo"
KEYS = ("flight_id",)
DEFAULT_CHUNK_SECONDS = 3600.0


_WIDTH: contextvars.ContextVar[float | None] = contextvars.ContextVar("chunk_width", default=None)


@contextlib.contextmanager
def chunk_width(seconds: float):
    """Operators called inside cut chunks of this width, whatever the session says."""
    token = _WIDTH.set(seconds)
    try:
        yield
    finally:
        _WIDTH.reset(token)


def chunk_seconds(df: DataFrame) -> float:
    """Width of a chunk: of ``chunk_width``, else ``flightwatch.chunk.seconds`` of the session, else the default."""
    return _WIDTH.get() or float(df.sparkSession.conf.get("flightwatch.chunk.seconds", str(DEFAULT_CHUNK_SECONDS)))


def time_axis(df: DataFrame, time: str = "time_s") -> Column:
    return F.floor(F.col(time) / F.lit(chunk_seconds(df))).cast("long")


def row_axis(df: DataFrame, number: str) -> Column:
    """Chunks of as many rows as a time chunk holds at 10 Hz."""
    return F.floor(F.col(number) / F.lit(max(2.0, 10 * chunk_seconds(df)))).cast("long")


def with_chunk(df: DataFrame, axis: Column | None = None) -> DataFrame:
    if axis is None and CHUNK in df.columns:
        return df
    return df.withColumn(CHUNK, time_axis(df) if axis is None else axis)


def lane(order: str = "time_s", keys: Sequence[str] = KEYS, backwards: bool = False) -> WindowSpec:
    """The window spec that all ordered expressions share: one exchange, one sort."""
    return Window.partitionBy(*keys, CHUNK).orderBy(F.col(order).desc() if backwards else F.col(order))


def _in_order(keys: Sequence[str], backwards: bool = False) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc() if backwards else F.col(CHUNK))


def with_halo(df: DataFrame, before: int = 0, after: int = 0, carry: Sequence[str] = (),
              order: str = "time_s", axis: Column | None = None,
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``_chunk`` and ``_halo``; copied rows hold ``order`` and ``carry``, else null.

    Every chunk receives exactly the ``before`` rows preceding it in its flight and the
    ``after`` rows following it, however many short or missing chunks lie between.
    """
    rows = with_chunk(df, axis)
    if before == 0 and after == 0:
        return rows.withColumn(HALO, F.lit(0))
    kept = list(dict.fromkeys([order, *carry]))
    narrow = rows.select(*dict.fromkeys([*keys, CHUNK, *kept]))
    along = _in_order(keys)
    if before <= 1 and after <= 1:
        # One value per column keeps this a hash aggregate; ``order`` is unique, so all agree.
        sides = [(F.max_by, F.lead(CHUNK).over(along), "t")] * before + [
            (F.min_by, F.lag(CHUNK).over(along), "h")] * after
        ends = narrow.groupBy(*keys, CHUNK).agg(*[
            pick(F.col(c), order).alias(f"_{tag}_{c}") for pick, _, tag in sides for c in kept])
        moves = F.array(*[F.struct(to.alias("to"), *[F.col(f"_{tag}_{c}").alias(c) for c in kept])
                          for _, to, tag in sides])
        copies = (ends.select(*keys, moves.alias("_moves"))
                  .select(*keys, F.explode("_moves").alias("_move"))
                  .filter("_move.to IS NOT NULL")
                  .select(*keys, F.col("_move.to").alias(CHUNK), *[F.col(f"_move.{c}").alias(c) for c in kept]))
    else:
        sizes = (narrow.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
                 .withColumn("_until", F.sum("_n").over(along)))
        parts = []
        if before:
            parts.append(_moved(narrow, sizes, keys, kept, order, before, forward=True))
        if after:
            parts.append(_moved(narrow, sizes, keys, kept, order, after, forward=False))
        copies = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    padded = copies.select(*[
        F.col(c) if c in (*keys, CHUNK, *kept) else F.lit(None).cast(rows.schema[c].dataType).alias(c)
        for c in rows.columns])
    return (rows.withColumn(HALO, F.lit(0))
            .unionByName(padded.withColumn(HALO, F.lit(1))))


def _moved(narrow: DataFrame, sizes: DataFrame, keys: Sequence[str], kept: Sequence[str],
           order: str, rows: int, forward: bool) -> DataFrame:
    """The edge rows of each chunk, addressed to the chunks that need them."""
    along = _in_order(keys)
    start = F.col("_until") - F.col("_n")
    if forward:
        near = F.collect_list(F.struct(F.col(CHUNK).alias("src"), F.col("_until").alias("at"))).over(
            along.rowsBetween(-rows, -1))
        between = F.col("_start") - F.col("_link.at")
        edge = F.col(order).desc()
    else:
        near = F.collect_list(F.struct(F.col(CHUNK).alias("src"), start.alias("at"))).over(
            along.rowsBetween(1, rows))
        between = F.col("_link.at") - F.col("_until")
        edge = F.col(order).asc()
    links = (sizes.select(*keys, CHUNK, "_until", start.alias("_start"), near.alias("_near"))
             .select(*keys, F.col(CHUNK).alias("_to"), "_until", "_start",
                     F.explode("_near").alias("_link"))
             .select(*keys, "_to", F.col("_link.src").alias(CHUNK), between.alias("_between"))
             .filter(F.col("_between") < rows))
    ranked = (narrow
              .withColumn("_rank", F.row_number().over(
                  Window.partitionBy(*keys, CHUNK).orderBy(edge)))
              .filter(F.col("_rank") <= rows))
    return (ranked.join(links, [*keys, CHUNK])
            .filter(F.col("_rank") + F.col("_between") <= rows)
            .select(*keys, F.col("_to").alias(CHUNK), *kept))


def without_halo(df: DataFrame, drop_chunk: bool = False) -> DataFrame:
    core = df.filter(F.col(HALO) == 0).drop(HALO)
    return core.drop(CHUNK) if drop_chunk else core


@dataclass(frozen=True)
class Prefix:
    """One running value: within the chunk, reduced per chunk, carried, and merged."""

    part: Callable[[str], Column]
    carry: Callable[[Column, WindowSpec], Column]
    local: Callable[[WindowSpec], Column] | None = None
    merge: Callable[[Column | None, Column], Column] = lambda local, carry: carry
    #: Frames run from the end of the flight: "before" is then what comes later.
    backwards: bool = False


def _ahead(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(e: Column) -> Prefix:
    return Prefix(
        part=lambda order: F.sum(e),
        carry=lambda p, w: F.sum(p).over(_ahead(w)),
        local=lambda w: F.sum(e).over(_upto(w)),
        merge=lambda loc, car: F.when(loc.isNull() & car.isNull(), None).otherwise(
            F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))))


def row_number() -> Prefix:
    """1-based position in the flight."""
    return Prefix(
        part=lambda order: F.count(F.lit(1)),
        carry=lambda p, w: F.sum(p).over(_ahead(w)),
        local=lambda w: F.row_number().over(w),
        merge=lambda loc, car: (loc + F.coalesce(car, F.lit(0))).cast("long"))


def row_count() -> Prefix:
    """Rows of the whole flight."""
    return whole_sum(F.lit(1).cast("long"))


def whole_sum(e: Column) -> Prefix:
    return Prefix(part=lambda order: F.sum(e),
                  carry=lambda p, w: F.sum(p).over(
                      w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def opening(e: Column) -> Prefix:
    """Value of the flight's first row."""
    return Prefix(part=lambda order: F.min_by(F.struct(e.alias("v")), order),
                  carry=lambda p, w: F.first(p["v"]).over(_upto(w)))


def latest(e: Column) -> Prefix:
    """Last non-null value up to and including the row."""
    return Prefix(
        part=lambda order: F.max_by(e, F.when(e.isNotNull(), F.col(order))),
        carry=lambda p, w: F.last(p, ignorenulls=True).over(_ahead(w)),
        local=lambda w: F.last(e, ignorenulls=True).over(_upto(w)),
        merge=lambda loc, car: F.coalesce(loc, car))


def earliest(e: Column) -> Prefix:
    """First non-null value up to and including the row."""
    return Prefix(
        part=lambda order: F.min_by(e, F.when(e.isNotNull(), F.col(order))),
        carry=lambda p, w: F.first(p, ignorenulls=True).over(_ahead(w)),
        local=lambda w: F.first(e, ignorenulls=True).over(_upto(w)),
        merge=lambda loc, car: F.coalesce(car, loc))


def latest_before(e: Column) -> Prefix:
    """Last non-null value strictly before the row."""
    return Prefix(
        part=lambda order: F.max_by(e, F.when(e.isNotNull(), F.col(order))),
        carry=lambda p, w: F.last(p, ignorenulls=True).over(_ahead(w)),
        local=lambda w: F.last(e, ignorenulls=True).over(_ahead(w)),
        merge=lambda loc, car: F.coalesce(loc, car))


def upcoming(e: Column) -> Prefix:
    """First non-null value strictly after the row: the latest one before it, seen from the end.

    A frame that only grows costs one step a row; one that shrinks would be read anew for each.
    """
    return Prefix(
        part=lambda order: F.min_by(e, F.when(e.isNotNull(), F.col(order))),
        carry=lambda p, w: F.last(p, ignorenulls=True).over(_ahead(w)),
        local=lambda w: F.last(e, ignorenulls=True).over(_ahead(w)),
        merge=lambda loc, car: F.coalesce(loc, car), backwards=True)


def with_prefix(df: DataFrame, values: dict[str, Prefix], order: str = "time_s",
                axis: Column | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add running values. ``order`` must be unique within a flight for exact results.

    The carried side holds one row per chunk and is hash-joined on (flight, chunk), the
    partitioning the windows need anyway: the wide rows move once and are sorted once.
    """
    rows = with_chunk(df, axis)
    parts = rows.groupBy(*keys, CHUNK).agg(
        *[v.part(order).alias(f"_part_{name}") for name, v in values.items()])
    carried = parts.select(
        *keys, CHUNK, *[v.carry(F.col(f"_part_{n}"), _in_order(keys, v.backwards)).alias(f"_carry_{n}")
                        for n, v in values.items()])
    local = rows.select("*", *[v.local(lane(order, keys, v.backwards)).alias(f"_local_{n}")
                               for n, v in values.items() if v.local is not None])
    joined = local.join(carried.hint("shuffle_hash"), [*keys, CHUNK], "left")
    base = [c for c in rows.columns if c not in values]
    return joined.select(*base, *[
        v.merge(F.col(f"_local_{n}") if v.local is not None else None,
                F.col(f"_carry_{n}")).alias(n)
        for n, v in values.items()])


def join_facts(df: DataFrame, facts: DataFrame, keys: Sequence[str] = KEYS, how: str = "left",
               salts: int = 16, spread: str | None = None) -> DataFrame:
    """Join rows with one-row-per-key facts, spreading the rows of a large key.

    Facts are copied ``salts`` times and rows take a copy by a hash of ``spread`` (by default the time or
    the window number, else all plain columns), so a key holding a third of the rows is met in ``salts``
    places. Adaptive execution splits what is still large; size decides on broadcasting.
    """
    spread = spread or next((c for c in ("time_s", "win", "seq") if c in df.columns), None)
    by = [spread] if spread else [c for c, t in df.dtypes if not t.startswith("map")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def shared_folder(df: DataFrame) -> str:
    """This application's folder for intermediate tables, below the cluster's checkpoint folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.path.join(tempfile.gettempdir(), "flightwatch")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def settled(df: DataFrame) -> DataFrame:
    """Write a stage result as a table in the shared folder and read it back.

    Ordered operators read their input two or three times (rows, chunk ends). Settling
    between chained stages keeps that from multiplying, and lets a lost executor restart
    from the written stage instead of from the raw logs.
    """
    path = f"{shared_folder(df)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_settled(df: DataFrame) -> None:
    """Remove this application's intermediate tables; call it when results are written."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(df))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
