"""Cleaning of raw telemetry rows and treatment of missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightwatch.functions.geo import haversine_m
from flightwatch.functions.modes import normalize_mode, number_of
from flightwatch.operators.timeline import (
    CHUNK, KEYS, join_facts, lane, latest, with_chunk, with_halo, with_prefix, without_halo)
from flightwatch.schema import CRITICAL_COLUMNS, NUMERIC_COLUMNS, TEXT_COLUMNS


def coerce_numbers(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    present = set(columns) & set(df.columns)
    return df.select(*[number_of(df, c).alias(c) if c in present else F.col(c) for c in df.columns])


def strip_text(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    return df.select(*[F.trim(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def normalize_text(df: DataFrame) -> DataFrame:
    out = df
    if "mode" in df.columns:
        out = out.withColumn("mode", normalize_mode(F.col("mode")))
    if "last_update_iso" in df.columns:
        out = out.withColumn("last_update_iso",
                             F.coalesce(F.trim("last_update_iso"), F.lit("UNKNOWN")))
    return out


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["time_s"] + [c for c in CRITICAL_COLUMNS if c in df.columns])


def keep_fixed(df: DataFrame, min_fix_type: int = 3) -> DataFrame:
    return df.filter(F.col("fix_type") >= min_fix_type) if "fix_type" in df.columns else df


def keep_connected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("connection_ok") == 1) if "connection_ok" in df.columns else df


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates; copies are removed before the shuffle as well as after it."""
    return df.dropDuplicates()


def first_per_instant(df: DataFrame, tie: Sequence[str] | None = None) -> DataFrame:
    """One row per flight and time: what duplicate removal and ``dt > 0`` leave together.

    ``row_number() = 1`` lets Spark discard copies before the shuffle, so a group of
    copies of any size never meets in one task.
    """
    ties = list(tie) if tie else [c for c in df.columns if c not in (*KEYS, "time_s", CHUNK)]
    w = Window.partitionBy(*KEYS, CHUNK, "time_s").orderBy(*ties)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def time_steps(df: DataFrame, order: str = "time_s", axis=None) -> DataFrame:
    """``dt`` to the previous row of the flight."""
    halo = with_halo(df, before=1, carry=["time_s"], order=order, axis=axis)
    return without_halo(halo.withColumn("dt", F.col("time_s") - F.lag("time_s").over(lane(order))))


def drop_gaps(df: DataFrame, max_gap_s: float = 5.0) -> DataFrame:
    return df.filter(F.col("dt").isNull() | ((F.col("dt") > 0) & (F.col("dt") < max_gap_s)))


def eligible(df: DataFrame, min_fix_type: int = 3) -> DataFrame:
    """The row-wise part of cleaning, without any shuffle."""
    return keep_connected(keep_fixed(drop_incomplete(normalize_text(df)), min_fix_type))


def clean(df: DataFrame, min_fix_type: int = 3, max_dt_gap_s: float = 5.0,
          tie: Sequence[str] | None = None) -> DataFrame:
    """Rows kept for analysis, with ``is_stale_repeat`` = 0 and ``dt`` before the gap filter."""
    rows = with_chunk(eligible(df, min_fix_type).withColumn("is_stale_repeat", F.lit(0)))
    single = first_per_instant(rows, tie)
    return drop_gaps(time_steps(single), max_dt_gap_s)


def drop_impossible_speed(df: DataFrame, max_speed_ms: float = 500.0) -> DataFrame:
    halo = with_halo(df, before=1, carry=["time_s", "lat_deg", "lon_deg"])
    w = lane()
    metres = haversine_m(F.lag("lat_deg").over(w), F.lag("lon_deg").over(w),
                         F.col("lat_deg"), F.col("lon_deg"))
    step = F.col("time_s") - F.lag("time_s").over(w)
    halo = halo.withColumn("_speed", F.when(step > 0, metres / step))
    return without_halo(halo).filter(
        F.col("_speed").isNull() | (F.col("_speed") <= max_speed_ms)).drop("_speed")


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing columns and missing values become 0.0."""
    have = set(df.columns)
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, *[
        F.coalesce(number_of(df, c), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c)
        for c in columns])


def fill_forward(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Last known value of the flight, else 0.0."""
    filled = with_prefix(df, {f"_ff_{c}": latest(number_of(df, c)) for c in columns})
    return filled.select(*[
        F.coalesce(F.col(f"_ff_{c}"), F.lit(0.0)).alias(c) if c in columns else F.col(c)
        for c in df.columns])


def flight_medians(df: DataFrame, columns: Sequence[str], accuracy: int = 10000) -> DataFrame:
    """Exact median per flight and column, as rows (flight_id, column, median).

    A bounded sketch brackets the middle ranks. Values outside the bracket are only counted,
    those inside are counted per value, both before the shuffle; so what is ordered per
    flight and column is a few ten-thousandths of its rows.
    """
    # The sketch is off by at most n/accuracy ranks; two such steps on each side cover it.
    slack = 2.0 / accuracy
    numbers = df.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in columns])
    brackets = numbers.groupBy(*KEYS).agg(*[
        F.percentile_approx(c, [max(0.0, 0.5 - slack), min(1.0, 0.5 + slack)], accuracy).alias(f"_b_{c}")
        for c in columns])

    def place(c: str):
        v, low, high = F.col(c), F.col(f"_b_{c}")[0], F.col(f"_b_{c}")[1]
        side = F.when(v < low, -1).when(v > high, 1).otherwise(0)
        return F.struct(F.lit(c).alias("column"), v.isNotNull().alias("_known"), side.alias("_side"),
                        F.when(side == 0, v).alias("_v"))
    counts = (join_facts(numbers, brackets)
              .select(*KEYS, F.explode(F.array(*[place(c) for c in columns])).alias("_p"))
              .filter("_p._known").select(*KEYS, "_p.column", "_p._side", "_p._v")
              .groupBy(*KEYS, "column", "_side", "_v").agg(F.count(F.lit(1)).alias("_n")))
    group = Window.partitionBy(*KEYS, "column")
    upto = F.sum("_n").over(group.orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_upto": upto, "_total": F.sum("_n").over(group)})
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    at = lambda rank: F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col("_v")))
    return ranked.groupBy(*KEYS, "column").agg(((at(low) + at(high)) / 2).alias("median"))


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become the flight's median of the column."""
    present = [c for c in columns if c in df.columns]
    wide = flight_medians(df, present).groupBy(*KEYS).pivot("column", present).agg(F.first("median"))
    wide = wide.select(*KEYS, *[F.col(c).alias(f"_med_{c}") for c in present])
    return join_facts(df, wide).select(*[
        F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")).alias(c) if c in present else F.col(c)
        for c in df.columns])
