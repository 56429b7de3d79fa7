"""Data-quality guards: one pass over the rows, violation counts per flight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightwatch.operators.segments import tally
from flightwatch.operators.timeline import CHUNK, KEYS, lane, row_axis, with_halo, without_halo
from flightwatch.schema import (
    INTEGER_COLUMNS, LABELLED_COLUMNS, MAGNITUDE_COLUMNS, TERRAIN_LIMITS)

BOX_MARGIN_DEG = 0.5
MIN_FLIGHT_ROWS = 100


def limits(spark) -> DataFrame:
    """The terrain limits: three fixed rows, safe to broadcast."""
    return spark.createDataFrame(
        TERRAIN_LIMITS, "terrain string, lat_min double, lat_max double, lon_min double, "
                        "lon_max double, alt_min double, alt_max double")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def check_rows(df: DataFrame, order: str = "row_no", terrain: str | None = "terrain") -> DataFrame:
    """Checks on rows in file order; ``order`` numbers the rows of a flight from 0."""
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in KEYS]
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint")
               and c not in (*KEYS, order)]
    real = [c for c, t in df.dtypes if t in ("double", "float")]
    ordered = [c for c in ("time_s", "battery_remaining_pct") if c in df.columns]
    halo = with_halo(df, before=1, carry=ordered, order=order, axis=row_axis(df, order))
    w = lane(order)
    halo = halo.withColumns({f"_d_{c}": F.col(c) - F.lag(c).over(w) for c in ordered})
    rows = without_halo(halo, drop_chunk=True)
    bad = {
        "no_null": _any([F.col(c).isNull() | (F.isnan(c) if c in real else F.lit(False))
                         for c in columns]),
        "no_infinity": _any([F.abs(F.col(c)) == F.lit(float("inf")) for c in real]),
        "magnitudes": _any([F.col(c) < 0 for c in MAGNITUDE_COLUMNS if c in numeric]),
        "integers": _any([F.col(c) != F.floor(c) for c in INTEGER_COLUMNS if c in numeric]),
        "time_increases": F.col("_d_time_s") <= 0,
    }
    if "battery_remaining_pct" in ordered:
        bad["battery_falls"] = F.col("_d_battery_remaining_pct") > 0
    have = set(df.columns)
    if {"failsafe", "fix_type"} <= have:
        bad["failsafe_without_fix"] = (F.col("failsafe") == 1) & (F.col("fix_type") == 3)
    if {"satellites_visible", "fix_type"} <= have:
        bad["few_satellites_without_fix"] = (F.col("satellites_visible") <= 4) & (F.col("fix_type") == 3)
    if {"vel_m_s", "vel_innov"} <= have:
        bad["fast_needs_innovation"] = (F.col("vel_m_s") > 22) & (F.col("vel_innov") < 1.0)
    if "mode" in have:
        bad["mode_auto"] = ~F.coalesce(F.col("mode") == "AUTO", F.lit(False))
    if terrain and terrain in have:
        rows = rows.join(F.broadcast(limits(spark)).withColumnRenamed("terrain", terrain), terrain, "left")
        bad["in_box"] = ~(F.col("lat_deg").between(F.col("lat_min") - BOX_MARGIN_DEG, F.col("lat_max") + BOX_MARGIN_DEG)
                          & F.col("lon_deg").between(F.col("lon_min") - BOX_MARGIN_DEG, F.col("lon_max") + BOX_MARGIN_DEG))
        bad["alt_clamp"] = ~F.col("alt_m").between(F.col("alt_min"), F.col("alt_max"))
        if "rel_alt_m" in have:
            bad["rel_alt_below_alt"] = F.col(terrain).isin("flat", "mountain") & (F.col("rel_alt_m") > F.col("alt_m"))
    return tally(rows, bad)


def duplicate_times(df: DataFrame) -> DataFrame:
    """Rows of a flight beyond the first at the same time."""
    return (df.groupBy(*KEYS, "time_s").agg((F.count(F.lit(1)) - 1).alias("_extra"))
            .groupBy(*KEYS).agg(F.sum("_extra").alias("violations")))


def short_flights(df: DataFrame, min_rows: int = MIN_FLIGHT_ROWS) -> DataFrame:
    return (df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") < min_rows))


def check_columns(df: DataFrame) -> list[str]:
    """Differences from the expected names and order; empty when they agree."""
    found = [c for c in df.columns if c not in (*KEYS, CHUNK)]
    issues = [f"missing {c}" for c in LABELLED_COLUMNS if c not in found]
    issues += [f"unexpected {c}" for c in found if c not in LABELLED_COLUMNS]
    if not issues and found != LABELLED_COLUMNS:
        issues.append("order differs")
    return issues
