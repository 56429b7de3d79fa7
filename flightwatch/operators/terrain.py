"""Terrain of positions, of flights and of stretches of path; routing to models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightwatch.functions.geo import haversine_km
from flightwatch.operators.clean import fill_forward
from flightwatch.operators.timeline import (
    KEYS, lane, latest, latest_before, running_sum, with_halo, with_prefix, without_halo)
from flightwatch.schema import DEBOUNCE, TERRAINS

MOUNTAIN_ELEVATION_M = 800.0
SEA_ELEVATION_M = 0.0


def terrain_of(elevation: Column) -> Column:
    return (F.when(elevation > MOUNTAIN_ELEVATION_M, "mountain")
            .when(elevation > SEA_ELEVATION_M, "flat").otherwise("sea"))


def cell(degrees: Column) -> Column:
    """Position rounded to four decimals, half to even, as a whole-number key."""
    return F.bround(degrees * 10000).cast("long")


def with_elevation(df: DataFrame, elevations: DataFrame, salts: int = 8) -> DataFrame:
    """``elevation`` from the table (lat_key, lon_key, elevation), else the row's altitude.

    A parked vehicle can put a large share of rows into one cell: rows are spread over
    ``salts`` copies of each entry. Size decides whether Spark broadcasts the table.
    """
    salt = F.pmod(F.xxhash64("time_s"), F.lit(salts)).cast("int")
    table = (elevations.groupBy("lat_key", "lon_key").agg(F.max("elevation").alias("_elevation"))
             .withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)]))))
    return (df.withColumns({"lat_key": cell(F.col("lat_deg")), "lon_key": cell(F.col("lon_deg")),
                            "_salt": salt})
            .join(table, ["lat_key", "lon_key", "_salt"], "left")
            .withColumn("elevation", F.coalesce("_elevation", "alt_m", F.lit(0.0)))
            .drop("lat_key", "lon_key", "_salt", "_elevation"))


def rolling_alt_std(df: DataFrame, rows: int = 30, at_least: int = 5) -> DataFrame:
    """``alt_std``: sample deviation of altitude over the last ``rows`` rows, else 0."""
    halo = with_halo(df, before=rows - 1, carry=["time_s", "alt_m"])
    frame = lane().rowsBetween(-(rows - 1), 0)
    std = F.when(F.count("alt_m").over(frame) >= at_least, F.stddev_samp("alt_m").over(frame))
    return without_halo(halo.withColumn("alt_std", F.coalesce(std, F.lit(0.0))))


def classify_terrain(df: DataFrame, elevations: DataFrame, std_m: float = 50.0, rows: int = 30) -> DataFrame:
    """``terrain`` per row: by ground elevation, mountain where the altitude is rough."""
    columns = ["lat_deg", "lon_deg", "alt_m"] + (["rel_alt_m"] if "rel_alt_m" in df.columns else [])
    rough = rolling_alt_std(with_elevation(fill_forward(df, columns), elevations), rows)
    return (rough.withColumn("terrain", F.when(F.col("alt_std") > std_m, "mountain")
                             .otherwise(terrain_of(F.col("elevation")))).drop("alt_std"))


def majority(df: DataFrame, column: str, keys: Sequence[str] = KEYS, name: str | None = None) -> DataFrame:
    """Most frequent value per key; the smallest value wins a tie."""
    counts = (df.filter(F.col(column).isNotNull()).groupBy(*keys, column)
              .agg(F.count(F.lit(1)).alias("_n")))
    return counts.groupBy(*keys).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))["v"].alias(name or column))


def terrain_shares(df: DataFrame) -> DataFrame:
    counts = df.groupBy("terrain").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per terrain is left for this unpartitioned sum.
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def debounce(df: DataFrame, column: str = "terrain", count: int = DEBOUNCE,
             default: str = "flat", order: str = "time_s", axis: Column | None = None) -> DataFrame:
    """``active`` changes once ``count`` rows in a row agree on a value other than it.

    A row confirms its value when the ``count - 1`` rows before it are equal (bounded
    lookback); the active value is the latest confirmed one (prefix).
    """
    halo = with_halo(df, before=count - 1, carry=[order, column], order=order, axis=axis)
    w = lane(order)
    agree = F.lit(True)
    for i in range(1, count):
        agree = agree & (F.lag(column, i).over(w) == F.col(column))
    sure = without_halo(halo.withColumn("_sure", F.when(agree, F.col(column))))
    state = with_prefix(sure, {"_now": latest(F.col("_sure")), "_was": latest_before(F.col("_sure"))},
                        order=order)
    return (state.withColumns({"active": F.coalesce("_now", F.lit(default)),
                               "_was": F.coalesce("_was", F.lit(default))})
            .withColumn("switched", (F.col("active") != F.col("_was")).cast("int"))
            .drop("_sure", "_now", "_was"))


def route(registry: DataFrame, default: str = "flat", preferred: str = "rf") -> DataFrame:
    """Model of every terrain: its own, else the default's, else flat/mountain/sea, else global.

    Of a terrain with models of several types, the ``preferred`` type is taken, else the first by name.
    ``registry`` has rows (terrain, model_type, available); the result has one row per
    terrain and is bounded by that, whatever the data size.
    """
    spark = registry.sparkSession
    wanted = spark.createDataFrame([(t,) for t in TERRAINS], "active string")
    candidates = []
    for t in TERRAINS:
        order = list(dict.fromkeys([t, default, *TERRAINS, "global_fallback"]))
        candidates += [(t, c, i) for i, c in enumerate(order)]
    ranked = spark.createDataFrame(candidates, "active string, terrain string, rank int")
    usable = registry.filter("available").select("terrain", "model_type")
    best = (ranked.join(usable, "terrain").groupBy("active")
            .agg(F.min_by(F.struct(F.col("terrain").alias("model_terrain"), "model_type"),
                          F.struct("rank", F.col("model_type") != preferred, "model_type")).alias("_m"))
            .select("active", "_m.*"))
    return wanted.join(best, "active", "left").withColumn(
        "is_fallback", (F.col("model_terrain") != F.col("active")).cast("int"))


def with_model(df: DataFrame, registry: DataFrame, default: str = "flat") -> DataFrame:
    return df.join(F.broadcast(route(registry, default)), "active", "left")


def path_length(df: DataFrame) -> DataFrame:
    """``path_km``: great-circle distance flown so far."""
    halo = with_halo(df, before=1, carry=["time_s", "lat_deg", "lon_deg"])
    w = lane()
    step = haversine_km(F.lag("lat_deg").over(w), F.lag("lon_deg").over(w), F.col("lat_deg"), F.col("lon_deg"))
    stepped = without_halo(halo.withColumn("_km", F.coalesce(step, F.lit(0.0))))
    return with_prefix(stepped, {"path_km": running_sum(F.col("_km"))}).drop("_km")
