"""Row-count windows, their labels and tensors, and data splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightwatch.operators.timeline import (
    CHUNK, KEYS, join_facts, lane, opening, row_count, row_number, running_sum, settled, whole_sum, with_halo,
    with_prefix, without_halo)
from flightwatch.functions.geo import local_east_m, local_north_m
from flightwatch.schema import FEATURES, WINDOW_LENGTH, WINDOW_STRIDE

#: Flights (some 40 bytes each) up to which their place in a split is broadcast.
BROADCAST_FLIGHTS = 400_000


def to_local(df: DataFrame) -> DataFrame:
    """``x_m`` north and ``y_m`` east of the flight's first row."""
    rows = with_prefix(df, {"_lat0": opening(F.col("lat_deg")), "_lon0": opening(F.col("lon_deg"))})
    return _localised(rows).drop("_lat0", "_lon0")


def _localised(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "x_m": local_north_m(F.col("lat_deg"), F.col("_lat0")),
        "y_m": local_east_m(F.col("lon_deg"), F.col("_lon0"), F.col("_lat0"))})


def numbered(df: DataFrame, local: bool = False) -> DataFrame:
    """``rn`` from 0 and ``n_rows`` of the flight; with ``local`` also x_m and y_m."""
    values = {"_nth": row_number(), "n_rows": row_count()}
    if local:
        values |= {"_lat0": opening(F.col("lat_deg")), "_lon0": opening(F.col("lon_deg"))}
    rows = with_prefix(df, values).withColumn("rn", F.col("_nth") - 1).drop("_nth")
    return _localised(rows).drop("_lat0", "_lon0") if local else rows


def sliding_windows(df: DataFrame, length: int = WINDOW_LENGTH, stride: int = WINDOW_STRIDE) -> DataFrame:
    """One row per (window, member): adds ``win`` and ``pos``; only full windows.

    A row is copied to the ceil(length/stride) windows that hold it; there is no join.
    """
    rows = df if {"rn", "n_rows"} <= set(df.columns) else numbered(df)
    overlaps = -(-length // stride)
    newest = F.floor(F.col("rn") / F.lit(float(stride))).cast("long")
    return (rows.withColumn("win", F.explode(F.array(*[newest - i for i in range(overlaps)])))
            .withColumn("pos", F.col("rn") - F.col("win") * stride)
            .filter((F.col("win") >= 0) & (F.col("pos") < length)
                    & (F.col("win") * stride + length <= F.col("n_rows"))))


def label_share(share: Column, ratio: float = 0.5, inclusive: bool = False) -> Column:
    return ((share >= ratio) if inclusive else (share > ratio)).cast("int")


def window_labels(members: DataFrame, ratio: float = 0.5, inclusive: bool = False,
                  stride: int = WINDOW_STRIDE, length: int = WINDOW_LENGTH, extra: Sequence[Column] = ()) -> DataFrame:
    """Per window: first and last time, centre time, share of positive rows, label."""
    centre = F.max(F.when(F.col("pos") == length // 2, F.col("time_s")))
    return (members.groupBy(*KEYS, "win").agg(
        F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"), centre.alias("centre_s"),
        F.avg(F.col("label").cast("double")).alias("share"), *extra)
        .withColumn("label", label_share(F.col("share"), ratio, inclusive)))


def window_tensors(members: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Row-major ``tensor`` (rows x features) and its flattened ``vector`` per window."""
    have = set(members.columns)
    cells = F.array(*[(F.col(c) if c in have else F.lit(0.0)).cast("float") for c in features])
    ordered = F.sort_array(F.collect_list(F.struct(F.col("pos"), cells.alias("cells"))))
    return (members.groupBy(*KEYS, "win").agg(
        ordered.alias("_rows"), F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"))
        .withColumn("tensor", F.transform("_rows", lambda r: r["cells"])).drop("_rows")
        .withColumn("vector", F.flatten("tensor")))


def window_dataset(df: DataFrame, features: Sequence[str] = FEATURES, ratio: float = 0.5,
                   inclusive: bool = False, extra: Sequence[Column] = ()) -> DataFrame:
    """Labels and tensors of all windows in one aggregation."""
    members = sliding_windows(numbered(df, local=True))
    have = set(members.columns)
    cells = F.array(*[F.coalesce((F.col(c) if c in have else F.lit(0.0)).cast("float"), F.lit(0.0).cast("float"))
                      for c in features])
    ordered = F.sort_array(F.collect_list(F.struct(F.col("pos"), cells.alias("cells"))))
    return (window_labels(members, ratio, inclusive, extra=(ordered.alias("_rows"), *extra))
            .withColumn("vector", F.flatten(F.transform("_rows", lambda r: r["cells"]))).drop("_rows"))


def rolling_buffer(df: DataFrame, column: str, length: int = WINDOW_LENGTH) -> DataFrame:
    """``buffer`` of the last ``length`` values, one row per input row once full."""
    halo = with_halo(df, before=length - 1, carry=["time_s", column])
    frame = lane().rowsBetween(-(length - 1), 0)
    return (without_halo(halo.withColumn("buffer", F.collect_list(column).over(frame)))
            .filter(F.size("buffer") == length))


def chronological_split(windows: DataFrame, train: float = 0.7, val: float = 0.15,
                        within: Sequence[str] = ()) -> DataFrame:
    """Cut all windows, in (flight, window) order, into train / val / test.

    ``win`` already numbers windows inside a flight, so a window's global position is the
    number of windows in earlier flights plus ``win``. Only one row per flight is ordered: flights are
    range-partitioned by id, summed per partition, and the sums of earlier partitions added; no window
    runs over the data rows, and no range depends on what ids look like. ``within`` splits per group,
    which must be the same for all windows of a flight.
    """
    flights = windows.groupBy(*within, *KEYS).agg(F.count(F.lit(1)).alias("_windows"))
    ranged = settled(flights.repartitionByRange(*within, "flight_id").withColumn("_range", F.spark_partition_id()))
    ranked = with_prefix(ranged, {"_earlier": running_sum(F.col("_windows")), "_total": whole_sum(F.col("_windows"))},
                         order="flight_id", axis=F.col("_range").cast("long"), keys=within).drop("_range")
    ranked = settled(ranked.withColumn("_earlier", F.col("_earlier") - F.col("_windows")).drop(CHUNK, "_windows"))
    # Few flights are broadcast once: windows are wide, and salted copies would soon make them move.
    placed = (windows.join(F.broadcast(ranked), [*within, *KEYS], "inner") if ranked.count() <= BROADCAST_FLIGHTS
              else join_facts(windows, ranked, [*within, *KEYS], "inner"))
    position = F.col("_earlier") + F.col("win")
    cut = F.floor(F.lit(train) * F.col("_total"))
    cut2 = cut + F.floor(F.lit(val) * F.col("_total"))
    return (placed.withColumn("ordinal", position)
            .withColumn("split", F.when(position < cut, "train").when(position < cut2, "val")
                        .otherwise("test"))
            .drop("_earlier", "_total"))


def flight_split(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Whole flights to one split, by a hash that never changes."""
    u = F.conv(F.substring(F.md5(F.col("flight_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def first_flights(flights: DataFrame, per: str = "terrain", n: int = 5) -> DataFrame:
    w = Window.partitionBy(per).orderBy("flight_id")
    return flights.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n).drop("_nth")
