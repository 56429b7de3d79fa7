"""Gates, smoothing, alerts and trust over scored rows or windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightwatch.operators.timeline import (
    CHUNK, KEYS, join_facts, lane, latest, running_sum, with_chunk, with_halo, with_prefix, without_halo)
from flightwatch.schema import ALERT_THRESHOLD, GROUND_PROBABILITY, SMOOTHING


def ground_gate(armed: Column, rel_alt: Column, speed: Column, model: Column) -> Column:
    """Disarmed, or low and slow: a fixed small probability instead of the model's."""
    return (F.when(~F.coalesce(armed > 0.5, F.lit(False)), F.lit(GROUND_PROBABILITY))
            .when((rel_alt < 5.0) & (speed < 3.0), F.lit(GROUND_PROBABILITY)).otherwise(model))


def alert(probability: Column, threshold: float = ALERT_THRESHOLD, inclusive: bool = True) -> Column:
    return probability >= threshold if inclusive else probability > threshold


def states_along(y: np.ndarray, whose: np.ndarray, gain: float) -> np.ndarray:
    """States after each value of several flights, one flight after another; a flight's first value is its first state."""
    if not len(y):
        return np.zeros(0)
    return pd.Series(y).groupby(whose, sort=False).ewm(alpha=gain, adjust=False).mean().to_numpy()


#: As many values at a flight's beginning are followed one by one.
HEAD = 16


def _recurrence(df: DataFrame, column: str, out: str, gain: float, seed: float | None,
                order: str, axis: Column | None) -> DataFrame:
    """state = gain * x + keep * state with keep = 1 - gain, along each flight; an unknown x keeps the state as it is.

    Known values of a chunk are numbered and cut into blocks short enough that keep ** -j stays a fine double: in a
    block the state is keep ** j * (state before + running sum of gain * x * keep ** -j), a plain window sum. Each
    block is one affine map (keep ** n, offset). The maps of a flight, one row per block, are folded up to each
    block over those before it that still count: beyond ``reach`` values keep ** n is less than any double can
    show. So results do not depend on the chunk width. The first HEAD values of a flight, where the state is still
    a short decimal, are followed one by one, so that they round as in a plain loop. ``seed`` is the state before the first row; with None the
    first known value is its own state, and rows before it have none. ``order`` must be unique within a flight.
    """
    if not 0 < gain <= 1:
        raise ValueError("the gain must be above 0 and at most 1")
    rows = with_chunk(df, axis)
    x = F.col(column).cast("double")
    x = F.when(x.isNotNull() & ~F.isnan(x), x)
    if gain == 1:
        last = with_prefix(rows, {out: latest(x)}, order)
        return last.select(*df.drop(CHUNK).columns, F.coalesce(out, F.lit(seed)).alias(out))
    keep = 1.0 - gain
    fade = -math.log(keep)
    block, reach = max(1, int(230 / fade)), max(1, math.ceil(700 / fade))
    power = lambda n: F.pow(F.lit(keep), n)
    w = lane(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (rows.withColumn("_n", F.count(x).over(upto))
                .withColumn("_block", F.floor(F.greatest(F.col("_n") - 1, F.lit(0)) / block).cast("int"))
                .withColumn("_j", (F.col("_n") - F.col("_block") * block).cast("double")))
    grown = gain * x * power(-F.col("_j"))

    # One row per block: its map, how many values lie before it, and the flight's first value.
    maps = (numbered.groupBy(*KEYS, CHUNK, "_block")
            .agg(F.count(x).alias("_k"), F.sum(grown).alias("_sum"), F.min_by(x, F.when(x.isNotNull(), F.col(order))).alias("_own"),
                 F.collect_list(F.when(x.isNotNull() & (F.col("_j") <= HEAD), F.struct(F.col(order).alias("at"), x.alias("x")))).alias("_few")))
    along = Window.partitionBy(*KEYS).orderBy(CHUNK, "_block")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.select(*KEYS, CHUNK, "_block", "_k", "_few",
                       F.coalesce(F.col("_sum") * power(F.col("_k")), F.lit(0.0)).alias("_offset"),
                       F.sum("_k").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_known"),
                       (F.lit(seed) if seed is not None else F.first("_own", ignorenulls=True).over(
                           along.rowsBetween(Window.unboundedPreceding, 0))).cast("double").alias("_seed"))
    near = Window.partitionBy(*KEYS).orderBy("_known").rangeBetween(-(reach + block), -1)
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct("_known", "_k", "_offset")).over(near)),
        F.when(F.col("_known") - F.col("_k") <= reach, F.col("_seed")).otherwise(0.0),
        lambda state, m: power(m["_k"]) * state + m["_offset"])
    after = F.when(F.col("_k") > 0, power(F.col("_k")) * F.col("_before") + F.col("_offset"))
    starts = (maps.withColumn("_before", folded).withColumn("_after", after)
              .withColumn("_start", F.coalesce(F.last("_after", ignorenulls=True).over(past), "_seed"))
              .groupBy(*KEYS, CHUNK).agg(F.array_sort(F.collect_list(F.struct("_block", "_start"))).alias("_starts"),
                                         F.min(F.col("_known") - F.col("_k")).alias("_earlier")))
    # As many blocks with values as may hold the first HEAD ones.
    heads = (maps.filter("_k > 0").withColumn("_nth", F.row_number().over(along)).filter(F.col("_nth") <= HEAD)
             .groupBy(*KEYS).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_few"))), 1, HEAD)["x"].alias("_few")))
    first = F.struct(F.lit(seed).cast("double").alias("state"), F.array().cast("array<double>").alias("states"))
    step = lambda past, v: F.coalesce(gain * v + keep * past["state"], v)
    states = F.aggregate("_few", first, lambda past, v: F.struct(
        step(past, v).alias("state"), F.concat(past["states"], F.array(step(past, v))).alias("states")), lambda done: done["states"])
    starts = starts.join(heads.select(*KEYS, states.alias("_head")), [*KEYS], "left")
    within = Window.partitionBy(*KEYS, CHUNK, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = numbered.withColumn("_sum", F.sum(grown).over(within))
    begun = F.element_at("_starts", F.col("_block") + 1)["_start"]
    # Before a flight's first value there is no state but the seed.
    state = (F.when(F.col("_earlier") + F.col("_n") == 0, F.lit(seed).cast("double")).when(F.col("_j") == 0, begun)
             .when(F.col("_earlier") + F.col("_n") <= HEAD, F.element_at("_head", (F.col("_earlier") + F.col("_n")).cast("int")))
             .otherwise(power(F.col("_j")) * (begun + F.col("_sum"))))
    return (local.join(starts.hint("shuffle_hash"), [*KEYS, CHUNK], "left")
            .select(*df.drop(CHUNK).columns, state.alias(out)))


def smooth(df: DataFrame, column: str, alpha: float = SMOOTHING, out: str = "smoothed",
           order: str = "time_s", axis: Column | None = None) -> DataFrame:
    """Exponential smoothing; the first value of a flight is taken as it is."""
    return _recurrence(df, column, out, alpha, None, order, axis)


def stale_flag(df: DataFrame, repeats: int = 2) -> DataFrame:
    """1 when the latitude equals the previous one at least ``repeats`` times in a row."""
    halo = with_halo(df, before=repeats, carry=["time_s", "lat_deg"])
    w = lane()
    same = F.lit(True)
    for i in range(1, repeats + 1):
        same = same & (F.lag("lat_deg", i).over(w) == F.col("lat_deg"))
    return without_halo(halo.withColumn("live_stale", F.coalesce(same, F.lit(False)).cast("int")))


def last_rows(df: DataFrame, n: int = 1, order: str = "time_s") -> DataFrame:
    """The last ``n`` rows of each flight; all others are dropped before the shuffle."""
    w = Window.partitionBy(*KEYS).orderBy(F.col(order).desc())
    return df.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= n).drop("_back")


def switches_in_tail(scores: DataFrame, rows: int = 200, order: str = "time_s") -> DataFrame:
    return last_rows(scores, rows, order).groupBy(*KEYS).agg(
        F.coalesce(F.sum("switched"), F.lit(0)).cast("long").alias("switches"))


def trust_decay(df: DataFrame, alert_column: str, rate: float = 0.5) -> DataFrame:
    """``trust`` = exp(-rate * alerts so far)."""
    summed = with_prefix(df, {"_alerts": running_sum(F.col(alert_column))})
    return summed.withColumn("trust", F.exp(F.lit(-rate) * F.col("_alerts"))).drop("_alerts", CHUNK)


def trust_smooth(df: DataFrame, mismatch: str, k: float, theta: float, keep: float = 0.95) -> DataFrame:
    """``trust`` = keep * trust + (1 - keep) * (1 - sigmoid(k * mismatch - theta)), from 1."""
    calm = 1 - 1 / (1 + F.exp(-(F.lit(k) * F.col(mismatch) - F.lit(theta))))
    return _recurrence(df.withColumn("_calm", calm), "_calm", "trust", 1 - keep, 1.0, "time_s", None).drop("_calm")


def escalation(df: DataFrame, trust: str = "trust") -> DataFrame:
    """Level 0-4 from trust; the last two levels need more than 5 / 10 rows in a row."""
    halo = with_halo(df, before=10, carry=["time_s", trust])
    def held(limit: float, rows: int) -> Column:
        frame = lane().rowsBetween(-rows, 0)
        return (F.max(trust).over(frame) < limit) & (F.count(F.lit(1)).over(frame) == rows + 1)
    level = (F.when(held(0.05, 10), 4).when(held(0.1, 5), 3).when(F.col(trust) <= 0.3, 2)
             .when(F.col(trust) <= 0.7, 1).otherwise(0))
    return without_halo(halo.withColumn("level", level))


def motion_consistency(df: DataFrame, rows: int = 10, limit_m: float = 8.0,
                       axes: Sequence[tuple[str, str]] = (("ax_mps2", "x_m"), ("ay_mps2", "y_m"),
                                                          ("az_mps2", "z_m"))) -> DataFrame:
    """``mismatch_m`` over the last ``rows`` steps, ``inconsistent`` above the limit.

    Acceleration is integrated twice by the trapezoid rule (once gives a velocity, which
    cannot be compared with a distance); velocity starts at 0. Null without acceleration.
    """
    accel = [a for a, _ in axes]
    places = [p for _, p in axes]
    w = lane()
    halo = with_halo(df, before=1, carry=["time_s", *accel])
    dt = F.col("time_s") - F.lag("time_s").over(w)
    dv = {f"_dv_{a}": F.coalesce((F.col(a) + F.lag(a).over(w)) / 2 * dt,
                                 F.when(dt.isNull() & F.col(a).isNotNull(), F.lit(0.0))) for a in accel}
    stepped = without_halo(halo.withColumns({**dv, "_dt": dt}))
    some = {a: F.col(f"_dv_{a}").isNotNull().cast("int") for a in accel}
    speed = with_prefix(stepped, {**{f"_v_{a}": running_sum(F.col(f"_dv_{a}")) for a in accel},
                                  **{f"_k_{a}": running_sum(some[a]) for a in accel}})
    # The velocity one row earlier is this one less its own step: no second look at the previous row.
    earlier = {a: F.when(F.col(f"_k_{a}") > some[a], F.col(f"_v_{a}") - F.coalesce(f"_dv_{a}", F.lit(0.0))) for a in accel}
    ds = {f"_ds_{a}": F.coalesce((F.col(f"_v_{a}") + earlier[a]) / 2 * F.col("_dt"), F.lit(0.0)) for a in accel}
    moved = with_prefix(speed.withColumns(ds), {f"_s_{a}": running_sum(F.col(f"_ds_{a}")) for a in accel})
    halo3 = with_halo(moved, before=rows, carry=["time_s", *places, *[f"_s_{a}" for a in accel]])
    total = F.lit(0.0)
    for a, p in axes:
        s = F.col(f"_s_{a}") - F.lag(f"_s_{a}", rows).over(w)
        x = F.col(p) - F.lag(p, rows).over(w)
        total = total + (s - x) * (s - x)
    known = F.lit(True)
    for a in accel:
        known = known & F.col(a).isNotNull()
    out = without_halo(halo3.withColumn("mismatch_m", F.when(known, F.sqrt(total))), drop_chunk=True)
    return (out.withColumn("inconsistent", (F.col("mismatch_m") > limit_m).cast("int"))
            .drop("_dt", *[f"_{k}_{a}" for a in accel for k in ("dv", "v", "k", "ds", "s")]))


def detection_delay(scores: DataFrame, threshold: float = ALERT_THRESHOLD, probability: str = "smoothed",
                    truth: str = "truth", inclusive: bool = True) -> DataFrame:
    """Seconds from the first positive row to the first alert at or after it, per flight."""
    onset = F.min(F.when(F.col(truth) == 1, F.col("time_s")))
    starts = scores.groupBy(*KEYS).agg(onset.alias("attack_start_s")).filter("attack_start_s IS NOT NULL")
    fired = scores.filter(alert(F.col(probability), threshold, inclusive)).select(*KEYS, "time_s")
    first = (join_facts(fired, starts, how="inner").filter("time_s >= attack_start_s")
             .groupBy(*KEYS).agg(F.min("time_s").alias("first_alert_s")))
    return (starts.join(first, list(KEYS), "left")
            .withColumn("delay_s", F.col("first_alert_s") - F.col("attack_start_s")))
