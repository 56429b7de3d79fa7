"""Displaced copies of rows, to measure how well detectors see an attack."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightwatch.functions.geo import offset_position

TICK_S = 0.1
JUMP_M = 15.0
PROFILES = ["drift", "ramp_drift", "jump_drift", "static", "teleport", "noise"]


def offsets(profile: Column, intensity: Column, tick: Column, duration_s: float, angle: float,
            seed: int) -> tuple[Column, Column]:
    """(north, east) metres at the tick, counted from 0 at the start of the attack.

    Drifts add up a speed every tick (east at half the speed); their sums are closed forms,
    so a row's offset needs no other row.
    """
    steps = tick + 1
    drift = intensity * TICK_S * steps
    # speed grows linearly over the attack: 0 + 1 + ... + tick
    ramp = intensity * (TICK_S * TICK_S / max(duration_s, 1e-9)) * tick * (tick + 1) / 2
    north_unit, east_unit = F.cos(F.lit(angle)), F.sin(F.lit(angle))
    north = (F.when(profile == "drift", drift).when(profile == "ramp_drift", ramp)
             .when(profile == "jump_drift", drift + JUMP_M * north_unit)
             .when(profile.isin("static", "teleport"), intensity * north_unit)
             .otherwise(F.randn(seed) * intensity))
    east = (F.when(profile == "drift", drift * 0.5).when(profile == "ramp_drift", ramp * 0.5)
            .when(profile == "jump_drift", drift * 0.5 + JUMP_M * east_unit)
            .when(profile.isin("static", "teleport"), intensity * east_unit)
            .otherwise(F.randn(seed + 1) * intensity))
    return north, east


def perturb(df: DataFrame, attacks: Sequence[tuple[str, float]], start_s: float, duration_s: float,
            angle: float = 0.0, seed: int = 42) -> DataFrame:
    """One copy of the rows per (profile, intensity), displaced and labelled 1 in
    [start, start + duration)."""
    unknown = {p for p, _ in attacks} - set(PROFILES)
    if unknown:
        raise ValueError(f"unknown profiles: {sorted(unknown)}")
    copies = df.drop("label").withColumn("_attack", F.explode(F.array(*[
        F.struct(F.lit(p).alias("profile"), F.lit(float(i)).alias("intensity")) for p, i in attacks])))
    rows = copies.select("*", "_attack.*").drop("_attack")
    active = (F.col("time_s") >= start_s) & (F.col("time_s") < start_s + duration_s)
    tick = F.round((F.col("time_s") - start_s) / TICK_S)
    north, east = offsets(F.col("profile"), F.col("intensity"), tick, duration_s, angle, seed)
    lat, lon = offset_position(F.col("lat_deg"), F.col("lon_deg"), north, east)
    return rows.withColumns({
        "lat_deg": F.when(active, lat).otherwise(F.col("lat_deg")),
        "lon_deg": F.when(active, lon).otherwise(F.col("lon_deg")),
        "label": active.cast("int")})
