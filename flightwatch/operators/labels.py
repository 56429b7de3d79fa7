"""The eight labelling rules as column expressions on one shared window spec.

Every rule returns ``{token: condition}``. ``label_rows`` ORs them into ``label`` and
collects the tokens in ``reasons``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightwatch.functions.geo import haversine_m
from flightwatch.operators.timeline import lane, with_halo, without_halo
from flightwatch.schema import (
    INNOVATION_COLUMNS, OPTIONAL_DEFAULTS, REQUIRED_COLUMNS, RULE_DEFAULTS)

PLATEAU_COLUMNS = ["lat_deg", "lon_deg", "alt_m", "vel_m_s"]
BODY_RATES = ["rollspeed_radps", "pitchspeed_radps", "yawspeed_radps"]
METRES_PER_DEGREE = 111000.0
REFERENCE_LATITUDE_DEG = 47.39


def require_columns(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def with_defaults(df: DataFrame) -> DataFrame:
    absent = {c: v for c, v in OPTIONAL_DEFAULTS.items() if c not in df.columns}
    return df.withColumns({c: F.lit(v) for c, v in absent.items()}) if absent else df


def _before(column: str) -> Column:
    return F.lag(column).over(lane())


def _step() -> Column:
    return F.col("time_s") - _before("time_s")


def jump_speed() -> Column:
    """Metres per second implied by the step from the previous row; null if dt <= 0."""
    metres = haversine_m(_before("lat_deg"), _before("lon_deg"), F.col("lat_deg"), F.col("lon_deg"))
    return F.when(_step() > 0, metres / _step())


def speed_change() -> Column:
    return F.when(_step() > 0, F.abs(F.col("vel_m_s") - _before("vel_m_s")))


def acceleration() -> Column:
    return F.try_divide(F.col("vel_m_s") - _before("vel_m_s"), _step())


def stale_repeat() -> Column:
    same = F.lit(True)
    for c in PLATEAU_COLUMNS:
        same = same & (F.col(c) == _before(c))
    return F.coalesce(same, F.lit(False))


def in_run(flag: Column, length: int) -> Column:
    """The row belongs to at least ``length`` consecutive flagged rows.

    Some stretch of exactly ``length`` rows around the row must be flagged throughout, so
    a bounded frame decides it for runs of any length.
    """
    value = flag.cast("int")
    ahead = lane().rowsBetween(0, length - 1)
    full = (F.min(value).over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == length)
    return full


def position_speed(local_cosine: bool = False) -> Column:
    """Flat-earth speed in m/s; the fixed latitude keeps the published numbers."""
    lat = F.col("lat_deg") if local_cosine else F.lit(REFERENCE_LATITUDE_DEG)
    north = F.try_divide(F.abs(F.col("lat_deg") - _before("lat_deg")), _step()) * METRES_PER_DEGREE
    east = (F.try_divide(F.abs(F.col("lon_deg") - _before("lon_deg")), _step())
            * METRES_PER_DEGREE * F.cos(F.radians(lat)))
    return F.sqrt(north * north + east * east)


def position_jump(p: dict) -> dict[str, Column]:
    return {"pos_jump": F.col("_jump_speed") > p["max_speed_ms"]}


def speed_anomaly(p: dict, has_accel: bool) -> dict[str, Column]:
    rules = {"speed_change": F.col("_speed_change") > p["max_speed_change_ms"]}
    if not has_accel:
        rules["accel_anomaly"] = F.abs("accel") > p["max_accel_ms2"]
    return rules


def quality_loss(p: dict) -> dict[str, Column]:
    return {"low_sats": F.col("satellites_visible") < p["min_satellites"],
            "high_eph": F.col("eph_m") > p["max_eph_m"],
            "high_epv": F.col("epv_m") > p["max_epv_m"]}


def stale_data(p: dict) -> dict[str, Column]:
    within = F.max(F.col("_full_run").cast("int")).over(lane().rowsBetween(-(p["stale_run"] - 1), 0))
    return {"stale_data": (F.col("is_stale") == 1) & (within == 1)}


def mode_anomaly(p: dict) -> dict[str, Column]:
    rules = {}
    if p["failsafe_is_anomaly"]:
        rules["failsafe"] = F.col("failsafe") == 1
    if p["hex_mode_is_anomaly"]:
        rules["mode_hex"] = F.col("mode").startswith("Mode(0x")
    return rules


def motion_spike(p: dict, columns: list[str]) -> dict[str, Column]:
    if "rollspeed_radps" not in columns:
        return {}
    rules = {"high_rollspeed": F.abs("rollspeed_radps") > p["max_body_rate"]}
    if "pitchspeed_radps" in columns:
        rules["high_pitchspeed"] = F.abs("pitchspeed_radps") > p["max_body_rate"]
    if "vibration_x" in columns and "vibration_z" in columns:
        rules["high_vibration"] = F.col("vibration_z") > p["max_vibration"]
    return rules


def innovation_spike(p: dict, columns: list[str]) -> dict[str, Column]:
    return {f"{c}_spike": F.abs(c) > p["max_innovation"] for c in INNOVATION_COLUMNS if c in columns}


def motion_mismatch(p: dict, columns: list[str]) -> dict[str, Column]:
    if not set(BODY_RATES) <= set(columns):
        return {}
    calm = F.lit(True)
    for c in BODY_RATES:
        calm = calm & (F.abs(c) < p["calm_rate"])
    fast = F.greatest("_position_speed", "vel_m_s") > p["calm_speed_ms"]
    return {"gps_imu_mismatch": calm & fast & (F.col("_nth") > p["exempt_rows"])}


def evaluate_rules(df: DataFrame, local_cosine: bool = False, **thresholds) -> DataFrame:
    """Rows plus one nullable boolean column ``rule_<token>`` per rule and the rule inputs.

    Two passes over one sort: lags first, then the frames over the stale flag.
    """
    unknown = set(thresholds) - set(RULE_DEFAULTS)
    if unknown:
        raise ValueError(f"unknown thresholds: {sorted(unknown)}")
    p = {**RULE_DEFAULTS, **thresholds}
    has_accel = "accel" in df.columns
    rows = with_defaults(require_columns(df))
    columns = rows.columns
    halo = with_halo(rows, before=max(p["exempt_rows"], p["stale_run"]), after=p["stale_run"] - 1,
                     carry=["time_s", *PLATEAU_COLUMNS])
    halo = halo.withColumns({
        "_jump_speed": jump_speed(), "_speed_change": speed_change(),
        "_position_speed": position_speed(local_cosine), "_nth": F.row_number().over(lane()),
        "is_stale": stale_repeat().cast("int")})
    if not has_accel:
        halo = halo.withColumn("accel", acceleration())
    halo = halo.withColumn("_full_run", in_run(F.col("is_stale") == 1, p["stale_run"]))
    rules = {**position_jump(p), **speed_anomaly(p, has_accel), **quality_loss(p), **stale_data(p),
             **mode_anomaly(p), **motion_spike(p, columns), **innovation_spike(p, columns),
             **motion_mismatch(p, columns)}
    return without_halo(halo.withColumns({f"rule_{t}": c for t, c in rules.items()}))


def _token(name: str) -> Column:
    if name == "pos_jump":
        return F.format_string("pos_jump:%.1fm/s", F.col("_jump_speed"))
    if name == "speed_change":
        return F.format_string("speed_change:%.1fm/s", F.col("_speed_change"))
    return F.lit(name)


def label_rows(df: DataFrame, **thresholds) -> DataFrame:
    """Add ``label`` (0/1), ``reasons`` (tokens in rule order), ``is_stale`` and ``accel``."""
    judged = evaluate_rules(df, **thresholds)
    names = [c[len("rule_"):] for c in judged.columns if c.startswith("rule_")]
    reasons = F.array_compact(F.array(*[F.when(F.col(f"rule_{n}"), _token(n)) for n in names]))
    keep = [c for c in judged.columns
            if not c.startswith("rule_") and c not in ("_jump_speed", "_speed_change",
                                                       "_position_speed", "_nth", "_full_run",
                                                       "label", "reasons")]
    return (judged.withColumn("reasons", reasons)
            .select(*keep, (F.size("reasons") > 0).cast("int").alias("label"), "reasons"))


def reason_text(reasons: Column) -> Column:
    """The stored form: every token followed by a semicolon."""
    return F.concat_ws("", F.transform(reasons, lambda t: F.concat(t, F.lit(";"))))


def reason_counts(labelled: DataFrame) -> DataFrame:
    """How often each rule fired; measured values are cut from the tokens."""
    return (labelled.select(F.explode("reasons").alias("token"))
            .groupBy(F.substring_index("token", ":", 1).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))


def step_rules(df: DataFrame, max_alt_step_m: float = 3.0, max_pos_step_m: float = 5.0,
               max_speed_rise_ms: float = 5.0) -> DataFrame:
    """The older rule set on row-to-row steps."""
    halo = with_halo(df, before=1, carry=["time_s", *PLATEAU_COLUMNS])
    metres = haversine_m(_before("lat_deg"), _before("lon_deg"), F.col("lat_deg"), F.col("lon_deg"))
    return without_halo(halo.withColumns({
        "alt_step": F.coalesce(F.abs(F.col("alt_m") - _before("alt_m")) > max_alt_step_m, F.lit(False)),
        "pos_step": F.coalesce(metres > max_pos_step_m, F.lit(False)),
        "speed_rise": F.coalesce(F.col("vel_m_s") - _before("vel_m_s") > max_speed_rise_ms, F.lit(False)),
    }))


def threshold_grid(df: DataFrame, value: Column, thresholds: list[float]) -> DataFrame:
    """Rows above each threshold, all thresholds in one pass over the rows."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(value > t).alias(f"_t{i}") for i, t in enumerate(thresholds)])
    return counts.select("rows", F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("flagged"))
        for i, t in enumerate(thresholds)])))
