"""Column names, types and default parameters shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and order of the telemetry columns and model features.
NUMERIC_COLUMNS = [
    "time_s", "lat_deg", "lon_deg", "alt_m", "rel_alt_m", "vel_m_s", "hdg_deg",
    "fix_type", "satellites_visible", "eph_m", "epv_m",
    "roll_deg", "pitch_deg", "yaw_deg",
    "rollspeed_radps", "pitchspeed_radps", "yawspeed_radps",
    "vibration_x", "vibration_y", "vibration_z",
    "clipping_0", "clipping_1", "clipping_2",
    "vel_ratio", "pos_horiz_ratio", "pos_vert_ratio",
    "vel_innov", "pos_horiz_innov", "pos_vert_innov",
    "battery_voltage", "battery_remaining_pct",
    "armed", "failsafe", "connection_ok",
]
# Sensor columns that only logs of the old layout have.
OLD_SENSOR_COLUMNS = ["ax_mps2", "ay_mps2", "az_mps2", "gx_radps", "gy_radps", "gz_radps"]
TEXT_COLUMNS = ["mode", "last_update_iso"]
# The columns of a raw log, in order.
RAW_COLUMNS = [
    "time_s", "lat_deg", "lon_deg", "alt_m", "rel_alt_m", "vel_m_s", "hdg_deg",
    "fix_type", "satellites_visible", "eph_m", "epv_m",
    "roll_deg", "pitch_deg", "yaw_deg",
    "rollspeed_radps", "pitchspeed_radps", "yawspeed_radps",
    "vibration_x", "vibration_y", "vibration_z",
    "clipping_0", "clipping_1", "clipping_2",
    "vel_ratio", "pos_horiz_ratio", "pos_vert_ratio",
    "vel_innov", "pos_horiz_innov", "pos_vert_innov",
    "battery_voltage", "battery_remaining_pct",
    "armed", "mode", "failsafe", "connection_ok", "last_update_iso",
]
CLEANED_COLUMNS = RAW_COLUMNS + ["is_stale_repeat", "dt"]
LABELLED_COLUMNS = CLEANED_COLUMNS + ["label"]
# The features of a model, in order.
FEATURES = [
    "x_m", "y_m", "alt_m", "rel_alt_m", "vel_m_s", "hdg_deg",
    "fix_type", "satellites_visible", "eph_m", "epv_m",
    "roll_deg", "pitch_deg", "yaw_deg",
    "rollspeed_radps", "pitchspeed_radps", "yawspeed_radps",
    "vibration_x", "vibration_y", "vibration_z",
    "clipping_0", "clipping_1", "clipping_2",
    "vel_ratio", "pos_horiz_ratio", "pos_vert_ratio",
    "vel_innov", "pos_horiz_innov", "pos_vert_innov",
    "battery_voltage", "battery_remaining_pct",
    "armed", "failsafe", "connection_ok", "is_stale_repeat",
]

# Columns of whole numbers, of magnitudes, and what is needed or assumed.
INTEGER_COLUMNS = [
    "fix_type", "satellites_visible", "clipping_0", "clipping_1", "clipping_2",
    "armed", "failsafe", "connection_ok", "is_stale_repeat",
]
MAGNITUDE_COLUMNS = [
    "vel_m_s", "eph_m", "epv_m", "vibration_x", "vibration_y", "vibration_z",
    "vel_ratio", "pos_horiz_ratio", "pos_vert_ratio",
    "vel_innov", "pos_horiz_innov", "pos_vert_innov",
    "battery_voltage", "battery_remaining_pct",
]
CRITICAL_COLUMNS = ["lat_deg", "lon_deg", "alt_m", "rel_alt_m", "vel_m_s"]
REQUIRED_COLUMNS = ["time_s", "lat_deg", "lon_deg", "alt_m", "vel_m_s"]
OPTIONAL_DEFAULTS = {"satellites_visible": 10, "eph_m": 1.0, "epv_m": 2.0,
                     "failsafe": 0, "mode": "UNKNOWN"}

EARTH_RADIUS_M = 6371000.0
EARTH_RADIUS_KM = 6371.0
TERRAINS = ["flat", "mountain", "sea"]
MESSAGE_TYPES = ["GLOBAL_POSITION_INT", "GPS_RAW_INT", "ATTITUDE", "VIBRATION",
                 "ESTIMATOR_STATUS", "HEARTBEAT", "SYS_STATUS", "VFR_HUD"]

# Position box and altitude clamp of each terrain.
TERRAIN_LIMITS = [
    # terrain, lat_min, lat_max, lon_min, lon_max, alt_min, alt_max
    ("flat", 47.35, 47.43, 8.50, 8.59, 440.0, 560.0),
    ("mountain", 46.47, 46.63, 7.87, 8.13, 1600.0, 2800.0),
    ("sea", 43.47, 43.73, 7.17, 7.53, 0.5, 120.0),
]

# Thresholds of the labelling rules.
RULE_DEFAULTS = {
    "max_speed_ms": 30.0, "max_speed_change_ms": 10.0, "max_accel_ms2": 15.0,
    "min_satellites": 6, "max_eph_m": 5.0, "max_epv_m": 10.0,
    "stale_run": 5, "failsafe_is_anomaly": False, "hex_mode_is_anomaly": False,
    "max_body_rate": 2.0, "max_vibration": 1.0, "max_innovation": 1.0,
    "calm_rate": 0.05, "calm_speed_ms": 2.0, "exempt_rows": 3,
}
INNOVATION_COLUMNS = ["vel_innov", "pos_horiz_innov", "pos_vert_innov"]

WINDOW_LENGTH = 30
WINDOW_STRIDE = 15
ALERT_THRESHOLD = 0.6
SMOOTHING = 0.3
DEBOUNCE = 5
GROUND_PROBABILITY = 0.01

RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
SEGMENT_SCHEMA = T.StructType([
    T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()),
    T.StructField("label", T.StringType()), T.StructField("reason", T.StringType()),
])
SCORE_LOG_COLUMNS = [
    "timestamp", "unix_time", "anom_proba", "lat_deg", "lon_deg", "alt_m", "rel_alt_m",
    "vel_m_s", "roll_deg", "pitch_deg", "yaw_deg", "rollspeed", "pitchspeed", "yawspeed",
    "terrain", "model_type", "switched_terrain",
]
_COUNTS = T.MapType(T.StringType(), T.LongType())
CLEANING_REPORT_SCHEMA = T.StructType([
    T.StructField("input_file", T.StringType()), T.StructField("output_file", T.StringType()),
    T.StructField("initial_rows", T.LongType()), T.StructField("final_rows", T.LongType()),
    T.StructField("rows_removed", T.LongType()), T.StructField("time_start_s", T.DoubleType()),
    T.StructField("time_end_s", T.DoubleType()), T.StructField("duration_s", T.DoubleType()),
    T.StructField("missing_after_cleaning", _COUNTS), T.StructField("mode_counts", _COUNTS),
    T.StructField("failsafe_counts", _COUNTS), T.StructField("armed_counts", _COUNTS),
])
MESSAGE_SCHEMA = T.StructType([
    T.StructField("flight_id", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("msg_type", T.StringType()),
] + [T.StructField(c, T.DoubleType()) for c in [
    "lat", "lon", "alt", "relative_alt", "vx", "vy", "vz", "hdg",
    "fix_type", "satellites_visible", "eph", "epv",
    "roll", "pitch", "yaw", "rollspeed", "pitchspeed", "yawspeed",
    "vibration_x", "vibration_y", "vibration_z", "clipping_0", "clipping_1", "clipping_2",
    "vel_ratio", "pos_horiz_ratio", "pos_vert_ratio", "vel_innov", "pos_horiz_innov",
    "pos_vert_innov", "base_mode", "voltage_battery", "battery_remaining",
    "airspeed", "groundspeed", "heading"]] + [T.StructField("mode", T.StringType())])
