"""Registry of queries and the SQL pieces their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightwatch.operators.clean import clean
from flightwatch.operators.labels import label_rows
from flightwatch.operators.timeline import settled
from flightwatch.plans.fixture import TELEMETRY_CTE, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ELIGIBLE = """
eligible AS (
  SELECT * REPLACE (CASE WHEN mode IS NULL THEN 'UNKNOWN'
      WHEN trim(mode) NOT LIKE 'Mode(0x%' THEN upper(trim(mode))
      WHEN lower(trim(replace(replace(trim(mode), 'Mode(0x', ''), ')', ''))) IN ('c0', '0xc0') THEN 'OFFBOARD'
      ELSE 'HEX_' || upper(trim(replace(replace(trim(mode), 'Mode(0x', ''), ')', ''))) END AS mode)
  FROM telemetry
  WHERE time_s IS NOT NULL AND lat_deg IS NOT NULL AND lon_deg IS NOT NULL AND alt_m IS NOT NULL
    AND rel_alt_m IS NOT NULL AND vel_m_s IS NOT NULL AND fix_type >= 3 AND connection_ok = 1)
"""
CLEANED = """
cleaned AS (
  SELECT * FROM (
    SELECT *, 0 AS is_stale_repeat, time_s - lag(time_s) OVER (PARTITION BY flight_id ORDER BY time_s, seq) AS dt
    FROM eligible)
  WHERE dt IS NULL OR (dt > 0 AND dt < 5.0e0))
"""
LAGGED = """
lagged AS (
  SELECT *, lag(time_s) OVER w AS p_t, lag(lat_deg) OVER w AS p_lat, lag(lon_deg) OVER w AS p_lon,
         lag(alt_m) OVER w AS p_alt, lag(vel_m_s) OVER w AS p_vel, row_number() OVER w AS nth,
         count(*) OVER (PARTITION BY flight_id) AS n_rows
  FROM cleaned WINDOW w AS (PARTITION BY flight_id ORDER BY time_s)),
rates AS (
  SELECT *,
    CASE WHEN time_s - p_t > 0 THEN 2 * 6371000.0e0 * asin(sqrt(
        pow(sin(radians(lat_deg - p_lat) / 2), 2)
        + cos(radians(p_lat)) * cos(radians(lat_deg)) * pow(sin(radians(lon_deg - p_lon) / 2), 2)))
      / (time_s - p_t) END AS jump_speed,
    CASE WHEN time_s - p_t > 0 THEN abs(vel_m_s - p_vel) END AS speed_change,
    (vel_m_s - p_vel) / (time_s - p_t) AS accel,
    sqrt(pow(abs(lat_deg - p_lat) / (time_s - p_t) * 111000.0e0, 2)
       + pow(abs(lon_deg - p_lon) / (time_s - p_t) * 111000.0e0 * cos(radians(47.39e0)), 2)) AS pos_speed,
    CASE WHEN lat_deg = p_lat AND lon_deg = p_lon AND alt_m = p_alt AND vel_m_s = p_vel THEN 1 ELSE 0 END AS is_stale
  FROM lagged),
edges AS (
  SELECT *, CASE WHEN is_stale = lag(is_stale) OVER (PARTITION BY flight_id ORDER BY time_s) THEN 0 ELSE 1 END AS edge
  FROM rates),
islands AS (SELECT *, sum(edge) OVER (PARTITION BY flight_id ORDER BY time_s) AS island FROM edges),
runs AS (SELECT *, count(*) OVER (PARTITION BY flight_id, island) AS run_rows FROM islands)
"""


def labelled_cte(stale_run: int = 5, failsafe: bool = False, max_speed: float = 30.0) -> str:
    return LAGGED + f""",
ruled AS (
  SELECT *,
    CASE WHEN jump_speed > {max_speed}e0 THEN 1 ELSE 0 END AS r_pos_jump,
    CASE WHEN speed_change > 10.0e0 THEN 1 ELSE 0 END AS r_speed_change,
    CASE WHEN abs(accel) > 15.0e0 THEN 1 ELSE 0 END AS r_accel_anomaly,
    CASE WHEN satellites_visible < 6 THEN 1 ELSE 0 END AS r_low_sats,
    CASE WHEN eph_m > 5.0e0 THEN 1 ELSE 0 END AS r_high_eph,
    CASE WHEN epv_m > 10.0e0 THEN 1 ELSE 0 END AS r_high_epv,
    CASE WHEN is_stale = 1 AND run_rows >= {stale_run} THEN 1 ELSE 0 END AS r_stale_data,
    CASE WHEN {'failsafe = 1' if failsafe else '1 = 0'} THEN 1 ELSE 0 END AS r_failsafe,
    CASE WHEN abs(rollspeed_radps) > 2.0e0 THEN 1 ELSE 0 END AS r_high_rollspeed,
    CASE WHEN abs(pitchspeed_radps) > 2.0e0 THEN 1 ELSE 0 END AS r_high_pitchspeed,
    CASE WHEN vibration_z > 1.0e0 THEN 1 ELSE 0 END AS r_high_vibration,
    CASE WHEN abs(vel_innov) > 1.0e0 THEN 1 ELSE 0 END AS r_vel_innov_spike,
    CASE WHEN abs(pos_horiz_innov) > 1.0e0 THEN 1 ELSE 0 END AS r_pos_horiz_innov_spike,
    CASE WHEN abs(pos_vert_innov) > 1.0e0 THEN 1 ELSE 0 END AS r_pos_vert_innov_spike,
    CASE WHEN abs(rollspeed_radps) < 0.05e0 AND abs(pitchspeed_radps) < 0.05e0 AND abs(yawspeed_radps) < 0.05e0
          AND greatest(pos_speed, vel_m_s) > 2.0e0 AND nth > 3 THEN 1 ELSE 0 END AS r_gps_imu_mismatch
  FROM runs),
labelled AS (
  SELECT *, CAST(CASE WHEN r_pos_jump + r_speed_change + r_accel_anomaly + r_low_sats + r_high_eph + r_high_epv
    + r_stale_data + r_failsafe + r_high_rollspeed + r_high_pitchspeed + r_high_vibration + r_vel_innov_spike
    + r_pos_horiz_innov_spike + r_pos_vert_innov_spike + r_gps_imu_mismatch > 0 THEN 1 ELSE 0 END AS INTEGER) AS label,
    nth - 1 AS rn
  FROM ruled)
"""


MEMBERS = """
members AS (
  SELECT l.*, CAST(FLOOR(l.rn/15.0e0) AS BIGINT) - o.o AS win,
         l.rn - (CAST(FLOOR(l.rn/15.0e0) AS BIGINT) - o.o) * 15 AS pos
  FROM labelled l CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1) o
  WHERE CAST(FLOOR(l.rn/15.0e0) AS BIGINT) - o.o >= 0
    AND (CAST(FLOOR(l.rn/15.0e0) AS BIGINT) - o.o) * 15 + 30 <= l.n_rows)
"""
WINDOWS = """
windows AS (
  SELECT flight_id, win, min(time_s) AS start_s, max(time_s) AS end_s,
         max(CASE WHEN pos = 15 THEN time_s END) AS centre_s, avg(label) AS share,
         CAST(CASE WHEN avg(label) > 0.5e0 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM members GROUP BY flight_id, win)
"""
_CHAIN = [("eligible", ELIGIBLE), ("cleaned", CLEANED), ("labelled", labelled_cte()),
          ("members", MEMBERS), ("windows", WINDOWS)]


def sql(upto: str | None, body: str, extra: str = "", recursive: bool = False, **labelled) -> str:
    """Oracle text: the shared steps up to ``upto``, own steps ``extra``, then ``body``."""
    parts = [TELEMETRY_CTE]
    if upto:
        for name, text in _CHAIN:
            parts.append(labelled_cte(**labelled) if name == "labelled" else text)
            if name == upto:
                break
    if extra:
        parts.append(extra)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + body


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry written once as a table; no flight is gathered for it."""
    return settled(telemetry(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(clean(raw(spark, sf_dir), tie=["seq"]))


def labelling(spark: SparkSession, sf_dir: str, **thresholds) -> DataFrame:
    # The vibration rule asks for all three axes to have been logged.
    return label_rows(cleaned(spark, sf_dir).withColumn("vibration_x", F.lit(0.02)), **thresholds)


def labelled(spark: SparkSession, sf_dir: str, **thresholds) -> DataFrame:
    """Settled, for queries that read the labels more than once."""
    return settled(labelling(spark, sf_dir, **thresholds))


def r6(column: str, name: str | None = None):
    return F.round(F.col(column), 6).alias(name or column)
