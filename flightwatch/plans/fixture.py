"""Telemetry derived from the driver's ``events`` table; one SQL text for both engines."""

from __future__ import annotations

import contextlib
import contextvars

from pyspark.sql import DataFrame, SparkSession

TELEMETRY_CTE = """
base AS (
  SELECT event_id, CAST(FLOOR(event_id/500.0e0) AS BIGINT) AS flight_id,
         CAST(event_id % 500 AS BIGINT) AS seq,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         value, event_type FROM events),
telemetry AS (
  SELECT flight_id, seq,
    seq*0.1e0 + CASE WHEN flight_id%3=0 AND seq>=400 THEN 7.0e0 ELSE 0.0e0 END AS time_s,
    CASE flight_id%3 WHEN 0 THEN 47.39e0 WHEN 1 THEN 46.55e0 ELSE 43.6e0 END
      + (CASE WHEN seq BETWEEN 300 AND 309 THEN 300 ELSE seq END)*0.000005e0
      + CASE WHEN flight_id%2=1 AND seq BETWEEN 200 AND 260 THEN 0.01e0 ELSE 0.0e0 END AS lat_deg,
    CASE flight_id%3 WHEN 0 THEN 8.54e0 WHEN 1 THEN 8.0e0 ELSE 7.3e0 END
      + CASE WHEN seq BETWEEN 300 AND 309 THEN 0.0e0 ELSE k*0.0000001e0 END AS lon_deg,
    CASE flight_id%3 WHEN 0 THEN 450.0e0 WHEN 1 THEN 2000.0e0 ELSE -1.0e0 END
      + CASE WHEN seq BETWEEN 300 AND 309 THEN 0.0e0 ELSE k*0.01e0 END AS alt_m,
    CASE WHEN k=51 THEN NULL ELSE seq*0.1e0 END AS rel_alt_m,
    CASE WHEN seq BETWEEN 300 AND 309 THEN 5.0e0
         WHEN k=77 THEN 20.0e0 ELSE 5.0e0 + value/1000.0e0 END AS vel_m_s,
    CASE WHEN k%25=24 THEN 2 ELSE 3 END AS fix_type,
    4 + k%12 AS satellites_visible, k/19.0e0 AS eph_m, k/9.0e0 AS epv_m,
    CASE WHEN k=97 THEN 2.5e0 ELSE (k%20-10)*0.01e0 END AS rollspeed_radps,
    CASE WHEN k=98 THEN -2.5e0 ELSE (k%14-7)*0.01e0 END AS pitchspeed_radps,
    (k%10-5)*0.01e0 AS yawspeed_radps,
    CASE WHEN k%25=0 THEN 1.5e0 ELSE 0.02e0 END AS vibration_z,
    k/90.0e0 AS vel_innov, k/95.0e0 AS pos_horiz_innov, k/92.0e0 AS pos_vert_innov,
    CASE WHEN k%50=7 THEN 1 ELSE 0 END AS failsafe,
    CASE WHEN seq>=20 THEN 1 ELSE 0 END AS armed,
    CASE WHEN k=33 THEN 0 ELSE 1 END AS connection_ok,
    100.0e0 - seq*0.01e0 AS battery_remaining_pct,
    CASE WHEN k=50 THEN NULL WHEN event_type='error' THEN 'Mode(0x000000C0)'
         WHEN event_type='signup' THEN 'Mode(0xC0)' ELSE concat(' ', event_type, ' ') END AS mode,
    k/100.0e0 AS score,
    CASE WHEN flight_id%2=1 AND seq BETWEEN 200 AND 260 THEN 1 ELSE 0 END AS truth
  FROM base)
"""


# Spark pushes filters below this projection and repeats its inputs there, so the number
# in ``props`` is cut out by a cheap expression that gives the same value.
_SPARK_NUMBER = "CAST(translate(props, '{\"k: }', '') AS BIGINT)"
_DUCK_NUMBER = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


# Every third stretch of 500 events belongs to one flight, which so holds a third of all rows.
_FLIGHT = ("CAST(FLOOR(event_id/500.0e0) AS BIGINT) AS flight_id,", "CAST(event_id % 500 AS BIGINT) AS seq,")
_LONG_FLIGHT = (
    "CAST(CASE WHEN FLOOR(event_id/500.0e0) % 3 = 0 THEN 0 ELSE FLOOR(event_id/500.0e0) END AS BIGINT) AS flight_id,",
    "CAST(CASE WHEN FLOOR(event_id/500.0e0) % 3 = 0 THEN FLOOR(event_id/1500.0e0) * 500 ELSE 0 END + event_id % 500 AS BIGINT) AS seq,")
_LONG = contextvars.ContextVar("long_flight", default=False)


def with_long_flight(text: str) -> str:
    """The same SQL over flights of which one holds a third of the rows."""
    for old, new in zip(_FLIGHT, _LONG_FLIGHT, strict=True):
        text = text.replace(old, new)
    return text


@contextlib.contextmanager
def long_flight():
    token = _LONG.set(True)
    try:
        yield
    finally:
        _LONG.reset(token)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = TELEMETRY_CTE.replace(_DUCK_NUMBER, _SPARK_NUMBER).replace("{", "{{").replace("}", "}}")
    text = text.replace("FROM events)", "FROM {events})")
    text = with_long_flight(text) if _LONG.get() else text
    return spark.sql("WITH " + text + " SELECT * FROM telemetry", events=events)
