"""Cleaning, labelling and row-wise queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightwatch.functions.geo import haversine_m, in_box
from flightwatch.operators import clean as C
from flightwatch.operators import labels as L
from flightwatch.operators.perturb import perturb
from flightwatch.operators.scoring import alert, ground_gate
from flightwatch.operators.terrain import terrain_of
from flightwatch.operators.timeline import lane, with_halo, without_halo
from flightwatch.operators.windows import to_local
from flightwatch.plans.catalog import LAGGED, cleaned, labelling, query, r6, raw, sql
from flightwatch.plans.fixture import telemetry

KEY = ["flight_id", "seq"]


@query("p01_numeric_coercion", sql(None, """
SELECT flight_id, seq, TRY_CAST(trim(a) AS DOUBLE) AS vel_m_s, TRY_CAST(trim(b) AS DOUBLE) AS rel_alt_m FROM (
  SELECT flight_id, seq, CASE WHEN k % 10 = 0 THEN 'n/a' WHEN k % 10 = 1 THEN '' ELSE ' ' || CAST(k AS VARCHAR) || '.5 ' END AS a,
         CAST(seq AS VARCHAR) || CASE WHEN k % 7 = 0 THEN 'm' ELSE '' END AS b
  FROM (SELECT t.*, CAST(score * 100 AS BIGINT) AS k FROM telemetry t))"""))
def p01(spark, sf):
    t = telemetry(spark, sf).withColumn("k", F.round(F.col("score") * 100).cast("long"))
    text = t.select(*KEY, F.when(F.col("k") % 10 == 0, "n/a").when(F.col("k") % 10 == 1, "")
                    .otherwise(F.concat(F.lit(" "), F.col("k").cast("string"), F.lit(".5 "))).alias("vel_m_s"),
                    F.concat(F.col("seq").cast("string"), F.when(F.col("k") % 7 == 0, "m").otherwise("")).alias("rel_alt_m"))
    return C.coerce_numbers(text)


@query("p02_text_strip", sql(None, " SELECT flight_id, seq, trim(mode) AS mode FROM telemetry"))
def p02(spark, sf):
    return C.strip_text(telemetry(spark, sf).select(*KEY, "mode"))


@query("p03_normalize_mode", sql("eligible", " SELECT flight_id, seq, mode FROM eligible"))
def p03(spark, sf):
    return C.eligible(telemetry(spark, sf)).select(*KEY, "mode")


@query("p04_iso_default", sql(None, """
SELECT flight_id, seq, coalesce(trim(CASE WHEN seq % 3 = 0 THEN NULL ELSE ' t' || seq END), 'UNKNOWN') AS last_update_iso FROM telemetry"""))
def p04(spark, sf):
    t = telemetry(spark, sf).select(*KEY, F.when(F.col("seq") % 3 != 0, F.concat(F.lit(" t"), F.col("seq"))).alias("last_update_iso"))
    return C.normalize_text(t)


@query("p05_drop_incomplete", sql(None, """
SELECT flight_id, count(*) AS n FROM telemetry WHERE time_s IS NOT NULL AND lat_deg IS NOT NULL AND lon_deg IS NOT NULL
 AND alt_m IS NOT NULL AND rel_alt_m IS NOT NULL AND vel_m_s IS NOT NULL GROUP BY flight_id"""))
def p05(spark, sf):
    return C.drop_incomplete(telemetry(spark, sf)).groupBy("flight_id").agg(F.count("*").alias("n"))


@query("p06_min_fix_type", sql(None, " SELECT flight_id, seq FROM telemetry WHERE fix_type >= 3"))
def p06(spark, sf):
    return C.keep_fixed(telemetry(spark, sf)).select(*KEY)


@query("p07_connected_only", sql(None, " SELECT flight_id, seq FROM telemetry WHERE connection_ok = 1"))
def p07(spark, sf):
    return C.keep_connected(telemetry(spark, sf)).select(*KEY)


@query("p08_duplicate_rows", sql(None, """
SELECT DISTINCT flight_id, seq, ROUND(time_s,6) AS time_s, mode, ROUND(score,6) AS score FROM (
  SELECT * FROM telemetry UNION ALL SELECT * FROM telemetry WHERE seq % 3 = 0)"""))
def p08(spark, sf):
    t = telemetry(spark, sf)
    both = t.unionByName(t.filter("seq % 3 = 0"))
    return C.drop_duplicate_rows(both).select(*KEY, r6("time_s"), "mode", r6("score"))


@query("p09_p10_clean_rows", sql("cleaned", """
 SELECT flight_id, seq, ROUND(time_s,6) AS time_s, ROUND(dt,6) AS dt, mode, is_stale_repeat FROM cleaned"""))
def p10(spark, sf):
    return C.clean(raw(spark, sf), tie=["seq"]).select(*KEY, r6("time_s"), r6("dt"), "mode", "is_stale_repeat")


@query("p10_repeated_instants", sql(None, """
 SELECT flight_id, seq, ROUND(dt,6) AS dt FROM cleaned""", extra="""
doubled AS (SELECT * FROM telemetry UNION ALL SELECT * REPLACE (seq + 100000 AS seq) FROM telemetry WHERE seq % 10 = 0
            UNION ALL SELECT * FROM telemetry WHERE seq % 4 = 1),
eligible AS (SELECT DISTINCT * FROM doubled
  WHERE lat_deg IS NOT NULL AND lon_deg IS NOT NULL AND alt_m IS NOT NULL AND rel_alt_m IS NOT NULL
    AND vel_m_s IS NOT NULL AND fix_type >= 3 AND connection_ok = 1),
cleaned AS (SELECT * FROM (
    SELECT *, time_s - lag(time_s) OVER (PARTITION BY flight_id ORDER BY time_s, seq) AS dt FROM eligible)
  WHERE dt IS NULL OR (dt > 0 AND dt < 5.0e0))"""))
def p10_repeats(spark, sf):
    t = raw(spark, sf)
    doubled = (t.unionByName(t.filter("seq % 10 = 0").withColumn("seq", F.col("seq") + 100000))
               .unionByName(t.filter("seq % 4 = 1")))
    return C.clean(doubled, tie=["seq"]).select(*KEY, r6("dt"))


@query("p12_optional_defaults", sql(None, """
 SELECT flight_id, seq, 10 AS satellites_visible, 1.0e0 AS eph_m, 2.0e0 AS epv_m, 0 AS failsafe, 'UNKNOWN' AS mode FROM telemetry"""))
def p12(spark, sf):
    t = telemetry(spark, sf).drop("satellites_visible", "eph_m", "epv_m", "failsafe", "mode")
    return L.with_defaults(t).select(*KEY, "satellites_visible", "eph_m", "epv_m", "failsafe", "mode")


@query("p13_p15_fill_zero", sql(None, """
 SELECT flight_id, seq, ROUND(coalesce(rel_alt_m, 0.0e0),6) AS rel_alt_m, 0.0e0 AS hdg_deg FROM telemetry"""))
def p13(spark, sf):
    return C.fill_zero(telemetry(spark, sf), ["rel_alt_m", "hdg_deg"]).select(*KEY, r6("rel_alt_m"), "hdg_deg")


@query("p14_fill_median", sql(None, """
 SELECT t.flight_id, seq, ROUND(coalesce(rel_alt_m, m_rel),6) AS rel_alt_m, ROUND(coalesce(v, m_v),6) AS vel_m_s
 FROM (SELECT *, CASE WHEN satellites_visible > 5 THEN vel_m_s END AS v FROM telemetry) t JOIN (
   SELECT flight_id, median(rel_alt_m) AS m_rel, median(CASE WHEN satellites_visible > 5 THEN vel_m_s END) AS m_v
   FROM telemetry GROUP BY flight_id) m ON t.flight_id = m.flight_id"""))
def p14(spark, sf):
    t = raw(spark, sf).withColumn("vel_m_s", F.when(F.col("satellites_visible") > 5, F.col("vel_m_s")))
    return C.fill_median(t, ["rel_alt_m", "vel_m_s"]).select(*KEY, r6("rel_alt_m"), r6("vel_m_s"))


@query("p16_fill_forward", sql(None, """
 SELECT flight_id, seq, ROUND(coalesce(last_value(rel_alt_m IGNORE NULLS) OVER w, 0.0e0),6) AS rel_alt_m,
        ROUND(coalesce(last_value(v IGNORE NULLS) OVER w, 0.0e0),6) AS vel_m_s
 FROM (SELECT *, CASE WHEN satellites_visible > 12 THEN vel_m_s END AS v FROM telemetry)
 WINDOW w AS (PARTITION BY flight_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def p16(spark, sf):
    t = raw(spark, sf).withColumn("vel_m_s", F.when(F.col("satellites_visible") > 12, F.col("vel_m_s")))
    return C.fill_forward(t, ["rel_alt_m", "vel_m_s"]).select(*KEY, r6("rel_alt_m"), r6("vel_m_s"))


@query("p17_local_metres", sql("cleaned", """
 SELECT flight_id, seq, ROUND(radians(lat_deg - lat0) * 6371000.0e0, 6) AS x_m,
        ROUND(radians(lon_deg - lon0) * 6371000.0e0 * cos(radians(lat0)), 6) AS y_m
 FROM (SELECT *, first_value(lat_deg) OVER w AS lat0, first_value(lon_deg) OVER w AS lon0
       FROM cleaned WINDOW w AS (PARTITION BY flight_id ORDER BY time_s))"""))
def p17(spark, sf):
    return to_local(cleaned(spark, sf)).select(*KEY, r6("x_m"), r6("y_m"))


@query("p24_bounding_box", sql(None, """
 SELECT flight_id, seq FROM telemetry WHERE lat_deg BETWEEN 46.5e0 AND 46.5515e0 AND lon_deg BETWEEN 7.9e0 AND 8.1e0"""))
def p24(spark, sf):
    return telemetry(spark, sf).filter(in_box(F.col("lat_deg"), F.col("lon_deg"), 46.5, 46.5515, 7.9, 8.1)).select(*KEY)


@query("p25_ground_gate", sql(None, """
 SELECT flight_id, seq, ROUND(CASE WHEN NOT coalesce(armed > 0.5e0, FALSE) THEN 0.01e0 WHEN rel_alt_m < 5.0e0 AND vel_m_s < 3.0e0 THEN 0.01e0 ELSE score END, 6) AS raw_proba FROM telemetry"""))
def p25(spark, sf):
    return telemetry(spark, sf).select(*KEY, F.round(ground_gate(
        F.col("armed"), F.col("rel_alt_m"), F.col("vel_m_s"), F.col("score")), 6).alias("raw_proba"))


@query("p26_alerts_both_bounds", sql(None, """
 SELECT flight_id, CAST(count_if(score >= 0.6e0) AS BIGINT) AS at_or_above, CAST(count_if(score > 0.6e0) AS BIGINT) AS above
 FROM telemetry GROUP BY flight_id"""))
def p26(spark, sf):
    s = F.col("score")
    return telemetry(spark, sf).groupBy("flight_id").agg(
        F.count_if(alert(s, 0.6)).alias("at_or_above"), F.count_if(alert(s, 0.6, inclusive=False)).alias("above"))


@query("p27_elevation_class", sql(None, """
 SELECT flight_id, seq, CASE WHEN alt_m > 800 THEN 'mountain' WHEN alt_m > 0 THEN 'flat' ELSE 'sea' END AS terrain FROM telemetry"""))
def p27(spark, sf):
    return telemetry(spark, sf).select(*KEY, terrain_of(F.col("alt_m")).alias("terrain"))


_TICK = "CAST(ROUND((time_s - 10.0e0) / 0.1e0) AS DOUBLE)"
_ACTIVE = "(time_s >= 10.0e0 AND time_s < 20.0e0)"


@query("p29_perturbed_positions", sql(None, f"""
 SELECT flight_id, seq, profile, intensity,
   ROUND(CASE WHEN {_ACTIVE} THEN lat_deg + degrees(north / 6371000.0e0) ELSE lat_deg END, 8) AS lat_deg,
   ROUND(CASE WHEN {_ACTIVE} THEN lon_deg + degrees(east / (6371000.0e0 * cos(radians(lat_deg)))) ELSE lon_deg END, 8) AS lon_deg,
   CAST(CASE WHEN {_ACTIVE} THEN 1 ELSE 0 END AS INTEGER) AS label
 FROM (SELECT t.*, profile, intensity,
   CASE profile WHEN 'drift' THEN intensity * 0.1e0 * ({_TICK} + 1)
     WHEN 'ramp_drift' THEN intensity * 0.01e0 / 10.0e0 * {_TICK} * ({_TICK} + 1) / 2
     WHEN 'jump_drift' THEN intensity * 0.1e0 * ({_TICK} + 1) + 15.0e0 * cos(0.5e0) ELSE intensity * cos(0.5e0) END AS north,
   CASE profile WHEN 'drift' THEN intensity * 0.1e0 * ({_TICK} + 1) * 0.5e0
     WHEN 'ramp_drift' THEN intensity * 0.01e0 / 10.0e0 * {_TICK} * ({_TICK} + 1) / 2 * 0.5e0
     WHEN 'jump_drift' THEN intensity * 0.1e0 * ({_TICK} + 1) * 0.5e0 + 15.0e0 * sin(0.5e0) ELSE intensity * sin(0.5e0) END AS east
   FROM telemetry t CROSS JOIN (VALUES ('drift', 2.0e0), ('ramp_drift', 2.0e0), ('jump_drift', 1.0e0), ('static', 50.0e0),
        ('teleport', 500.0e0)) p(profile, intensity))"""))
def p29(spark, sf):
    attacks = [("drift", 2.0), ("ramp_drift", 2.0), ("jump_drift", 1.0), ("static", 50.0), ("teleport", 500.0)]
    return perturb(telemetry(spark, sf), attacks, 10.0, 10.0, angle=0.5).select(
        *KEY, "profile", "intensity", F.round("lat_deg", 8).alias("lat_deg"),
        F.round("lon_deg", 8).alias("lon_deg"), "label")


@query("p29_noise_profile")
def p29_noise(spark, sf):
    return perturb(telemetry(spark, sf), [("noise", 5.0)], 10.0, 10.0).select(*KEY, "profile", "lat_deg", "lon_deg", "label")


@query("p30_impossible_speed", sql("cleaned", " SELECT flight_id, seq FROM rates WHERE jump_speed IS NULL OR jump_speed <= 500",
                                   extra=LAGGED))
def p30(spark, sf):
    return C.drop_impossible_speed(cleaned(spark, sf)).select(*KEY)


def _rules(spark, sf, **thresholds):
    c = cleaned(spark, sf).withColumn("vibration_x", F.lit(0.02))
    return L.evaluate_rules(c, **thresholds)


def _flag(*names):
    return [F.coalesce(F.col(f"rule_{n}"), F.lit(False)).cast("int").alias(n) for n in names]


def _flag_sql(*names):
    return ", ".join(f"CAST(r_{n} AS INTEGER) AS {n}" for n in names)


@query("w01_time_steps", sql("eligible", """
 SELECT flight_id, seq, ROUND(time_s - lag(time_s) OVER (PARTITION BY flight_id ORDER BY time_s), 6) AS dt FROM eligible"""))
def w01(spark, sf):
    return C.time_steps(C.eligible(raw(spark, sf))).select(*KEY, r6("dt"))


@query("w02_haversine_steps", sql("labelled", """
 SELECT flight_id, seq, ROUND(jump_speed * (time_s - p_t), 4) AS metres FROM labelled"""))
def w02(spark, sf):
    halo = with_halo(cleaned(spark, sf), before=1, carry=["time_s", "lat_deg", "lon_deg"])
    w = lane()
    m = haversine_m(F.lag("lat_deg").over(w), F.lag("lon_deg").over(w), F.col("lat_deg"), F.col("lon_deg"))
    return without_halo(halo.withColumn("metres", F.round(m, 4))).select(*KEY, "metres")


@query("w03_h1_position_jump", sql("labelled", " SELECT flight_id, seq, ROUND(jump_speed, 4) AS jump_speed, "
                                   + _flag_sql("pos_jump") + " FROM labelled"))
def w03(spark, sf):
    return _rules(spark, sf).select(*KEY, F.round("_jump_speed", 4).alias("jump_speed"), *_flag("pos_jump"))


@query("w04_h2_speed_change", sql("labelled", " SELECT flight_id, seq, ROUND(accel, 5) AS accel, "
                                  + _flag_sql("speed_change", "accel_anomaly") + " FROM labelled"))
def w04(spark, sf):
    return _rules(spark, sf).select(*KEY, F.round("accel", 5).alias("accel"), *_flag("speed_change", "accel_anomaly"))


@query("w05_h3_quality", sql("labelled", " SELECT flight_id, seq, " + _flag_sql("low_sats", "high_eph", "high_epv") + " FROM labelled"))
def w05(spark, sf):
    return _rules(spark, sf).select(*KEY, *_flag("low_sats", "high_eph", "high_epv"))


for _n in (2, 5):
    @query(f"w06_h4_stale_run_{_n}", sql("labelled", " SELECT flight_id, seq, CAST(is_stale AS INTEGER) AS is_stale, "
                                         + _flag_sql("stale_data") + " FROM labelled", stale_run=_n))
    def w06(spark, sf, n=_n):
        return _rules(spark, sf, stale_run=n).select(*KEY, "is_stale", *_flag("stale_data"))


@query("w07_h5_mode", sql("labelled", " SELECT flight_id, seq, " + _flag_sql("failsafe") + ", 0 AS mode_hex FROM labelled", failsafe=True))
def w07(spark, sf):
    return _rules(spark, sf, failsafe_is_anomaly=True, hex_mode_is_anomaly=True).select(*KEY, *_flag("failsafe", "mode_hex"))


@query("w08_h6_motion", sql("labelled", " SELECT flight_id, seq, "
                            + _flag_sql("high_rollspeed", "high_pitchspeed", "high_vibration") + " FROM labelled"))
def w08(spark, sf):
    return _rules(spark, sf).select(*KEY, *_flag("high_rollspeed", "high_pitchspeed", "high_vibration"))


@query("w09_h7_innovation", sql("labelled", " SELECT flight_id, seq, "
                                + _flag_sql("vel_innov_spike", "pos_horiz_innov_spike", "pos_vert_innov_spike") + " FROM labelled"))
def w09(spark, sf):
    return _rules(spark, sf).select(*KEY, *_flag("vel_innov_spike", "pos_horiz_innov_spike", "pos_vert_innov_spike"))


@query("w10_h8_motion_mismatch", sql("labelled", " SELECT flight_id, seq, " + _flag_sql("gps_imu_mismatch") + " FROM labelled"))
def w10(spark, sf):
    return _rules(spark, sf).select(*KEY, *_flag("gps_imu_mismatch"))


_TOKENS = ["pos_jump", "speed_change", "accel_anomaly", "low_sats", "high_eph", "high_epv", "stale_data", "failsafe",
           "high_rollspeed", "high_pitchspeed", "high_vibration", "vel_innov_spike", "pos_horiz_innov_spike",
           "pos_vert_innov_spike", "gps_imu_mismatch"]


@query("w03_w10_row_labels", sql("labelled", " SELECT flight_id, seq, label, CAST("
                                 + " + ".join(f"r_{t}" for t in _TOKENS) + " AS INTEGER) AS n_reasons FROM labelled", failsafe=True, stale_run=2))
def row_labels(spark, sf):
    c = cleaned(spark, sf).withColumn("vibration_x", F.lit(0.02))
    return L.label_rows(c, failsafe_is_anomaly=True, stale_run=2).select(
        *KEY, "label", F.size("reasons").alias("n_reasons"))


@query("a04_reason_counts", sql("labelled", " SELECT reason, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS reason FROM labelled WHERE r_{t} = 1" for t in _TOKENS) + ") GROUP BY reason", failsafe=True))
def a04(spark, sf):
    return L.reason_counts(labelling(spark, sf, failsafe_is_anomaly=True))


@query("w29_older_step_rules", sql("labelled", """
 SELECT flight_id, CAST(count_if(abs(alt_m - p_alt) > 3) AS BIGINT) AS alt_steps,
   CAST(count_if(jump_speed * (time_s - p_t) > 5) AS BIGINT) AS pos_steps,
   CAST(count_if(vel_m_s - p_vel > 5) AS BIGINT) AS speed_rises FROM labelled GROUP BY flight_id"""))
def w29(spark, sf):
    return L.step_rules(cleaned(spark, sf)).groupBy("flight_id").agg(
        F.count_if("alt_step").alias("alt_steps"), F.count_if("pos_step").alias("pos_steps"),
        F.count_if("speed_rise").alias("speed_rises"))


@query("j12_threshold_grid", sql("labelled", """
 SELECT count(*) AS rows, threshold, CAST(count_if(jump_speed > threshold) AS BIGINT) AS flagged
 FROM labelled CROSS JOIN (VALUES (5.0e0), (10.0e0), (15.0e0), (30.0e0), (60.0e0)) g(threshold) GROUP BY threshold"""))
def j12(spark, sf):
    return L.threshold_grid(_rules(spark, sf), F.col("_jump_speed"), [5.0, 10.0, 15.0, 30.0, 60.0])


@query("f01_f03_scalar_functions", sql(None, """
 SELECT flight_id, seq, concat_ws('|', upper(trim(mode)), CAST(seq AS VARCHAR)) AS tag,
   ROUND(greatest(0.0e0, least(1.0e0, score * 2 - 0.5e0)), 6) AS clipped, ROUND(degrees(atan2(sin(score), cos(score))), 6) AS angle,
   ROUND(exp(-score), 6) AS decay, CAST(round_even(score * 10, 0) AS BIGINT) AS half_even,
   strftime(TIMESTAMP '2026-05-01 00:00:00' + to_milliseconds(CAST(round(time_s * 1000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso
 FROM telemetry"""))
def f01(spark, sf):
    s = F.col("score")
    base = 1777593600000
    return telemetry(spark, sf).select(
        *KEY, F.concat_ws("|", F.upper(F.trim("mode")), F.col("seq").cast("string")).alias("tag"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s * 2 - 0.5)), 6).alias("clipped"),
        F.round(F.degrees(F.atan2(F.sin(s), F.cos(s))), 6).alias("angle"), F.round(F.exp(-s), 6).alias("decay"),
        F.bround(s * 10).cast("long").alias("half_even"),
        F.date_format(F.timestamp_millis(F.lit(base) + F.round(F.col("time_s") * 1000).cast("long")),
                      "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))


@query("f05_f06_maps_json_and_defaults", """
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, '{"k":' || regexp_extract(props, '([0-9]+)', 1) || '}' AS again,
  greatest(coalesce(CASE WHEN event_id % 2 = 0 THEN value END, 100.0e0), 5.0e0) AS floor_value FROM events""")
def f05(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    fields = F.from_json("props", "map<string, bigint>")
    return events.select("event_id", F.element_at(fields, "k").alias("k"), F.to_json(fields).alias("again"),
                         F.greatest(F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("value")), F.lit(100.0)), F.lit(5.0)).alias("floor_value"))
