"""Terrain, path, message, scoring and metric queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from flightwatch.operators import messages as M
from flightwatch.operators import metrics as E
from flightwatch.operators import scoring as S
from flightwatch.operators import terrain as T
from flightwatch.operators.path import terrain_segments
from flightwatch.operators.perturb import perturb
from flightwatch.operators.reports import training_summary
from flightwatch.operators.learning import registry_info
from flightwatch.operators.timeline import settled
from flightwatch.plans.catalog import query, r6, raw, sql
from flightwatch.plans.fixture import telemetry

KEY = ["flight_id", "seq"]
_TERRAIN = "CASE WHEN alt_m > 800 THEN 'mountain' WHEN alt_m > 0 THEN 'flat' ELSE 'sea' END"

# Elevations are known for the cells of even rows only.
_ELEVATION_SQL = """
elevations AS (SELECT CAST(round_even(lat_deg * 10000, 0) AS BIGINT) AS lat_key, CAST(round_even(lon_deg * 10000, 0) AS BIGINT) AS lon_key,
    max(CASE WHEN seq < 250 THEN 900.0e0 ELSE 100.0e0 END) AS elevation FROM telemetry WHERE seq % 8 = 0 GROUP BY 1, 2)
"""


def _elevations(t):
    return (t.filter("seq % 8 = 0").groupBy(T.cell(F.col("lat_deg")).alias("lat_key"), T.cell(F.col("lon_deg")).alias("lon_key"))
            .agg(F.max(F.when(F.col("seq") < 250, 900.0).otherwise(100.0)).alias("elevation")))


@query("j05_elevation_lookup", sql(None, """
 SELECT t.flight_id, seq, ROUND(coalesce(e.elevation, t.alt_m, 0.0e0), 6) AS elevation FROM telemetry t LEFT JOIN elevations e
 ON e.lat_key = CAST(round_even(t.lat_deg * 10000, 0) AS BIGINT) AND e.lon_key = CAST(round_even(t.lon_deg * 10000, 0) AS BIGINT)""",
                                   extra=_ELEVATION_SQL))
def j05(spark, sf):
    t = telemetry(spark, sf)
    return T.with_elevation(t, _elevations(t)).select(*KEY, r6("elevation"))


@query("w12_rolling_deviation", sql(None, """
 SELECT flight_id, seq, ROUND(CASE WHEN n >= 5 THEN s ELSE 0.0e0 END, 5) AS alt_std FROM (
   SELECT flight_id, seq, count(*) OVER w AS n, stddev_samp(alt_m + CASE WHEN seq > 240 AND seq < 260 THEN seq * 20 ELSE 0 END) OVER w AS s
   FROM telemetry WINDOW w AS (PARTITION BY flight_id ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""))
def w12(spark, sf):
    t = raw(spark, sf).withColumn("alt_m", F.col("alt_m") + F.when(F.col("seq").between(241, 259), F.col("seq") * 20).otherwise(0))
    return T.rolling_alt_std(t).select(*KEY, F.round("alt_std", 5).alias("alt_std"))


@query("p16_j05_w12_terrain_of_rows", sql(None, """
 SELECT flight_id, seq, CASE WHEN n >= 5 AND s > 50 THEN 'mountain' WHEN elevation > 800 THEN 'mountain' WHEN elevation > 0 THEN 'flat' ELSE 'sea' END AS terrain
 FROM (SELECT t.flight_id, seq, coalesce(e.elevation, t.alt) AS elevation, count(*) OVER w AS n, stddev_samp(t.alt) OVER w AS s
   FROM (SELECT *, alt_m + CASE WHEN seq > 240 AND seq < 260 THEN seq * 20 ELSE 0 END AS alt FROM telemetry) t LEFT JOIN elevations e
   ON e.lat_key = CAST(round_even(t.lat_deg * 10000, 0) AS BIGINT) AND e.lon_key = CAST(round_even(t.lon_deg * 10000, 0) AS BIGINT)
   WINDOW w AS (PARTITION BY t.flight_id ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""", extra=_ELEVATION_SQL))
def terrain_rows(spark, sf):
    t = raw(spark, sf)
    rough = t.withColumn("alt_m", F.col("alt_m") + F.when(F.col("seq").between(241, 259), F.col("seq") * 20).otherwise(0))
    return T.classify_terrain(rough, _elevations(t)).select(*KEY, "terrain")


_STEP_KM = """2 * 6371.0e0 * atan2(sqrt(a), sqrt(1 - a))"""
_PATH_SQL = f"""
steps AS (SELECT *, coalesce(pow(sin(radians(lat_deg - p_lat) / 2), 2)
    + cos(radians(p_lat)) * cos(radians(lat_deg)) * pow(sin(radians(lon_deg - p_lon) / 2), 2), 0.0e0) AS a
  FROM (SELECT *, lag(lat_deg) OVER w AS p_lat, lag(lon_deg) OVER w AS p_lon FROM telemetry WINDOW w AS (PARTITION BY flight_id ORDER BY seq))),
path AS (SELECT *, sum({_STEP_KM}) OVER (PARTITION BY flight_id ORDER BY seq) AS km, {_TERRAIN} AS terrain FROM steps)
"""


@query("w13_path_length", sql(None, " SELECT flight_id, seq, ROUND(km, 6) AS path_km FROM path", extra=_PATH_SQL))
def w13(spark, sf):
    return T.path_length(raw(spark, sf)).select(*KEY, r6("path_km"))


@query("w14_path_segments", sql(None, """
 SELECT g.flight_id, g.segment_id, ROUND(p0.time_s, 6) AS start_time_s, ROUND(p1.time_s, 6) AS end_time_s, ROUND(p0.lat_deg, 8) AS start_lat,
   ROUND(p1.lat_deg, 8) AS end_lat, ROUND(p1.km - p0.km, 4) AS distance_km, g.terrain_type
 FROM (SELECT flight_id, seg AS segment_id, min(a) AS a, max(b) AS b, min_by(terrain, (-n, terrain)) AS terrain_type FROM (
     SELECT p.flight_id, s.seg, p.terrain, count(*) AS n, min(s.a) AS a, max(s.b) AS b FROM pieces s JOIN path p
       ON p.flight_id = s.flight_id AND p.seq BETWEEN s.a AND s.b GROUP BY p.flight_id, s.seg, p.terrain) GROUP BY flight_id, seg) g
 JOIN path p0 ON p0.flight_id = g.flight_id AND p0.seq = g.a JOIN path p1 ON p1.flight_id = g.flight_id AND p1.seq = g.b""",
                                extra=_PATH_SQL + """,
walk(flight_id, seq, seg, start_km, start_seq, closed) AS (
  SELECT flight_id, 0, CAST(0 AS BIGINT), km, CAST(0 AS BIGINT), FALSE FROM path WHERE seq = 0
  UNION ALL
  SELECT w.flight_id, p.seq, CASE WHEN w.closed THEN w.seg + 1 ELSE w.seg END,
    CASE WHEN p.km - w.start_km >= 0.1e0 THEN p.km ELSE w.start_km END,
    CASE WHEN p.km - w.start_km >= 0.1e0 THEN p.seq ELSE w.start_seq END, p.km - w.start_km >= 0.1e0
  FROM walk w JOIN path p ON p.flight_id = w.flight_id AND p.seq = w.seq + 1),
pieces AS (SELECT flight_id, seg, max(seq) AS b, greatest(min(seq) - 1, 0) AS a FROM walk WHERE seq > 0 GROUP BY flight_id, seg)
""", recursive=True))
def w14(spark, sf):
    t = raw(spark, sf).withColumn("terrain", T.terrain_of(F.col("alt_m")))
    return terrain_segments(t, 0.1).select(
        "flight_id", "segment_id", r6("start_time_s"), r6("end_time_s"), F.round("start_lat", 8).alias("start_lat"),
        F.round("end_lat", 8).alias("end_lat"), "distance_km", "terrain_type")


_CALLS = "CASE WHEN seq % 97 < 40 THEN 'flat' WHEN CAST(ROUND(score * 100) AS BIGINT) % 3 = 0 THEN 'sea' WHEN seq % 97 < 70 THEN 'mountain' ELSE 'sea' END"


@query("w18_debounced_terrain", sql(None, f"""
 SELECT flight_id, seq, active, CAST(CASE WHEN active <> lag(active, 1, 'flat') OVER (PARTITION BY flight_id ORDER BY seq) THEN 1 ELSE 0 END AS INTEGER) AS switched
 FROM (SELECT flight_id, seq, coalesce(last_value(CASE WHEN place >= 5 THEN call END IGNORE NULLS) OVER (PARTITION BY flight_id ORDER BY seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'flat') AS active
   FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, grp ORDER BY seq) AS place FROM (
     SELECT *, sum(CASE WHEN call = p THEN 0 ELSE 1 END) OVER (PARTITION BY flight_id ORDER BY seq) AS grp FROM (
       SELECT *, lag(call) OVER (PARTITION BY flight_id ORDER BY seq) AS p FROM (SELECT flight_id, seq, {_CALLS} AS call FROM telemetry)))))"""))
def w18(spark, sf):
    t = raw(spark, sf).withColumn("terrain", F.expr(_CALLS))
    return T.debounce(t).select(*KEY, "active", "switched")


_REGISTRY_SQL = """
registry AS (SELECT * FROM (VALUES ('sea', 'rf', TRUE), ('mountain', 'rf', FALSE), ('global_fallback', 'global_rf', TRUE)) r(terrain, model_type, available))
"""


def _registry(spark):
    return spark.sql("SELECT * FROM VALUES ('sea', 'rf', true), ('mountain', 'rf', false), ('global_fallback', 'global_rf', true) "
                     "AS r(terrain, model_type, available)")


@query("j11_model_routing", sql(None, f"""
 SELECT flight_id, seq, active, 'sea' AS model_terrain, 'rf' AS model_type, CAST(CASE WHEN active = 'sea' THEN 0 ELSE 1 END AS INTEGER) AS is_fallback
 FROM (SELECT *, {_TERRAIN} AS active FROM telemetry)"""))
def j11(spark, sf):
    t = telemetry(spark, sf).withColumn("active", T.terrain_of(F.col("alt_m")))
    return T.with_model(t, _registry(spark)).select(*KEY, "active", "model_terrain", "model_type", "is_fallback")


@query("m12_registry_info", sql(None, """
 SELECT t.active, t.active AS model_terrain, 'rf' AS model_type, 0 AS is_fallback, t.n AS n_training_windows, ROUND(t.f1, 6) AS rf_val_f1
 FROM (SELECT CASE WHEN alt_m > 800 THEN 'mountain' WHEN alt_m > 0 THEN 'flat' ELSE 'sea' END AS active, count(*) AS n, avg(score) AS f1
   FROM telemetry GROUP BY 1) t"""))
def m12(spark, sf):
    table = telemetry(spark, sf).groupBy(T.terrain_of(F.col("alt_m")).alias("terrain")).agg(
        F.count("*").alias("n_train"), F.avg("score").alias("rf_val_f1"))
    registry = table.select("terrain", F.lit("rf").alias("model_type"), F.lit(True).alias("available"),
                            "rf_val_f1", F.lit(None).cast("double").alias("cnn_val_f1"), "n_train")
    # Terrains absent from the data fall back and are left out of the comparison.
    return registry_info(registry).filter("is_fallback = 0").select(
        "active", "model_terrain", "model_type", "is_fallback", "n_training_windows", r6("rf_val_f1"))


@query("a15_default_model", sql(None, f"""
 SELECT terrain, n AS n_windows, CAST(CASE WHEN row_number() OVER (ORDER BY n DESC, rank) = 1 THEN 1 ELSE 0 END AS INTEGER) AS is_default
 FROM (SELECT terrain, count(*) AS n, CASE terrain WHEN 'flat' THEN 0 WHEN 'mountain' THEN 1 ELSE 2 END AS rank
   FROM (SELECT *, {_TERRAIN} AS terrain FROM telemetry) GROUP BY terrain)"""))
def a15(spark, sf):
    counts = telemetry(spark, sf).groupBy(T.terrain_of(F.col("alt_m")).alias("terrain")).agg(F.count("*").alias("n_windows"))
    return training_summary(counts.withColumn("status", F.lit("trained"))).select("terrain", "n_windows", "is_default")


def _walk_sql(first: str, step: str, out: str) -> str:
    return f"""
ema(flight_id, seq, s) AS (
  SELECT flight_id, seq, {first} FROM telemetry WHERE seq = 0
  UNION ALL SELECT e.flight_id, t.seq, {step} FROM ema e JOIN telemetry t ON t.flight_id = e.flight_id AND t.seq = e.seq + 1)"""


@query("w19_smoothed_probability", sql(None, " SELECT flight_id, seq, ROUND(s, 6) AS smoothed FROM ema",
                                       extra=_walk_sql("score", "0.3e0 * t.score + 0.7e0 * e.s", "s"), recursive=True))
def w19(spark, sf):
    return S.smooth(raw(spark, sf), "score").select(*KEY, r6("smoothed"))


@query("w20_live_stale_flag", sql(None, """
 SELECT flight_id, seq, CAST(CASE WHEN lat_deg = p1 AND p1 = p2 THEN 1 ELSE 0 END AS INTEGER) AS live_stale FROM (
   SELECT *, lag(lat_deg) OVER w AS p1, lag(lat_deg, 2) OVER w AS p2 FROM telemetry WINDOW w AS (PARTITION BY flight_id ORDER BY seq))"""))
def w20(spark, sf):
    return S.stale_flag(raw(spark, sf)).select(*KEY, "live_stale")


@query("a09_switches_in_tail", sql(None, """
 SELECT flight_id, CAST(sum(CASE WHEN call <> p THEN 1 ELSE 0 END) AS BIGINT) AS switches FROM (
   SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY seq DESC) AS back FROM (
     SELECT *, lag(call) OVER (PARTITION BY flight_id ORDER BY seq) AS p FROM (
       SELECT flight_id, seq, CASE WHEN score > 0.9e0 THEN 'sea' ELSE 'flat' END AS call FROM telemetry))) WHERE back <= 200 GROUP BY flight_id"""))
def a09(spark, sf):
    t = raw(spark, sf).withColumn("terrain", F.when(F.col("score") > 0.9, "sea").otherwise("flat"))
    return S.switches_in_tail(T.debounce(t, count=1))


@query("w25_trust_decay", sql(None, """
 SELECT flight_id, seq, ROUND(exp(-0.5e0 * sum(CASE WHEN score >= 0.95e0 THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY seq)), 6) AS trust FROM telemetry"""))
def w25(spark, sf):
    t = raw(spark, sf).withColumn("alert", S.alert(F.col("score"), 0.95).cast("int"))
    return S.trust_decay(t, "alert").select(*KEY, r6("trust"))


@query("w26_trust_smooth", sql(None, " SELECT flight_id, seq, ROUND(s, 6) AS trust FROM ema", extra=_walk_sql(
    "0.95e0 * 1.0e0 + 0.05e0 * (1 - 1 / (1 + exp(-(2.0e0 * vel_innov - 1.0e0))))",
    "0.95e0 * e.s + 0.05e0 * (1 - 1 / (1 + exp(-(2.0e0 * t.vel_innov - 1.0e0))))", "s"), recursive=True))
def w26(spark, sf):
    return S.trust_smooth(raw(spark, sf), "vel_innov", k=2.0, theta=1.0).select(*KEY, r6("trust"))


@query("w27_escalation_level", sql(None, """
 SELECT flight_id, seq, CAST(CASE WHEN trust < 0.05e0 AND low05 > 10 THEN 4 WHEN trust < 0.1e0 AND low1 > 5 THEN 3 WHEN trust <= 0.3e0 THEN 2
   WHEN trust <= 0.7e0 THEN 1 ELSE 0 END AS INTEGER) AS level
 FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, i1 ORDER BY seq) AS low1, row_number() OVER (PARTITION BY flight_id, i2 ORDER BY seq) AS low05
   FROM (SELECT *, sum(CASE WHEN trust < 0.1e0 AND p < 0.1e0 THEN 0 ELSE 1 END) OVER (PARTITION BY flight_id ORDER BY seq) AS i1,
                sum(CASE WHEN trust < 0.05e0 AND p < 0.05e0 THEN 0 ELSE 1 END) OVER (PARTITION BY flight_id ORDER BY seq) AS i2
     FROM (SELECT *, lag(trust) OVER (PARTITION BY flight_id ORDER BY seq) AS p FROM (
       SELECT flight_id, seq, CASE WHEN seq % 60 < 25 THEN score ELSE score * 0.09e0 END AS trust FROM telemetry))))"""))
def w27(spark, sf):
    t = raw(spark, sf).withColumn("trust", F.when(F.col("seq") % 60 < 25, F.col("score")).otherwise(F.col("score") * 0.09))
    return S.escalation(t).select(*KEY, "level")


@query("w28_motion_consistency", sql(None, """
 SELECT flight_id, seq, ROUND(sqrt(pow((s - lag(s, 10) OVER w) - (x - lag(x, 10) OVER w), 2)), 7) AS mismatch_m
 FROM (SELECT *, sum(coalesce((v + lag(v) OVER w) / 2 * dt, 0)) OVER w2 AS s FROM (
   SELECT *, sum(coalesce((a + pa) / 2 * dt, 0)) OVER w2 AS v FROM (
     SELECT flight_id, seq, rollspeed_radps AS a, lag(rollspeed_radps) OVER w AS pa, time_s - lag(time_s) OVER w AS dt, vel_innov AS x
     FROM telemetry WINDOW w AS (PARTITION BY flight_id ORDER BY seq))
   WINDOW w2 AS (PARTITION BY flight_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
   WINDOW w AS (PARTITION BY flight_id ORDER BY seq), w2 AS (PARTITION BY flight_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
 WINDOW w AS (PARTITION BY flight_id ORDER BY seq)""".replace(
    "sum(coalesce((v + lag(v) OVER w) / 2 * dt, 0)) OVER w2 AS s FROM (", "sum(ds) OVER w2 AS s FROM (SELECT *, coalesce((v + lag(v) OVER w) / 2 * dt, 0) AS ds FROM (").replace(
    "WINDOW w2 AS (PARTITION BY flight_id ORDER BY seq ROWS UNBOUNDED PRECEDING))\n   WINDOW w AS (PARTITION BY flight_id ORDER BY seq), w2",
    "WINDOW w2 AS (PARTITION BY flight_id ORDER BY seq ROWS UNBOUNDED PRECEDING))\n   WINDOW w AS (PARTITION BY flight_id ORDER BY seq)) WINDOW w2")))
def w28(spark, sf):
    t = raw(spark, sf).withColumns({"ax_mps2": F.col("rollspeed_radps"), "x_m": F.col("vel_innov")})
    return S.motion_consistency(t, axes=(("ax_mps2", "x_m"),)).select(*KEY, F.round("mismatch_m", 7).alias("mismatch_m"))


@query("a24_detection_delay", sql(None, """
 SELECT o.flight_id, ROUND(min(t.time_s) - min(o.a), 6) AS delay_s FROM (SELECT flight_id, min(time_s) AS a FROM telemetry WHERE truth = 1 GROUP BY flight_id) o
 LEFT JOIN telemetry t ON t.flight_id = o.flight_id AND t.time_s >= o.a AND t.score >= 0.9e0 GROUP BY o.flight_id"""))
def a24(spark, sf):
    return S.detection_delay(telemetry(spark, sf), 0.9, "score").select("flight_id", r6("delay_s"))


_PRED = "CAST(CASE WHEN score > 0.55e0 OR (truth = 1 AND seq % 3 > 0) THEN 1 ELSE 0 END AS INTEGER)"
_MATRIX = f"""
matrix AS (SELECT CAST(truth AS INTEGER) AS label, {_PRED} AS prediction, count(*) AS n FROM telemetry GROUP BY 1, 2),
per AS (SELECT c AS class, (SELECT sum(n) FROM matrix WHERE label = c) AS support, (SELECT sum(n) FROM matrix WHERE prediction = c) AS said,
          (SELECT sum(n) FROM matrix WHERE prediction = c AND label = c) AS hits FROM (VALUES (0), (1)) v(c)),
rep AS (SELECT class, CAST(support AS BIGINT) AS support, hits::DOUBLE / said AS p, hits::DOUBLE / support AS r,
          2.0e0 * hits / (said + support) AS f FROM per)
"""


def _matrix(spark, sf):
    t = telemetry(spark, sf).withColumn("prediction", ((F.col("score") > 0.55) | ((F.col("truth") == 1) & (F.col("seq") % 3 > 0))).cast("int"))
    return E.confusion(t, "truth")


@query("a17_confusion_matrix", sql(None, " SELECT * FROM matrix", extra=_MATRIX))
def a17(spark, sf):
    return _matrix(spark, sf)


@query("a18_class_report", sql(None, ' SELECT class, support, ROUND(p, 6) AS "precision", ROUND(r, 6) AS recall, ROUND(f, 6) AS f1 FROM rep', extra=_MATRIX))
def a18(spark, sf):
    return E.class_report(_matrix(spark, sf)).select("class", "support", r6("precision"), r6("recall"), r6("f1"))


@query("a18_a20_overall_report", sql(None, """
 SELECT ROUND(acc, 6) AS accuracy, ROUND(avg(p), 6) AS macro_precision, ROUND(avg(f), 6) AS macro_f1, ROUND(sum(r * support) / sum(support), 6) AS weighted_recall,
   ROUND((acc - chance) / (1 - chance), 6) AS kappa
 FROM rep, (SELECT sum(CASE WHEN label = prediction THEN n ELSE 0 END)::DOUBLE / sum(n) AS acc FROM matrix),
   (SELECT sum(support::DOUBLE * said) / pow(sum(support), 2) AS chance FROM per) GROUP BY acc, chance""", extra=_MATRIX))
def a18_all(spark, sf):
    return E.overall_report(_matrix(spark, sf)).select(
        r6("accuracy"), r6("macro_precision"), r6("macro_f1"), r6("weighted_recall"), r6("kappa"))


_ROC = """
pts AS (SELECT s, sum(p) OVER w AS tp, sum(q) OVER w AS fp, p, q FROM (
   SELECT ROUND(score * 0.7e0 + value, 9) AS s, sum(truth) AS p, sum(1 - truth) AS q
   FROM (SELECT score, CASE WHEN truth = 1 THEN 0.1e0 ELSE 0.0e0 END AS value, truth FROM telemetry) GROUP BY 1) WINDOW w AS (ORDER BY s DESC))
"""


def _roc(spark, sf):
    t = telemetry(spark, sf).withColumn("s", F.round(F.col("score") * 0.7 + F.when(F.col("truth") == 1, 0.1).otherwise(0.0), 9))
    return E.roc_points(t, "s", "truth")


@query("a19_roc_points", sql(None, " SELECT ROUND(s, 6) AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM pts", extra=_ROC))
def a19(spark, sf):
    return _roc(spark, sf).select(r6("score"), "tp", "fp")


@query("a19_a20_areas", sql(None, """
 SELECT ROUND(sum(q * (2 * tp - p) / 2.0e0) / (sum(p) * sum(q)), 6) AS auc, ROUND(sum(p * tp::DOUBLE / (tp + fp)) / sum(p), 6) AS average_precision FROM pts""", extra=_ROC))
def a19_area(spark, sf):
    return E.ranking_report(_roc(spark, sf)).select(r6("auc"), r6("average_precision"))


# Nine of ten scores lie between 0.01 and 0.011.
_CROWDED_SCORE = "CASE WHEN seq % 10 < 9 THEN 0.01e0 + seq * 0.000002e0 + flight_id % 7 * 0.0000001e0 ELSE score END"
_CROWDED = f"""
pts AS (SELECT s, sum(p) OVER w AS tp, sum(q) OVER w AS fp, p, q FROM (
   SELECT ROUND({_CROWDED_SCORE}, 9) AS s, sum(truth) AS p, sum(1 - truth) AS q FROM telemetry GROUP BY 1) WINDOW w AS (ORDER BY s DESC))
"""


@query("a19_crowded_scores", sql(None, " SELECT ROUND(s, 9) AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM pts", extra=_CROWDED))
def a19_crowded(spark, sf):
    return E.roc_points(telemetry(spark, sf).withColumn("s", F.round(F.expr(_CROWDED_SCORE), 9)), "s", "truth").select(
        F.round("score", 9).alias("score"), "tp", "fp")


@query("a25_detection_sweep", sql(None, """
 SELECT profile, intensity, count(*) AS rows, ROUND(avg(CASE WHEN abs(lat_deg - moved) * 111000.0e0 > 15 THEN 1.0e0 ELSE 0.0e0 END), 6) AS detection_rate
 FROM (SELECT t.lat_deg, profile, intensity, t.lat_deg + degrees(CASE WHEN profile = 'drift' THEN intensity * 0.1e0 * (ROUND((time_s - 10.0e0) / 0.1e0) + 1) ELSE intensity END / 6371000.0e0) AS moved
   FROM telemetry t CROSS JOIN (VALUES ('drift', 1.0e0), ('drift', 4.0e0), ('teleport', 10.0e0), ('teleport', 40.0e0)) p(profile, intensity)
   WHERE time_s >= 10.0e0 AND time_s < 20.0e0) GROUP BY profile, intensity"""))
def a25(spark, sf):
    t = telemetry(spark, sf).withColumn("true_lat", F.col("lat_deg"))
    moved = perturb(t, [("drift", 1.0), ("drift", 4.0), ("teleport", 10.0), ("teleport", 40.0)], 10.0, 10.0).filter("label = 1")
    judged = moved.withColumn("alert", F.abs(F.col("true_lat") - F.col("lat_deg")) * 111000.0 > 15)
    return E.detection_rates(judged).select("profile", "intensity", "rows", r6("detection_rate"))


# Four message types at different rates, raw units, one base instant.
_MESSAGES_SQL = """
msgs AS (
  SELECT flight_id, TIMESTAMP '2026-05-01 00:00:00' + to_milliseconds(seq * 100) AS ts, msg_type,
    CASE WHEN msg_type = 'GLOBAL_POSITION_INT' THEN ROUND(lat_deg * 1e7) END AS lat, CASE WHEN msg_type = 'GLOBAL_POSITION_INT' THEN ROUND(vel_m_s * 100) END AS vx,
    CASE WHEN msg_type = 'GPS_RAW_INT' THEN CASE WHEN satellites_visible = 4 THEN 255 ELSE satellites_visible END END AS satellites_visible,
    CASE WHEN msg_type = 'GPS_RAW_INT' THEN CASE WHEN eph_m > 5 THEN 65535.0e0 ELSE ROUND(eph_m * 100) END END AS eph,
    CASE WHEN msg_type = 'ATTITUDE' THEN rollspeed_radps END AS rollspeed, CASE WHEN msg_type = 'HEARTBEAT' THEN armed * 128 + 1 END AS base_mode,
    CASE WHEN msg_type = 'GLOBAL_POSITION_INT' THEN CASE WHEN seq % 11 = 0 THEN 65535 ELSE seq END END AS hdg
  FROM telemetry JOIN (VALUES ('GLOBAL_POSITION_INT', 1), ('GPS_RAW_INT', 2), ('ATTITUDE', 5), ('HEARTBEAT', 10)) m(msg_type, every) ON seq % every = 0)
"""


def _messages(spark, sf):
    t = telemetry(spark, sf)
    kinds = F.array(*[F.struct(F.lit(n).alias("msg_type"), F.lit(e).alias("every")) for n, e in
                      (("GLOBAL_POSITION_INT", 1), ("GPS_RAW_INT", 2), ("ATTITUDE", 5), ("HEARTBEAT", 10))])
    m = t.withColumn("_k", F.explode(kinds)).filter("seq % _k.every = 0").withColumn("msg_type", F.col("_k.msg_type"))
    when = lambda kind, value: F.when(F.col("msg_type") == kind, value)
    p = "GLOBAL_POSITION_INT"
    null = F.lit(None).cast("double")
    return m.select(
        "flight_id", F.timestamp_millis(F.lit(1777593600000) + F.col("seq") * 100).alias("ts"), "msg_type",
        when(p, F.round(F.col("lat_deg") * 1e7)).alias("lat"), when(p, F.round(F.col("lon_deg") * 1e7)).alias("lon"),
        when(p, F.round(F.col("alt_m") * 1000)).alias("alt"), when(p, F.round(F.col("rel_alt_m") * 1000)).alias("relative_alt"),
        when(p, F.round(F.col("vel_m_s") * 100)).alias("vx"), when(p, F.lit(0.0)).alias("vy"), when(p, F.lit(0.0)).alias("vz"),
        when(p, F.when(F.col("seq") % 11 == 0, 65535).otherwise(F.col("seq"))).alias("hdg"),
        when("GPS_RAW_INT", F.when(F.col("satellites_visible") == 4, 255).otherwise(F.col("satellites_visible"))).alias("satellites_visible"),
        when("GPS_RAW_INT", F.when(F.col("eph_m") > 5, 65535.0).otherwise(F.round(F.col("eph_m") * 100))).alias("eph"),
        when("ATTITUDE", F.col("rollspeed_radps")).alias("rollspeed"), when("HEARTBEAT", F.col("armed") * 128 + 1).alias("base_mode"),
        null.alias("epv"))


@query("p18_p21_scaled_messages", sql(None, """
 SELECT flight_id, CAST(epoch_ms(ts) AS BIGINT) AS ms, msg_type, ROUND(lat / 1e7, 7) AS lat_deg, ROUND(vx / 100.0e0, 6) AS vel_m_s,
   ROUND(CASE WHEN hdg <> 65535 THEN hdg / 100.0e0 END, 6) AS hdg_deg, CAST(CASE WHEN satellites_visible <> 255 THEN satellites_visible END AS DOUBLE) AS satellites_visible,
   ROUND(CASE WHEN eph <> 65535 THEN eph / 100.0e0 END, 6) AS eph_m, CAST(CASE WHEN base_mode & 128 > 0 THEN 1 WHEN base_mode IS NOT NULL THEN 0 END AS INTEGER) AS armed FROM msgs""",
                                      extra=_MESSAGES_SQL))
def p18(spark, sf):
    return M.scaled_messages(_messages(spark, sf)).select(
        "flight_id", F.unix_millis("ts").alias("ms"), "msg_type", F.round("lat_deg", 7).alias("lat_deg"), r6("vel_m_s"), r6("hdg_deg"),
        "satellites_visible", r6("eph_m"), "armed")


@query("j06_p22_hold_last", sql(None, """
 SELECT p.flight_id, CAST(epoch_ms(p.ts) AS BIGINT) AS ms, ROUND(p.lat / 1e7, 7) AS lat_deg, CAST(CASE WHEN q.satellites_visible <> 255 THEN q.satellites_visible END AS DOUBLE) AS satellites_visible,
   ROUND(CASE WHEN q.eph <> 65535 THEN q.eph / 100.0e0 END, 6) AS eph_m, ROUND(a.rollspeed, 6) AS rollspeed_radps,
   CAST(CASE WHEN h.base_mode & 128 > 0 THEN 1 ELSE 0 END AS INTEGER) AS armed, ROUND(g.hdg / 100.0e0, 6) AS hdg_deg
 FROM (SELECT * FROM msgs WHERE msg_type = 'GLOBAL_POSITION_INT') p
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'GPS_RAW_INT') q ON q.flight_id = p.flight_id AND p.ts >= q.ts
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'ATTITUDE') a ON a.flight_id = p.flight_id AND p.ts >= a.ts
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'HEARTBEAT') h ON h.flight_id = p.flight_id AND p.ts >= h.ts
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'GLOBAL_POSITION_INT' AND hdg <> 65535) g ON g.flight_id = p.flight_id AND p.ts >= g.ts""", extra=_MESSAGES_SQL))
def j06(spark, sf):
    return M.hold_last(M.scaled_messages(settled(_messages(spark, sf)))).select(
        "flight_id", F.unix_millis("ts").alias("ms"), F.round("lat_deg", 7).alias("lat_deg"), "satellites_visible", r6("eph_m"),
        r6("rollspeed_radps"), "armed", r6("hdg_deg"))


@query("t02_t11_resampled_rows", sql(None, """
 SELECT g.flight_id, ROUND(g.i * 0.25e0, 3) AS time_s, ROUND(p.lat / 1e7, 7) AS lat_deg, ROUND(a.rollspeed, 6) AS rollspeed_radps,
   CAST(CASE WHEN epoch_ms(g.ts) - epoch_ms(p.ts) > 50 THEN 1 ELSE 0 END AS INTEGER) AS stale
 FROM (SELECT flight_id, i, a + to_milliseconds(i * 250) AS ts FROM (SELECT flight_id, min(ts) AS a, max(ts) AS b FROM msgs GROUP BY flight_id), range(0, 1000) r(i)
       WHERE a + to_milliseconds(i * 250) <= b) g
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'GLOBAL_POSITION_INT') p ON p.flight_id = g.flight_id AND g.ts >= p.ts
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'ATTITUDE') a ON a.flight_id = g.flight_id AND g.ts >= a.ts""", extra=_MESSAGES_SQL))
def t02(spark, sf):
    return M.resample(settled(_messages(spark, sf)), hz=4.0, max_age_s=0.05).select(
        "flight_id", "time_s", F.round("lat_deg", 7).alias("lat_deg"), r6("rollspeed_radps"), "stale")


@query("t11_interpolated_fixes", sql(None, """
 SELECT g.flight_id, CAST(epoch_ms(g.ts) AS BIGINT) AS ms, ROUND(CASE WHEN n.lat IS NULL OR epoch_ms(g.ts) - epoch_ms(p.ts) <= 50 THEN p.lat / 1e7
   ELSE p.lat / 1e7 + (epoch_ms(g.ts) - epoch_ms(p.ts))::DOUBLE / (epoch_ms(n.ts) - epoch_ms(p.ts)) * (n.lat / 1e7 - p.lat / 1e7) END, 7) AS lat_deg
 FROM (SELECT DISTINCT flight_id, ts + to_milliseconds(70) AS ts FROM msgs) g
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'GLOBAL_POSITION_INT') p ON p.flight_id = g.flight_id AND g.ts >= p.ts
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'GLOBAL_POSITION_INT') n ON n.flight_id = g.flight_id AND g.ts < n.ts""", extra=_MESSAGES_SQL))
def t11(spark, sf):
    m = settled(_messages(spark, sf))
    at = m.select("flight_id", (F.col("ts") + F.expr("INTERVAL 70 MILLISECONDS")).alias("ts")).distinct()
    return M.interpolated_fixes(m, at).select("flight_id", F.unix_millis("ts").alias("ms"), F.round("lat_deg", 7).alias("lat_deg"))


@query("p20_p23_message_features", sql(None, """
 SELECT p.flight_id, CAST(epoch_ms(p.ts) AS BIGINT) AS ms, ROUND(radians(p.lat / 1e7 - p.lat0 / 1e7) * 6371000.0e0, 4) AS x_m,
   ROUND(p.vx / 100.0e0, 6) AS vel_m_s, CAST(coalesce(CASE WHEN q.satellites_visible <> 255 THEN q.satellites_visible END, 10) AS DOUBLE) AS satellites_visible,
   ROUND(coalesce(CASE WHEN q.eph <> 65535 THEN q.eph / 100.0e0 END, 0), 6) AS eph_m, ROUND(a.rollspeed, 6) AS rollspeed_radps,
   CAST(CASE WHEN h.base_mode & 128 > 0 THEN 1 ELSE 0 END AS DOUBLE) AS armed, ROUND(coalesce(g.hdg / 100.0e0, 0), 6) AS hdg_deg,
   CAST(CASE WHEN p.lat = p.lat1 AND p.lat1 = p.lat2 THEN 1 ELSE 0 END AS DOUBLE) AS is_stale_repeat, 1.0e0 AS connection_ok, 0.0e0 AS vibration_z
 FROM (SELECT *, first_value(lat) OVER w AS lat0, lag(lat) OVER w AS lat1, lag(lat, 2) OVER w AS lat2 FROM msgs WHERE msg_type = 'GLOBAL_POSITION_INT'
       WINDOW w AS (PARTITION BY flight_id ORDER BY ts)) p
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'GPS_RAW_INT') q ON q.flight_id = p.flight_id AND p.ts >= q.ts
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'ATTITUDE') a ON a.flight_id = p.flight_id AND p.ts >= a.ts
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'HEARTBEAT') h ON h.flight_id = p.flight_id AND p.ts >= h.ts
 ASOF LEFT JOIN (SELECT * FROM msgs WHERE msg_type = 'GLOBAL_POSITION_INT' AND hdg <> 65535) g ON g.flight_id = p.flight_id AND p.ts >= g.ts""",
                                       extra=_MESSAGES_SQL))
def p23(spark, sf):
    return M.message_features(settled(_messages(spark, sf))).select(
        "flight_id", F.unix_millis("ts").alias("ms"), F.round("x_m", 4).alias("x_m"), r6("vel_m_s"), "satellites_visible", r6("eph_m"),
        r6("rollspeed_radps"), "armed", r6("hdg_deg"), "is_stale_repeat", "connection_ok", "vibration_z")


@query("a16_message_counts", sql(None, """
 SELECT CAST(epoch_ms(time_bucket(INTERVAL 5 SECONDS, ts)) AS BIGINT) AS ms, msg_type, count(*) AS n FROM msgs GROUP BY 1, 2""", extra=_MESSAGES_SQL))
def a16(spark, sf):
    return M.message_counts(_messages(spark, sf)).select(F.unix_millis("window_start").alias("ms"), "msg_type", "n")
