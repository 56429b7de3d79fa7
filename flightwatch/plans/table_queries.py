"""Segments, joins, aggregates, windows, splits and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightwatch.operators import quality as Q
from flightwatch.operators import reports as R
from flightwatch.operators import segments as S
from flightwatch.operators import windows as W
from flightwatch.operators.learning import feature_statistics, scale_rows
from flightwatch.operators.scoring import last_rows
from flightwatch.operators.terrain import majority, terrain_of, terrain_shares
from flightwatch.operators.timeline import settled
from flightwatch.plans.catalog import cleaned, labelled, labelling, query, r6, raw, sql
from flightwatch.plans.fixture import telemetry

KEY = ["flight_id", "seq"]


def _label_file(t):
    return t.filter("seq % 7 <> 0").select("flight_id", "time_s", F.col("truth").alias("label"))


# Bounds are written as the same products the time column is made of.
_SEGMENTS_SQL = """
segs AS (
  SELECT DISTINCT flight_id, 0.0e0 AS start_s, CASE WHEN flight_id % 2 = 1 THEN 200*0.1e0 ELSE 60.0e0 END AS end_s, '0' AS label, 'normal' AS reason FROM telemetry
  UNION ALL SELECT DISTINCT flight_id, 200*0.1e0, 261*0.1e0, '1', 'gps_spoof_synthetic' FROM telemetry WHERE flight_id % 2 = 1
  UNION ALL SELECT DISTINCT flight_id, 261*0.1e0, 60.0e0, '0', 'normal' FROM telemetry WHERE flight_id % 2 = 1)
"""


def _segments(t):
    seg = lambda a, b, v, r: F.struct(a.alias("start_s"), b.alias("end_s"), F.lit(v).alias("label"), F.lit(r).alias("reason"))
    tenth = lambda n: F.lit(n) * F.lit(0.1)
    zero, end = F.lit(0.0), F.lit(60.0)
    odd = F.array(seg(zero, tenth(200), "0", "normal"), seg(tenth(200), tenth(261), "1", "gps_spoof_synthetic"),
                  seg(tenth(261), end, "0", "normal"))
    flights = t.select("flight_id").distinct()
    return flights.select("flight_id", F.inline(
        F.when(F.col("flight_id") % 2 == 1, odd).otherwise(F.array(seg(zero, end, "0", "normal")))))


@query("w11_segments", sql("labelled", """
 SELECT flight_id, ROUND(min(time_s), 6) AS start_s,
   ROUND(coalesce(lead(min(time_s)) OVER (PARTITION BY flight_id ORDER BY min(time_s)), max(last_s)), 6) AS end_s, label
 FROM (SELECT *, sum(CASE WHEN label = p THEN 0 ELSE 1 END) OVER (PARTITION BY flight_id ORDER BY time_s) AS grp
       FROM (SELECT *, lag(label) OVER (PARTITION BY flight_id ORDER BY time_s) AS p,
                    max(time_s) OVER (PARTITION BY flight_id) AS last_s FROM labelled))
 GROUP BY flight_id, grp, label"""))
def w11(spark, sf):
    return S.segments(labelled(spark, sf)).select("flight_id", r6("start_s"), r6("end_s"), "label")


@query("j01_label_file_join", sql("cleaned", """
 SELECT c.flight_id, c.seq, CAST(coalesce(l.label, 0) AS INTEGER) AS label FROM cleaned c LEFT JOIN (
   SELECT flight_id, time_s, truth AS label FROM telemetry WHERE seq % 7 <> 0) l
 ON c.flight_id = l.flight_id AND c.time_s = l.time_s"""))
def j01(spark, sf):
    t = raw(spark, sf)
    from flightwatch.operators.clean import clean
    return S.attach_labels(clean(t, tie=["seq"]), _label_file(t)).select(*KEY, "label")


for _closed, _op in (("left", "<"), ("both", "<=")):
    @query(f"j0{2 if _closed == 'left' else 3}_interval_labels_{_closed}", sql(None, f"""
 SELECT t.flight_id, seq, CAST(coalesce(max_by(CAST(s.label AS INTEGER), s.start_s), 0) AS INTEGER) AS label
 FROM telemetry t LEFT JOIN segs s ON t.flight_id = s.flight_id AND t.time_s >= s.start_s AND t.time_s {_op} s.end_s
 GROUP BY t.flight_id, seq""", extra=_SEGMENTS_SQL))
    def interval(spark, sf, closed=_closed):
        t = telemetry(spark, sf)
        return S.labels_from_segments(t, _segments(t), closed=closed).select(*KEY, "label")


@query("j04_a11_windows_with_rows", sql("windows", """
 SELECT flight_id, win, mode AS dominant_mode, failsafe, armed FROM (
   SELECT *, row_number() OVER (PARTITION BY flight_id, win ORDER BY n DESC, mode) AS pick,
     max(f) OVER (PARTITION BY flight_id, win) AS failsafe, max(a) OVER (PARTITION BY flight_id, win) AS armed
   FROM (SELECT w.flight_id, w.win, c.mode, count(*) AS n, max(c.failsafe) AS f, max(c.armed) AS a
         FROM windows w JOIN cleaned c ON c.flight_id = w.flight_id AND c.time_s BETWEEN w.start_s AND w.end_s
         GROUP BY w.flight_id, w.win, c.mode)) WHERE pick = 1"""))
def j04(spark, sf):
    rows = labelled(spark, sf)
    windows = W.window_labels(W.sliding_windows(rows))
    return S.windows_with_rows(windows, rows).select("flight_id", "win", "dominant_mode", "failsafe", "armed")


@query("j07_label_sources", sql(None, """
 SELECT t.flight_id, t.seq,
   CAST(CASE WHEN f.label IS NOT NULL AND fc.n = tc.n THEN f.label WHEN hs.flight_id IS NOT NULL THEN coalesce(x.label, 0)
        ELSE coalesce(sh.label, 0) END AS INTEGER) AS label,
   CASE WHEN f.label IS NOT NULL AND fc.n = tc.n THEN 'file' WHEN hs.flight_id IS NOT NULL THEN 'segments' ELSE 'shared' END AS label_source
 FROM telemetry t JOIN (SELECT flight_id, count(*) AS n FROM telemetry GROUP BY flight_id) tc ON t.flight_id = tc.flight_id
 LEFT JOIN files f ON f.flight_id = t.flight_id AND f.seq = t.seq
 LEFT JOIN (SELECT flight_id, count(*) AS n FROM files GROUP BY flight_id) fc ON fc.flight_id = t.flight_id
 LEFT JOIN (SELECT DISTINCT flight_id FROM segs WHERE flight_id % 4 = 1) hs ON hs.flight_id = t.flight_id
 LEFT JOIN (SELECT t.flight_id, t.seq, max_by(CAST(s.label AS INTEGER), s.start_s) AS label FROM telemetry t JOIN segs s
            ON s.flight_id % 4 = 1 AND t.flight_id = s.flight_id AND t.time_s >= s.start_s AND t.time_s < s.end_s GROUP BY 1, 2) x
   ON x.flight_id = t.flight_id AND x.seq = t.seq
 LEFT JOIN (SELECT flight_id, seq, CASE WHEN time_s >= 5.0e0 AND time_s < 8.0e0 THEN 1 ELSE 0 END AS label FROM telemetry) sh
   ON sh.flight_id = t.flight_id AND sh.seq = t.seq""", extra=_SEGMENTS_SQL + """,
files AS (SELECT flight_id, seq, truth AS label FROM telemetry WHERE flight_id % 3 = 0 OR (flight_id % 3 = 1 AND seq % 2 = 0))"""))
def j07(spark, sf):
    t = raw(spark, sf)
    files = (t.filter("flight_id % 3 = 0 OR (flight_id % 3 = 1 AND seq % 2 = 0)")
             .select("flight_id", "time_s", F.col("truth").alias("label")))
    shared = spark.sql("SELECT 5.0D AS start_s, 8.0D AS end_s, '1' AS label UNION ALL SELECT 8.0D, 60.0D, '0'")
    return S.resolve_labels(t, files, _segments(t).filter("flight_id % 4 = 1"), shared).select(*KEY, "label", "label_source")


@query("j08_labelled_flights", sql(None, """
 SELECT flight_id, seq FROM telemetry WHERE flight_id IN (SELECT flight_id FROM telemetry WHERE truth = 1)"""))
def j08(spark, sf):
    t = telemetry(spark, sf)
    return S.labelled_flights(t, t.filter("truth = 1")).select(*KEY)


@query("j09_u04_flights_without_segments", sql(None, """
 SELECT DISTINCT flight_id FROM telemetry WHERE flight_id NOT IN (SELECT flight_id FROM telemetry WHERE truth = 1)"""))
def j09(spark, sf):
    t = telemetry(spark, sf)
    return S.flights_without(t, t.filter("truth = 1"))


@query("j10_substring_names", sql(None, """
 SELECT s.stem, n.log_name FROM (SELECT DISTINCT 'f' || flight_id AS stem FROM telemetry) s
 JOIN (SELECT DISTINCT 'run_f' || flight_id || CASE WHEN flight_id % 2 = 0 THEN '_b' ELSE '' END AS log_name FROM telemetry) n
 ON contains(n.log_name, s.stem)"""))
def j10(spark, sf):
    flights = telemetry(spark, sf).select("flight_id").distinct()
    stems = flights.select(F.concat(F.lit("f"), "flight_id").alias("stem"))
    names = flights.select(F.concat(F.lit("run_f"), "flight_id", F.when(F.col("flight_id") % 2 == 0, "_b").otherwise(""))
                           .alias("log_name"))
    return S.stems_in_names(stems, names)


@query("a01_cleaning_report", sql("cleaned", """
 SELECT r.flight_id, r.n AS initial_rows, coalesce(c.n, 0) AS final_rows, r.n - coalesce(c.n, 0) AS rows_removed,
   ROUND(c.a, 6) AS time_start_s, ROUND(c.b, 6) AS time_end_s, ROUND(c.b - c.a, 6) AS duration_s,
   coalesce(c.null_dt, 0) AS null_dt, coalesce(c.null_mode, 0) AS null_mode
 FROM (SELECT flight_id, count(*) AS n FROM telemetry GROUP BY flight_id) r LEFT JOIN (
   SELECT flight_id, count(*) AS n, min(time_s) AS a, max(time_s) AS b, CAST(count_if(dt IS NULL) AS BIGINT) AS null_dt,
          CAST(count_if(mode IS NULL) AS BIGINT) AS null_mode FROM cleaned GROUP BY flight_id) c ON r.flight_id = c.flight_id"""))
def a01(spark, sf):
    t = raw(spark, sf)
    from flightwatch.operators.clean import clean
    missing = F.col("missing_after_cleaning")
    return R.cleaning_report(t, settled(clean(t, tie=["seq"]))).select(
        "flight_id", "initial_rows", "final_rows", "rows_removed", r6("time_start_s"), r6("time_end_s"), r6("duration_s"),
        F.coalesce(missing["dt"], F.lit(0)).alias("null_dt"), F.coalesce(missing["mode"], F.lit(0)).alias("null_mode"))


@query("a02_value_counts", sql("cleaned", """
 SELECT flight_id, 'mode' AS "column", mode AS value, count(*) AS n FROM cleaned GROUP BY flight_id, mode
 UNION ALL SELECT flight_id, 'failsafe', CAST(failsafe AS VARCHAR), count(*) FROM cleaned GROUP BY flight_id, failsafe
 UNION ALL SELECT flight_id, 'armed', CAST(armed AS VARCHAR), count(*) FROM cleaned GROUP BY flight_id, armed"""))
def a02(spark, sf):
    return R.value_counts(cleaned(spark, sf))


@query("a03_label_distribution", sql("labelled", """
 SELECT flight_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS anomalies, ROUND(avg(label) * 100, 6) AS anomaly_pct
 FROM labelled GROUP BY flight_id"""))
def a03(spark, sf):
    return R.anomaly_share(labelling(spark, sf)).select("flight_id", "n", "anomalies", r6("anomaly_pct"))


_SPLIT = """
ordered AS (SELECT *, row_number() OVER (ORDER BY flight_id, win) - 1 AS ordinal, count(*) OVER () AS total FROM windows),
split AS (SELECT *, CASE WHEN ordinal < FLOOR(0.7e0 * total) THEN 'train'
   WHEN ordinal < FLOOR(0.7e0 * total) + FLOOR(0.15e0 * total) THEN 'val' ELSE 'test' END AS split FROM ordered)
"""


@query("a05_w22_dataset_info", sql("windows", """
 SELECT split, count(*) AS n, ROUND(min_by(start_s, ordinal), 6) AS first_start_s, ROUND(max_by(end_s, ordinal), 6) AS last_end_s,
   CAST(count_if(label = 0) AS BIGINT) AS label_0, CAST(count_if(label = 1) AS BIGINT) AS label_1 FROM split GROUP BY split""", extra=_SPLIT))
def a05(spark, sf):
    windows = settled(W.window_labels(W.sliding_windows(labelling(spark, sf))))
    return R.dataset_info(W.chronological_split(windows)).select(
        "split", "n", r6("first_start_s"), r6("last_end_s"), "label_0", "label_1")


@query("w22_chronological_split", sql("windows", " SELECT flight_id, win, ordinal, split FROM split", extra=_SPLIT))
def w22(spark, sf):
    windows = settled(W.window_labels(W.sliding_windows(labelling(spark, sf))))
    return W.chronological_split(windows).select("flight_id", "win", "ordinal", "split")


@query("w23_flight_isolated_split", sql(None, """
 SELECT flight_id, CAST(1 AS BIGINT) AS splits, CASE WHEN u < 0.7e0 THEN 'train' WHEN u < 0.85e0 THEN 'val' ELSE 'test' END AS split, n_rows FROM (
   SELECT flight_id, CAST('0x' || substr(md5(CAST(flight_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0e0 AS u, count(*) AS n_rows FROM telemetry GROUP BY 1)"""))
def w23(spark, sf):
    return W.flight_split(telemetry(spark, sf)).groupBy("flight_id").agg(
        F.countDistinct("split").alias("splits"), F.min("split").alias("split"), F.count(F.lit(1)).alias("n_rows"))


_TERRAIN = "CASE WHEN alt_m > 800 THEN 'mountain' WHEN alt_m > 0 THEN 'flat' ELSE 'sea' END"


def _terrain_rows(spark, sf):
    return telemetry(spark, sf).withColumn("terrain", terrain_of(F.col("alt_m")))


@query("a06_majority_terrain", sql(None, f"""
 SELECT flight_id, terrain FROM (SELECT flight_id, terrain, row_number() OVER (PARTITION BY flight_id ORDER BY count(*) DESC, terrain) AS pick
   FROM (SELECT *, {_TERRAIN} AS terrain FROM telemetry) GROUP BY flight_id, terrain) WHERE pick = 1"""))
def a06(spark, sf):
    return majority(_terrain_rows(spark, sf), "terrain")


@query("a06_majority_mode_with_ties", sql(None, """
 SELECT seq, mode FROM (SELECT seq, mode, row_number() OVER (PARTITION BY seq ORDER BY count(*) DESC, mode) AS pick
   FROM telemetry WHERE mode IS NOT NULL GROUP BY seq, mode) WHERE pick = 1"""))
def a06_ties(spark, sf):
    return majority(telemetry(spark, sf), "mode", keys=["seq"])


@query("a07_terrain_shares", sql(None, f"""
 SELECT terrain, count(*) AS n, ROUND(count(*) * 100.0e0 / sum(count(*)) OVER (), 6) AS pct
 FROM (SELECT *, {_TERRAIN} AS terrain FROM telemetry) GROUP BY terrain"""))
def a07(spark, sf):
    return terrain_shares(_terrain_rows(spark, sf)).select("terrain", "n", r6("pct"))


@query("a08_probability_by_terrain", sql(None, f"""
 SELECT terrain, ROUND(avg(score), 6) AS mean_anom_proba FROM (SELECT *, {_TERRAIN} AS terrain FROM telemetry) GROUP BY terrain"""))
def a08(spark, sf):
    return R.probability_by_terrain(_terrain_rows(spark, sf), "score").select("terrain", r6("mean_anom_proba"))


@query("a10_probability_by_class", sql(None, """
 SELECT CAST(truth AS INTEGER) AS label, count(*) AS windows, ROUND(avg(score), 6) AS mean_proba FROM telemetry GROUP BY truth"""))
def a10(spark, sf):
    return R.probability_by_class(telemetry(spark, sf), "score", "truth").select("label", "windows", r6("mean_proba"))


@query("a12_window_medians", sql("members", """
 SELECT flight_id, win, ROUND(median(lat_deg), 8) AS lat_med, ROUND(median(lon_deg), 9) AS lon_med, ROUND(median(alt_m), 6) AS alt_med
 FROM members GROUP BY flight_id, win"""))
def a12(spark, sf):
    m = W.sliding_windows(labelling(spark, sf))
    return m.groupBy("flight_id", "win").agg(F.round(F.median("lat_deg"), 8).alias("lat_med"),
                                             F.round(F.median("lon_deg"), 9).alias("lon_med"),
                                             F.round(F.median("alt_m"), 6).alias("alt_med"))


@query("a13_windows_per_flight", sql("windows", """
 SELECT flight_id, count(*) AS windows, CAST(sum(label) AS BIGINT) AS positive, ROUND(avg(label), 6) AS positive_share
 FROM windows GROUP BY flight_id"""))
def a13(spark, sf):
    windows = W.window_labels(W.sliding_windows(labelling(spark, sf)))
    return windows.groupBy("flight_id").agg(
        F.count("*").alias("windows"), F.sum("label").alias("positive"), F.round(F.avg("label"), 6).alias("positive_share"))


@query("a14_w15_w17_windows_inclusive", sql("members", """
 SELECT flight_id, win, ROUND(min(time_s), 6) AS start_s, ROUND(max(time_s), 6) AS end_s,
   ROUND(max(CASE WHEN pos = 15 THEN time_s END), 6) AS centre_s,
   CAST(CASE WHEN avg(label) >= 0.5e0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM members GROUP BY flight_id, win""",
                                             stale_run=2, failsafe=True))
def a14(spark, sf):
    rows = labelling(spark, sf, stale_run=2, failsafe_is_anomaly=True)
    return W.window_labels(W.sliding_windows(rows), inclusive=True).select(
        "flight_id", "win", r6("start_s"), r6("end_s"), r6("centre_s"), "label")


@query("a22_attack_interval", sql(None, """
 SELECT flight_id, ROUND(min(time_s), 6) AS attack_start_s, ROUND(max(time_s), 6) AS attack_end_s FROM telemetry WHERE truth = 1 GROUP BY flight_id"""))
def a22(spark, sf):
    return R.attack_interval(telemetry(spark, sf), "truth").select("flight_id", r6("attack_start_s"), r6("attack_end_s"))


@query("a01_dropped_positives", sql("cleaned", """
 SELECT t.flight_id, CAST(count_if(t.truth = 1) AS BIGINT) AS positives_in,
   CAST(count_if(t.truth = 1) AS BIGINT) - CAST(count_if(c.truth = 1) AS BIGINT) AS positives_dropped
 FROM telemetry t LEFT JOIN cleaned c ON t.flight_id = c.flight_id AND t.seq = c.seq GROUP BY t.flight_id"""))
def a01_dropped(spark, sf):
    t = raw(spark, sf)
    from flightwatch.operators.clean import clean
    return R.dropped_positives(t, clean(t, tie=["seq"]), "truth").select("flight_id", "positives_in", "positives_dropped")


@query("w15_window_members", sql("members", " SELECT flight_id, win, pos, seq FROM members"))
def w15(spark, sf):
    return W.sliding_windows(labelling(spark, sf)).select("flight_id", "win", "pos", "seq")


@query("f04_window_tensor_cells", sql("members", """
 SELECT flight_id, win, CAST(pos * 2 AS BIGINT) AS cell, ROUND(CAST(CAST(score AS FLOAT) AS DOUBLE), 6) AS value FROM members
 UNION ALL SELECT flight_id, win, CAST(pos * 2 + 1 AS BIGINT), 0.0e0 FROM members"""))
def f04(spark, sf):
    t = W.window_tensors(W.sliding_windows(labelling(spark, sf)), ["score", "hdg_deg"])
    return t.select("flight_id", "win", F.posexplode("vector").alias("cell", "value")).select(
        "flight_id", "win", F.col("cell").cast("long").alias("cell"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("t03_rolling_buffer", sql("cleaned", """
 SELECT flight_id, seq, ROUND(s, 6) AS total, ROUND(f, 6) AS oldest FROM (
   SELECT flight_id, seq, sum(score) OVER w AS s, first_value(score) OVER w AS f, count(*) OVER w AS n
   FROM cleaned WINDOW w AS (PARTITION BY flight_id ORDER BY time_s ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE n = 30"""))
def t03(spark, sf):
    return W.rolling_buffer(cleaned(spark, sf), "score").select(
        *KEY, F.round(F.aggregate("buffer", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.element_at("buffer", 1), 6).alias("oldest"))


@query("w21_k04_last_rows", sql(None, """
 SELECT flight_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY time_s DESC) AS back FROM telemetry) WHERE back <= 20"""))
def w21(spark, sf):
    return last_rows(telemetry(spark, sf), 20).select(*KEY)


@query("w24_first_flights_per_terrain", sql(None, f"""
 SELECT terrain, flight_id FROM (SELECT terrain, flight_id, row_number() OVER (PARTITION BY terrain ORDER BY flight_id) AS nth
   FROM (SELECT DISTINCT flight_id, {_TERRAIN} AS terrain FROM telemetry)) WHERE nth <= 5"""))
def w24(spark, sf):
    return W.first_flights(majority(_terrain_rows(spark, sf), "terrain"))


@query("k01_k02_sorted_windows", sql("windows", " SELECT flight_id, win, ROUND(start_s, 6) AS start_s FROM windows"))
def k02(spark, sf):
    return W.window_labels(W.sliding_windows(labelling(spark, sf))).select(
        "flight_id", "win", r6("start_s")).orderBy("start_s", "flight_id")


@query("k05_first_positive_flight", sql("windows", " SELECT min(flight_id) AS flight_id FROM windows WHERE label = 1"))
def k05(spark, sf):
    windows = W.window_labels(W.sliding_windows(labelling(spark, sf)))
    return windows.filter("label = 1").agg(F.min("flight_id").alias("flight_id"))


@query("u01_u02_union_of_sources", sql(None, """
 SELECT flight_id, seq, ROUND(score, 6) AS score, CAST(truth AS INTEGER) AS label FROM telemetry WHERE flight_id % 2 = 0
 UNION ALL SELECT flight_id, seq, NULL, NULL FROM telemetry WHERE flight_id % 2 = 1"""))
def u02(spark, sf):
    t = telemetry(spark, sf)
    even = t.filter("flight_id % 2 = 0").select(*KEY, r6("score"), F.col("truth").alias("label"))
    return even.unionByName(t.filter("flight_id % 2 = 1").select(*KEY), allowMissingColumns=True)


@query("u03_one_file_per_mission", sql(None, """
 SELECT min(name) AS file_name, root FROM (
   SELECT 'f' || flight_id || '_cleaned.csv' AS name, 'f' || flight_id AS root FROM telemetry
   UNION ALL SELECT 'f' || flight_id || '_cleaned_cleaned.csv', 'f' || flight_id FROM telemetry WHERE flight_id % 2 = 0) GROUP BY root"""))
def u03(spark, sf):
    flights = telemetry(spark, sf).select("flight_id").distinct()
    once = flights.select(F.concat(F.lit("f"), "flight_id", F.lit("_cleaned.csv")).alias("file_name"))
    twice = flights.filter("flight_id % 2 = 0").select(F.concat(F.lit("f"), "flight_id", F.lit("_cleaned_cleaned.csv")).alias("file_name"))
    return S.mission_roots(once.union(twice))


_CHECKED = "time_s alt_m vel_m_s vel_innov battery_remaining_pct fix_type satellites_visible failsafe".split()
_LIMITS = "(VALUES ('flat', 440.0e0, 560.0e0, 47.35e0, 47.43e0, 8.5e0, 8.59e0), ('mountain', 1600.0e0, 2800.0e0, 46.47e0, 46.63e0, 7.87e0, 8.13e0), ('sea', 0.5e0, 120.0e0, 43.47e0, 43.73e0, 7.17e0, 7.53e0)) l(terrain, lo, hi, a, b, c, d)"


@query("q01_q15_row_checks", sql(None, f"""
 SELECT flight_id, "check", CAST(violations AS BIGINT) AS violations FROM (
  SELECT flight_id, unnest(['no_null', 'no_infinity', 'magnitudes', 'integers', 'time_increases', 'battery_falls', 'failsafe_without_fix',
      'few_satellites_without_fix', 'fast_needs_innovation', 'mode_auto', 'in_box', 'alt_clamp', 'rel_alt_below_alt']) AS "check",
    unnest([count_if(mode IS NULL OR rel_alt_m IS NULL), 0, count_if(vel_m_s < 0 OR eph_m < 0 OR battery_remaining_pct < 0), 0,
      count_if(dt <= 0), count_if(db > 0), count_if(failsafe = 1 AND fix_type = 3), count_if(satellites_visible <= 4 AND fix_type = 3),
      count_if(vel_m_s > 22 AND vel_innov < 1), count_if(coalesce(mode <> 'AUTO', TRUE)),
      count_if(NOT (lat_deg BETWEEN a - 0.5e0 AND b + 0.5e0 AND lon_deg BETWEEN c - 0.5e0 AND d + 0.5e0)), count_if(NOT alt_m BETWEEN lo AND hi),
      count_if(t.terrain IN ('flat', 'mountain') AND rel_alt_m > alt_m)]) AS violations
  FROM (SELECT *, {_TERRAIN} AS terrain, time_s - lag(time_s) OVER (PARTITION BY flight_id ORDER BY seq) AS dt,
          battery_remaining_pct - lag(battery_remaining_pct) OVER (PARTITION BY flight_id ORDER BY seq) AS db FROM telemetry) t
  JOIN {_LIMITS} ON l.terrain = t.terrain GROUP BY flight_id)"""))
def q_rows(spark, sf):
    return Q.check_rows(_terrain_rows(spark, sf), order="seq")


@query("q05_q06_order_broken_on_purpose", sql(None, """
 SELECT flight_id, CAST(count_if(dt <= 0) AS BIGINT) AS time_back, CAST(count_if(db > 0) AS BIGINT) AS battery_up FROM (
   SELECT *, t - lag(t) OVER (PARTITION BY flight_id ORDER BY seq) AS dt, b - lag(b) OVER (PARTITION BY flight_id ORDER BY seq) AS db
   FROM (SELECT *, CASE WHEN seq % 50 = 49 THEN time_s - 1 ELSE time_s END AS t,
                CASE WHEN seq % 40 = 39 THEN 100.5e0 ELSE battery_remaining_pct END AS b FROM telemetry)) GROUP BY flight_id"""))
def q05(spark, sf):
    t = telemetry(spark, sf).withColumns({
        "time_s": F.when(F.col("seq") % 50 == 49, F.col("time_s") - 1).otherwise(F.col("time_s")),
        "battery_remaining_pct": F.when(F.col("seq") % 40 == 39, F.lit(100.5)).otherwise(F.col("battery_remaining_pct"))})
    found = Q.check_rows(t, order="seq", terrain=None).filter(F.col("check").isin("time_increases", "battery_falls"))
    return found.groupBy("flight_id").agg(
        F.max(F.when(F.col("check") == "time_increases", F.col("violations"))).alias("time_back"),
        F.max(F.when(F.col("check") == "battery_falls", F.col("violations"))).alias("battery_up"))


@query("q07_duplicate_times", sql(None, """
 SELECT flight_id, count(*) - count(DISTINCT time_s) AS violations FROM (
   SELECT * FROM telemetry UNION ALL SELECT * FROM telemetry WHERE seq % 9 = 0) GROUP BY flight_id"""))
def q07(spark, sf):
    t = telemetry(spark, sf)
    return Q.duplicate_times(t.unionByName(t.filter("seq % 9 = 0")))


@query("q16_q17_segment_checks", sql(None, """
 SELECT flight_id, "check", CAST(violations AS BIGINT) AS violations FROM (
   SELECT flight_id, unnest(['end_after_start', 'label_known', 'reason_known', 'long_enough', 'contiguous']) AS "check",
     unnest([count_if(NOT end_s > start_s), count_if(coalesce(TRY_CAST(label AS INTEGER), -1) NOT IN (0, 1)),
       count_if(reason NOT IN ('normal', 'gps_spoof_synthetic')), count_if(NOT end_s - start_s >= 0.4e0),
       count_if(coalesce(abs(ROUND(nxt - end_s, 3)) > 0.002e0, FALSE))]) AS violations
   FROM (SELECT *, lead(start_s) OVER (PARTITION BY flight_id ORDER BY start_s) AS nxt FROM broken) GROUP BY flight_id)""",
                                     extra=_SEGMENTS_SQL + """,
broken AS (SELECT flight_id, CASE WHEN flight_id % 5 = 1 AND start_s > 25 THEN start_s + 0.5e0 ELSE start_s END AS start_s, end_s,
  CASE WHEN flight_id % 3 = 1 THEN 'ignore' ELSE label END AS label, CASE WHEN flight_id % 4 = 3 THEN 'drill' ELSE reason END AS reason FROM segs)"""))
def q16(spark, sf):
    segs = _segments(telemetry(spark, sf))
    f = F.col("flight_id")
    broken = segs.withColumns({
        "start_s": F.when((f % 5 == 1) & (F.col("start_s") > 25), F.col("start_s") + 0.5).otherwise(F.col("start_s")),
        "label": F.when(f % 3 == 1, "ignore").otherwise(F.col("label")),
        "reason": F.when(f % 4 == 3, "drill").otherwise(F.col("reason"))})
    return S.check_segments(broken)


@query("q18_short_flights", sql("cleaned", """
 SELECT flight_id, count(*) AS n_rows FROM cleaned WHERE fix_type = 3 AND armed = 1 GROUP BY flight_id HAVING count(*) < 450"""))
def q18(spark, sf):
    return Q.short_flights(cleaned(spark, sf).filter("armed = 1"), 450)


@query("m01_row_scaler_statistics", sql("windows", """
 SELECT feature, ROUND(avg(v), 6) AS mean, ROUND(stddev_pop(v), 6) AS std FROM (
   SELECT unnest(['alt_m', 'vel_m_s', 'eph_m', 'failsafe']) AS feature, unnest([alt_m, vel_m_s, eph_m, CAST(failsafe AS DOUBLE)]) AS v
   FROM members m JOIN split s ON m.flight_id = s.flight_id AND m.win = s.win WHERE s.split = 'train') GROUP BY feature""", extra=_SPLIT))
def m01(spark, sf):
    members = settled(W.sliding_windows(labelling(spark, sf)))
    windows = settled(W.window_labels(members))
    train = W.chronological_split(windows).filter("split = 'train'").select("flight_id", "win")
    return feature_statistics(members.join(train, ["flight_id", "win"], "left_semi"),
                              ["alt_m", "vel_m_s", "eph_m", "failsafe"]).select("feature", r6("mean"), r6("std"))


@query("m01_scaled_rows", sql(None, """
 SELECT flight_id, seq, ROUND((vel_m_s - m) / s, 6) AS vel_m_s_std FROM telemetry CROSS JOIN (
   SELECT avg(vel_m_s) AS m, stddev_pop(vel_m_s) AS s FROM telemetry)"""))
def m01_scaled(spark, sf):
    t = telemetry(spark, sf)
    return scale_rows(t, feature_statistics(t, ["vel_m_s"]), ["vel_m_s"]).select(*KEY, r6("vel_m_s_std"))
