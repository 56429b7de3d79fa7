"""Writers and readers, checked by a round trip through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from flightwatch.operators import reports as R
from flightwatch.operators import segments as S
from flightwatch.operators import windows as W
from flightwatch.operators.labels import require_columns
from flightwatch.operators.quality import check_columns
from flightwatch.operators.timeline import KEYS, row_number, running_sum, settled, shared_folder, with_prefix
from flightwatch.plans.catalog import ORACLES, cleaned, labelled, query, r6, raw, sql
from flightwatch.schema import LABELLED_COLUMNS, SCORE_LOG_COLUMNS
from flightwatch.sources import logs


def _folder(df, name):
    return f"{shared_folder(df)}/{name}-{uuid.uuid4().hex}"


@query("s01_s02_csv_logs", sql(None, """
 SELECT CAST(flight_id AS VARCHAR) AS flight_id, CAST(row_number() OVER (PARTITION BY flight_id ORDER BY seq) AS INTEGER) AS nth,
   ROUND(time_s, 6) AS time_s, ROUND(vel_m_s, 6) AS vel_m_s, ROUND(rel_alt_m, 6) AS rel_alt_m, CAST(fix_type AS DOUBLE) AS fix_type, trim(mode) AS mode FROM telemetry"""))
def s01(spark, sf):
    t = raw(spark, sf).drop("truth", "score")
    path = _folder(t, "logs")
    # One file per flight, rows in log order, headers with stray blanks.
    (t.repartition("flight_id").sortWithinPartitions("flight_id", "seq")
     .withColumnRenamed("vel_m_s", " vel_m_s ").write.partitionBy("flight_id").option("header", True).csv(path))
    read = logs.read_logs(spark, path)
    w = Window.partitionBy("flight_id").orderBy("row_no")
    return read.select("flight_id", F.row_number().over(w).alias("nth"), r6("time_s"), r6("vel_m_s"), r6("rel_alt_m"), "fix_type", "mode")


@query("s03_s10_label_files", sql("labelled", """
 SELECT CAST(flight_id AS VARCHAR) AS flight_id, ROUND(time_s, 3) AS time_s, label FROM labelled"""))
def s03(spark, sf):
    rows = labelled(spark, sf)
    path = _folder(rows, "labels")
    logs.write_labels(rows, path)
    return logs.read_labels(spark, path, "*.csv").select("flight_id", F.round("time_s", 3).alias("time_s"), "label")


@query("s04_s10_segment_files", ORACLES["w11_segments"].replace(
    " SELECT flight_id, ROUND(min(time_s), 6) AS start_s", " SELECT CAST(flight_id AS VARCHAR) AS flight_id, ROUND(min(time_s), 6) AS start_s"))
def s04(spark, sf):
    segs = S.segments(labelled(spark, sf))
    path = _folder(segs, "segments")
    logs.write_segments(segs, path)
    return logs.read_segments(spark, path, "*.json", lines=True).select(
        "flight_id", r6("start_s"), r6("end_s"), S.label_number(F.col("label")).alias("label"))


@query("s05_s12_a23_report_files", sql("cleaned", """
 SELECT 'f' AS family, (SELECT count(DISTINCT flight_id) FROM telemetry) AS flights, (SELECT count(*) FROM telemetry) AS rows_in, count(*) AS rows_out FROM cleaned"""))
def s05(spark, sf):
    t = raw(spark, sf)
    report = R.cleaning_report(t, cleaned(spark, sf)).withColumn("input_file", F.concat(F.lit("raw/f_"), "flight_id", F.lit(".csv")))
    path = _folder(t, "reports")
    logs.write_report(report.drop("flight_id"), path)
    return R.corpus_totals(logs.read_cleaning_reports(spark, path, "*.json", lines=True))


@query("s07_s13_score_log", sql(None, """
 SELECT strftime(TIMESTAMP '2026-05-01 00:00:00' + to_milliseconds(CAST(round(time_s * 1000) AS BIGINT)), '%H:%M:%S.%g') AS clock,
   CASE WHEN seq % 20 = 0 THEN NULL ELSE ROUND(score, 6) END AS anom_proba, ROUND(alt_m, 3) AS alt_m, flight_id % 3 AS switched FROM telemetry"""))
def s07(spark, sf):
    t = raw(spark, sf)
    ts = F.timestamp_millis(F.lit(1777593600000) + F.round(F.col("time_s") * 1000).cast("long"))
    null = F.lit(0.0)
    scores = t.withColumns({"timestamp": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "unix_time": F.unix_millis(ts) / 1000.0,
                            "anom_proba": F.col("score"), "roll_deg": F.when(F.col("seq") % 20 == 0, 1.0).otherwise(0.0), **{c: null for c in ("pitch_deg", "yaw_deg", "rollspeed", "pitchspeed", "yawspeed")},
                            "terrain": F.lit("flat"), "model_type": F.lit("rf"), "switched_terrain": F.col("flight_id") % 3})
    lines = logs.log_format(scores.withColumn("rel_alt_m", F.coalesce("rel_alt_m", null)))
    # Some probabilities are unreadable; readers turn them into nulls.
    path = _folder(t, "scores")
    (lines.withColumn("anom_proba", F.when(F.col("roll_deg") == "1.00", "n/a").otherwise(F.col("anom_proba")))
     .write.option("header", True).csv(path))
    return logs.read_scores(spark, path, pattern="*.csv").select(
        F.date_format("timestamp", "HH:mm:ss.SSS").alias("clock"), "anom_proba", F.round("alt_m", 3).alias("alt_m"),
        F.col("switched_terrain").cast("long").alias("switched"))


@query("s09_cleaned_table", sql("cleaned", " SELECT flight_id, seq, ROUND(dt, 6) AS dt, mode FROM cleaned"))
def s09(spark, sf):
    rows = cleaned(spark, sf)
    path = _folder(rows, "cleaned")
    logs.write_rows(rows, path)
    return spark.read.parquet(path).select(F.col("flight_id").cast("long").alias("flight_id"), "seq", r6("dt"), "mode")


@query("s07_newest_log", sql(None, """
 SELECT ROUND(score, 6) AS anom_proba, flight_id % 8 AS part, count(*) AS n FROM telemetry
 WHERE flight_id % 8 = (SELECT max(flight_id % 8) FROM telemetry) GROUP BY 1, 2"""))
def s07_newest(spark, sf):
    """Scores in up to eight files; only the one with the greatest name is read."""
    t = raw(spark, sf)
    path = _folder(t, "logs")
    scores = t.select(*[F.round("score", 6).cast("string").alias("anom_proba") if c == "anom_proba" else
                        (F.col("flight_id") % 8).cast("string").alias(c) if c == "switched_terrain" else F.lit("0").alias(c) for c in SCORE_LOG_COLUMNS],
                      (F.col("flight_id") % 8).cast("int").alias("_part"))
    scores.repartitionById(8, "_part").drop("_part").write.option("header", True).csv(path)
    return logs.read_scores(spark, path, latest_only=True, pattern="part-*.csv").groupBy(
        r6("anom_proba"), F.col("switched_terrain").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("s09_bucketed_table", sql("cleaned", """
 SELECT flight_id, seq, row_number() OVER (PARTITION BY flight_id ORDER BY time_s) AS nth, ROUND(sum(dt) OVER (PARTITION BY flight_id ORDER BY time_s), 6) AS flown_s
 FROM cleaned"""))
def s09_bucketed(spark, sf):
    """Cleaned rows in buckets of (flight, chunk), read again by an ordered operator."""
    rows = cleaned(spark, sf)
    name = f"cleaned_{uuid.uuid4().hex}"
    logs.write_rows_bucketed(rows, name, 16, _folder(rows, "bucketed"))
    placed = with_prefix(spark.table(name), {"nth": row_number(), "flown_s": running_sum(F.col("dt"))})
    return placed.select("flight_id", "seq", "nth", r6("flown_s"))


@query("s11_window_dataset", sql("windows", " SELECT flight_id, win, label FROM windows"))
def s11(spark, sf):
    windows = settled(W.window_dataset(labelled(spark, sf)))
    path = _folder(windows, "dataset")
    logs.write_windows(W.chronological_split(windows), path)
    return spark.read.parquet(path).select("flight_id", "win", "label")


@query("s01_u02_mixed_layouts", sql(None, """
 SELECT CAST(flight_id AS VARCHAR) AS flight_id, CAST(row_number() OVER (PARTITION BY flight_id ORDER BY seq) AS INTEGER) AS nth,
   ROUND(time_s, 6) AS time_s, ROUND(lat_deg, 6) AS lat_deg, CASE WHEN flight_id % 2 = 0 THEN ROUND(vel_m_s, 6) END AS vel_m_s,
   CASE WHEN flight_id % 2 = 1 THEN ROUND(eph_m, 6) END AS eph_m, trim(mode) AS mode,
   CASE WHEN flight_id % 2 = 1 THEN ROUND(rollspeed_radps * 100, 6) END AS ax_mps2 FROM telemetry"""))
def s01_mixed(spark, sf):
    """Two layouts in one folder: other columns, in another order; one has a sensor that only old logs have."""
    t = raw(spark, sf).withColumn("ax_mps2", F.col("rollspeed_radps") * 100)
    path = _folder(t, "mixed")
    for rest, names in ((0, ["time_s", "lat_deg", "vel_m_s", "mode"]), (1, ["time_s", "eph_m", "ax_mps2", "mode", "lat_deg"])):
        (t.filter(F.col("flight_id") % 2 == rest).repartition("flight_id").sortWithinPartitions("flight_id", "seq")
         .select("flight_id", *names).write.mode("append").partitionBy("flight_id").option("header", True).csv(path))
    w = Window.partitionBy("flight_id").orderBy("row_no")
    read = logs.read_mixed_logs(spark, path, ["time_s", "lat_deg", "vel_m_s", "eph_m", "mode", "ax_mps2"])
    return read.select("flight_id", F.row_number().over(w).alias("nth"), r6("time_s"), r6("lat_deg"), r6("vel_m_s"), r6("eph_m"), "mode",
                       r6("ax_mps2"))


@query("s06_elevation_cache", sql(None, """
 SELECT CAST(round_even(round_even(lat_deg, 2) * 10000, 0) AS BIGINT) AS lat_key, CAST(round_even(round_even(lon_deg, 3) * 10000, 0) AS BIGINT) AS lon_key,
   max(flight_id % 3 * 100.0e0) AS elevation FROM telemetry GROUP BY 1, 2"""))
def s06(spark, sf):
    t = raw(spark, sf)
    path = _folder(t, "elevations")
    cells = (t.groupBy(F.bround("lat_deg", 2).alias("lat"), F.bround("lon_deg", 3).alias("lon"))
             .agg(F.max(F.col("flight_id") % 3 * 100.0).alias("elevation")))
    logs.write_elevations(cells, path)
    return logs.read_elevations(spark, path, lines=True)


@query("s08_replay", sql(None, """
 SELECT flight_id % 3 AS switched, ROUND(score, 6) AS anom_proba, ROUND(alt_m, 3) AS alt_m, ROUND(vel_m_s, 3) AS vel_m_s FROM telemetry"""))
def s08(spark, sf):
    t = raw(spark, sf)
    ts = F.timestamp_millis(F.lit(1777593600000) + F.round(F.col("time_s") * 1000).cast("long"))
    null = F.lit(0.0)
    scores = t.withColumns({"timestamp": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "unix_time": F.unix_millis(ts) / 1000.0,
                            "anom_proba": F.col("score"), "rel_alt_m": F.coalesce("rel_alt_m", null),
                            **{c: null for c in ("roll_deg", "pitch_deg", "yaw_deg", "rollspeed", "pitchspeed", "yawspeed")},
                            "terrain": F.lit("flat"), "model_type": F.lit("rf"), "switched_terrain": F.col("flight_id") % 3})
    path = _folder(t, "replay")
    logs.log_format(scores).write.option("header", True).csv(path)
    return logs.read_replay(spark, path).select(
        F.col("switched_terrain").cast("long").alias("switched"), r6("anom_proba"), F.round("alt_m", 3).alias("alt_m"), F.round("vel_m_s", 3).alias("vel_m_s"))


@query("q11_column_check", sql("labelled", " SELECT 'missing vibration_y' AS issue, count(*) AS n_rows FROM labelled"))
def q11(spark, sf):
    """The columns of a labelled table are compared with the expected names; of two absent ones, one is put back."""
    rows = labelled(spark, sf)
    absent = [c for c in LABELLED_COLUMNS if c not in rows.columns and c != "vibration_y"]
    table = rows.withColumns({c: F.lit(0.0) for c in absent}).select(*KEYS, *[c for c in LABELLED_COLUMNS if c != "vibration_y"])
    issues = check_columns(table)
    return table.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array(*[F.lit(i) for i in issues])).alias("issue"), "n_rows")


@query("p11_required_columns", sql(None, " SELECT 'missing required columns: alt_m, vel_m_s' AS refusal, count(*) AS n_rows FROM telemetry"))
def p11(spark, sf):
    t = require_columns(raw(spark, sf))
    try:
        refusal = ""
        require_columns(t.drop("vel_m_s", "alt_m"))
    except ValueError as e:
        refusal = str(e)
    return t.agg(F.lit(refusal).alias("refusal"), F.count(F.lit(1)).alias("n_rows"))
