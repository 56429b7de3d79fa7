"""Readers on files laid out as loggers write them."""

import json

from pyspark.sql import functions as F

from flightwatch.operators.learning import fit_forest, predicted
from flightwatch.operators.terrain import with_elevation
from flightwatch.operators import timeline as TL
from flightwatch.sources import logs, models


def test_csv_logs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_cleaned.csv").write_text("time_s , lat_deg,mode\n0.1,47.0, auto \n0.2,x,Mode(0xC0)\n,,\n")
    (tmp_path / "sub" / "b_cleaned.csv").write_text("time_s , lat_deg,mode\n0.3,46.0,\n")
    got = logs.read_logs(spark, str(tmp_path), "*_cleaned.csv").orderBy("flight_id", "row_no").collect()
    assert [(r["flight_id"], r["time_s"], r["lat_deg"], r["mode"]) for r in got] == [
        ("a", 0.1, 47.0, "auto"), ("a", 0.2, None, "Mode(0xC0)"), ("a", None, None, None), ("b", 0.3, 46.0, None)]
    assert logs.read_logs(spark, str(tmp_path), "*_cleaned.csv", skip="/sub/").count() == 3


def test_logs_of_differing_layout(spark, tmp_path):
    (tmp_path / "new.csv").write_text("time_s,lat_deg,roll_deg\n0.1,47.0,1.5\n")
    (tmp_path / "old.csv").write_text("time_s,ax_mps2,lat_deg\n0.2,,46.0\n0.3,,\n")
    got = {(r["flight_id"], r["time_s"]): r for r in logs.read_mixed_logs(spark, str(tmp_path)).collect()}
    assert got["new", 0.1]["roll_deg"] == 1.5 and got["old", 0.2]["lat_deg"] == 46.0
    assert got["old", 0.2]["roll_deg"] is None and got["old", 0.3]["lat_deg"] is None


def test_segments_reports_and_elevations(spark, tmp_path):
    (tmp_path / "f_auto_segments.json").write_text(json.dumps(
        [{"start_s": 0, "end_s": 2.5, "label": 1, "reason": "x"}, {"start_s": 2.5, "end_s": 3.0, "label": "ignore", "reason": "y"}]))
    assert [(r["flight_id"], r["end_s"], r["label"]) for r in logs.read_segments(spark, str(tmp_path)).orderBy("start_s").collect()] == [
        ("f", 2.5, "1"), ("f", 3.0, "ignore")]
    (tmp_path / "f_cleaning_report.json").write_text(json.dumps(
        {"input_file": "raw/gps_log_1.csv", "initial_rows": 10, "final_rows": 0, "time_start_s": None, "mode_counts": {"AUTO": 3}}))
    report = logs.read_cleaning_reports(spark, str(tmp_path))
    assert report.first()["time_start_s"] is None
    assert [tuple(r) for r in logs.report_counts(report).collect()] == [("f", "AUTO", 3)]
    cache = tmp_path / "cache.json"
    cache.write_text(json.dumps({"47.3979_8.5461": 450.0, "-43.5_7.25": -1.0}))
    elevations = logs.read_elevations(spark, str(cache))
    spots = spark.createDataFrame([(0.0, 47.39791, 8.54609, 9.0), (1.0, -43.50001, 7.25, 9.0), (2.0, 1.0, 1.0, 9.0)],
                                  "time_s double, lat_deg double, lon_deg double, alt_m double")
    assert [r["elevation"] for r in with_elevation(spots, elevations).orderBy("time_s").collect()] == [450.0, -1.0, 9.0]


def test_training_report_becomes_a_registry(spark, tmp_path):
    path = tmp_path / "report.json"
    path.write_text(json.dumps({"terrain_summary": {"flat": {"n_windows": 9, "rf_val_f1": None, "status": "skip"},
                                                    "sea": {"n_windows": 795, "rf_val_f1": 0.9, "status": "trained"}},
                                "recommended_default_model": "sea"}, indent=2))
    rows = {r["terrain"]: r for r in logs.terrain_registry(logs.read_report(spark, str(path), logs.TRAINING_REPORT_SCHEMA)).collect()}
    assert rows["sea"]["available"] and not rows["flat"]["available"] and rows["sea"]["n_train"] == 795


def test_score_logs(spark, tmp_path):
    header = ",".join(logs.SCORE_LOG_COLUMNS)
    line = "2026-05-01T00:00:00+00:00,1.5,{},47,8,1,1,1,0,0,0,0,0,0,flat,rf,1"
    (tmp_path / "live_1.csv").write_text(header + "\n" + line.format(0.1) + "\n")
    (tmp_path / "live_2.csv").write_text(header + "\n" + line.format("oops") + "\n" + line.format(0.7) + "\n")
    (tmp_path / "live_0.csv").write_text("")
    assert logs.read_scores(spark, str(tmp_path)).count() == 3
    newest = logs.read_scores(spark, str(tmp_path), latest_only=True).orderBy(F.col("anom_proba").asc_nulls_first()).collect()
    assert [r["anom_proba"] for r in newest] == [None, 0.7]


def test_models_survive_saving(spark, tmp_path):
    data = spark.range(40).select((F.col("id") % 2).cast("int").alias("label"),
                                  F.array((F.col("id") % 2).cast("double"), F.rand(1)).alias("vector"))
    model = fit_forest(data, trees=3, depth=3)
    models.save_models({"flat": model}, str(tmp_path))
    loaded = models.load_models(str(tmp_path), ["flat"])["flat"]
    assert predicted(loaded, data).filter("prediction <> label").count() == 0
    models.save_registry(models.area_entry(spark, "area", (1.0, 2.0, 3.0, 4.0), 392, 0.99), str(tmp_path))
    assert models.load_registry(spark, str(tmp_path)).first()["bbox"]["lat_max"] == 2.0


def test_label_fallback(spark, tmp_path):
    for name, text in {"a/x_cleaned.csv": "time_s\n1", "a/x_labels.csv": "time_s,label\n1,1", "a/y_cleaned.csv": "time_s\n2",
                       "a/row_labels_auto.csv": "time_s,label\n5,0\n6,1", "b/z_cleaned.csv": "time_s\n3"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text + "\n")
    got = logs.labels_with_fallback(spark, str(tmp_path))
    assert sorted(tuple(r)[:3] for r in got.collect()) == [("x", 1.0, 1), ("y", 5.0, 0), ("y", 6.0, 1)]


def test_absent_score_folder_has_no_rows(spark, tmp_path):
    rows = logs.read_scores(spark, str(tmp_path / "nothing"))
    assert rows.collect() == [] and dict(rows.dtypes)["anom_proba"] == "double"


def test_files_of_two_layouts(spark, tmp_path):
    (tmp_path / "one.csv").write_text("time_s, lat_deg ,mode\n1,2.5,A\n2,3.5,\"B, b\"\n")
    (tmp_path / "two.csv").write_text("mode,ax_mps2,time_s\nC,9,3\n")
    (tmp_path / "none.csv").write_text("")
    rows = {(r["flight_id"], r["time_s"]): r for r in logs.read_logs(spark, str(tmp_path)).collect()}
    assert rows["one", 2.0]["lat_deg"] == 3.5 and rows["one", 2.0]["mode"] == "B, b" and rows["one", 1.0]["ax_mps2"] is None
    assert rows["two", 3.0]["ax_mps2"] == 9.0 and rows["two", 3.0]["lat_deg"] is None and rows["two", 3.0]["mode"] == "C"


def test_ignored_segments(spark, tmp_path):
    (tmp_path / "f_auto_segments.json").write_text('[{"start_s": 1, "end_s": 2, "label": "ignore"}, {"start_s": 3, "end_s": 4, "label": 1}]')
    got = logs.read_segments(spark, str(tmp_path)).orderBy("start_s").collect()
    assert [r["ignored"] for r in got] == [True, False]


def test_bucketed_rows_are_read_without_moving(spark, tmp_path):
    rows = spark.createDataFrame([(f, float(t), t * 0.5) for f in ("a", "b") for t in range(40)], "flight_id string, time_s double, x double")
    logs.write_rows_bucketed(rows, "bucketed_rows", 4, str(tmp_path / "bucketed"))
    ordered = spark.table("bucketed_rows").withColumn("before", F.lag("x").over(TL.lane()))
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert ordered.filter("before IS NOT NULL AND before <> x - 0.5").count() == 0 and ordered.count() == 80
    spark.sql("DROP TABLE bucketed_rows")


def test_only_the_newest_log_is_read(spark, tmp_path):
    for name in ("live_1.csv", "live_2 late.csv", "live_2.csv", "other_9.csv"):
        (tmp_path / name).write_text(",".join(["timestamp", "unix_time", "anom_proba"]) + f"\nx,{len(name)},0.5\n")
    rows = logs.read_scores(spark, str(tmp_path), latest_only=True)
    assert [(r["unix_time"], r["file_name"]) for r in rows.collect()] == [(10.0, "live_2.csv")]
    plan = rows._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert plan.collectLeaves().head().metrics().apply("numFiles").value() == 1
    assert logs.read_scores(spark, str(tmp_path / "none"), latest_only=True).count() == 0


def test_elevation_cache_of_many_lines(spark, tmp_path):
    cells = spark.createDataFrame([(47.0 + i / 100, 8.0 + i / 1000, float(i)) for i in range(50)], "lat double, lon double, elevation double")
    logs.write_elevations(cells, str(tmp_path / "cache"), per_line=7)
    assert len(spark.read.text(str(tmp_path / "cache")).collect()) > 3
    assert sorted(r["elevation"] for r in logs.read_elevations(spark, str(tmp_path / "cache"), lines=True).collect()) == [float(i) for i in range(50)]
