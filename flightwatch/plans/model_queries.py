"""Training and scoring queries.

Predictions of forests and networks have no SQL form; what is compared is which windows are predicted, with
which label, and that every one has a probability.
"""

from __future__ import annotations

import functools
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from flightwatch.operators import learning as L
from flightwatch.operators import metrics as E
from flightwatch.operators.terrain import cell, majority, terrain_of
from flightwatch.operators.timeline import settled, shared_folder
from flightwatch.plans.catalog import labelled, query, r6, sql
from flightwatch.sources import models

# The defaults of the operators.
TREES = 100
DEPTH = 15
#: The report pools the first flights of each terrain, as its SQL does.
FIRST = 5


def _rows(spark, sf):
    """Cleaned, labelled rows; the label is the true one."""
    return labelled(spark, sf).withColumn("label", F.col("truth"))


def _windows(spark, sf, rows=None):
    """Windows of ``_rows`` (made here if not given); the terrain is the flight's."""
    rows = _rows(spark, sf) if rows is None else rows
    windows = L.scoring_windows(rows)
    terrain = majority(rows.withColumn("terrain", terrain_of(F.col("alt_m"))), "terrain")
    return settled(windows.join(terrain, "flight_id"))


_TRUE = """
true_windows AS (
  SELECT *, row_number() OVER (ORDER BY flight_id, win) - 1 AS ordinal, count(*) OVER () AS n,
         CASE flight_id % 3 WHEN 0 THEN 'flat' WHEN 1 THEN 'mountain' ELSE 'sea' END AS terrain
  FROM (SELECT flight_id, win, CAST(CASE WHEN avg(truth) > 0.5e0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM members GROUP BY flight_id, win))
"""
_VALID = "coalesce(anom_proba BETWEEN 0 AND 1, false) AS valid"


def _true(body: str) -> str:
    return sql("members", body, extra=_TRUE)


@query("m02_m03_forest_split_report", _true("""
 SELECT label AS class, count(*) AS support FROM true_windows WHERE ordinal >= floor(0.7e0 * n) GROUP BY label"""))
def m03(spark, sf):
    # The split is told from few broadcast rows at each reading: wide windows are not written twice for it.
    split = L.chronological_split(_windows(spark, sf))
    model = L.fit_forest(split.filter("split = 'train'"), TREES, depth=DEPTH)
    report = E.class_report(E.confusion(L.predicted(model, split.filter("split <> 'train'"))))
    return report.filter("support > 0 AND f1 BETWEEN 0 AND 1").select("class", "support")


@query("m04_network_predictions", _true("""
 SELECT flight_id, win, label, true AS valid FROM true_windows WHERE ordinal >= floor(0.7e0 * n) + floor(0.15e0 * n)"""))
def m04(spark, sf):
    split = settled(L.chronological_split(_windows(spark, sf)))
    model = L.fit_neural(split.filter("split = 'train'"), split.filter("split = 'val'"))
    return L.predicted(model, split.filter("split = 'test'"), neural=True).selectExpr("flight_id", "win", "label", _VALID)


@query("m05_a15_training_summary", _true("""
 SELECT t.terrain, count(w.win) AS n_windows, CASE WHEN count(w.win) < 10 THEN 'skip' WHEN count(w.win) < 30 THEN 'rf_only' ELSE 'trained' END AS status
 FROM (SELECT unnest(['flat', 'mountain', 'sea']) AS terrain) t LEFT JOIN true_windows w USING (terrain) GROUP BY t.terrain"""))
def m05(spark, sf):
    return L.train_by_terrain(_windows(spark, sf), TREES, DEPTH)[1].select("terrain", "n_windows", "status")


@query("m06_area_model", _true(" SELECT flight_id, win, label, true AS valid FROM true_windows"))
def m06(spark, sf):
    windows = _windows(spark, sf)
    box = (47.0, 48.0, 8.0, 9.0)
    model = L.train_area(windows, box, TREES, DEPTH)
    return L.predicted(model, windows).selectExpr("flight_id", "win", "label", _VALID)


@query("m07_terrain_identifier")
def m07(spark, sf):
    _, predictions = L.fit_terrain_identifier(_windows(spark, sf), TREES, DEPTH)
    return E.class_report(E.confusion(predictions))


@query("m08_leave_one_flight_out", _true("""
 SELECT flight_id, win, label, true AS valid FROM true_windows WHERE flight_id IS NOT NULL"""))
def m08(spark, sf):
    pooled = L.leave_one_flight_out(_windows(spark, sf), trees=TREES, depth=DEPTH)
    return pooled.selectExpr("flight_id", "win", "label", _VALID)


@query("m08_pool_report", _true("""
 , pool AS (SELECT label FROM true_windows JOIN (
   SELECT flight_id FROM (SELECT flight_id, row_number() OVER (PARTITION BY flight_id % 3 ORDER BY flight_id) AS nth
     FROM (SELECT DISTINCT flight_id FROM true_windows)) WHERE nth <= 5) USING (flight_id))
 SELECT (SELECT count(*) FROM pool WHERE label = 0) AS support_0, (SELECT count(*) FROM pool WHERE label = 1) AS support_1,
   (SELECT count(*) FROM pool WHERE label = 1) AS last_tp, (SELECT count(*) FROM pool WHERE label = 0) AS last_fp, true AS valid"""))
def m08_report(spark, sf):
    """The report has every window of the folds, and the curve ends where all of them are taken."""
    report, points = L.pool_report(L.leave_one_flight_out(_windows(spark, sf), per_terrain=FIRST, trees=TREES, depth=DEPTH))
    of = lambda c: F.coalesce(F.max(F.when(F.col("class") == c, F.col("support"))), F.lit(0)).cast("long").alias(f"support_{c}")
    ends = points.agg(F.max("tp").cast("long").alias("last_tp"), F.max("fp").cast("long").alias("last_fp"))
    areas = E.ranking_report(points).select(F.coalesce("auc", F.lit(0.0)).between(0, 1).alias("valid"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(report.agg(of(0), of(1))).join(one(ends), "_one").join(one(areas), "_one").drop("_one")


@query("m09_scored_flights", _true("""
 SELECT flight_id, win AS window_idx, win * 15 AS start_row, win * 15 + 29 AS end_row, label, true AS valid,
   CASE WHEN win >= 4 THEN terrain ELSE 'flat' END AS terrain, CASE WHEN win >= 4 THEN terrain ELSE 'flat' END AS model,
   win = 4 AND terrain <> 'flat' AS switched_terrain FROM true_windows"""))
def m09(spark, sf):
    return _scored(spark, sf).selectExpr("flight_id", "window_idx", "start_row", "end_row", "label", _VALID, "terrain", "model", "switched_terrain")


@query("m09_home_area", _true("""
 SELECT flight_id, win AS window_idx, CASE WHEN flight_id % 3 = 0 THEN 'area' WHEN win >= 4 THEN terrain ELSE 'flat' END AS model, true AS valid FROM true_windows"""))
def m09_home(spark, sf):
    """Flights that begin inside the area's box are scored by its model, all along, whatever the terrain says."""
    return _scored(spark, sf, box=(47.0, 48.0, 8.0, 9.0), use_home=True).selectExpr("flight_id", "window_idx", "model", _VALID)


def _scored(spark, sf, box=None, **how):
    """All windows scored by a forest for each terrain, and by one for ``box`` if given. Rows and windows are made once."""
    rows = _rows(spark, sf)
    windows = _windows(spark, sf, rows)
    terrains = sorted(r["terrain"] for r in windows.select("terrain").distinct().collect())
    fits = [functools.partial(L.fit_forest, windows.filter(F.col("terrain") == t), TREES, depth=DEPTH) for t in terrains]
    if box:
        fits.append(functools.partial(L.train_area, windows, box, TREES, DEPTH))
    # Side by side, so that one fit's last tasks do not leave the cluster idle.
    with ThreadPoolExecutor(4) as pool:
        fitted = [f.result() for f in [pool.submit(fit) for fit in fits]]
    forests = dict(zip(terrains, fitted))
    elevations = (rows.groupBy(cell(F.col("lat_deg")).alias("lat_key"), cell(F.col("lon_deg")).alias("lon_key"))
                  .agg(F.max("alt_m").alias("elevation")))
    area = (fitted[-1], box) if box else None
    return L.score_flights(rows, forests, elevations, default=terrains[0], area=area, **how)


@query("m10_probability_trace", _true("""
 SELECT flight_id, win, label, true AS valid FROM true_windows WHERE flight_id = (SELECT min(flight_id) FROM true_windows WHERE label = 1)"""))
def m10(spark, sf):
    windows = _windows(spark, sf)
    flight = windows.filter("label = 1").agg(F.min("flight_id").alias("f")).first()["f"]
    return L.probability_trace(windows, flight, TREES, DEPTH).selectExpr("flight_id", "win", "label", _VALID)


@query("m11_class_weights", sql("windows", """
 SELECT w.flight_id, w.win, CAST(w.y AS INTEGER) AS label, ROUND(t.n / (2.0e0 * c.n), 6) AS weight FROM (
   SELECT flight_id, win, CASE WHEN avg(truth) > 0.5e0 THEN 1 ELSE 0 END AS y FROM members GROUP BY flight_id, win) w
 JOIN (SELECT y, count(*) AS n FROM (SELECT CASE WHEN avg(truth) > 0.5e0 THEN 1 ELSE 0 END AS y FROM members GROUP BY flight_id, win) GROUP BY y) c ON c.y = w.y
 CROSS JOIN (SELECT count(*) AS n FROM windows) t"""))
def m11(spark, sf):
    return L.with_weights(_windows(spark, sf)).select("flight_id", "win", "label", r6("weight"))


@query("m11_balanced_sample")
def m11_sample(spark, sf):
    return L.balanced_sample(_windows(spark, sf)).select("flight_id", "win", "label")


@query("a21_k03_feature_importance")
def a21(spark, sf):
    windows = _windows(spark, sf)
    return L.feature_importance(L.fit_forest(windows, TREES, depth=DEPTH), spark)


@query("m04_window_summaries", sql("members", """
 SELECT flight_id, win, ROUND(avg(CAST(CAST(vel_m_s AS FLOAT) AS DOUBLE)), 6) AS mean_vel,
   ROUND(sqrt(greatest(avg(pow(CAST(CAST(vel_m_s AS FLOAT) AS DOUBLE), 2)) - pow(avg(CAST(CAST(vel_m_s AS FLOAT) AS DOUBLE)), 2), 0)), 4) AS std_vel
 FROM members GROUP BY flight_id, win"""))
def m04_summary(spark, sf):
    at = L.FEATURES.index("vel_m_s")
    return L.window_summaries(_windows(spark, sf)).select(
        "flight_id", "win", F.round(F.element_at("summary", at + 1), 6).alias("mean_vel"),
        F.round(F.element_at("summary", at + 1 + len(L.FEATURES)), 4).alias("std_vel"))


@query("s15_s16_stored_models", _true("""
 SELECT flight_id, win, label, true AS valid, lat_med BETWEEN 47.0e0 AND 48.0e0 AND lon_med BETWEEN 8.0e0 AND 9.0e0 AS at_home
 FROM true_windows JOIN (SELECT flight_id, win, median(lat_deg) AS lat_med, median(lon_deg) AS lon_med FROM members GROUP BY flight_id, win)
 USING (flight_id, win)"""))
def s15(spark, sf):
    """An area model and its registry entry are stored, read again, and used where the entry's box says."""
    windows = _windows(spark, sf)
    box = (47.0, 48.0, 8.0, 9.0)
    folder = f"{shared_folder(windows)}/models-{uuid.uuid4().hex}"
    models.save_models({"area": L.train_area(windows, box, TREES, DEPTH)}, folder)
    models.save_registry(models.area_entry(spark, "area", box, windows.count(), 0.0), folder)
    entry = models.load_registry(spark, folder).first()
    model = models.load_models(folder, [entry["terrain"]])["area"]
    here = L.in_box(F.col("lat_med"), F.col("lon_med"), *entry["bbox"])
    scored = L.by_routed_model(windows.withColumn("active", F.col("terrain")), {"flat": model}, "flat", here, model)
    return scored.selectExpr("flight_id", "win", "label", _VALID, "model = 'area' AS at_home")
