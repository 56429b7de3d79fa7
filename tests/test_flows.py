from pyspark.sql import functions as F

from conftest import SF
from flightwatch.operators.terrain import cell
from flightwatch.plans import flows
from flightwatch.plans.fixture import telemetry


def test_logs_to_scores(spark, tmp_path):
    t = telemetry(spark, SF)
    (t.drop("truth", "score").repartition("flight_id").sortWithinPartitions("flight_id", "seq")
     .write.partitionBy("flight_id").option("header", True).csv(str(tmp_path / "raw")))
    out = str(tmp_path / "out")
    rows = flows.prepare(spark, str(tmp_path / "raw"), out, stale_run=2)
    assert rows.count() == 938
    labels = spark.read.option("header", True).csv(f"{out}/labels")
    assert labels.count() == 938
    reports = spark.read.json(f"{out}/cleaning_reports")
    assert reports.agg(F.sum("rows_removed")).first()[0] == 62
    assert flows.dataset(rows, out).groupBy("split").count().count() == 3
    elevations = t.groupBy(cell(F.col("lat_deg")).alias("lat_key"), cell(F.col("lon_deg")).alias("lon_key")).agg(
        F.max("alt_m").alias("elevation"))
    box = (47.0, 48.0, 8.0, 9.0)
    stored = flows.train_terrain_models(rows, elevations, out, trees=3, depth=4, neural=True, area=box).collect()
    registry = {r["terrain"]: r for r in stored if r["model_type"] != "nn"}
    assert registry["global_fallback"]["available"] and tuple(registry["area"]["bbox"]) == box
    assert registry["flat"]["available"] and registry["mountain"]["available"] and not registry["sea"]["available"]
    scores = flows.score(rows, elevations, out)
    assert scores.count() == 60
    assert scores.filter("anom_proba < 0 OR anom_proba > 1").count() == 0
    assert {r[0] for r in scores.select("terrain").distinct().collect()} == {"flat", "mountain"}
    assert {r[0] for r in scores.select("model").distinct().collect()} >= {"area", "mountain"}
    neural = [r["terrain"] for r in stored if r["model_type"] == "nn"]
    if neural:
        used = flows.score(rows, elevations, out, preferred="nn").select("terrain", "model_type", "model").distinct().collect()
        assert all(r["model_type"] == "nn" for r in used if r["terrain"] in neural and r["model"] != "area")


def test_windows_without_a_model_stay(spark):
    from flightwatch.operators.learning import by_routed_model
    import pytest
    rows = spark.createDataFrame([("f", 1, "flat", [1.0]), ("g", 2, "sea", [1.0])], "flight_id string, win int, active string, vector array<double>")
    with pytest.raises(ValueError):
        by_routed_model(rows, {}, "flat", F.lit(False), None)
    left = by_routed_model(rows, {}, "flat", F.lit(False), _Nothing()).collect()
    assert sorted(r["flight_id"] for r in left) == ["f", "g"] and all(r["anom_proba"] is None for r in left)


class _Nothing:
    """Stands for an area model that no row is at home in."""

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector
        return df.withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.lit(0.5)))).withColumn("prediction", F.lit(0.0))


def test_home_area_makes_rows_and_windows_once(spark, monkeypatch):
    from flightwatch.plans import model_queries as Q
    made = []
    for name in ("labelled", "_windows"):
        original = getattr(Q, name)
        monkeypatch.setattr(Q, name, lambda *a, name=name, original=original: made.append(name) or original(*a))
    monkeypatch.setattr(Q, "TREES", 2)
    assert Q.m09_home(spark, "/root/testdata/sf0.001").count() > 0
    assert made == ["labelled", "_windows"]


def test_every_flight_is_left_out_once(spark):
    """Also those beyond the first five of a terrain, each with a forest that did not see it; rows of no flight stay out."""
    from flightwatch.operators import learning as L
    windows = spark.range(28).selectExpr(
        "id div 4 AS flight_id", "int(id % 4) AS win", "int(id div 4 < 4) AS label", "'flat' AS terrain",
        "array(float(if(id div 4 < 4, 1, 0)), float(id % 4)) AS vector")
    windows = windows.unionByName(windows.limit(1).withColumn("flight_id", F.lit(None).cast("long")))
    pooled = L.leave_one_flight_out(windows, trees=2, depth=2)
    told = pooled.select("flight_id", "win", "label", "prediction").collect()
    assert sorted((r["flight_id"], r["win"]) for r in told) == [(f, w) for f in range(7) for w in range(4)]
    assert all(r["label"] == int(r["flight_id"] < 4) for r in told)
    assert pooled._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    first = L.leave_one_flight_out(windows, per_terrain=5, trees=2, depth=2)
    assert sorted({r["flight_id"] for r in first.collect()}) == [0, 1, 2, 3, 4]
    assert L.leave_one_flight_out(windows.filter("win < 0")).count() == 0


def test_a_left_out_flight_is_not_trained_on(spark, monkeypatch):
    from flightwatch.operators import learning as L
    windows = spark.range(12).selectExpr("id div 2 AS flight_id", "int(id % 2) AS win", "0 AS label", "'sea' AS terrain", "array(float(id)) AS vector")
    seen = {}

    def fit(train, *_, **__):
        ids = sorted(r["flight_id"] for r in train.select("flight_id").distinct().collect())
        seen[tuple(ids)] = train.count()
        return _Nothing()

    monkeypatch.setattr(L, "fit_forest", fit)
    assert L.leave_one_flight_out(windows).count() == 12
    assert seen == {tuple(f for f in range(6) if f != left): 10 for left in range(6)}
