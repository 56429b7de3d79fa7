"""End-to-end flows: logs -> cleaned and labelled tables -> models -> scores.

Every stage is a written table, so a later stage restarts from it. Intermediate tables stay
until ``clear_settled`` is called, which the caller does when nothing of the run is read any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightwatch.operators import learning, reports, segments
from flightwatch.operators.clean import clean
from flightwatch.operators.labels import label_rows
from flightwatch.operators.terrain import classify_terrain, majority
from flightwatch.operators.timeline import join_facts, settled
from flightwatch.operators.windows import chronological_split, window_dataset
from flightwatch.sources import logs, models as stored


def prepare(spark: SparkSession, raw_path: str, out: str, min_fix_type: int = 3, max_dt_gap_s: float = 5.0,
            skip: str | None = "processed", **thresholds) -> DataFrame:
    """Clean and label all logs; writes rows, labels, segments and reports, returns the rows.

    Unreadable numbers become nulls and short files simply yield few rows, so one bad log
    does not stop the others.
    """
    raw = settled(logs.read_logs(spark, raw_path, skip=skip))
    cleaned = settled(clean(raw, min_fix_type, max_dt_gap_s, tie=["row_no"]))
    labelled = settled(label_rows(cleaned, **thresholds))
    logs.write_labels(labelled, f"{out}/labels")
    logs.write_segments(segments.segments(labelled), f"{out}/segments")
    logs.write_report(reports.cleaning_report(raw, cleaned), f"{out}/cleaning_reports")
    logs.write_rows(labelled.drop("reasons"), f"{out}/rows")
    return spark.read.parquet(f"{out}/rows")


def dataset(rows: DataFrame, out: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Windows with labels and tensors, split in time order; writes them and their summary."""
    split = settled(chronological_split(settled(window_dataset(rows)), train, val))
    logs.write_windows(split, f"{out}/windows")
    logs.write_report(reports.dataset_info(split), f"{out}/dataset_info")
    return split


def train_terrain_models(rows: DataFrame, elevations: DataFrame, out: str, trees: int = 100, depth: int = 15,
                         neural: bool = True, area: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A model per terrain (the flight's majority decides), one over all of them to fall back on, one for ``area``
    if a box is given, and the registry; returns the latter."""
    spark = rows.sparkSession
    classed = settled(classify_terrain(rows, elevations))
    windows = learning.window_dataset(classed, inclusive=True, extra=(
        F.median("lat_deg").alias("lat_med"), F.median("lon_deg").alias("lon_med")))
    windows = settled(join_facts(windows, majority(classed, "terrain"), how="inner"))
    fitted, summary = learning.train_by_terrain(windows, trees, depth, neural)
    n = windows.count()
    if n:
        fitted["global_fallback"] = learning.fit_forest(windows, trees, depth=depth)
    facts = summary.select("terrain", "rf_val_f1", "cnn_val_f1", F.col("n_windows").alias("n_train"), "status", "is_default")
    known = learning.model_registry(spark, fitted).unionByName(
        facts.filter("status = 'skip'").select("terrain", F.lit("rf").alias("model_type"), F.lit(False).alias("available")))
    registry = known.join(facts, "terrain", "left").withColumns({
        "n_train": F.coalesce("n_train", F.lit(n)), "bbox": F.lit(None).cast(stored.BOX), "accuracy": F.lit(None).cast("double")})
    if area:
        inside = windows.filter(learning.in_box(F.col("lat_med"), F.col("lon_med"), *area))
        if inside.take(1):
            fitted["area"] = model = learning.train_area(windows, area, trees, depth)
            accuracy = learning.class_one(learning.confusion(learning.predicted(model, inside)))["accuracy"]
            registry = registry.unionByName(stored.area_entry(spark, "area", area, inside.count(), accuracy)
                                            .withColumn("available", F.lit(True)), allowMissingColumns=True)
    stored.save_models({k.replace(":", "-"): m for k, m in fitted.items()}, f"{out}/models")
    stored.save_registry(registry, f"{out}/models")
    return stored.load_registry(spark, f"{out}/models")


def score(rows: DataFrame, elevations: DataFrame, out: str, threshold: float = 0.5, preferred: str = "rf",
          use_home: bool = False) -> DataFrame:
    """Scores of all windows by the stored models, the area model among them; writes and returns them."""
    spark = rows.sparkSession
    # One row per model.
    known = stored.load_registry(spark, f"{out}/models").filter("available").collect()
    default = next((r["terrain"] for r in known if r["is_default"]), "flat")
    names = [r["terrain"] + (learning.NEURAL if r["model_type"] == "nn" else "") for r in known]
    loaded = stored.load_models(f"{out}/models", [n.replace(":", "-") for n in names])
    fitted = {n: loaded[n.replace(":", "-")] for n in names}
    box = next((tuple(r["bbox"]) for r in known if r["bbox"]), None)
    area = (fitted.pop("area"), box) if box else None
    scored = learning.score_flights(rows, fitted, elevations, default=default, threshold=threshold, area=area,
                                    preferred=preferred, use_home=use_home)
    scored.write.mode("overwrite").partitionBy("flight_id").parquet(f"{out}/scores")
    return spark.read.parquet(f"{out}/scores")
