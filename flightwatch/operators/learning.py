"""Training and scoring of window classifiers with Spark ML."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightwatch.functions.geo import in_box
from flightwatch.operators.scoring import alert, ground_gate, smooth
from flightwatch.operators.terrain import debounce, route, terrain_of, with_elevation
from flightwatch.operators.timeline import KEYS, join_facts, row_axis, settled, shared_folder
from flightwatch.operators.windows import chronological_split, first_flights, window_dataset
from flightwatch.operators.metrics import class_report, confusion, roc_points
from flightwatch.operators.reports import training_summary
from flightwatch.schema import FEATURES, TERRAINS, WINDOW_LENGTH, WINDOW_STRIDE

MIN_WINDOWS = 10
MIN_NEURAL_WINDOWS = 30


def feature_statistics(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean and population deviation per feature, as rows; the fit of the row scaler."""
    have = [f for f in features if f in rows.columns]
    stats = rows.agg(*[s for f in have for s in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])
    return stats.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("std"))
        for f in have])))


def scale_rows(rows: DataFrame, statistics: DataFrame, features: Sequence[str]) -> DataFrame:
    """Standardised copies ``<feature>_std``; a constant feature is only centred.

    The statistics are two numbers per feature, collected once as constants of the plan.
    """
    fit = {r["feature"]: (r["mean"], r["std"]) for r in statistics.collect()}
    return rows.withColumns({f"{f}_std": (F.col(f) - fit[f][0]) / (fit[f][1] or 1.0) for f in features if f in fit})


def with_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """``weight`` = n / (2 n_class); the joined table has one row per class."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).withColumn("_one", F.lit(1))
    weights = (counts.withColumn("_one", F.lit(1)).join(total, "_one")
               .select(label, (F.col("_total") / (2.0 * F.col("_n"))).alias("weight")))
    return train.join(F.broadcast(weights), label)


def balanced_sample(df: DataFrame, label: str = "label", seed: int = 42) -> DataFrame:
    """Majority class thinned to the size of the minority; an operator that samples."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = min(counts.values())
    return df.sampleBy(label, {k: least / v for k, v in counts.items()}, seed)


def vectorised(windows: DataFrame) -> DataFrame:
    return windows.withColumn("_input", array_to_vector("vector"))


def fit_forest(train: DataFrame, trees: int = 100, seed: int = 42, depth: int = 15,
               balanced: bool = True, label: str = "label") -> PipelineModel:
    """Scaler on the flattened window, then a forest; expects ``vector`` and the label."""
    data = vectorised(with_weights(train, label) if balanced else train)
    scaler = StandardScaler(inputCol="_input", outputCol="_scaled", withMean=True, withStd=True)
    forest = RandomForestClassifier(featuresCol="_scaled", labelCol=label, numTrees=trees, seed=seed,
                                    maxDepth=depth, featureSubsetStrategy="sqrt")
    if balanced:
        forest = forest.setWeightCol("weight")
    return Pipeline(stages=[scaler, forest]).fit(data)


def window_summaries(windows: DataFrame, length: int = WINDOW_LENGTH, features: int = len(FEATURES)) -> DataFrame:
    """``summary``: mean and deviation of every feature over the window (2 x features)."""
    column = lambda i: F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
                                   lambda p: F.element_at("vector", (p * features + i + 1).cast("int")).cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / length
    pairs = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda i: F.struct(
        mean(column(i)).alias("m"),
        mean(F.transform(column(i), lambda x: x * x)).alias("q")))
    deviation = lambda p: F.sqrt(F.greatest(p["q"] - p["m"] * p["m"], F.lit(0.0)))
    return (windows.withColumn("_p", pairs)
            .withColumn("summary", F.concat(F.transform("_p", lambda p: p["m"]), F.transform("_p", deviation)))
            .drop("_p"))


def fit_neural(train: DataFrame, val: DataFrame, seeds: Sequence[int] = (42,), iterations: int = 50,
               hidden: Sequence[int] = (32, 16)) -> PipelineModel:
    """Feed-forward network on window summaries; the fit with the least loss on ``val`` wins (the first one if
    ``val`` has no rows)."""
    # Written once: the optimiser reads its input in every iteration.
    prepare = lambda w: settled(window_summaries(w).select("label", "summary")).withColumn(
        "_input", array_to_vector("summary"))
    fitted, data = [], prepare(train)
    check = prepare(val)
    measured = bool(check.take(1))
    loss = MulticlassClassificationEvaluator(metricName="logLoss", labelCol="label")
    for seed in seeds:
        scaler = StandardScaler(inputCol="_input", outputCol="_scaled", withMean=True, withStd=True)
        network = MultilayerPerceptronClassifier(
            featuresCol="_scaled", labelCol="label", seed=seed, maxIter=iterations,
            layers=[2 * len(FEATURES), *hidden, 2])
        model = Pipeline(stages=[scaler, network]).fit(data)
        fitted.append((loss.evaluate(model.transform(check)) if measured else 0.0, len(fitted), model))
    return min(fitted, key=lambda f: f[:2])[2]


def predicted(model: PipelineModel, windows: DataFrame, neural: bool = False) -> DataFrame:
    """Adds ``anom_proba`` (probability of class 1) and ``prediction``."""
    data = (window_summaries(windows).withColumn("_input", array_to_vector("summary")) if neural
            else vectorised(windows))
    scored = model.transform(data)
    probability = vector_to_array("probability")
    return (scored.withColumn("anom_proba", F.coalesce(F.get(probability, F.lit(1)), F.lit(0.0)))
            .drop("_input", "_scaled", "rawPrediction", "probability", "summary"))


def feature_importance(model: PipelineModel, spark, features: Sequence[str] = FEATURES, top: int = 20) -> DataFrame:
    """Importance folded from (row, feature) back to features; the vector is part of the model."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    cells = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "importance double, cell int")
    names = F.array(*[F.lit(f) for f in features])
    return (cells.groupBy(F.get(names, F.col("cell") % len(features)).alias("feature"))
            .agg(F.sum("importance").alias("importance"))
            .orderBy(F.desc("importance"), "feature").limit(top))


def class_one(matrix: DataFrame) -> dict:
    """Accuracy and positive-class F1 of a confusion matrix (at most a few rows)."""
    cells = {(r["label"], r["prediction"]): r["n"] for r in matrix.collect()}
    n = sum(cells.values())
    hit, wrong = cells.get((1, 1), 0), cells.get((0, 1), 0) + cells.get((1, 0), 0)
    return {"accuracy": sum(v for (a, b), v in cells.items() if a == b) / n if n else None,
            "f1": 2 * hit / (2 * hit + wrong) if 2 * hit + wrong else 0.0}


def train_by_terrain(windows: DataFrame, trees: int = 100, depth: int = 15, neural: bool = True,
                     seed: int = 42) -> tuple[dict[str, PipelineModel], DataFrame]:
    """A forest per terrain (and a network from 30 windows on) and the training summary.

    ``windows`` has terrain, label, vector. The models are named by terrain, networks with NEURAL behind it.
    At most six fits, each distributed over its rows.
    """
    spark = windows.sparkSession
    ready = settled(chronological_split(windows, within=["terrain"]))
    sizes = {r["terrain"]: r["n"] for r in ready.groupBy("terrain").agg(F.count(F.lit(1)).alias("n")).collect()}
    models, summary = {}, []
    for terrain in TERRAINS:
        n = sizes.get(terrain, 0)
        if n < MIN_WINDOWS:
            summary.append((terrain, n, None, None, "skip"))
            continue
        part = ready.filter(F.col("terrain") == terrain)
        train, val = part.filter("split = 'train'"), part.filter("split = 'val'")
        models[terrain] = fit_forest(train, trees, seed, depth)
        forest_f1 = class_one(confusion(predicted(models[terrain], val)))["f1"]
        network_f1 = None
        if neural and n >= MIN_NEURAL_WINDOWS:
            network = models[terrain + NEURAL] = fit_neural(train, val)
            network_f1 = class_one(confusion(predicted(network, val, neural=True)))["f1"]
        summary.append((terrain, n, forest_f1, network_f1, "trained" if network_f1 is not None else "rf_only"))
    table = spark.createDataFrame(
        summary, "terrain string, n_windows long, rf_val_f1 double, cnn_val_f1 double, status string")
    return models, training_summary(table)


def train_area(windows: DataFrame, box: tuple[float, float, float, float], trees: int = 100,
               depth: int = 15) -> PipelineModel:
    """A forest on the windows whose median position lies in the box."""
    return fit_forest(windows.filter(in_box(F.col("lat_med"), F.col("lon_med"), *box)), trees, depth=depth)


def fit_terrain_identifier(windows: DataFrame, trees: int = 100, depth: int = 15, seed: int = 42):
    """Model of the terrain itself, on a random 80/20 split; returns it and test predictions."""
    indexer = StringIndexer(inputCol="terrain", outputCol="terrain_no", stringOrderType="alphabetAsc",
                            handleInvalid="keep").fit(windows)
    train, test = indexer.transform(windows).randomSplit([0.8, 0.2], seed)
    # A random split sorts whole windows, and a fit reads them five times: on disk they are sorted once.
    train = train.select("vector", "terrain_no").persist(StorageLevel.DISK_ONLY)
    try:
        model = fit_forest(train, trees, seed, depth, balanced=False, label="terrain_no")
    finally:
        train.unpersist()
    return model, predicted(model, test).withColumn("label", F.col("terrain_no").cast("int"))


def leave_one_flight_out(windows: DataFrame, per_terrain: int | None = None, trees: int = 100, depth: int = 15,
                         at_once: int = 4) -> DataFrame:
    """Pooled predictions; every flight is predicted by a forest fitted on all the others.

    There is a fit for each flight; ``at_once`` of them run side by side, so that one fit's last tasks do not leave the
    cluster idle. A fold's predictions are written when it is done and its forest forgotten, so that neither plan nor
    driver grows with the flights. ``per_terrain`` keeps only the windows of so many first flights per terrain.
    """
    windows = windows.filter(F.col("flight_id").isNotNull())
    if per_terrain is not None:
        chosen = first_flights(windows.select("terrain", *KEYS).distinct(), "terrain", per_terrain)
        windows = windows.join(F.broadcast(chosen.select(*KEYS).distinct()), list(KEYS), "left_semi")
    data = settled(windows)
    # One value per flight, sorted by the cluster; the rows of a fold are never collected.
    folds = [r["flight_id"] for r in data.select(*KEYS).distinct().orderBy(*KEYS).collect()]
    if not folds:
        return data.withColumns({"anom_proba": F.lit(None).cast("double"), "prediction": F.lit(None).cast("double")})
    folder = f"{shared_folder(data)}/folds-{uuid.uuid4().hex}"

    def fold(numbered) -> T.StructType:
        number, flight = numbered
        model = fit_forest(data.filter(F.col("flight_id") != F.lit(flight)), trees, depth=depth)
        told = predicted(model, data.filter(F.col("flight_id") == F.lit(flight)))
        told.write.parquet(f"{folder}/{number:09d}")
        return told.schema

    with ThreadPoolExecutor(at_once) as pool:
        schema = list(pool.map(fold, enumerate(folds)))[0]
    return data.sparkSession.read.schema(schema).parquet(f"{folder}/*")


def pool_report(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report by class and points of the ROC curve of pooled predictions."""
    kept = settled(pool.select("label", "prediction", "anom_proba"))
    return class_report(confusion(kept)), roc_points(kept, "anom_proba")


def probability_trace(windows: DataFrame, flight, trees: int = 100, depth: int = 15) -> DataFrame:
    """Probabilities of one flight by a model trained on all others, at window centres."""
    model = fit_forest(windows.filter(F.col("flight_id") != flight), trees, depth=depth, balanced=False)
    return predicted(model, windows.filter(F.col("flight_id") == flight)).select(
        *KEYS, "win", F.col("centre_s").alias("time_s"), "anom_proba", "label")


def middle(values: Column) -> Column:
    """Median of an array without nulls; of none, null."""
    ordered, n = F.sort_array(values), F.size(values)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)


def scoring_windows(df: DataFrame, features: Sequence[str] = FEATURES, extra: Sequence[Column] = ()) -> DataFrame:
    """Windows with what scoring needs: tensor, median position, last row's gate inputs."""
    rows = df if "label" in df.columns else df.withColumn("label", F.lit(0))
    at_end = lambda c: F.max(F.when(F.col("pos") == WINDOW_LENGTH - 1, F.col(c))).alias(f"last_{c}")
    # A window has few rows: their values travel as a list, which costs less than a median's table of counts.
    medians = {"lat_med": "lat_deg", "lon_med": "lon_deg", "alt_med": "alt_m"}
    windows = window_dataset(rows, features, extra=(
        *[F.collect_list(F.col(c).cast("double")).alias(m) for m, c in medians.items()],
        at_end("armed"), at_end("rel_alt_m"), at_end("vel_m_s"), *extra))
    return windows.withColumns({m: middle(F.col(m)) for m in medians})


NEURAL = ":nn"


def model_registry(spark, models: dict[str, PipelineModel]) -> DataFrame:
    """The fitted models as rows for routing: terrain, model_type (rf or nn), available."""
    rows = [(name.removesuffix(NEURAL), "nn" if name.endswith(NEURAL) else "rf", True) for name in models]
    return spark.createDataFrame(rows, "terrain string, model_type string, available boolean")


def routed_model(rows: DataFrame, models: dict[str, PipelineModel], default: str, at_home: Column | None = None,
                 preferred: str = "rf") -> DataFrame:
    """Which model each row's ``active`` terrain is routed to: ``model`` is a name of ``models``, ``area`` at home, or
    null. Without any model this fails at once."""
    if not models and at_home is None:
        raise ValueError("no fitted model to score with")
    routes = route(model_registry(rows.sparkSession, models), default, preferred)
    routed = rows.join(F.broadcast(routes), "active", "left")
    name = F.concat("model_terrain", F.when(F.col("model_type") == "nn", NEURAL).otherwise(""))
    return routed.withColumn("model", name if at_home is None else F.when(at_home, F.lit("area")).otherwise(name))


def by_routed_model(rows: DataFrame, models: dict[str, PipelineModel], default: str, at_home: Column,
                    area: PipelineModel | None, preferred: str = "rf") -> DataFrame:
    """Predictions of the model that each row's ``active`` terrain is routed to, or of the area model at home.

    A row that no model fits keeps a null probability and a null ``model``; without any model this fails at once.
    """
    routed = routed_model(rows, models, default, at_home if area else None, preferred)
    parts = routed.filter("model IS NULL").withColumns({"anom_proba": F.lit(None).cast("double"),
                                                        "prediction": F.lit(None).cast("double")})
    for name, model in [*models.items(), *([("area", area)] if area else [])]:
        part = predicted(model, routed.filter(F.col("model") == name), name.endswith(NEURAL))
        parts = parts.unionByName(part.select(parts.columns))
    return parts


def score_flights(df: DataFrame, models: dict[str, PipelineModel], elevations: DataFrame,
                  default: str = "flat", threshold: float = 0.5,
                  area: tuple[PipelineModel, tuple[float, float, float, float]] | None = None,
                  smoothing: float = 0.3, preferred: str = "rf", use_home: bool = False) -> DataFrame:
    """Windows scored by the model of the debounced terrain, gated and smoothed per flight.

    ``area`` is a model and its box; a window belongs to it by its median position, or, with ``use_home``, by
    the place where its flight begins. Windows that no model fits stay, with a null probability.
    """
    windows = scoring_windows(df)
    spots = windows.withColumns({"lat_deg": F.col("lat_med"), "lon_deg": F.col("lon_med"),
                                 "alt_m": F.col("alt_med"), "time_s": F.col("start_s")})
    placed = with_elevation(spots, elevations).withColumn("terrain", terrain_of(F.col("elevation")))
    axis = row_axis(placed, "win")
    active = settled(debounce(placed, "terrain", default=default, order="win", axis=axis))
    if use_home and area:
        w0 = active.filter("win = 0").select(*KEYS, F.col("lat_med").alias("_lat"), F.col("lon_med").alias("_lon"))
        active = join_facts(active, w0)
    place = ("_lat", "_lon") if use_home and area else ("lat_med", "lon_med")
    here = F.coalesce(in_box(F.col(place[0]), F.col(place[1]), *area[1]), F.lit(False)) if area else F.lit(False)
    parts = by_routed_model(active, models, default, here, area[0] if area else None, preferred)
    gated = parts.withColumn("raw_proba", ground_gate(F.col("last_armed"), F.col("last_rel_alt_m"),
                                                      F.col("last_vel_m_s"), F.col("anom_proba")))
    slim = gated.select(*KEYS, "win", F.col("model_terrain").alias("terrain"),
                        "model", "model_type", "raw_proba", "switched", "label")
    smoothed = smooth(slim, "raw_proba", smoothing, out="anom_proba", order="win", axis=row_axis(slim, "win"))
    return smoothed.select(
        *KEYS, F.col("win").alias("window_idx"), (F.col("win") * WINDOW_STRIDE).alias("start_row"),
        (F.col("win") * WINDOW_STRIDE + WINDOW_LENGTH - 1).alias("end_row"), "terrain", "model", "model_type",
        F.round("anom_proba", 6).alias("anom_proba"), alert(F.col("anom_proba"), threshold).alias("is_anomaly"),
        (F.col("switched") == 1).alias("switched_terrain"), "label")


def registry_info(registry: DataFrame, default: str = "flat", preferred: str = "rf") -> DataFrame:
    """Per active terrain: the model used, its scores, and whether it is a stand-in."""
    chosen = route(registry, default, preferred)
    facts = registry.select(F.col("terrain").alias("model_terrain"), "model_type", "rf_val_f1", "cnn_val_f1",
                            F.col("n_train").alias("n_training_windows"))
    return chosen.join(facts, ["model_terrain", "model_type"], "left")
