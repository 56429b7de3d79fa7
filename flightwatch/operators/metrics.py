"""Classification metrics from counts; ranking metrics from distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwatch.operators.timeline import CHUNK, running_sum, settled, whole_sum, with_prefix


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_report(matrix: DataFrame) -> DataFrame:
    """Per class precision, recall, f1, support; 0 where a ratio is undefined."""
    sides = matrix.select("n", F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))),
        (F.col("label") == F.col("prediction")).alias("_hit"))
    totals = sides.groupBy("class").agg(
        F.sum(F.col("n") * F.col("t")).alias("support"), F.sum(F.col("n") * F.col("p")).alias("_predicted"),
        F.coalesce(F.sum(F.when(F.col("_hit"), F.col("n") * F.col("t"))), F.lit(0)).alias("_hits"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    scored = totals.withColumns({"precision": ratio(F.col("_hits"), F.col("_predicted")),
                                 "recall": ratio(F.col("_hits"), F.col("support"))})
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"),
                                         F.col("precision") + F.col("recall"))
                             ).select("class", "precision", "recall", "f1", "support")


def overall_report(matrix: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted averages, and Cohen's kappa, in one row.

    Works on the matrix (classes squared rows), never on the scored rows.
    """
    per_class = class_report(matrix)
    w = F.sum("support")
    averages = per_class.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * F.col("support")) / w).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])
    total = F.sum("n")
    observed = matrix.agg((F.coalesce(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n"))), F.lit(0))
                           / total).alias("accuracy"), total.alias("n"))
    margins = (matrix.select("n", F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))))
        .groupBy("class").agg(F.sum(F.col("n") * F.col("t")).alias("a"), F.sum(F.col("n") * F.col("p")).alias("b")))
    chance = margins.agg((F.sum(F.col("a").cast("double") * F.col("b")) / (F.sum("a").cast("double") * F.sum("a")))
                         .alias("_chance"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    joined = one(observed).join(one(averages), "_one").join(one(chance), "_one")
    return joined.withColumn("kappa", F.coalesce(F.try_divide(
        F.col("accuracy") - F.col("_chance"), 1 - F.col("_chance")), F.lit(0.0))).drop("_one", "_chance")


def roc_points(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score, highest first: true and false positives so far.

    Rows collapse to distinct scores before anything is ordered. These are dealt into ranges by sampled bounds, so
    that scores crowding in a narrow band spread as well as any others; sums run inside a range, and only one row
    per range is ordered globally. Scores that are null count as no score and are left out.
    """
    counts = settled(df.select(F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("_y"))
                     .filter("score IS NOT NULL").groupBy("score")
                     .agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
                     .withColumn("_down", -F.col("score")))
    ranged = settled(counts.repartitionByRange("_down").withColumn(CHUNK, F.spark_partition_id()))
    return with_prefix(ranged, {
        "tp": running_sum(F.col("pos")), "fp": running_sum(F.col("neg")),
        "positives": whole_sum(F.col("pos")), "negatives": whole_sum(F.col("neg"))},
        order="_down", keys=()).drop("_down", CHUNK)


def ranking_report(points: DataFrame) -> DataFrame:
    """Area under the ROC curve (trapezoids) and average precision."""
    before_tp = F.col("tp") - F.col("pos")
    strip = F.col("neg") * (F.col("tp") + before_tp) / 2.0
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return points.agg(
        F.try_divide(F.sum(strip), (F.max("positives") * F.max("negatives")).cast("double")).alias("auc"),
        F.try_divide(F.sum(step), F.max("positives").cast("double")).alias("average_precision"))


def detection_rates(df: DataFrame, alert: str = "alert") -> DataFrame:
    """Share of alerts per attack profile and intensity."""
    return df.groupBy("profile", "intensity").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(alert).cast("double")).alias("detection_rate"))
