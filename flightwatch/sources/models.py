"""Fitted models and their registry on shared storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BOX = "struct<lat_min: double, lat_max: double, lon_min: double, lon_max: double>"


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_models(path: str, names: list[str]) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{path}/{name}") for name in names}


def save_registry(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Training summary plus, for area models, a ``bbox`` struct; one row per model."""
    summary.write.mode(mode).parquet(f"{path}/registry")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/registry")


def area_entry(spark: SparkSession, name: str, box: tuple[float, float, float, float], n_train: int,
               accuracy: float) -> DataFrame:
    lat_min, lat_max, lon_min, lon_max = box
    return spark.range(1).select(
        F.lit(name).alias("terrain"), F.lit("area").alias("model_type"), F.lit(n_train).cast("long").alias("n_train"),
        F.lit(accuracy).alias("accuracy"),
        F.struct(F.lit(lat_min).alias("lat_min"), F.lit(lat_max).alias("lat_max"), F.lit(lon_min).alias("lon_min"),
                 F.lit(lon_max).alias("lon_max")).alias("bbox"))
