"""Summaries of cleaning, labels, data sets and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwatch.operators.timeline import CHUNK, KEYS
from flightwatch.schema import TERRAINS


def value_counts(df: DataFrame, columns: Sequence[str] = ("mode", "failsafe", "armed")) -> DataFrame:
    """Counts per flight, column and value; missing values counted as null."""
    present = [c for c in columns if c in df.columns]
    return (df.select(*KEYS, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in present]))
        .alias("_x")).select(*KEYS, "_x.*").groupBy(*KEYS, "column", "value")
        .agg(F.count(F.lit(1)).alias("n")))


def cleaning_summary(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows in / out / removed and time span; flights that lost all rows stay, with nulls."""
    before = raw.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("initial_rows"))
    columns = [c for c in cleaned.columns if c not in (*KEYS, CHUNK)]
    after = cleaned.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("final_rows"), F.min("time_s").alias("time_start_s"),
        F.max("time_s").alias("time_end_s"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns])
    kept = F.coalesce("final_rows", F.lit(0)).cast("long")
    return before.join(after, list(KEYS), "left").select(
        *KEYS, "initial_rows", kept.alias("final_rows"), (F.col("initial_rows") - kept).alias("rows_removed"),
        "time_start_s", "time_end_s", (F.col("time_end_s") - F.col("time_start_s")).alias("duration_s"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[
            F.coalesce(F.col(f"_null_{c}"), F.lit(0)).cast("long") for c in columns])).alias("missing_after_cleaning"))


def cleaning_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The summary with the value counts as maps, one row per flight."""
    counts = value_counts(cleaned).withColumn("value", F.coalesce("value", F.lit("null")))
    maps = counts.groupBy(*KEYS).agg(*[
        F.map_from_entries(F.sort_array(F.collect_list(
            F.when(F.col("column") == c, F.struct("value", "n"))))).alias(f"{c}_counts")
        for c in ("mode", "failsafe", "armed")])
    return cleaning_summary(raw, cleaned).join(maps, list(KEYS), "left")


def dropped_positives(raw: DataFrame, cleaned: DataFrame, truth: str = "label") -> DataFrame:
    """Positive rows lost by cleaning, per flight."""
    count = lambda df, name: df.groupBy(*KEYS).agg(F.count_if(F.col(truth) == 1).alias(name))
    return (count(raw, "positives_in").join(count(cleaned, "positives_out"), list(KEYS), "left")
            .withColumn("positives_dropped", F.col("positives_in") - F.coalesce("positives_out", F.lit(0))))


def label_distribution(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))


def anomaly_share(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("anomalies"),
                                 (F.avg("label") * 100).alias("anomaly_pct"))


def dataset_info(split_windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per split: windows, start of its first window, end of its last, label counts."""
    return split_windows.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("start_s", "ordinal").alias("first_start_s"),
        F.max_by("end_s", "ordinal").alias("last_end_s"),
        F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label") == 1).alias("label_1"))


def probability_by_terrain(scores: DataFrame, probability: str = "anom_proba") -> DataFrame:
    return scores.groupBy("terrain").agg(F.avg(probability).alias("mean_anom_proba"))


def probability_by_class(scores: DataFrame, probability: str = "anom_proba", label: str = "label") -> DataFrame:
    return scores.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("windows"), F.avg(probability).alias("mean_proba"))


def training_summary(trained: DataFrame) -> DataFrame:
    """Adds ``is_default``: most windows, first terrain on ties. One row per terrain in."""
    rank = F.create_map(*[x for i, t in enumerate(TERRAINS) for x in (F.lit(t), F.lit(i))])[F.col("terrain")]
    usable = trained.filter("status <> 'skip'")
    best = usable.agg(F.min(F.struct((-F.col("n_windows")).alias("n"), rank.alias("r"),
                                     F.col("terrain").alias("t")))["t"].alias("terrain"))
    return trained.join(best.withColumn("_best", F.lit(1)), "terrain", "left").withColumn(
        "is_default", F.coalesce("_best", F.lit(0))).drop("_best")


def attack_interval(df: DataFrame, label: str = "label") -> DataFrame:
    hit = F.when(F.col(label) == 1, F.col("time_s"))
    return (df.groupBy(*KEYS).agg(F.min(hit).alias("attack_start_s"), F.max(hit).alias("attack_end_s"))
            .filter("attack_start_s IS NOT NULL"))


def corpus_totals(reports: DataFrame) -> DataFrame:
    """Rows in and out per family of source files."""
    stem = F.regexp_extract("input_file", "([^/]+)$", 1)
    family = F.when(stem.startswith("gps_log"), "recorded").otherwise(F.regexp_extract(stem, "^([a-z]+)_", 1))
    return (reports.groupBy(family.alias("family")).agg(
        F.count(F.lit(1)).alias("flights"), F.sum("initial_rows").alias("rows_in"),
        F.sum("final_rows").alias("rows_out")))
