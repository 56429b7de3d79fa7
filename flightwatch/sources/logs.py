"""Readers and writers of logs, labels, segments, reports and scores.

A file is a flight: ``flight_id`` is the file's stem without the stage suffix, or the value of
a ``flight_id=`` folder above it, which is how the writers here lay files out.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightwatch.functions.modes import number
from flightwatch.operators.clean import coerce_numbers, strip_text
from flightwatch.operators.timeline import CHUNK, KEYS, with_chunk
from flightwatch.schema import (
    CLEANING_REPORT_SCHEMA, NUMERIC_COLUMNS, OLD_SENSOR_COLUMNS, RAW_COLUMNS, SCORE_LOG_COLUMNS, SEGMENT_SCHEMA)

STAGE_SUFFIX = "((_cleaned)+|_labels|_auto_segments|_cleaning_report)?\\.(csv|json)$"


def flight_of(file_path: Column) -> Column:
    folder = F.regexp_extract(file_path, "/flight_id=([^/]+)/", 1)
    stem = F.regexp_replace(F.substring_index(file_path, "/", -1), STAGE_SUFFIX, "")
    return F.when(folder != "", folder).otherwise(stem)


def _layouts(spark: SparkSession, path: str, pattern: str, recursive: bool) -> dict[str, list[str]]:
    """Files by their header line; as many entries as files, like Spark's own file index."""
    lines = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(path)
             .select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_at")))
    heads = (lines.filter("_block = 0").groupBy("file_path").agg(F.min_by("value", "_at").alias("head"))
             .filter(F.length(F.trim("head")) > 0).collect())
    out: dict[str, list[str]] = {}
    for r in heads:
        out.setdefault(r["head"].lstrip("\ufeff"), []).append(r["file_path"])
    return out


def _text_csv(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    """All columns as text, names trimmed, matched by name: files of one header are read together, and a
    column that a file does not have is null there. Empty files give no rows."""
    found = None
    for head, files in sorted(_layouts(spark, path, pattern, recursive).items()):
        names = [n.strip() for n in next(csv.reader([head]))]
        names = [n or f"_c{i}" for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        # Folder names are no columns here: flights are told by the file's path.
        rows = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
                .schema(schema).csv([unquote(f) for f in files]))
        rows = rows.select(*names, F.col("_metadata.file_path").alias("file_path"),
                           F.col("_metadata.file_block_start").alias("_block"))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        raise ValueError(f"no files {pattern} with a header in {path}")
    return found


def read_logs(spark: SparkSession, path: str, pattern: str = "*.csv", recursive: bool = True,
              skip: str | None = None) -> DataFrame:
    """Telemetry of any layouts, by column name: numbers coerced, text stripped, ``row_no`` in file order.

    ``skip`` leaves out files whose path contains the text.
    """
    rows = _text_csv(spark, path, pattern, recursive)
    if skip:
        rows = rows.filter(~F.col("file_path").contains(skip))
    # Rows count up inside a task's input, and a later block of a file starts at a later byte
    # than rows can be counted before it.
    in_task = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = rows.withColumns({"flight_id": flight_of(F.col("file_path")), "row_no": F.col("_block") + in_task})
    return strip_text(coerce_numbers(numbered.drop("_block", "file_path"), [*NUMERIC_COLUMNS, *OLD_SENSOR_COLUMNS]))


def read_mixed_logs(spark: SparkSession, path: str, columns: Sequence[str] = tuple(RAW_COLUMNS),
                    pattern: str = "*.csv") -> DataFrame:
    """Exactly ``columns`` of files of differing layout; absent ones are null."""
    rows = read_logs(spark, path, pattern)
    numeric = {*NUMERIC_COLUMNS, *OLD_SENSOR_COLUMNS}
    return rows.select("flight_id", "row_no", *[
        F.col(c) if c in rows.columns else F.lit(None).cast("double" if c in numeric else "string").alias(c) for c in columns])


def read_labels(spark: SparkSession, path: str, pattern: str = "*_labels.csv") -> DataFrame:
    """Label files of flights. A file named SHARED_LABELS stands for the flights of its folder that have none
    of their own: its rows carry no flight but ``folder``, see ``labels_with_fallback``."""
    rows = _text_csv(spark, path, pattern, True)
    extra = [F.trim("log_name").alias("log_name")] if "log_name" in rows.columns else []
    reason = [F.col("anomaly_reason")] if "anomaly_reason" in rows.columns else []
    return rows.select(flight_of(F.col("file_path")).alias("flight_id"), number(F.col("time_s")).alias("time_s"),
                       F.trim("label").try_cast("int").alias("label"), *reason, *extra)


# Fixed value: the name of a label file without a flight in it.
SHARED_LABELS = "row_labels_auto.csv"


def labels_with_fallback(spark: SparkSession, logs_path: str, pattern: str = "*_cleaned.csv") -> DataFrame:
    """Labels of every log in a tree: its own label file, else the shared one in its folder, else none.

    Returns ``flight_id, time_s, label, label_file``; flights without either are left out.
    """
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
             .load(logs_path).select(F.col("path").alias("file_path")))
    flights = (files.filter(F.substring_index("file_path", "/", -1).rlike(pattern.replace(".", "\\.").replace("*", ".*") + "$"))
               .select(flight_of(F.col("file_path")).alias("flight_id"), folder.alias("folder")).distinct())
    name = F.substring_index("file_path", "/", -1)
    own = (files.filter(name.endswith("_labels.csv")).select(flight_of(F.col("file_path")).alias("flight_id"),
                                                            folder.alias("folder"), F.lit(True).alias("_own")).distinct())
    rows = (_text_csv(spark, logs_path, "*label*.csv", True)
            .select("file_path", folder.alias("folder"), name.alias("label_file"), number(F.col("time_s")).alias("time_s"),
                    F.trim("label").try_cast("int").alias("label")))
    mine = (rows.filter(F.col("label_file").endswith("_labels.csv"))
            .select(flight_of(F.col("file_path")).alias("flight_id"), "time_s", "label", "label_file"))
    needy = flights.join(own, ["flight_id", "folder"], "left").filter("_own IS NULL").select("flight_id", "folder")
    shared = rows.filter(F.col("label_file") == SHARED_LABELS).join(needy, "folder")
    return mine.unionByName(shared.select("flight_id", "time_s", "label", "label_file"))


def read_segments(spark: SparkSession, path: str, pattern: str = "*_auto_segments.json",
                  lines: bool = False) -> DataFrame:
    """Arrays of segments, or one per line; the label stays text because it may be a word."""
    return (spark.read.schema(SEGMENT_SCHEMA).option("multiLine", not lines).option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).json(path)
            .select(flight_of(F.col("_metadata.file_path")).alias("flight_id"), "start_s", "end_s", "label", "reason",
                    (F.lower(F.trim(F.col("label").cast("string"))) == "ignore").alias("ignored")))


def read_cleaning_reports(spark: SparkSession, path: str, pattern: str = "*_cleaning_report.json",
                          lines: bool = False) -> DataFrame:
    return (spark.read.schema(CLEANING_REPORT_SCHEMA).option("multiLine", not lines).option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).json(path)
            .select(flight_of(F.col("_metadata.file_path")).alias("flight_id"), "*"))


def report_counts(reports: DataFrame, column: str = "mode_counts") -> DataFrame:
    return reports.select("flight_id", F.explode(column).alias("value", "n"))


_LABELS = "map<string, bigint>"
DATASET_INFO_SCHEMA = ("terrain_type string, status string, window_len bigint, stride bigint, num_features bigint, "
                       "feature_names array<string>, n_total_windows bigint, n_train bigint, n_val bigint, n_test bigint, "
                       f"label_dist struct<train: {_LABELS}, val: {_LABELS}, test: {_LABELS}, all: {_LABELS}>, "
                       "rf_val_accuracy double, rf_val_f1 double, cnn_val_accuracy double, cnn_val_f1 double, cnn_status string")
TRAINING_REPORT_SCHEMA = ("generated_at string, total_source_csvs bigint, terrain_summary map<string, struct<n_windows: bigint, "
                          "rf_val_f1: double, cnn_val_f1: double, status: string>>, recommended_default_model string")
AREA_MODEL_SCHEMA = ("n_windows bigint, n_train bigint, n_test bigint, accuracy double, "
                     "bbox struct<lat_min: double, lat_max: double, lon_min: double, lon_max: double>")


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def terrain_registry(training_report: DataFrame) -> DataFrame:
    """One row per terrain of a training report, as model routing expects it."""
    return training_report.select(F.explode("terrain_summary").alias("terrain", "s")).select(
        "terrain", F.lit("rf").alias("model_type"), (F.col("s.status") != "skip").alias("available"),
        "s.rf_val_f1", "s.cnn_val_f1", F.col("s.n_windows").alias("n_train"))


def read_elevations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The elevation cache: JSON objects "lat_lon" -> metres, as key columns.

    A file is one object, however it is broken into lines; with ``lines`` each line is one, so that a large cache
    is read by many tasks.
    """
    entries = (spark.read.option("wholetext", not lines).text(path)
               .select(F.explode(F.from_json("value", "map<string, double>")).alias("key", "elevation")))
    part = lambda i: F.bround(F.split("key", "_")[i].cast("double") * 10000).cast("long")
    return entries.select(part(0).alias("lat_key"), part(1).alias("lon_key"), "elevation")


def write_elevations(cells: DataFrame, path: str, per_line: int = 1000, mode: str = "overwrite") -> None:
    """``lat, lon, elevation`` as a cache of JSON lines with about ``per_line`` cells each."""
    count = cells.count()
    line = F.pmod(F.xxhash64("lat", "lon"), F.lit(max(1, -(-count // per_line))))
    entry = F.struct(F.format_string("%.4f_%.4f", "lat", "lon"), "elevation")
    (cells.groupBy(line.alias("_line")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
     .select("value").write.mode(mode).text(path))


def read_scores(spark: SparkSession, path: str, latest_only: bool = False, pattern: str = "live_*.csv",
                numbers: Sequence[str] = ("unix_time", "anom_proba")) -> DataFrame:
    """Scoring logs; unreadable values become null, absent or empty files give no rows.

    ``latest_only`` reads the file with the greatest name and no other: names are listed without opening files,
    and a filter on the name prunes the scan.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in SCORE_LOG_COLUMNS])
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return _typed_scores(spark.createDataFrame([], T.StructType([*schema, T.StructField("file_name", T.StringType())])), numbers)
    rows = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("pathGlobFilter", pattern).csv(path))
    if latest_only:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
        newest = listed.agg(F.max(F.substring_index("path", "/", -1))).first()[0]
        rows = rows.filter(F.col("_metadata.file_name") == F.lit(unquote(newest or "")))
    return _typed_scores(rows.select("*", F.col("_metadata.file_name").alias("file_name")), numbers)


def _typed_scores(rows: DataFrame, numbers: Sequence[str]) -> DataFrame:
    text = ("timestamp", "terrain", "model_type", "file_name")
    return rows.select(*[
        F.try_to_timestamp(F.col(c)).alias(c) if c == "timestamp" else
        F.col(c) if c in text else number(F.col(c)).alias(c) for c in rows.columns])


REPLAY_NUMBERS = ("unix_time", "anom_proba", "alt_m", "rel_alt_m", "vel_m_s")


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    return read_scores(spark, path, pattern="*.csv", numbers=REPLAY_NUMBERS)


def write_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by flight, in time order inside every file.

    Rows are spread by (flight, chunk), so a long flight is written by many tasks.
    """
    keys = [*KEYS, CHUNK] if CHUNK in df.columns else list(KEYS)
    (df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "time_s").drop(CHUNK)
     .write.mode(mode).partitionBy(*KEYS).parquet(path))


def write_rows_bucketed(df: DataFrame, table: str, buckets: int = 512, path: str | None = None) -> None:
    """Table bucketed by (flight, chunk): later ordered operators read it without moving its rows.

    Rows go to their bucket first, so there is one file per bucket; ``path`` makes it an external table there.
    """
    rows = with_chunk(df)
    writer = (rows.repartition(buckets, *KEYS, CHUNK).write.mode("overwrite").bucketBy(buckets, *KEYS, CHUNK)
              .sortBy(*KEYS, CHUNK, "time_s").format("parquet"))
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_labels(labelled: DataFrame, path: str, mode: str = "overwrite") -> None:
    (labelled.select(*KEYS, "time_s", "label",
                     F.concat_ws("", F.transform("reasons", lambda t: F.concat(t, F.lit(";")))).alias("anomaly_reason"))
     .write.mode(mode).partitionBy(*KEYS).option("header", True).csv(path))


def write_segments(segs: DataFrame, path: str, mode: str = "overwrite") -> None:
    segs.write.mode(mode).partitionBy(*KEYS).json(path)


def write_windows(split_windows: DataFrame, path: str, mode: str = "overwrite") -> None:
    split_windows.write.mode(mode).partitionBy("split").parquet(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.write.mode(mode).json(path)


def log_format(scores: DataFrame) -> DataFrame:
    """Scores as the 17 text columns of the log, with fixed numbers of decimals."""
    # Decimals of each column.
    decimals = {"unix_time": 3, "anom_proba": 6, "lat_deg": 7, "lon_deg": 7, "alt_m": 3, "rel_alt_m": 3, "vel_m_s": 3,
                "roll_deg": 2, "pitch_deg": 2, "yaw_deg": 2, "rollspeed": 4, "pitchspeed": 4, "yawspeed": 4}
    return scores.select(*[
        F.format_string(f"%.{decimals[c]}f", F.col(c).cast("double")).alias(c) if c in decimals else
        F.col(c).cast("int").cast("string").alias(c) if c == "switched_terrain" else F.col(c).cast("string").alias(c)
        for c in SCORE_LOG_COLUMNS])
