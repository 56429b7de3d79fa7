"""Streaming queries run to the end of their input and compared with their batch twins."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from flightwatch.operators import learning as L
from flightwatch.operators.terrain import terrain_of
from flightwatch.operators.timeline import CHUNK, join_facts, settled, shared_folder, with_halo, without_halo
from flightwatch.plans.catalog import ORACLES, query, r6, raw, sql
from flightwatch.plans.score_queries import _CALLS, _MESSAGES_SQL, _messages
from flightwatch.plans.model_queries import DEPTH, TREES, _windows
from flightwatch.schema import FEATURES
from flightwatch.streaming import live
from flightwatch.streaming.state import Flights

#: The span of time is cut into so many arrivals at least, each of so many files; a file has so many rows at most.
SLICES = 3
FILES = 8
FILE_ROWS = 125_000
#: Rows are up to so many seconds late; streams hold them back for longer.
JITTER_S = 1.0
#: Width of a range of scores; wider than how far two equal ones may lie apart.
_NEAR = 1e-5


def _arrive(df: DataFrame, jitter_s: float = JITTER_S, slices: int = SLICES, closing: bool = True) -> DataFrame:
    """The rows as a stream of files, each row up to ``jitter_s`` later than its instant, in no order within a file.

    With ``closing`` the last file holds one row of no flight, a day later: it moves the watermark past all others.
    """
    spark, folder = df.sparkSession, f"{shared_folder(df)}/arrivals-{uuid.uuid4().hex}"
    span = df.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if span["n"]:
        slices = max(slices, -(-span["n"] // (FILES * FILE_ROWS)))
        chance = F.xxhash64(*df.columns)
        late = F.pmod(chance, F.lit(round(jitter_s * 1e6) + 1))
        width = (span["b"] + round(jitter_s * 1e6) - span["a"]) // slices + 1
        # All slices at once, a file in a folder of its own; a file arrives when it was last modified.
        (df.withColumn("_slice", F.floor((F.unix_micros("ts") + late - span["a"]) / width).cast("int"))
         .withColumn("_file", F.pmod(F.shiftright(chance, 32), F.lit(FILES)).cast("int"))
         .repartition(slices * FILES, "_slice", "_file").write.partitionBy("_slice", "_file").parquet(folder))
        folder = _in_turn(df, folder, slices)
        end = spark.range(1).select(*[F.timestamp_micros(F.lit(span["b"] + 86_400_000_000)).alias(c) if c == "ts"
                                      else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        if closing:
            end.write.parquet(f"{folder}/_slice={slices}/_file=0")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(folder).select(*df.columns)


def _dated(spark: SparkSession, folder: str, slices: int) -> bool:
    """Sets the times of slices one after another; whether the store kept them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    # Whole seconds: stores may keep no finer ones.
    start, files, kept = (int(time.time()) - slices) * 1000, store.listFiles(root, True), True
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().endswith(".parquet"):
            at = start + 1000 * int(path.toString().split("_slice=")[1].split("/")[0])
            store.setTimes(path, at, -1)
            kept = kept and store.getFileStatus(path).getModificationTime() == at
    return kept


def _in_turn(df: DataFrame, folder: str, slices: int) -> str:
    """The folder with its slices modified one after another; a copy of it where a store has no such times to set."""
    if _dated(df.sparkSession, folder, slices):
        return folder
    cut = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField("_slice", T.IntegerType()), T.StructField("_file", T.IntegerType())])).parquet(folder)
    for i in range(slices):
        part = cut.filter(F.col("_slice") == i).select(*df.columns)
        part.repartition(FILES).write.parquet(f"{folder}-in-turn/_slice={i}/_file=0")
        time.sleep(0.01)
    return f"{folder}-in-turn"


def _to_the_end(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Run a stream until its input is read.

    A micro-batch has a task for every partition of state, however little is in it, and each reports to the driver;
    they are fixed for a checkpoint and never coalesced. So there are no more of them than cores.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        running = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    running.awaitTermination()


def _finish(stream: DataFrame) -> DataFrame:
    folder = f"{shared_folder(stream)}/stream-{uuid.uuid4().hex}"
    _to_the_end(stream.writeStream.format("parquet").option("path", f"{folder}/rows")
                .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append"), stream.sparkSession)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def _timed(spark, sf):
    return raw(spark, sf).withColumn("ts", F.timestamp_millis(
        F.lit(1777593600000) + F.round(F.col("time_s") * 1000).cast("long")))


@query("t01_held_values_stream", ORACLES["j06_p22_hold_last"])
def t01(spark, sf):
    held = _finish(live.held_values(_arrive(_messages(spark, sf))))
    return held.filter("msg_type = 'GLOBAL_POSITION_INT'").select(
        "flight_id", F.unix_millis("ts").alias("ms"), F.round("lat_deg", 7).alias("lat_deg"), "satellites_visible", r6("eph_m"),
        r6("rollspeed_radps"), "armed", r6("hdg_deg"))


@query("t02_resampled_stream", ORACLES["t02_t11_resampled_rows"])
def t02(spark, sf):
    rows = settled(_finish(live.resampled(_arrive(_messages(spark, sf)), hz=4.0, max_age_s=0.05, idle_s=5.0)))
    # The grid of the batch twin ends with a flight's last message, the stream's when the flight is idle.
    ends = rows.groupBy("flight_id").agg(F.max("seen_ts").alias("_end"))
    return join_facts(rows, ends).filter("ts <= _end").select(
        "flight_id", "time_s", F.round("lat_deg", 7).alias("lat_deg"), r6("rollspeed_radps"), "stale")


@query("t12_late_rows", sql(None, """
 SELECT flight_id, seq, CAST(seq % 97 = 50 AND seq BETWEEN 98 AND 399 AS INTEGER) AS late, CASE WHEN NOT (seq % 97 = 50 AND seq BETWEEN 98 AND 399) THEN
   ROUND(sum(CASE WHEN seq % 97 = 50 AND seq BETWEEN 98 AND 399 THEN 0 ELSE score END) OVER (PARTITION BY flight_id ORDER BY seq), 6) END AS total FROM telemetry"""))
def t12(spark, sf):
    """Every 97th row arrives thirty seconds after its time: flagged, and without effect on the running total."""
    rows = _timed(spark, sf).select("flight_id", "seq", "ts", "score")
    straggles = (F.col("seq") % 97 == 50) & F.col("seq").between(98, 399)
    arrivals = _arrive(rows.withColumn("_due", F.col("ts")).withColumn(
        "ts", F.when(straggles, F.col("ts") + F.expr("INTERVAL 30 SECONDS")).otherwise(F.col("ts"))), slices=8)
    # The instant that counts is the one a row was made at; the end of input keeps its own.
    return _finish(live.ordered(arrivals.withColumn("ts", F.coalesce("_due", "ts")).drop("_due"), _TOTAL, "2 seconds")).select(
        "flight_id", "seq", "late", r6("total"))


def _sum_up(rows, memory):
    at = Flights(rows, memory)
    total = np.nan_to_num(at.number_before("total"))[at.number] + rows["score"].groupby(at.number).cumsum()
    return rows.assign(total=total), at.memory(total=total.to_numpy()[at.ends])


_TOTAL = live.Step(_sum_up, [T.StructField("total", T.DoubleType())], T.StructType([T.StructField("total", T.DoubleType())]))


@query("s14_message_lines", sql(None, """
 SELECT flight_id, CAST(epoch_ms(ts) AS BIGINT) AS ms, CASE WHEN reason IS NULL THEN msg_type ELSE 'STATUSTEXT' END AS msg_type, CASE WHEN reason IS NULL THEN lat END AS lat, reason FROM (
   SELECT *, row_number() OVER (PARTITION BY flight_id, msg_type ORDER BY ts) AS nth FROM msgs) m, LATERAL (SELECT CASE
     WHEN nth % 31 = 3 THEN 'unknown type' WHEN nth % 31 = 5 THEN 'bad line' WHEN nth % 31 = 7 THEN 'no instant' END AS reason)
 WHERE reason IS NULL OR reason = 'unknown type'
 UNION ALL SELECT CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), reason, CAST(count(*) AS DOUBLE), reason FROM (
   SELECT CASE WHEN nth % 31 = 5 THEN 'bad line' WHEN nth % 31 = 7 THEN 'no instant' END AS reason
   FROM (SELECT row_number() OVER (PARTITION BY flight_id, msg_type ORDER BY ts) AS nth FROM msgs)) WHERE reason IS NOT NULL GROUP BY reason""", extra=_MESSAGES_SQL))
def s14(spark, sf):
    """Messages as lines of text, some of them broken: the good ones are read, the others kept with the reason."""
    m = settled(_messages(spark, sf)).withColumn("nth", F.row_number().over(Window.partitionBy("flight_id", "msg_type").orderBy("ts")) % 31)
    spoilt = m.withColumns({"msg_type": F.when(F.col("nth") == 3, "STATUSTEXT").otherwise(F.col("msg_type")),
                            "flight_id": F.col("flight_id").cast("string")})
    line = F.to_json(F.struct(*[c for c in spoilt.columns if c != "nth"]))
    folder = f"{shared_folder(m)}/lines-{uuid.uuid4().hex}"
    (spoilt.select(F.when(F.col("nth") == 5, F.substring(line, 1, 20))
                   .when(F.col("nth") == 7, F.regexp_replace(line, '"ts":"[^"]*",', "")).otherwise(line).alias("value")).write.text(folder))
    good = _finish(live.read_messages(spark, folder))
    bad = settled(_finish(live.rejected_messages(spark, folder)))
    own = bad.filter("reason = 'unknown type'").select(
        "flight_id", "ts", "msg_type", F.lit(None).cast("double").alias("lat"), "reason")
    counts = bad.filter("reason <> 'unknown type'").groupBy("reason").agg(F.count(F.lit(1)).cast("double").alias("lat")).select(
        F.lit(None).cast("string").alias("flight_id"), F.lit(None).cast("timestamp").alias("ts"), F.col("reason").alias("msg_type"), "lat", "reason")
    rows = good.select("flight_id", "ts", "msg_type", "lat", F.lit(None).cast("string").alias("reason")).unionByName(own).unionByName(counts)
    return rows.select(F.col("flight_id").cast("long").alias("flight_id"), F.unix_millis("ts").alias("ms"), "msg_type", "lat", "reason")


@query("t04_debounced_stream", ORACLES["w18_debounced_terrain"])
def t04(spark, sf):
    rows = _timed(spark, sf).withColumn("terrain", F.expr(_CALLS)).select("flight_id", "seq", "ts", "terrain")
    return _finish(live.debounced(_arrive(rows))).select("flight_id", "seq", "active", "switched")


@query("t05_smoothed_stream", ORACLES["w19_smoothed_probability"])
def t05(spark, sf):
    return _finish(live.smoothed(_arrive(_timed(spark, sf).select("flight_id", "seq", "ts", "score")), "score")).select(
        "flight_id", "seq", r6("smoothed"))


@query("t06_stale_stream", ORACLES["w20_live_stale_flag"])
def t06(spark, sf):
    return _finish(live.stale(_arrive(_timed(spark, sf).select("flight_id", "seq", "ts", "lat_deg")))).select(
        "flight_id", "seq", "live_stale")


@query("t03_buffered_stream", sql(None, """
 SELECT flight_id, seq, ROUND(s, 6) AS total FROM (
   SELECT flight_id, seq, sum(score) OVER w AS s, count(*) OVER w AS n FROM telemetry
   WINDOW w AS (PARTITION BY flight_id ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE n = 30"""))
def t03(spark, sf):
    rows = _timed(spark, sf).select("flight_id", "seq", "ts", F.array("score").alias("features"))
    return _finish(live.buffered(_arrive(rows))).select(
        "flight_id", "seq", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("t09_t12_message_counts_stream", sql(None, """
 SELECT CAST(epoch_ms(time_bucket(INTERVAL 5 SECONDS, ts)) AS BIGINT) AS ms, msg_type, count(*) AS n
 FROM msgs WHERE time_bucket(INTERVAL 5 SECONDS, ts) + INTERVAL 5 SECONDS <= (SELECT max(ts) FROM msgs) - INTERVAL 5 SECONDS GROUP BY 1, 2""",
                                            extra=_MESSAGES_SQL))
def t09(spark, sf):
    return _finish(live.message_counts(_arrive(_messages(spark, sf), closing=False))).select(
        F.unix_millis("window_start").alias("ms"), "msg_type", "n")


@query("t07_t08_s13_live_scores", sql(None, """
 SELECT flight_id, CAST(epoch_ms(ts) AS BIGINT) AS ms, CAST(vx < 300 AND coalesce(rel_alt, 0) < 5 AS INTEGER) AS gated,
   true AS smooth_ok, true AS alert_ok, true AS logged FROM (
   SELECT flight_id, seq, TIMESTAMP '2026-05-01 00:00:00' + to_milliseconds(seq * 100) AS ts, ROUND(rel_alt_m * 1000) / 1000.0e0 AS rel_alt,
          CASE WHEN seq % 3 = 0 THEN 200 ELSE ROUND(vel_m_s * 100) END AS vx FROM telemetry) WHERE seq >= 29"""))
def t07(spark, sf):
    """Which windows come out, which of them the gate decides, that smoothing follows from one row to the next, and
    that alerts and log have exactly the rows they should."""
    windows = _windows(spark, sf)
    terrains = sorted(r["terrain"] for r in windows.select("terrain").distinct().collect())
    # Side by side, so that one fit's last tasks do not leave the cluster idle.
    with ThreadPoolExecutor(4) as pool:
        models = dict(zip(terrains, pool.map(lambda t: L.fit_forest(windows.filter(F.col("terrain") == t), TREES, depth=DEPTH), terrains)))
    slow = F.unix_millis("ts") % 300 == F.lit(1777593600000 % 300)
    messages = _messages(spark, sf).withColumn("vx", F.when(slow & F.col("vx").isNotNull(), 200.0).otherwise(F.col("vx")))
    folder = f"{shared_folder(messages)}/scores-{uuid.uuid4().hex}"
    stream = live.live_windows(_arrive(messages), default=sorted(models)[0])
    _to_the_end(live.score_stream(stream, models, folder, default=sorted(models)[0]), spark)
    done = settled(spark.read.parquet(f"{folder}/windows").drop("batch"))
    alerts = spark.read.parquet(f"{folder}/alerts").select("flight_id", "ts", F.lit(True).alias("_alert"))
    logged = spark.read.option("header", True).csv(f"{folder}/scores").select(
        (F.col("unix_time").cast("double") * 1000).cast("long").alias("_ms"), F.col("anom_proba").cast("double").alias("_logged")).distinct()
    before = Window.partitionBy("flight_id", CHUNK).orderBy("ts")
    rows = with_halo(done.withColumn("time_s", F.unix_micros("ts") / 1e6), before=1, carry=["time_s", "smoothed", "ts"])
    rows = without_halo(rows.withColumn("_past", F.lag("smoothed").over(before)), drop_chunk=True)
    smooth = F.coalesce(0.3 * F.col("raw_proba") + 0.7 * F.col("_past"), F.col("raw_proba"))
    rows = rows.withColumn("ms", F.unix_millis("ts")).join(alerts, ["flight_id", "ts"], "left")
    rows = _with_logged(rows, logged)
    # A forest of a hundred trees may say 0.01 as well: the gate is told by its inputs and its value together.
    at = lambda f: F.element_at("features", FEATURES.index(f) + 1)
    gated = (F.col("raw_proba") == 0.01) & (at("rel_alt_m") < 5) & (at("vel_m_s") < 3)
    return rows.groupBy(F.col("flight_id").cast("long").alias("flight_id"), "ms").agg(
        F.max(gated.cast("int")).alias("gated"), F.bool_and(F.abs(smooth - F.col("smoothed")) < 1e-9).alias("smooth_ok"),
        F.bool_and((F.col("smoothed") >= 0.6) == F.coalesce("_alert", F.lit(False))).alias("alert_ok"),
        F.bool_or(F.col("_logged").isNotNull()).alias("logged"))


def _with_logged(rows: DataFrame, logged: DataFrame) -> DataFrame:
    """Rows with the logged values (``_ms``, ``_logged``) of their instant within 1e-6 of ``smoothed``; each at least once.

    All flights share their instants: values meet by instant and range of value, not every one with every other.
    """
    step = F.floor(F.col("smoothed") / _NEAR)
    logged = logged.withColumn("_step", F.floor(F.col("_logged") / _NEAR))
    rows = rows.withColumn("_of", F.explode(F.array(step - 1, step, step + 1)))
    return rows.join(logged, (F.col("ms") == F.col("_ms")) & (F.col("_of") == F.col("_step"))
                     & (F.abs(F.col("_logged") - F.col("smoothed")) <= 1e-6), "left_outer")


@query("t10_dashboard_totals", sql(None, """
 SELECT CASE WHEN alt_m > 800 THEN 'mountain' WHEN alt_m > 0 THEN 'flat' ELSE 'sea' END AS terrain, count(*) AS rows, ROUND(avg(score), 6) AS mean_anom_proba
 FROM telemetry GROUP BY 1"""))
def t10(spark, sf):
    rows = _timed(spark, sf).select("ts", terrain_of(F.col("alt_m")).alias("terrain"), F.col("score").alias("anom_proba"))
    folder = f"{shared_folder(rows)}/dashboard-{uuid.uuid4().hex}"
    flush = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/{number:09d}")
    _to_the_end(live.dashboard(_arrive(rows, closing=False)).writeStream.outputMode("complete").foreachBatch(flush)
                .option("checkpointLocation", f"{folder}-checkpoint"), spark)
    newest = spark.read.parquet(f"{folder}/*").select("*", F.col("_metadata.file_path").alias("_file"))
    last = newest.groupBy("terrain").agg(F.max_by(F.struct("rows", "mean_anom_proba"), "_file").alias("r"))
    return last.select("terrain", "r.rows", F.round("r.mean_anom_proba", 6).alias("mean_anom_proba"))
