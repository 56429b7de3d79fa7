"""Live detection as Structured Streaming queries.

State is kept per lane of flights (see ``state``): rows wait for the watermark, are stepped in order of time,
and late ones leave flagged. Every step works on whole columns of a lane's released rows; everything else is
ordinary column work on the stream.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightwatch.functions.geo import in_box
from flightwatch.operators.learning import predicted, routed_model
from flightwatch.operators.messages import FEATURE_DEFAULTS, HELD, MAX_AGE_S, POSITION, scaled_messages
from flightwatch.operators.scoring import alert, ground_gate, states_along
from flightwatch.operators.terrain import cell, terrain_of
from flightwatch.schema import (
    ALERT_THRESHOLD, DEBOUNCE, EARTH_RADIUS_M, FEATURES, MESSAGE_SCHEMA, MESSAGE_TYPES, SMOOTHING, WINDOW_LENGTH)
from flightwatch.sources.logs import log_format
from flightwatch.streaming.state import DELAY, IDLE_S, LATE, TICK, Columns, Flights, Memory, Step, numbers, objects, ordered, table

BAD_LINE = "_bad_line"


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Decoded messages arriving as JSON-lines files; what ``rejected_messages`` keeps is left out here."""
    return _lines(spark, path, files_per_batch).filter(_reason().isNull()).drop(BAD_LINE)


def rejected_messages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The dead-letter side of the same files: ``reason`` (bad line, no instant, no flight, unknown type), the line
    if it could not be read, and the message's type, flight and file."""
    rows = _lines(spark, path, files_per_batch)
    return rows.withColumn("reason", _reason()).filter("reason IS NOT NULL").select(
        "reason", F.col(BAD_LINE).alias("line"), "msg_type", "flight_id", "ts", F.col("_metadata.file_path").alias("file_path"))


def _lines(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    schema = T.StructType([*MESSAGE_SCHEMA.fields, T.StructField(BAD_LINE, T.StringType())])
    return (spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
            .option("maxFilesPerTrigger", files_per_batch).json(path))


def _reason():
    return (F.when(F.col(BAD_LINE).isNotNull(), "bad line").when(F.col("ts").isNull(), "no instant")
            .when(F.col("flight_id").isNull(), "no flight")
            .when(~F.coalesce(F.col("msg_type").isin(MESSAGE_TYPES), F.lit(False)), "unknown type"))


def _fields(schema: T.StructType, names) -> list[T.StructField]:
    return [T.StructField(n, schema[n].dataType) for n in names]


_DOUBLES = ["vel_m_s", "alt_m", "hdg_deg"]
_HUD = {"vel_m_s": "hud_speed", "alt_m": "hud_alt"}


def _held(rows: pd.DataFrame, memory: Memory) -> tuple[pd.DataFrame, Memory]:
    """``_hold`` on frames."""
    at = Flights(rows, memory)
    out, new = _hold({c: rows[c].to_numpy() for c in rows.columns}, {c: at.past[c].to_numpy() for c in at.past.columns})
    return table(out, rows.index), table(new, at.ids)


def _hold(rows: Columns, past: Columns) -> tuple[Columns, Columns]:
    """Newest values of every message type at each row.

    A message replaces all fields of its type, also by nothing. Speed, altitude and heading stay until a new one is
    known; those of the instrument message serve until a position message has brought its own, its heading always.
    """
    at, columns, held = Flights(rows, past), {}, {}
    before = lambda f: _values(past[f]) if f in past else np.full(len(at.ids), np.nan)
    for kind, fields in HELD.items():
        last = at.last(rows["msg_type"] == kind)
        for f in fields:
            columns[f] = at.taken(_values(rows[f]), last, before(f))
            held[f] = columns[f][at.ends]
    for f, of_position in (("vel_m_s", "vel_m_s"), ("alt_m", "alt_m"), ("hdg_deg", None)):
        own = numbers(rows[f])
        known = own if of_position else np.where(np.isnan(own), numbers(rows["hud_heading"]), own)
        told = at.following(known, before(f))
        held[f] = told[at.ends]
        if f in _HUD:
            first, own = before(_HUD[f]).copy(), numbers(rows[_HUD[f]])
            seen = ~np.isnan(at.following(own, first))
            # The first one that was ever known.
            there = np.flatnonzero(~np.isnan(own))
            unset = there[np.isnan(first)[at.number[there]]][::-1]
            first[at.number[unset]] = own[unset]
            first = np.where(seen, first[at.number], np.nan)
            held[_HUD[f]] = first[at.ends]
            told = np.where(np.isnan(told), first, told)
        columns[f] = told
    return {**rows, **columns}, {**past, **held}


def _values(column: np.ndarray) -> np.ndarray:
    """Text as it is, all else as numbers."""
    return column if column.dtype == object and any(isinstance(v, str) for v in column) else numbers(column)


def _hold_memory(schema: T.StructType) -> list[T.StructField]:
    names = [f for fields in HELD.values() for f in fields] + [*_DOUBLES, *_HUD.values()]
    return _fields(schema, dict.fromkeys(names))


def held_values(messages: DataFrame, delay: str = DELAY, idle_s: float = IDLE_S) -> DataFrame:
    """Latest-value state: every message with all fields known at its time."""
    scaled = scaled_messages(messages)
    return ordered(scaled, Step(_hold, memory=T.StructType(_hold_memory(scaled.schema)), plain=True), delay, idle_s, asks=POSITION)


def resampled(messages: DataFrame, hz: float = 10.0, max_age_s: float = MAX_AGE_S, delay: str = DELAY,
              idle_s: float = IDLE_S) -> DataFrame:
    """Latest values at a fixed rate, driven by timers: a tick comes whether or not a message does.

    Ticks begin with a flight's first message and go on until it is idle. ``time_s`` counts from the first,
    ``age_s`` from the last position; ``stale`` is 1 if that is older than ``max_age_s`` (or there is none),
    ``connection_ok`` 1 if any message is younger than MAX_AGE_S; ``seen_ts`` is that message's instant and
    ``last_update_iso`` the last position's.
    """
    scaled = scaled_messages(messages)
    memory = [*_hold_memory(scaled.schema), *[T.StructField(n, T.LongType()) for n in ("_first", "_seen", "_fix")]]
    added = [T.StructField("time_s", T.DoubleType()), T.StructField("age_s", T.DoubleType()), T.StructField("stale", T.IntegerType()),
             T.StructField("connection_ok", T.IntegerType()), T.StructField("seen_ts", T.TimestampType()),
             T.StructField("fix_ts", T.TimestampType())]

    def run(rows: Columns, past: Columns) -> tuple[Columns, Columns]:
        out, new = _hold(rows, past)
        flights = Flights(rows, past)
        at, ticks = rows["ts"], rows["msg_type"] == TICK
        before = numbers(past["_first"])
        new["_first"] = first = np.where(np.isnan(before), at[flights.starts], before)
        for name, kind in (("_seen", ~ticks), ("_fix", rows["msg_type"] == POSITION)):
            out[name] = flights.following(np.where(kind, at, np.nan), numbers(past[name]))
            new[name] = out[name][flights.ends]
        age, quiet = (at - out["_fix"]) / 1e6, (at - out["_seen"]) / 1e6
        out |= {"time_s": np.round((at - first[flights.number]) / 1e6, 3), "age_s": age, "stale": (~(age <= max_age_s)).astype("int32"),
                "connection_ok": (quiet <= MAX_AGE_S).astype("int32"), "seen_ts": out["_seen"], "fix_ts": out["_fix"]}
        return {c: x[ticks] for c, x in out.items()}, new

    step = Step(run, added, T.StructType(memory), plain=True)
    ticks = ordered(scaled, step, delay, idle_s, every_s=1 / hz, asks=POSITION)
    return ticks.filter(f"{LATE} = 0").withColumn("last_update_iso", F.date_format("fix_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).drop("msg_type", "fix_ts")


def message_counts(messages: DataFrame, width: str = "5 seconds", late: str = "5 seconds") -> DataFrame:
    return (messages.withWatermark("ts", late).groupBy(F.window("ts", width).alias("_w"), "msg_type")
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("window_start"), "msg_type", "n"))


def late_rows(stepped: DataFrame) -> DataFrame:
    """The rows of a stepped stream that came too late to be stepped: they can be kept and counted."""
    return stepped.filter(f"{LATE} = 1")


def smooth_step(column: str, alpha: float = SMOOTHING) -> Step:
    def run(rows: pd.DataFrame, memory: Memory) -> tuple[pd.DataFrame, Memory]:
        at, x = Flights(rows, memory), rows[column].astype(float).to_numpy()
        last, known = at.number_before("last"), ~np.isnan(x)
        # The state before a flight's first row stands before its known values.
        has = ~np.isnan(last)
        whose = np.concatenate([np.flatnonzero(has), at.number[known]])
        by = np.argsort(whose, kind="stable")
        states = states_along(np.concatenate([last[has], x[known]])[by], whose[by], alpha)
        values = np.full(len(x), np.nan)
        values[known] = states[by >= has.sum()]
        values = at.following(values, last)  # an unknown value keeps the state
        return rows.assign(smoothed=values), at.memory(last=values[at.ends])
    return Step(run, [T.StructField("smoothed", T.DoubleType())], T.StructType([T.StructField("last", T.DoubleType())]))


def smoothed(stream: DataFrame, column: str, alpha: float = SMOOTHING, delay: str = DELAY, idle_s: float = IDLE_S) -> DataFrame:
    return ordered(stream, smooth_step(column, alpha), delay, idle_s)


def _lists(values: np.ndarray, whose: np.ndarray, length: int) -> list[np.ndarray]:
    """The last ``length`` values of each flight."""
    ends = np.flatnonzero(np.concatenate([whose[1:] != whose[:-1], [True]])) + 1
    begins = np.concatenate([[0], ends[:-1]])
    return [values[max(a, b - length):b].tolist() for a, b in zip(begins, ends, strict=True)]


def _steady(values: pd.Series, place: np.ndarray, repeats: int) -> np.ndarray:
    """Where a value equals each of the ``repeats`` before it in its flight."""
    same = place >= repeats
    for i in range(1, repeats + 1):
        same &= (values == values.shift(i)).to_numpy()
    return same


def debounce_step(column: str, count: int, default: str) -> Step:
    def run(rows: pd.DataFrame, memory: Memory) -> tuple[pd.DataFrame, Memory]:
        at = Flights(rows, memory)
        values, new, place, whose = at.after_lists(rows[column].to_numpy(object), "recent")
        sure = _steady(pd.Series(values, dtype=object), place, count - 1)[new]
        told = at.before("active").to_numpy(object)
        before = np.array([v if isinstance(v, str) and v else default for v in told], object)
        own = values[new]
        active = at.latest(own, sure & pd.notna(own), before)
        earlier = np.where(at.first, before[at.number], np.concatenate([active[:1], active[:-1]]))
        out = rows.assign(active=active, switched=(active != earlier).astype("int32"))
        return out, at.memory(recent=_lists(values, whose, count), active=active[at.ends])
    return Step(run, [T.StructField("active", T.StringType()), T.StructField("switched", T.IntegerType())],
                T.StructType([T.StructField("recent", T.ArrayType(T.StringType())), T.StructField("active", T.StringType())]))


def debounced(stream: DataFrame, column: str = "terrain", count: int = DEBOUNCE, default: str = "flat",
              delay: str = DELAY, idle_s: float = IDLE_S) -> DataFrame:
    return ordered(stream, debounce_step(column, count, default), delay, idle_s)


def stale_step(repeats: int = 2) -> Step:
    def run(rows: pd.DataFrame, memory: Memory) -> tuple[pd.DataFrame, Memory]:
        at = Flights(rows, memory)
        lats, new, place, whose = at.after_lists(rows["lat_deg"].astype(float).to_numpy(), "lats")
        lats = lats.astype(float)
        same = _steady(pd.Series(lats), place, repeats)[new]
        return rows.assign(live_stale=same.astype("int32")), at.memory(lats=_lists(lats, whose, repeats))
    return Step(run, [T.StructField("live_stale", T.IntegerType())], T.StructType([T.StructField("lats", T.ArrayType(T.DoubleType()))]))


def stale(stream: DataFrame, repeats: int = 2, delay: str = DELAY, idle_s: float = IDLE_S) -> DataFrame:
    return ordered(stream, stale_step(repeats), delay, idle_s)


_VECTOR = T.ArrayType(T.DoubleType())


def _rolled(new: np.ndarray, at: Flights, before, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Which rows of ``new`` have ``length`` rows with them, those rows side by side, and what each flight remembers."""
    width = new.shape[1]
    past = [np.zeros((0, width)) if x is None or isinstance(x, float) else np.asarray(x, float).reshape(-1, width) for x in before]
    n = np.asarray([len(x) for x in past], np.int64)
    whose = np.concatenate([np.repeat(np.arange(len(past)), n), at.number])
    by = np.argsort(whose, kind="stable")
    cells, whose, is_new = np.concatenate([*past, new])[by], whose[by], by >= n.sum()
    ends = np.flatnonzero(np.concatenate([whose[1:] != whose[:-1], [True]])) + 1
    begins = np.concatenate([[0], ends[:-1]])
    full = np.flatnonzero(is_new & (np.arange(len(whose)) - begins[whose] >= length - 1))
    vectors = (np.lib.stride_tricks.sliding_window_view(cells.ravel(), length * width)[(full - length + 1) * width] if len(full)
               else np.zeros((0, length * width)))
    kept = [cells[max(a, b - length + 1):b].ravel() for a, b in zip(begins, ends, strict=True)]
    return np.isin(np.flatnonzero(is_new), full), vectors, kept


def buffer_step(column: str, length: int) -> Step:
    def run(rows: pd.DataFrame, memory: Memory) -> tuple[pd.DataFrame, Memory]:
        at = Flights(rows, memory)
        which, vectors, kept = _rolled(np.stack([np.asarray(v, float) for v in rows[column]]), at, at.before("rows"), length)
        out = rows[which].reset_index(drop=True)
        out["vector"] = list(vectors) if len(vectors) else None
        return out, at.memory(rows=kept)
    return Step(run, [T.StructField("vector", _VECTOR)], T.StructType([T.StructField("rows", _VECTOR)]))


def buffered(stream: DataFrame, column: str = "features", length: int = WINDOW_LENGTH, delay: str = DELAY,
             idle_s: float = IDLE_S) -> DataFrame:
    """Rows once ``length`` are known, with the last ``length`` feature rows as ``vector``."""
    return ordered(stream, buffer_step(column, length), delay, idle_s)


WINDOW_SCHEMA = T.StructType([
    T.StructField("flight_id", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("lat_deg", T.DoubleType()), T.StructField("lon_deg", T.DoubleType()),
    T.StructField("terrain", T.StringType()), T.StructField("features", _VECTOR),
    T.StructField("live_stale", T.IntegerType()), T.StructField("active", T.StringType()),
    T.StructField("switched", T.IntegerType()), T.StructField("vector", _VECTOR),
    T.StructField("home_lat", T.DoubleType()), T.StructField("home_lon", T.DoubleType())])


def window_step(schema: T.StructType, count: int, default: str, length: int = WINDOW_LENGTH) -> Step:
    """All per-flight memory of live scoring in one state: latest values, origin, stale flag,
    terrain and the rolling buffer (which a terrain switch does not empty)."""
    parts = [stale_step(), debounce_step("terrain", count, default), buffer_step("features", length)]
    memory = [*_hold_memory(schema), T.StructField("home_lat", T.DoubleType()), T.StructField("home_lon", T.DoubleType()),
              *[f for p in parts for f in p.memory]]

    def run(rows: Columns, past: Columns) -> tuple[Columns, Columns]:
        held, new = _hold(rows, past)
        is_fix = rows["msg_type"] == POSITION
        fixes = {c: x[is_fix] for c, x in held.items()}
        if not is_fix.any():
            return fixes, new
        # Flights without a fix remember what they did.
        first = Flights(fixes)
        places = Flights(rows).number[is_fix][first.starts]
        at = Flights(fixes, {c: x[places] for c, x in past.items()})
        home, told = {}, {}
        known = ~np.isnan(at.number_before("home_lat"))
        for name, column in (("home_lat", "lat_deg"), ("home_lon", "lon_deg")):
            home[name] = told[name] = np.where(known, at.number_before(name), fixes[column][at.starts])
        for part, columns in zip(parts[:2], (["lat_deg"], ["terrain"]), strict=True):
            out, of_part = part.run(table({c: fixes[c] for c in ["flight_id", *columns]}),
                                    table({c: at.past[c] for c in part.memory.names}, at.ids))
            fixes |= {f.name: out[f.name].to_numpy() for f in part.adds}
            told |= {c: of_part[c].to_numpy() for c in of_part.columns}
        lat, lon = home["home_lat"][at.number], home["home_lon"][at.number]
        fixes |= {"x_m": np.radians(fixes["lat_deg"] - lat) * EARTH_RADIUS_M,
                  "y_m": np.radians(fixes["lon_deg"] - lon) * EARTH_RADIUS_M * np.cos(np.radians(lat)),
                  "is_stale_repeat": fixes["live_stale"], "connection_ok": np.ones(len(lat)), "home_lat": lat, "home_lon": lon}
        cells = np.empty((len(lat), len(FEATURES)))
        for i, f in enumerate(FEATURES):
            cells[:, i] = numbers(fixes[f]) if f in fixes else np.nan
            cells[np.isnan(cells[:, i]), i] = FEATURE_DEFAULTS.get(f, 0.0)
        which, vectors, kept = _rolled(cells, at, at.before("rows"), length)
        told["rows"] = objects(kept)
        for c, x in told.items():
            new[c] = x if len(places) == len(past[c]) else _replaced(past[c], places, x)
        wanted = {c: fixes[c][which] for c in WINDOW_SCHEMA.names if c in fixes}
        return {**wanted, "features": cells[which], "vector": vectors}, new
    return Step(run, memory=T.StructType(memory), schema=WINDOW_SCHEMA, plain=True)


def _replaced(values: np.ndarray, places: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = values.astype(object) if by.dtype == object else values.astype(by.dtype)
    out[places] = by
    return out


def live_windows(messages: DataFrame, elevations: DataFrame | None = None, count: int = DEBOUNCE,
                 default: str = "flat", delay: str = DELAY, idle_s: float = IDLE_S) -> DataFrame:
    """Messages -> one scoring window per position fix, slide 1; late messages leave flagged, without a window.

    Ground elevation comes from a join with the static table; without an entry, the altitude.
    """
    scaled = scaled_messages(messages)
    elevation = F.coalesce("alt_m", F.lit(0.0))
    if elevations is not None:
        keyed = scaled.withColumns({"lat_key": cell(F.col("lat_deg")), "lon_key": cell(F.col("lon_deg"))})
        known = elevations.groupBy("lat_key", "lon_key").agg(F.max("elevation").alias("_elevation"))
        scaled = keyed.join(known, ["lat_key", "lon_key"], "left")
        elevation = F.coalesce("_elevation", elevation)
    ready = scaled.withColumn("terrain", terrain_of(elevation)).withColumn("flight_id", F.col("flight_id").cast("string"))
    return ordered(ready, window_step(ready.schema, count, default), delay, idle_s, asks=POSITION)


def scored_windows(windows: DataFrame, models: dict[str, PipelineModel], default: str = "flat",
                   area: tuple[PipelineModel, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Gate, area model at home, else the active terrain's model; before smoothing.

    Every model adds its probability as a column, so the stream is read once however many there are.
    """
    home = F.coalesce(in_box(F.col("home_lat"), F.col("home_lon"), *area[1]), F.lit(False)) if area else None
    rows = routed_model(windows.filter(f"{LATE} = 0").drop(LATE), models, default, home)
    chosen = F.lit(None).cast("double")
    for i, (name, model) in enumerate([*models.items(), *([("area", area[0])] if area else [])]):
        rows = predicted(model, rows, name.endswith(":nn")).drop("prediction").withColumnRenamed("anom_proba", f"_proba{i}")
        chosen = F.when(F.col("model") == name, F.col(f"_proba{i}")).otherwise(chosen)
    at = lambda f: F.element_at("features", FEATURES.index(f) + 1)
    gated = ground_gate(at("armed"), at("rel_alt_m"), at("vel_m_s"), chosen)
    return rows.withColumn("raw_proba", gated).drop(*[c for c in rows.columns if c.startswith("_proba")])


def live_scores(windows: DataFrame, models: dict[str, PipelineModel], default: str = "flat", area=None,
                alpha: float = SMOOTHING, idle_s: float = IDLE_S) -> DataFrame:
    """Windows scored and smoothed, all inside the stream: window state, models and smoothing state are chained.

    The windows come in order of time from the first state, so the second holds nothing back.
    """
    scored = scored_windows(windows, models, default, area).select(
        "flight_id", "ts", "lat_deg", "lon_deg", "model_terrain", "model_type", "switched", "features", "raw_proba")
    return ordered(scored, smooth_step("raw_proba", alpha), None, idle_s).drop(LATE)


def score_stream(windows: DataFrame, models: dict[str, PipelineModel], folder: str, default: str = "flat",
                 area=None, threshold: float = ALERT_THRESHOLD, alpha: float = SMOOTHING):
    """Start scoring: per micro-batch, log rows to ``folder/scores``, alerts to ``folder/alerts`` and all that is
    known to ``folder/windows``. A repeated batch overwrites its own files; state is only in the checkpoint."""
    def flush(batch: DataFrame, number: int) -> None:
        batch.persist()  # three writes, one run of the models
        try:
            batch.write.mode("overwrite").parquet(f"{folder}/windows/batch={number}")
            log_format(_log_rows(batch)).write.mode("overwrite").option("header", True).csv(f"{folder}/scores/batch={number}")
            (batch.filter(alert(F.col("smoothed"), threshold)).select("flight_id", "ts", F.col("smoothed").alias("anom_proba"))
             .write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}"))
        finally:
            batch.unpersist()
    return (live_scores(windows, models, default, area, alpha).writeStream.foreachBatch(flush)
            .option("checkpointLocation", f"{folder}/checkpoint"))


def _log_rows(done: DataFrame) -> DataFrame:
    at = lambda f: F.element_at("features", FEATURES.index(f) + 1)
    return done.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), (F.unix_micros("ts") / 1e6).alias("unix_time"),
        F.round("smoothed", 6).alias("anom_proba"), "lat_deg", "lon_deg", at("alt_m").alias("alt_m"),
        at("rel_alt_m").alias("rel_alt_m"), at("vel_m_s").alias("vel_m_s"), at("roll_deg").alias("roll_deg"),
        at("pitch_deg").alias("pitch_deg"), at("yaw_deg").alias("yaw_deg"), at("rollspeed_radps").alias("rollspeed"),
        at("pitchspeed_radps").alias("pitchspeed"), at("yawspeed_radps").alias("yawspeed"),
        F.col("model_terrain").alias("terrain"), "model_type", F.col("switched").alias("switched_terrain"))


def dashboard(scores: DataFrame) -> DataFrame:
    """Running aggregates per terrain for a monitor (complete mode)."""
    return scores.groupBy("terrain").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("anom_proba").alias("mean_anom_proba"),
        F.max_by("anom_proba", "ts").alias("latest_proba"), F.max("ts").alias("latest_ts"))
