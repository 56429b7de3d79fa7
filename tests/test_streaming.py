"""Ordered steps on streams: any cut into batches, restarts, late rows, ended flights, latest values."""

import time
import uuid
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightwatch.operators import messages as M
from flightwatch.streaming import live

START = 1_777_593_600_000
ROWS = [(f"f{i % 2}", START + i * 100, float(i % 7)) for i in range(90)]


def arrive(spark, folder, parts):
    for part in parts:
        rows = spark.createDataFrame(part, "flight_id string, ms long, x double")
        rows.select("flight_id", F.timestamp_millis("ms").alias("ts"), "x").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)


def unordered(rows, size=15):
    """Each file has its rows backwards, and neighbours of two files are exchanged."""
    parts = [rows[i:i + size][::-1] for i in range(0, len(rows), size)]
    for a, b in zip(parts, parts[1:]):
        a[0], b[-1] = b[-1], a[0]
    return parts


END = [(None, START + 86_400_000, 0.0)]


def run(spark, folder, files, out, make=lambda s: live.smoothed(s, "x", delay="3 seconds")):
    stream = spark.readStream.schema("flight_id string, ts timestamp, x double").option("maxFilesPerTrigger", files).parquet(folder)
    made = make(stream)
    (made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(made.schema).parquet(f"{out}/rows")


def expected(rows, alpha=0.3):
    out, last = {}, {}
    for flight, ms, x in sorted(rows, key=lambda r: r[1]):
        last[flight] = x if flight not in last else alpha * x + (1 - alpha) * last[flight]
        out[flight, ms] = pytest.approx(last[flight])
    return out


def by_key(df, column="smoothed"):
    return {(r["flight_id"], r["ms"]): r[column] for r in df.withColumn("ms", F.unix_millis("ts")).collect()}


def test_any_cut_into_batches_gives_the_same(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), [*unordered(ROWS), END])
    for files in (1, 3, 100):
        got = run(spark, str(tmp_path / "in"), files, str(tmp_path / f"out{files}"))
        assert by_key(got) == expected(ROWS) and got.filter("late = 1").count() == 0


def test_restart_from_the_checkpoint(spark, tmp_path):
    parts, folder, out = unordered(ROWS), str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, folder, parts[:3])
    first = run(spark, folder, 2, out).count()
    assert 0 < first < 45  # the last three seconds still wait
    arrive(spark, folder, [*parts[3:], END])
    assert by_key(run(spark, folder, 2, out)) == expected(ROWS)


def test_late_rows_leave_flagged_and_ended_flights_are_forgotten(spark, tmp_path):
    again = [("f0", START + 7_200_000 + i * 100, 5.0) for i in range(5)]
    late = [("f0", START + 100, 99.0)]
    other = [("f1", START + 3_600_000, 1.0)]
    folder = str(tmp_path / "in")
    early = [r for r in ROWS if r[0] == "f0"]
    arrive(spark, folder, [early[:20], early[20:], [("f1", START + 20_000, 1.0)], late, other, other, again, END])
    rows = run(spark, folder, 1, str(tmp_path / "out"), lambda s: live.smoothed(s, "x", delay="1 second", idle_s=600.0))
    told = live.late_rows(rows).collect()
    assert [(r["flight_id"], r["x"], r["smoothed"]) for r in told] == [("f0", 99.0, None)]
    got = by_key(rows.filter("late = 0"))
    want = expected(early) | expected(again)
    assert {k: v for k, v in got.items() if k[0] == "f0"} == want


def test_latest_values_are_those_of_the_batch_operator(spark):
    kinds = ["VFR_HUD", "GPS_RAW_INT", "GLOBAL_POSITION_INT", "ATTITUDE", "VFR_HUD", "VIBRATION", "GLOBAL_POSITION_INT", "ESTIMATOR_STATUS",
             "HEARTBEAT", "SYS_STATUS", "GLOBAL_POSITION_INT", "VFR_HUD", "GPS_RAW_INT", "GLOBAL_POSITION_INT"]
    rows = [{"flight_id": "f", "ms": START + 100 * i, "msg_type": k, "n": float(i), "even": None if i % 4 == 2 else float(i)} for i, k in enumerate(kinds)]
    df = spark.createDataFrame(pd.DataFrame(rows)).withColumn("even", F.nanvl("even", F.lit(None)))
    raw = df.select("flight_id", F.timestamp_millis("ms").alias("ts"), "msg_type", *[(F.col("n") * k).alias(c) for k, c in enumerate(
        ["lat", "lon", "relative_alt", "vy", "vz", "fix_type", "satellites_visible", "eph", "epv", "roll", "pitch", "yaw", "vibration_x",
         "vel_ratio", "pos_vert_innov", "base_mode", "voltage_battery", "battery_remaining", "groundspeed", "heading"], 1)],
        F.col("even").alias("alt"), F.col("even").alias("vx"), (F.col("even") * 100).alias("hdg"), F.concat(F.lit("M"), F.col("n")).alias("mode"))
    scaled = M.scaled_messages(raw)
    batch = M.hold_last(scaled).orderBy("ts").toPandas()
    step = scaled.orderBy("ts").toPandas()
    halves, memory = [], {}
    for part in (step[:6], step[6:]):
        out, memory = live._held(part.reset_index(drop=True), memory)
        halves.append(out)
    stream = pd.concat(halves)
    stream = stream[stream["msg_type"] == M.POSITION].reset_index(drop=True)
    for c in batch.columns:
        if c not in ("ts", "flight_id", "msg_type"):
            a, b = batch[c].astype(object).where(batch[c].notna(), None).tolist(), stream[c].astype(object).where(stream[c].notna(), None).tolist()
            assert a == b, (c, a, b)
    assert batch["vel_m_s"].notna().any() and batch["mode"].notna().any()


def test_steps_of_many_flights_at_once_are_those_of_each_alone():
    """Half of the rows at a time, what is remembered in between; flights that come in one half only."""
    n = 240
    rows = pd.DataFrame({"flight_id": [f"f{i * i % 11}" for i in range(n)], "ts": [START + i for i in range(n)],
                         "x": [None if i % 13 == 0 else float(i % 7) for i in range(n)], "lat_deg": [float(i // 40) for i in range(n)],
                         "terrain": ["sea" if i // 50 % 2 else "flat" for i in range(n)], "features": [[float(i), 1.0] for i in range(n)]})
    rows.loc[rows.index < 60, "flight_id"] = "early"
    rows.loc[rows.index >= 200, "flight_id"] = "later"

    def in_halves(step, part):
        memory, outs = pd.DataFrame(), []
        for half in (part[part["ts"] < START + 100], part[part["ts"] >= START + 100]):
            if len(half):
                out, new = step.run(half.sort_values(["flight_id", "ts"], kind="stable", ignore_index=True), memory)
                memory = pd.concat([memory[~memory.index.isin(new.index)], new]) if len(memory) else new
                outs.append(out)
        return pd.concat(outs)

    for step, columns in ((live.smooth_step("x"), ["smoothed"]), (live.debounce_step("terrain", 3, "flat"), ["active", "switched"]),
                          (live.stale_step(), ["live_stale"]), (live.buffer_step("features", 4), ["vector"])):
        told = lambda df: {r["ts"]: str([list(r[c]) if c == "vector" else r[c] for c in columns]) for r in df.to_dict("records")}
        alone = {}
        for _, part in rows.groupby("flight_id"):
            alone |= told(in_halves(step, part))
        assert told(in_halves(step, rows)) == alone and len(alone) > 200 - 4 * 8


def test_state_is_kept_by_lane_and_not_by_flight(spark, tmp_path):
    """A micro-batch calls the step once for the flights of a lane: the number of calls does not follow the flights."""
    spark.conf.set("flightwatch.stream.lanes", "2")
    try:
        many = [(f"f{i % 40}", START + i * 100, float(i % 7)) for i in range(400)]
        arrive(spark, str(tmp_path / "in"), [many, END])

        def count(rows, memory):
            return rows.assign(met=rows["flight_id"].nunique()), memory
        step = live.Step(count, [T.StructField("met", T.LongType())])
        got = run(spark, str(tmp_path / "in"), 1, str(tmp_path / "out"), lambda s: live.ordered(s, step, "60 seconds"))
        assert got.count() == 400 and got.agg(F.min("met")).first()[0] > 5
    finally:
        spark.conf.unset("flightwatch.stream.lanes")


def test_state_has_no_more_partitions_than_cores(spark):
    """Every partition of state is a task a micro-batch that reports to the driver; the session's number stays."""
    from flightwatch.plans import stream_queries as Q
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.createDataFrame([(START + i * 1000, f"k{i % 3}") for i in range(100)], "ms long, msg_type string")
        stream = live.message_counts(Q._arrive(rows.select(F.timestamp_millis("ms").alias("ts"), "msg_type"), closing=False))
        told = []
        original = spark.sparkContext.defaultParallelism
        Q._finish(stream).count()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
        for folder in Path(Q.shared_folder(rows).removeprefix("file:")).glob("stream-*/checkpoint/state/0"):
            told.append(len([f for f in folder.iterdir() if f.name.isdigit()]))
        assert told and max(told) <= original
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_logged_scores_meet_by_instant_and_value(spark):
    """As a comparison of all pairs tells; values at the borders of ranges, unknown ones, and equal instants."""
    from flightwatch.plans import stream_queries as Q
    values = [0.0, 1e-5, 0.999999e-5, 1.0000004e-5, 0.30000049, 0.2999999, 1.0, None]
    rows = [(f"f{i}", 100 * (i % 2), v) for i in range(6) for v in values]
    logged = [(0, round(v, 6)) for v in values if v is not None] + [(100, 0.3), (100, 0.000011)]
    met = Q._with_logged(spark.createDataFrame(rows, "flight_id string, ms long, smoothed double"),
                         spark.createDataFrame(logged, "_ms long, _logged double").distinct())
    told = {(r["flight_id"], r["ms"], r["smoothed"]): r["has"] for r in met.groupBy("flight_id", "ms", "smoothed").agg(
        F.bool_or(F.col("_logged").isNotNull()).alias("has")).collect()}
    assert told == {(f, ms, v): any(m == ms and v is not None and abs(v - x) <= 1e-6 for m, x in logged) for f, ms, v in rows}
    assert "_step" in next(line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


@pytest.mark.parametrize("kept", [True, False])
def test_slices_arrive_in_turn(spark, monkeypatch, kept):
    """Files of a slice are older than those of the next, also where a store keeps no times; no row is lost, the end comes last."""
    from flightwatch.plans import stream_queries as Q
    monkeypatch.setattr(Q, "FILE_ROWS", 5)
    dated = Q._dated
    monkeypatch.setattr(Q, "_dated", lambda *a: dated(*a) and kept)
    rows = spark.range(400).select((F.col("id") % 7).alias("flight_id"), F.timestamp_millis(START + F.col("id") * 100).alias("ts"))
    folder = Path(Q.shared_folder(rows).removeprefix("file:"))
    had = set(folder.glob("arrivals-*")) if folder.exists() else set()
    stream = Q._arrive(rows)
    assert stream.columns == ["flight_id", "ts"]
    made = sorted(set(folder.glob("arrivals-*")) - had, key=lambda p: len(p.name))[-1]
    files = [(int(f.parent.parent.name.split("=")[1]), f.stat().st_mtime_ns) for f in made.glob("*/*/*.parquet")]
    slices = {n for n, _ in files}
    assert len(slices) >= 400 // (Q.FILES * 5)
    for n in slices - {max(slices)}:
        later = min(m for m in slices if m > n)
        assert max(t for m, t in files if m == n) < min(t for m, t in files if m == later)
    got = spark.read.parquet(str(made))
    assert got.filter("flight_id IS NULL").select("_slice").collect() == [(max(slices),)]
    told = got.filter("flight_id IS NOT NULL").select("flight_id", F.unix_millis("ts").alias("ms"))
    assert sorted(map(tuple, told.collect())) == sorted((i % 7, START + i * 100) for i in range(400))


class _State:
    """A state of any kind that notes what is written."""

    def __init__(self, written):
        self.values, self.written = {}, written

    def put(self, key, value):
        self.values[key] = value
        self.written.append(len(value[0]))

    get = lambda self: self.values.get("", None)
    update = lambda self, value: self.put("", value)
    clear = lambda self: self.values.clear()
    keys = lambda self: iter(list(self.values))
    getValue = lambda self, key: self.values[key]
    updateValue = put
    removeKey = lambda self, key: self.values.pop(key)
    appendValue = lambda self, value: self.put(len(self.values), value)


class _Handle:
    def __init__(self):
        self.rows, self.other, self.timers = [], [], set()

    def getMapState(self, *_):
        return _State(self.rows)

    def getValueState(self, *_):
        return _State(self.other)

    def getListState(self, *_):
        state = _State(self.other)
        state.get = lambda: list(state.values.values())
        return state

    def registerTimer(self, at):
        self.timers.add(at)


class _Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_waiting_rows_are_written_once(spark):
    """Batches that wait are not written again at each look at the lane, however many there are, and no row is lost."""
    import pyarrow as pa
    from flightwatch.streaming import state as S
    schema = T.StructType([T.StructField("flight_id", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("x", T.DoubleType()),
                           T.StructField("_asks", T.IntegerType()), T.StructField("_tie", T.LongType()), T.StructField("_lane", T.LongType())])
    out = T.StructType([*schema.fields[:3], T.StructField("late", T.IntegerType())])
    lane, handle = S.Ordered(S.Step(lambda rows, memory: (rows, memory)), schema, out, 600_000_000), _Handle()
    lane.init(handle)
    size, told = 0, []
    # A batch a second; the watermark stays twenty seconds behind.
    for second in range(60):
        low = second * 1_000_000
        rows = pd.DataFrame({"flight_id": range(50), "ts": [low + 10_000 * i for i in range(50)], "x": 1.5, "_asks": 0, "_tie": 0, "_lane": 0})
        batch = pa.RecordBatch.from_pandas(rows, schema=S._types(schema), preserve_index=False)
        cells = pa.Table.from_batches(S._deal(schema)(iter([batch]))).to_pandas()
        size += sum(map(len, cells["rows"]))
        told += lane.handleInputRows((0,), iter([cells]), _Now((second - 20) * 1000))
        told += lane.handleExpiredTimer((0,), _Now((second - 20) * 1000), None)
    told += lane.handleExpiredTimer((0,), _Now(10_000_000), None)
    assert sum(handle.rows) < 2 * size
    rows = [pa.ipc.read_record_batch(c, S._types(out)) for frame in told for c in frame["rows"]]
    assert sum(r.num_rows for r in rows) == 3000 and sum(sum(r.column(3).to_pylist()) for r in rows) == 0


def test_windows_are_cut_from_one_table():
    """Windows of several flights, with what is remembered of them, equal a loop, and leave as one column without lists in between."""
    import numpy as np
    import pyarrow as pa
    from flightwatch.streaming import state as S
    rows = {"flight_id": np.array(["a"] * 5 + ["b"] * 2 + ["c"] * 3, object)}
    cells = np.arange(20, dtype=float).reshape(10, 2)
    before = [np.array([-4.0, -3.0, -2.0, -1.0]), None, np.array([-9.0, -8.0])]
    which, vectors, kept = live._rolled(cells, S.Flights(rows), before, 3)
    want, left = [], []
    for past, part in zip(before, (cells[:5], cells[5:7], cells[7:]), strict=True):
        held = [] if past is None else past.reshape(-1, 2).tolist()
        for row in part.tolist():
            held.append(row)
            want.append(sum(held[-3:], []) if len(held) >= 3 else None)
        left.append(sum(held[-2:], []))
    assert which.tolist() == [w is not None for w in want] and vectors.tolist() == [w for w in want if w]
    assert [k.tolist() for k in kept] == left
    column = S._arrow(vectors, pa.list_(pa.float64()))
    assert column.to_pylist() == vectors.tolist() and column.flatten().type == pa.float64()
