"""Hand-made cases, golden numbers and properties."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from flightwatch.functions.modes import normalize_mode, number
from flightwatch.operators import clean as C
from flightwatch.operators import labels as L
from flightwatch.operators import messages as M
from flightwatch.operators import quality as Q
from flightwatch.operators import reports as R
from flightwatch.operators import scoring as S
from flightwatch.operators import segments as G
from flightwatch.operators import terrain as T
from flightwatch.operators import windows as W
from flightwatch.operators.path import path_cuts
from flightwatch.operators.timeline import settled
from flightwatch.plans.fixture import telemetry
from flightwatch.schema import FEATURES, LABELLED_COLUMNS


def test_modes(spark):
    cases = {None: "UNKNOWN", " auto ": "AUTO", "Mode(0xC0)": "OFFBOARD", "Mode(0xc0)": "OFFBOARD",
             "Mode(0x000000C0)": "HEX_000000C0", "Mode(0x1f)": "HEX_1F", "": ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "mode string, want string")
    assert df.filter(~normalize_mode(F.col("mode")).eqNullSafe(F.col("want"))).count() == 0


def test_numbers(spark):
    cases = {" 1.5 ": 1.5, "abc": None, "": None, "1.5d": None, "nan": None, "-2e3": -2000.0, None: None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "text string, want double")
    assert df.filter(~number(F.col("text")).eqNullSafe(F.col("want"))).count() == 0


def test_published_counts_of_the_fixture(spark):
    cleaned = settled(C.clean(telemetry(spark, SF), tie=["seq"]))
    assert cleaned.count() == 938
    rows = settled(L.evaluate_rules(cleaned.withColumn("vibration_x", F.lit(0.0)), stale_run=2, failsafe_is_anomaly=True))
    fired = rows.agg(*[F.count_if(F.col(f"rule_{n}")).alias(n) for n in ("pos_jump", "speed_change", "stale_data", "gps_imu_mismatch")]).first()
    assert tuple(fired) == (4, 20, 17, 217)
    labelled = L.label_rows(cleaned.withColumn("vibration_x", F.lit(0.0)), stale_run=2, failsafe_is_anomaly=True)
    assert labelled.agg(F.sum("label")).first()[0] == 420
    members = settled(W.sliding_windows(labelled))
    assert W.window_labels(members).agg(F.count("*"), F.sum("label")).first()[:] == (60, 9)
    assert W.window_labels(members, inclusive=True).agg(F.sum("label")).first()[0] == 22


@pytest.mark.parametrize("n,train,val,test", [(419, 293, 62, 64), (297, 207, 44, 46), (795, 556, 119, 120), (11551, 8085, 1732, 1734)])
def test_split_sizes(spark, n, train, val, test):
    windows = spark.range(n).select((F.col("id") % 7).alias("flight_id"), F.floor(F.col("id") / 7).alias("win"))
    got = {r["split"]: r["n"] for r in W.chronological_split(windows).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": train, "val": val, "test": test}


def test_segment_labels_and_windows_of_a_long_flight(spark):
    bounds = [(0.1, 106.3, 0), (106.3, 122.1, 1), (122.1, 160.9, 0), (160.9, 189.7, 1), (189.7, 234.1, 0), (234.1, 249.9, 1), (249.9, 300.0, 0)]
    segs = spark.createDataFrame([("f", a, b, str(v), "x") for a, b, v in bounds], "flight_id string, start_s double, end_s double, label string, reason string")
    rows = spark.range(1, 3001).select(F.lit("f").alias("flight_id"), F.round(F.col("id") / 10, 1).alias("time_s"))
    half = settled(G.labels_from_segments(rows, segs))
    assert half.agg(F.sum("label")).first()[0] == 604
    members = W.sliding_windows(half)
    assert W.window_labels(members).agg(F.count("*"), F.sum("label")).first()[:] == (199, 40)
    assert W.window_labels(members, inclusive=True).agg(F.sum("label")).first()[0] == 41
    closed = G.labels_from_segments(rows, segs, closed="both")
    assert closed.agg(F.sum("label")).first()[0] == 604
    back = {(round(r["start_s"], 1), round(r["end_s"], 1), r["label"]) for r in G.segments(half).collect()}
    assert back == set(bounds)


def test_windows_of_short_flights(spark):
    rows = spark.range(100).select((F.when(F.col("id") < 29, 1).when(F.col("id") < 59, 2).otherwise(3)).alias("flight_id"),
                                   (F.col("id") / 10).alias("time_s"), F.lit(0).alias("label"))
    counts = {r["flight_id"]: r["n"] for r in W.window_labels(W.sliding_windows(rows)).groupBy("flight_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {2: 1, 3: 1}


def test_debounce_equals_a_loop(spark):
    rng = random.Random(3)
    data = [(f, i * 1.3, rng.choice("abc") if rng.random() < 0.3 else "abc"[(i // 9 + f) % 3]) for f in range(4) for i in range(120)]
    df = spark.createDataFrame(data, "flight_id int, time_s double, terrain string")
    got = {(r["flight_id"], r["time_s"]): (r["active"], r["switched"]) for r in T.debounce(df, default="a").collect()}
    for f in range(4):
        active, candidate, count = "a", None, 0
        for _, t, v in sorted(r for r in data if r[0] == f):
            candidate, count = (v, count + 1) if v == candidate else (v, 1)
            switched = int(count >= 5 and v != active)
            if switched:
                active, count = v, 0
            assert got[f, t] == (active, switched)


def test_smoothing_equals_a_loop(spark):
    rng = random.Random(5)
    data = [(f, i * 0.9, rng.random()) for f in range(3) for i in range(400)]
    df = spark.createDataFrame(data, "flight_id int, time_s double, p double")
    got = {(r["flight_id"], r["time_s"]): r["smoothed"] for r in S.smooth(df, "p").collect()}
    for f in range(3):
        state = None
        for _, t, p in sorted(r for r in data if r[0] == f):
            state = p if state is None else 0.3 * p + 0.7 * state
            assert got[f, t] == pytest.approx(state, abs=1e-14)
            assert 0 <= got[f, t] <= 1


@pytest.mark.parametrize("blocks", [1, 2, 50])
def test_path_cuts_equal_a_loop(spark, blocks):
    rng = random.Random(blocks)
    data, want = [], set()
    for f in range(3):
        d, start = 0.0, None
        for i in range(300):
            if i:
                d += rng.choice([0.0, 0.01, 0.04, 0.3, 2.5 if rng.random() < 0.05 else 0.02])
            data.append((f, float(i), d))
            if start is None or d - start >= 0.25:
                start = d
                want.add((f, float(i)))
    df = spark.createDataFrame(data, "flight_id int, time_s double, path_km double")
    got = {(r["flight_id"], r["time_s"]) for r in path_cuts(df, 0.25, block_rows=blocks, fan=2).collect()}
    assert got == want


def test_exact_medians(spark):
    rng = random.Random(2)
    data = [(f, rng.choice([None, 12.0, rng.random(), float(rng.randint(0, 3))])) for f in (1, 1, 1, 2) for _ in range(251)]
    df = spark.createDataFrame(data, "flight_id int, v double")
    want = {r["flight_id"]: r["m"] for r in df.groupBy("flight_id").agg(F.median("v").alias("m")).collect()}
    got = {r["flight_id"]: r["median"] for r in C.flight_medians(df, ["v"], accuracy=100).collect()}
    assert got == pytest.approx(want)


def test_points_and_gate(spark):
    df = spark.createDataFrame([(450.0, "flat"), (1800.0, "mountain"), (0.0, "sea"), (-1.0, "sea")], "e double, want string")
    assert df.filter(T.terrain_of(F.col("e")) != F.col("want")).count() == 0
    gate = spark.sql("SELECT 0 AS armed, 9.0D AS rel, 9.0D AS v UNION ALL SELECT 1, 4.9D, 2.9D UNION ALL SELECT 1, 5.0D, 2.9D UNION ALL SELECT NULL, 9.0D, 9.0D")
    got = [r[0] for r in gate.select(S.ground_gate(F.col("armed"), F.col("rel"), F.col("v"), F.lit(0.9))).collect()]
    assert got == [0.01, 0.01, 0.9, 0.01]


def test_model_fallback_order(spark):
    reg = lambda names: spark.createDataFrame([(n, "rf", True) for n in names], "terrain string, model_type string, available boolean")
    routes = lambda names, default: {r["active"]: r["model_terrain"] for r in T.route(reg(names), default).collect()}
    assert routes(["flat", "mountain", "sea"], "sea") == {"flat": "flat", "mountain": "mountain", "sea": "sea"}
    assert routes(["mountain", "sea"], "sea") == {"flat": "sea", "mountain": "mountain", "sea": "sea"}
    assert routes(["mountain"], "flat") == {"flat": "mountain", "mountain": "mountain", "sea": "mountain"}
    assert routes(["global_fallback"], "flat") == dict.fromkeys(["flat", "mountain", "sea"], "global_fallback")


def test_required_columns(spark):
    with pytest.raises(ValueError, match="alt_m"):
        L.require_columns(spark.sql("SELECT 1 AS time_s, 1 AS lat_deg, 1 AS lon_deg, 1 AS vel_m_s"))
    with pytest.raises(ValueError, match="unknown thresholds"):
        L.evaluate_rules(telemetry(spark, SF), max_sped=1)


def test_column_order_check(spark):
    right = spark.createDataFrame([], ", ".join(f"{c} double" for c in LABELLED_COLUMNS))
    assert Q.check_columns(right) == []
    assert Q.check_columns(right.select(*reversed(LABELLED_COLUMNS))) == ["order differs"]
    assert Q.check_columns(right.drop("mode")) == ["missing mode"]


def test_emptied_flights_stay_in_the_report(spark):
    raw = telemetry(spark, SF).withColumn("fix_type", F.when(F.col("flight_id") == 0, 1).otherwise(F.col("fix_type")))
    report = {r["flight_id"]: r for r in R.cleaning_report(raw, settled(C.clean(raw, tie=["seq"]))).collect()}
    assert (report[0]["final_rows"], report[0]["time_start_s"], report[0]["rows_removed"]) == (0, None, 500)
    assert report[1]["final_rows"] > 400 and report[1]["missing_after_cleaning"]["dt"] == 1


def test_message_fallbacks(spark):
    """Instrument speed and altitude serve until a position message came; heading always wins."""
    rows = [("f", 0, "VFR_HUD", 5.0, 90.0, 40.0, None, None), ("f", 1, "VFR_HUD", 7.0, 91.0, 41.0, None, None),
            ("f", 2, "GLOBAL_POSITION_INT", None, None, None, 300.0, 50000.0), ("f", 3, "VFR_HUD", 9.0, 65535.0, 60.0, None, None),
            ("f", 20, "GPS_RAW_INT", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "flight_id string, s int, msg_type string, groundspeed double, heading double, alt0 double, vx double, palt double")
    df = df.select("flight_id", F.timestamp_seconds(F.col("s")).alias("ts"), "msg_type", "groundspeed", "heading",
                   F.coalesce("palt", "alt0").alias("alt"), "vx", F.when(F.col("vx").isNotNull(), 0.0).alias("vy"),
                   F.when(F.col("vx").isNotNull(), 0.0).alias("vz"))
    held = M.hold_last(M.scaled_messages(df), at=["VFR_HUD", "GLOBAL_POSITION_INT", "GPS_RAW_INT"]).orderBy("ts").collect()
    assert [r["vel_m_s"] for r in held] == [5.0, 5.0, 3.0, 3.0, 3.0]
    assert [r["alt_m"] for r in held] == [40.0, 40.0, 50.0, 50.0, 50.0]
    assert [r["hdg_deg"] for r in held] == [90.0, 91.0, 91.0, 91.0, 91.0]


def test_features_have_the_model_order(spark):
    from flightwatch.plans.catalog import QUERIES
    import flightwatch.plans.all_queries  # noqa: F401
    columns = QUERIES["p20_p23_message_features"](spark, SF).columns
    assert columns[-34:] == FEATURES


def test_overlapping_segments_equal_a_loop(spark):
    """Nested, equal, crossing, touching, empty and year-long segments; labels that are no numbers; both ends open or closed."""
    rng = random.Random(11)
    segs = [(f, a, a + rng.choice([0.0, 0.5, 3.0, 40.0, 3e7]), rng.choice(["0", "1", "2", "ignore"])) for f in ("a", "b")
            for a in [rng.randrange(0, 80) / 2 for _ in range(40)]]
    segs += [("a", None, 5.0, "1"), ("b", 3.0, None, "1"), ("c", 9.0, 4.0, "1")]
    rows = [(f, i / 4) for f in ("a", "b", "c", "d") for i in range(-8, 400)]
    df = spark.createDataFrame(rows, "flight_id string, time_s double").withColumn("kept", F.col("time_s") * 2)
    sdf = spark.createDataFrame(segs, "flight_id string, start_s double, end_s double, label string")
    number = {"0": 0, "1": 1, "2": 2, "ignore": None}
    for closed in ("left", "both"):
        for shared in (False, True):
            got = {(r["flight_id"], r["time_s"]): r["label"] for r in G.labels_from_segments(df, sdf, closed=closed, shared=shared).collect()}
            for f, t in rows:
                holding = [(a, a, b, -1 if number[v] is None else number[v]) for g, a, b, v in segs if (shared or g == f) and a is not None
                           and b is not None and a <= t and (t < b if closed == "left" else t <= b)]
                want = max(max(holding)[3], 0) if holding else 0
                assert got[f, t] == want, (closed, shared, f, t)


def test_median_of_a_list(spark):
    from flightwatch.operators.learning import middle
    rows = spark.sql("""SELECT * FROM VALUES (1, 3.0D), (1, 1.0D), (1, null), (2, 0.1D), (2, 0.7D), (2, 0.3D), (2, 1e9D), (3, null),
      (4, 5.0D), (5, double('NaN')), (5, 1.0D), (5, double('NaN')) AS t(k, x)""")
    both = rows.groupBy("k").agg(F.median("x").alias("want"), middle(F.collect_list("x")).alias("got"))
    assert both.filter("NOT want <=> got").count() == 0 and both.filter("want IS NULL").count() == 1


def test_few_flights_do_not_move_the_windows(spark, monkeypatch):
    """Places of a split reach wide windows without moving them; with many flights both are dealt out, with the same rows."""
    from flightwatch.operators import windows as W
    # Many enough that copies for salted joins are too large to be broadcast by their size.
    flights = spark.range(40).withColumnRenamed("id", "flight_id")
    wins = flights.withColumn("win", F.explode(F.sequence(F.lit(0), F.col("flight_id") % 7)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = W.chronological_split(wins)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, few.select("flight_id", "win", "ordinal", "split").collect()))
        monkeypatch.setattr(W, "BROADCAST_FLIGHTS", -1)
        assert sorted(map(tuple, W.chronological_split(wins).select("flight_id", "win", "ordinal", "split").collect())) == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r[2] for r in got] == list(range(len(got)))
    n = len(got)
    assert [r[3] for r in got] == ["train" if i < n * 7 // 10 else "val" if i < n * 7 // 10 + int(n * 0.15) else "test" for i in range(n)]


def test_terrain_fit_sorts_its_windows_once(spark, monkeypatch):
    from flightwatch.operators import learning as L
    kept = []

    def fit(train, *_, **__):
        kept.append((train.storageLevel.useDisk, train.count()))
        raise ValueError("seen")

    monkeypatch.setattr(L, "fit_forest", fit)
    windows = spark.range(50).selectExpr("id AS flight_id", "0 AS win", "array(float(id)) AS vector", "if(id % 2 = 0, 'flat', 'sea') AS terrain")
    with pytest.raises(ValueError, match="seen"):
        L.fit_terrain_identifier(windows)
    assert kept[0][0] and 25 < kept[0][1] < 50
