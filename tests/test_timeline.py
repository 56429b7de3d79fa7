"""Halo and prefix against plain loops, with chunks of all sizes and missing chunks."""

import random

import pytest
from pyspark.sql import functions as F

from flightwatch.operators import timeline as TL


def rows(seed, flights=3):
    rng = random.Random(seed)
    out = []
    for f in range(flights):
        t = rng.uniform(0, 20)
        for _ in range(rng.choice([1, 2, 40, 90])):
            t += rng.choice([0.1, 0.5, 2.0, 30.0])
            out.append((f"f{f}", round(t, 3), rng.choice([None, rng.randint(0, 5)])))
    return out


def by_flight(data):
    groups = {}
    for f, t, v in sorted(data, key=lambda r: (r[0], r[1])):
        groups.setdefault(f, []).append((t, v))
    return groups


@pytest.mark.parametrize("before,after", [(1, 0), (0, 1), (1, 1), (4, 0), (0, 3), (9, 2)])
def test_halo_gives_every_chunk_its_neighbours(spark, before, after):
    data = rows(before * 10 + after)
    df = spark.createDataFrame(data, "flight_id string, time_s double, v int")
    halo = TL.with_halo(df, before=before, after=after, carry=["v"])
    w = TL.lane()
    probes = {f"p{i}": F.lag("time_s", i).over(w) for i in range(1, before + 1)}
    probes |= {f"n{i}": F.lead("time_s", i).over(w) for i in range(1, after + 1)}
    got = {(r["flight_id"], r["time_s"]): r for r in TL.without_halo(halo.withColumns(probes)).collect()}
    assert len(got) == len(data)
    for f, seq in by_flight(data).items():
        for i, (t, _) in enumerate(seq):
            for k in range(1, before + 1):
                assert got[f, t][f"p{k}"] == (seq[i - k][0] if i >= k else None)
            for k in range(1, after + 1):
                assert got[f, t][f"n{k}"] == (seq[i + k][0] if i + k < len(seq) else None)


def test_prefixes_cross_chunks(spark):
    data = rows(7)
    df = spark.createDataFrame(data, "flight_id string, time_s double, v int")
    v = F.col("v")
    out = TL.with_prefix(df, {
        "total": TL.running_sum(v), "nth": TL.row_number(), "n": TL.row_count(), "first": TL.opening(v),
        "last": TL.latest(v), "was": TL.latest_before(v), "next": TL.upcoming(v), "once": TL.earliest(v)})
    got = {(r["flight_id"], r["time_s"]): r for r in out.collect()}
    assert len(got) == len(data)
    for f, seq in by_flight(data).items():
        values = [x for _, x in seq]
        known = lambda part: [x for x in part if x is not None]
        for i, (t, _) in enumerate(seq):
            r = got[f, t]
            upto, rest = known(values[:i + 1]), known(values[i + 1:])
            assert r["total"] == (sum(upto) if upto else None)
            assert (r["nth"], r["n"], r["first"]) == (i + 1, len(seq), values[0])
            assert r["last"] == (upto[-1] if upto else None)
            assert r["once"] == (upto[0] if upto else None)
            assert r["was"] == (known(values[:i])[-1] if known(values[:i]) else None)
            assert r["next"] == (rest[0] if rest else None)


def test_no_window_runs_over_a_whole_flight_of_rows(spark):
    """The wide rows move once: windows are per chunk, only the chunk table is per flight."""
    df = spark.createDataFrame(rows(1), "flight_id string, time_s double, v int")
    plan = TL.with_prefix(df, {"total": TL.running_sum(F.col("v"))})._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
    assert "sum(v" in plan and "_chunk" in plan


def test_settled_tables_can_be_cleared(spark):
    import os
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    back = TL.settled(df)
    assert back.collect() == df.collect()
    folder = TL.shared_folder(df)
    assert os.path.isdir(folder)
    TL.clear_settled(df)
    assert not os.path.exists(folder)


def test_smoothing_does_not_depend_on_the_chunk_width(spark):
    from flightwatch.operators.scoring import smooth, trust_smooth
    from flightwatch.operators.timeline import chunk_width
    values = [None] * 5 + [float(i % 7) for i in range(60)] + [None] * 200 + [3.0] + [None] * 40 + [1.5]
    rows = [(f, float(i), v) for f in (1, 2) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "flight_id long, time_s double, x double")
    state, want = None, []
    for v in values:
        state = v if state is None else state if v is None else 0.3 * v + 0.7 * state
        want.append(state)
    seen = []
    for width in (3.0, 50.0, 3600.0):
        with chunk_width(width):
            got = {(r[0], r[1]): r[2] for r in smooth(df, "x", 0.3).select("flight_id", "time_s", "smoothed").collect()}
            seen.append(sorted(tuple(r) for r in trust_smooth(df, "x", 2.0, 1.0).select("flight_id", "time_s", "trust").collect()))
        for i, w in enumerate(want):
            assert got[1, float(i)] is None if w is None else abs(got[2, float(i)] - w) < 1e-12
    for other in seen[1:]:
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-12 for a, b in zip(seen[0], other))


def test_split_of_flights_with_like_names(spark):
    from flightwatch.operators.windows import chronological_split
    rows = [(f"gps_log_20260402_{i:06d}", w) for i in range(50) for w in range(i % 4 + 1)]
    got = chronological_split(spark.createDataFrame(rows, "flight_id string, win long")).collect()
    assert [(r["flight_id"], r["win"]) for r in sorted(got, key=lambda r: r["ordinal"])] == sorted(rows)
    assert sorted(r["ordinal"] for r in got) == list(range(len(rows)))


@pytest.mark.parametrize("gain, seed", [(0.3, None), (0.05, 1.0), (0.999, None), (1.0, None), (1.0, 0.5)])
def test_recurrence_is_free_of_chunk_width(spark, gain, seed):
    import random

    from flightwatch.operators.scoring import _recurrence
    from flightwatch.operators.timeline import chunk_width
    rng = random.Random(3)
    rows = [("a", i * 0.1, None if i < 3 or rng.random() < 0.3 or 900 < i < 1200 else rng.choice([0.0, 1.0, -5.0, float("nan"), 1e9])) for i in range(3000)]
    rows += [("b", 1.0, None), ("b", 2.0, None), ("c", 5.0, 2.0)]
    want, state, flight = {}, None, None
    for f, t, x in rows:
        state = seed if f != flight else state
        flight = f
        if x is not None and x == x:
            state = x if state is None else gain * x + (1 - gain) * state
        want[f, t] = state
    df = spark.createDataFrame(rows, "flight_id string, time_s double, x double").repartition(3).cache()
    for width in (0.7, 7.0, 3600.0):
        with chunk_width(width):
            got = {(r["flight_id"], r["time_s"]): r["y"] for r in _recurrence(df, "x", "y", gain, seed, "time_s", None).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == (None if v is None else pytest.approx(v, rel=1e-9, abs=1e-12)) for k, v in want.items())
