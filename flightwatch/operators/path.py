"""Cutting a flight's path into stretches of a given length.

Every stretch ends at the first row that is ``segment_km`` away, along the path, from where it began, and the next
one begins there: each cut depends on the one before. To spread this, a flight is divided into blocks of rows. In
a block every row points to the row that would end a stretch begun there; doubling these pointers tells, for each
row where the block's first cut may lie, where its last cut then lies and how many there are. Such maps are
composed, FAN at a time, until one is left of a flight; going back down, every block learns the cut it really
starts from, and all blocks are cut at the same time. No task sees more than a block, or FAN maps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwatch.operators.terrain import path_length
from flightwatch.operators.timeline import CHUNK, KEYS, row_number, settled, with_chunk, with_prefix

BLOCK_ROWS = 4096
FAN = 64


def _first_after(d: np.ndarray, start: np.ndarray, km: float) -> np.ndarray:
    """Index of the first distance at least ``km`` beyond each start (len(d) if none)."""
    n = len(d)
    at = np.searchsorted(d, start + km)
    if not n:
        return at
    while (back := (at > 0) & (d[np.maximum(at - 1, 0)] - start >= km)).any():  # rounding of start + km
        at = at - back
    while (on := (at < n) & (d[np.minimum(at, n - 1)] - start < km)).any():
        at = at + on
    return at


def _ladder(d: np.ndarray, km: float) -> list[np.ndarray]:
    """Pointers to the 1st, 2nd, 4th, ... next cut of each row; len(d) is beyond the block and points to itself."""
    steps = [np.append(_first_after(d, d, km), len(d))]
    while (steps[-1][:-1] < len(d)).any():
        steps.append(steps[-1][steps[-1]])
    return steps


def _block_map(km: float):
    """Per place of a block's first cut: where its last one is, and how many cuts that makes."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        d = np.sort(block["path_km"].to_numpy())
        # A cut before the block lies before its first row, so the first one inside is at most one row beyond km.
        last = np.arange(min(len(d), int(np.searchsorted(d, d[0] + km, "right")) + 1))
        cuts = np.ones(len(last), np.int64)
        for k, step in reversed(list(enumerate(_ladder(d, km)))):
            on = step[last] < len(d)
            last, cuts = np.where(on, step[last], last), cuts + (on << k)
        return _map_row(block, "_rank", d[0], d[:len(last)], d[last], cuts)
    return run


def _map_row(of: pd.DataFrame, rank: str, first: float, entry: np.ndarray, last: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
    """Of places with the same outcome the last one stands for all."""
    keep = np.ones(len(entry), bool)
    keep[:-1] = (last[1:] != last[:-1]) | (cuts[1:] != cuts[:-1])
    return pd.DataFrame({"flight_id": of["flight_id"].iloc[0], "_rank": of[rank].iloc[0], "first_km": first,
                         "entry_km": [entry[keep]], "last_km": [last[keep]], "cuts": [cuts[keep]]})


def _followed(block, state: np.ndarray, cuts: np.ndarray, km: float) -> tuple[np.ndarray, np.ndarray]:
    """Last cut and number of cuts after a block, for each state before it."""
    entry, last, more = (np.asarray(block[c]) for c in ("entry_km", "last_km", "cuts"))
    at = _first_after(entry, state, km)
    inside = at < len(entry)
    at = np.minimum(at, len(entry) - 1)
    return np.where(inside, last[at], state), np.where(inside, cuts + more[at], cuts)


def _compose(km: float):
    """One map of up to FAN consecutive ones."""
    def run(maps: pd.DataFrame) -> pd.DataFrame:
        maps = maps.sort_values("_rank")
        first = float(maps["first_km"].iloc[0])
        entry, state, cuts = (np.empty(0), np.empty(0), np.empty(0, np.int64))
        for _, block in maps.iterrows():
            state, cuts = _followed(block, state, cuts, km)
            if not len(entry) or entry[-1] <= first + km:  # the first cut may still lie here
                entry = np.concatenate([entry, block["entry_km"]])
                state, cuts = np.concatenate([state, block["last_km"]]), np.concatenate([cuts, block["cuts"]])
        return _map_row(maps, "_group", first, entry, state, cuts)
    return run


def _follow(km: float):
    def run(maps: pd.DataFrame) -> pd.DataFrame:
        """State before each of up to FAN maps, from the state before the first."""
        maps = maps.sort_values("_rank")
        state, cuts = maps["before_km"].to_numpy(float)[:1], maps["before_cuts"].to_numpy()[:1]
        kms, counts = [], []
        for _, block in maps.iterrows():
            kms.append(state[0])
            counts.append(cuts[0])
            state, cuts = _followed(block, state, cuts, km)
        return maps[["flight_id", "_rank"]].assign(before_km=kms, before_cuts=counts)
    return run


def _cuts_of(d: np.ndarray, before: float, km: float) -> np.ndarray:
    """Places of all cuts of a block whose last one before it was at ``before``."""
    cuts = _first_after(d, np.array([before]), km)
    for step in _ladder(d, km):  # the first 1, 2, 4, ... cuts and as many after them
        cuts = np.concatenate([cuts, step[cuts]])
    return np.unique(cuts[cuts < len(d)])


def _stretches(km: float):
    """Rows, first and last point of each (stretch, terrain) of a block; a cut row belongs to both sides."""
    points = ["time_s", "lat_deg", "lon_deg", "path_km"]

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("time_s", kind="stable", na_position="first", ignore_index=True)
        cuts = _cuts_of(block["path_km"].to_numpy(), block["before_km"].iloc[0], km)
        number = block["before_cuts"].to_numpy() + np.searchsorted(cuts, np.arange(len(block)), "right") - 1
        row, stretch = np.concatenate([np.arange(len(block)), cuts]), np.concatenate([number, number[cuts] - 1])
        row, stretch = row[stretch >= 0], stretch[stretch >= 0]
        kinds, names = pd.factorize(block["terrain"], use_na_sentinel=False)
        order = np.lexsort((row, kinds[row], stretch))
        row, stretch = row[order], stretch[order]
        first = np.nonzero(np.append(True, (stretch[1:] != stretch[:-1]) | (kinds[row[1:]] != kinds[row[:-1]])))[0]
        last = np.append(first[1:], len(row)) - 1
        out = pd.DataFrame({"flight_id": block["flight_id"].iloc[0], "segment_id": stretch[first],
                            "terrain": names.take(kinds[row[first]]), "_n": last - first + 1})
        for side, at in (("a", first), ("b", last)):
            for c in points:
                out[f"{side}_{c}"] = block[c].to_numpy()[row[at]]
        return out
    return run


def _blocks(measured: DataFrame, km: float, block_rows: int, fan: int) -> DataFrame:
    """The rows with the number of their block along the flight, ``_rank``, the last cut before that block,
    ``before_km``, and how many there are, ``before_cuts``."""
    kind = measured.schema["flight_id"].dataType.simpleString()
    # Blocks are of equal numbers of rows, whatever the width of chunks: narrow chunks do not make many small blocks.
    # Flights without an id have no cuts; rows without a time come first.
    rows = with_chunk(measured).filter(" AND ".join(f"{k} IS NOT NULL" for k in KEYS))
    rows = settled(rows.withColumn(CHUNK, F.coalesce(CHUNK, F.lit(-(1 << 63)))))
    placed = with_prefix(rows, {"_nth": row_number()})
    ranked = settled(placed.withColumn("_rank", F.floor((F.col("_nth") - 1) / block_rows).cast("long")).drop("_nth", CHUNK))
    shape = f"flight_id {kind}, _rank long, first_km double, entry_km array<double>, last_km array<double>, cuts array<long>"
    levels = [settled(ranked.groupBy(*KEYS, "_rank").applyInPandas(_block_map(km), shape))]
    group = F.floor(F.col("_rank") / fan).cast("long")
    most = levels[0].agg(F.max("_rank")).first()[0] or 0
    while most >= fan:
        levels.append(settled(levels[-1].withColumn("_group", group).groupBy(*KEYS, "_group").applyInPandas(_compose(km), shape)))
        most //= fan
    state = f"flight_id {kind}, _rank long, before_km double, before_cuts long"
    before = None
    for maps in reversed(levels):
        maps = maps.withColumn("_group", group)
        if before is None:
            maps = maps.withColumns({"before_km": F.lit(float("-inf")), "before_cuts": F.lit(0).cast("long")})
        else:
            maps = maps.join(before.withColumnRenamed("_rank", "_group"), [*KEYS, "_group"])
        before = settled(maps.groupBy(*KEYS, "_group").applyInPandas(_follow(km), state))
    return ranked.join(before, [*KEYS, "_rank"])


def path_cuts(measured: DataFrame, segment_km: float = 1.0, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """(flight_id, time_s) of all cuts; ``measured`` has path_km per row."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("time_s", kind="stable", na_position="first")
        at = _cuts_of(block["path_km"].to_numpy(), block["before_km"].iloc[0], segment_km)
        return block.iloc[at][["flight_id", "time_s"]]

    kind = measured.schema["flight_id"].dataType.simpleString()
    blocks = _blocks(measured, segment_km, block_rows, fan)
    return (blocks.select(*KEYS, "_rank", "time_s", "path_km", "before_km").groupBy(*KEYS, "_rank")
            .applyInPandas(run, f"flight_id {kind}, time_s double"))


def terrain_segments(df: DataFrame, segment_km: float = 1.0, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """Stretches with start, end, length and majority terrain; a cut row belongs to both sides."""
    rows = with_chunk(df.select(*KEYS, "time_s", "lat_deg", "lon_deg", "terrain"))
    kind = df.schema["flight_id"].dataType.simpleString()
    blocks = _blocks(path_length(rows), segment_km, block_rows, fan)
    ends = ", ".join(f"{side}_{c} double" for side in "ab" for c in ("time_s", "lat_deg", "lon_deg", "path_km"))
    counted = (blocks.groupBy(*KEYS, "_rank").applyInPandas(_stretches(
        segment_km), f"flight_id {kind}, segment_id long, terrain string, _n long, {ends}"))
    point = lambda side: F.struct(*[F.col(f"{side}_{c}").alias(c) for c in ("time_s", "lat_deg", "lon_deg", "path_km")])
    whole = counted.groupBy(*KEYS, "segment_id", "terrain").agg(
        F.sum("_n").alias("_n"), F.min(point("a")).alias("_a"), F.max(point("b")).alias("_b"))
    return (whole.groupBy(*KEYS, "segment_id").agg(
        F.sum("_n").alias("_rows"), F.min("_a").alias("_a"), F.max("_b").alias("_b"),
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("terrain").alias("t")))["t"].alias("terrain_type"))
        .filter("_rows > 1")
        .select(*KEYS, "segment_id", F.col("_a.time_s").alias("start_time_s"), F.col("_b.time_s").alias("end_time_s"),
                F.col("_a.lat_deg").alias("start_lat"), F.col("_a.lon_deg").alias("start_lon"),
                F.col("_b.lat_deg").alias("end_lat"), F.col("_b.lon_deg").alias("end_lon"),
                F.round(F.col("_b.path_km") - F.col("_a.path_km"), 4).alias("distance_km"), "terrain_type"))
