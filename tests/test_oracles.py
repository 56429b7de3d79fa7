"""Every query with an oracle gives the oracle's rows (sf0.001, flights cut into short chunks).

Training queries and streams take longest; set FLIGHTWATCH_ALL=1 to run them here as well. Queries of other
folders are tested with them.
"""

import math
import os
import re

import duckdb
import pytest

from conftest import SF

import __spark_entry__ as entry
from flightwatch.plans.catalog import QUERIES

SLOW = ("m0", "m1", "a21", "t01", "t02_resampled", "t03_buffered", "t04", "t05", "t06", "t07", "t09", "t10", "s15")
NAMES = [n for n in QUERIES if os.environ.get("FLIGHTWATCH_ALL") or not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value + 0.0:.9g}"
    return "null" if value is None else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, df.collect())
    if name in entry.oracle_sql():
        run = duck.execute(entry.oracle_sql()[name])
        assert got == table([d[0] for d in run.description], run.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 2


@pytest.mark.parametrize("name", ["a13_windows_per_flight", "w11_segments", "w13_path_length", "w18_debounced_terrain",
                                  "w19_smoothed_probability", "p16_fill_forward", "q01_q15_row_checks", "j06_p22_hold_last"])
def test_rows_are_windowed_per_chunk(spark, name):
    """A flight with a third of all rows must not meet in one task."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    specs = re.findall(r"windowspecdefinition\(([^()]*)", plan)
    # _known orders the table that has one row per block of a chunk.
    assert all("_chunk" in s or "_known" in s for s in specs)
