"""Queries again, on flights of which one holds a third of all rows, in chunks of some seconds.

Every border of a chunk is crossed here, and no chunk width may change a result.
"""

from __future__ import annotations

from flightwatch.operators.timeline import chunk_width
from flightwatch.plans.catalog import ORACLES, QUERIES, query
from flightwatch.plans.fixture import long_flight, with_long_flight

WIDTHS = {
    "w03_w10_row_labels": 9.0, "w11_segments": 7.0, "a13_windows_per_flight": 8.0, "w13_path_length": 6.0,
    "w18_debounced_terrain": 5.0, "w19_smoothed_probability": 4.0, "w22_chronological_split": 11.0, "w26_trust_smooth": 4.0,
    "w28_motion_consistency": 13.0, "j06_p22_hold_last": 10.0, "t11_interpolated_fixes": 12.0, "p16_fill_forward": 9.0,
    "w14_path_segments": 10.0, "j02_interval_labels_left": 10.0, "w27_escalation_level": 6.0, "w06_h4_stale_run_5": 3.0,
}


def _again(name: str, width: float) -> None:
    @query(f"long_{name}", with_long_flight(ORACLES[name]))
    def run(spark, sf):
        with chunk_width(width), long_flight():
            return QUERIES[name](spark, sf)


for _name, _width in WIDTHS.items():
    _again(_name, _width)
