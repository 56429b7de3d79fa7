"""Importing this module registers every query."""

# ruff: noqa: I001 - later modules reuse oracle texts of earlier ones
from flightwatch.plans import row_queries, table_queries, score_queries  # noqa: F401
from flightwatch.plans import model_queries, source_queries, stream_queries  # noqa: F401
from flightwatch.plans import long_queries  # noqa: F401
