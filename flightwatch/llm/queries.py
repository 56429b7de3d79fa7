"""Importing this module registers the queries of this folder."""

from flightwatch.llm import (  # noqa: F401
    decontamination, jaccard, language, manifest, mixing, negatives, neighbours, packing, pii, rollups, sharding, toxicity,
    wrappers)
from flightwatch.llm.registry import ORACLES, QUERIES  # noqa: F401
