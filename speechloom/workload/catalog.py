"""Imports every query module, so that the registry is complete."""

from speechloom.workload import (  # noqa: F401
    speaker_queries, region_queries, word_queries, cue_queries, writer_queries, signal_queries, quality_queries,
    alignment_queries,
)
from speechloom.workload.registry import ORACLES, QUERIES  # noqa: F401
