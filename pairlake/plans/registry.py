"""All registered queries."""

from pairlake.plans import (  # noqa: F401
    catalog_queries,
    evaluate_queries,
    frame_queries,
    gate_queries,
    result_queries,
    sample_queries,
)
from pairlake.plans.common import ORACLES, QUERIES

FLAGSHIP = "prepare_pairs"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
