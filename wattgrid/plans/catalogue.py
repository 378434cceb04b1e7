"""Imports every module that registers queries."""

from wattgrid.plans import (  # noqa: F401
    combining,
    documents,
    files,
    formulas,
    measures,
    models,
    preparing,
    streams,
    summaries,
    tables,
    timelines,
)
from wattgrid.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
