"""The registered queries; importing this package fills the registry."""

from millrace.plans import (  # noqa: F401
    aggregation,
    expressions,
    fleet,
    joining,
    ordering,
    scanning,
    selecting,
    sinking,
    streams,
    windowing,
)
from millrace.plans.registry import QUERIES

__all__ = ["QUERIES"]
