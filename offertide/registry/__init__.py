"""Registered queries: one callable per operator, with its SQL oracle where one exists."""

from offertide.registry.core import ORACLES, QUERIES
from offertide.registry import (  # noqa: F401  (each module registers its queries)
    prepare,
    quality,
    describe,
    evaluate,
    model,
    serve,
    segment,
    invariants,
)

__all__ = ["ORACLES", "QUERIES"]
