"""Registered queries of the library's own operators."""

from . import chains, comparisons, evaluation, events, filters, intervals, pileups, reads, records, references, reports, rescue, seeds, vectors  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
