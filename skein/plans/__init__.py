"""The registry of the evaluation engine's queries and their SQL oracles."""

from __future__ import annotations

from . import corpus, evaluation, records, reports
from .registry import ORACLES, QUERIES, Query

__all__ = ["corpus", "evaluation", "oracles", "queries", "records", "reports"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
