"""Registered queries and their SQL."""

from . import machine, retrieval  # noqa: F401  (declare their queries)
from .registry import ORACLES, QUERIES

FLAGSHIP = "q02_hourly_coverage"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
