"""Collects queries and their SQL as the plan modules declare them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None) -> Callable:
    """Register a function of (spark, sf_dir); ``oracle`` is the same in SQL, None where SQL cannot say it."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add
