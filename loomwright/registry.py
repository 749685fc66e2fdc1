"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_FIXTURES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_FIXTURE_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, and the SQL that gives the same rows."""

    def keep(f):
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return keep


def fixture(name: str, oracle: str | None = None):
    """Keep a check on fixed rows for the tests; it reads no table, so it is no query."""

    def keep(f):
        _FIXTURES[name] = f
        if oracle:
            _FIXTURE_ORACLES[name] = oracle
        return f

    return keep


def _load() -> None:
    from .plans import load

    load()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def fixtures() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """Checks on fixed rows, each with its SQL or None."""
    _load()
    return {k: (f, _FIXTURE_ORACLES.get(k)) for k, f in _FIXTURES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
