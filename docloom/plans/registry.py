"""Registration of queries, each with its DuckDB oracle."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a query function (spark, sf_dir) under a name, with its oracle SQL."""

    def keep(f):
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLES)
