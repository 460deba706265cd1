"""Registry of queries: name -> (Spark plan, DuckDB SQL)."""

from __future__ import annotations

FLAGSHIP = "A17_trends_daily"

_QUERIES: dict = {}
_ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Adds a query (spark, sf_dir) -> DataFrame, with its SQL where there is one."""

    def add(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLES)
