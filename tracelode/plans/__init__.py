"""The query catalogue with its DuckDB counterparts."""

from . import custom, engine, logs, ranks, requests, sessions, texts, threads  # noqa: F401
