"""Sessions like a given one, by five weighed signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts how much: tools in common, shared beginning of the folder's path, nearness in time, tags, and tokens.
WEIGHTS = {"tools": 30, "project": 25, "time": 15, "tags": 20, "tokens": 10}
WEEK = 7 * 86400.0


def _overlap(a: Column, b: Column, neither: float) -> Column:
    """Per cent of two sets' union that both have; `neither` if both are empty."""
    n, m = F.size(a), F.size(b)
    return F.when((n == 0) & (m == 0), neither).when((n == 0) | (m == 0), 0.0).otherwise(100.0 * F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def similar(sessions: DataFrame, to: str, weights: dict[str, int] | None = None, least: float = 0.0, most: int | None = None) -> DataFrame:
    """(session_key, total, tools, project, time, tags, tokens) of sessions(session_key, project, modified, tools, tags, tokens) against the one of key `to`, in per cent, the most like first.

    The given session is one row, and each other is compared with it once. Null lists and paths count as empty, null
    times as infinitely far. Ties go to the smaller key.
    """
    w = WEIGHTS | (weights or {})
    none = F.array().cast("array<string>")
    s = sessions.select("session_key", F.coalesce("project", F.lit("")).alias("project"), F.col("modified").cast("timestamp").alias("modified"), F.coalesce("tools", none).alias("tools"), F.coalesce("tags", none).alias("tags"), F.coalesce("tokens", F.lit(0)).cast("double").alias("tokens"))
    given = s.filter(F.col("session_key") == to).limit(1)
    x = s.filter(F.col("session_key") != to).crossJoin(F.broadcast(given.select(*[F.col(c).alias(f"my_{c}") for c in s.columns if c != "session_key"])))
    a, b = F.split("project", "/"), F.split("my_project", "/")
    shared = F.zip_with(a, b, lambda p, q: F.coalesce(p == q, F.lit(False)))
    apart = F.array_position(shared, False)
    prefix = F.when(apart == 0, F.least(F.size(a), F.size(b))).otherwise(apart - 1)
    far = F.abs(F.unix_seconds("modified") - F.unix_seconds("my_modified"))
    larger = F.greatest("tokens", "my_tokens")
    parts = {
        "tools": _overlap(F.col("tools"), F.col("my_tools"), 100.0), "project": F.when(F.col("project") == F.col("my_project"), 100.0).otherwise(100.0 * prefix / F.greatest(F.size(a), F.size(b))),
        "time": F.coalesce(100.0 * F.exp(-far / WEEK), F.lit(0.0)), "tags": _overlap(F.col("tags"), F.col("my_tags"), 50.0),
        "tokens": F.when(larger == 0, 100.0).when(F.least("tokens", "my_tokens") == 0, 0.0).otherwise(100.0 * (1 - F.abs(F.col("tokens") - F.col("my_tokens")) / larger)),
    }
    all_ = sum(w.values())
    total = sum((parts[k] * w[k] for k in parts), F.lit(0.0)) / all_ if all_ else F.lit(0.0)
    out = x.select("session_key", total.alias("total"), *[v.alias(k) for k, v in parts.items()]).filter(F.col("total") >= least).orderBy(F.desc("total"), "session_key")
    return out.limit(most) if most is not None else out
