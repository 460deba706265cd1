"""User annotations: tags, goals, notes and decisions, as an append-only table of changes.

A change is a row; the state is the last change of each id, so a store survives writers that meet, and its history
stays. Stores are small next to the logs and are joined to sessions by their key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "kind string, id string, seq long, removed boolean, session_key string, name string, status string, body string, confidence double, at timestamp"
#: Statuses of each kind.
STATUSES = {"goal": ("open", "in_progress", "done", "abandoned"), "decision": ("proposed", "confirmed", "superseded", "abandoned"), "note": ("active", "expired"), "tag": ("set",), "outcome": ("success", "partial", "failed", "abandoned"), "bookmark": ("set",), "name": ("set",), "link": ("set",)}


class Registry:
    """A store of one folder of Parquet files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _changes(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def put(self, kind: str, id: str, at, session_key: str | None = None, name: str | None = None, status: str | None = None, body: str | None = None, confidence: float | None = None, removed: bool = False) -> None:
        """Adds or changes an item; what isn't given stays as it was."""
        if kind not in STATUSES or (status is not None and status not in STATUSES[kind]):
            raise ValueError(f"{kind}: {status}")
        seq = (self._changes().agg(F.max("seq")).first()[0] or 0) + 1
        row = (kind, id, seq, removed, session_key, name, status, body, confidence, at)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def remove(self, kind: str, id: str, at) -> None:
        self.put(kind, id, at, removed=True)

    def items(self, kind: str | None = None) -> DataFrame:
        """The current items: of each column the last value given since the item was last removed."""
        c = self._changes() if kind is None else self._changes().filter(F.col("kind") == kind)
        w = Window.partitionBy("kind", "id")
        c = c.withColumn("gone", F.coalesce(F.max(F.when(F.col("removed"), F.col("seq"))).over(w), F.lit(0))).filter("seq > gone")
        last = [F.max_by(x, F.when(F.col(x).isNotNull(), F.col("seq"))).alias(x) for x in ("session_key", "name", "status", "body", "confidence")]
        return c.groupBy("kind", "id").agg(*last, F.max("at").alias("at"))

    def supersede(self, old: str, new: str, at, **fields) -> None:
        """Replaces a decision by a new one."""
        self.put("decision", old, at, status="superseded")
        self.put("decision", new, at, status="confirmed", **fields)

    def annotations(self) -> DataFrame:
        """(session_key, tags, outcome, bookmarked, name, notes, links): a row for each session that has any; of several outcomes and names the last counts."""
        i = self.items()
        of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
        last = lambda kind, c: F.max_by(of(kind, c), F.when(F.col("kind") == kind, F.struct("at", "id")))
        return i.filter("session_key is not null").groupBy("session_key").agg(
            F.sort_array(F.collect_set(of("tag", "name"))).alias("tags"), last("outcome", "status").alias("outcome"), F.bool_or(F.col("kind") == "bookmark").alias("bookmarked"), last("name", "name").alias("name"),
            F.count_if(F.col("kind") == "note").alias("notes"), F.sort_array(F.collect_set(of("link", "name"))).alias("links"),
        )

    def annotate(self, sessions: DataFrame) -> DataFrame:
        """sessions with annotations(); Spark picks the join by the store's size."""
        return sessions.join(self.annotations(), "session_key", "left")

    def find(self, tags: tuple[str, ...] = (), every: bool = True, outcome: str | None = None, bookmarked: bool | None = None) -> DataFrame:
        """Sessions with all of the tags, or one of them, and with the outcome and bookmark asked for."""
        a = self.annotations()
        if tags:
            wanted = F.array(*[F.lit(t) for t in tags])
            a = a.filter(F.size(F.array_intersect("tags", wanted)) >= (len(set(tags)) if every else 1))
        if outcome is not None:
            a = a.filter(F.col("outcome") == outcome)
        return a.filter(F.col("bookmarked") == bookmarked) if bookmarked is not None else a

    def outcomes(self) -> DataFrame:
        """(outcome, sessions, share): sessions by outcome, and their share of those that have one, in per cent."""
        n = self.annotations().filter("outcome is not null").groupBy("outcome").agg(F.count("*").alias("sessions"))
        return n.join(n.agg(F.sum("sessions").alias("all"))).select("outcome", "sessions", (100.0 * F.col("sessions") / F.col("all")).alias("share"))
