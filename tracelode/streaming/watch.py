"""Following logs as they grow, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import jsonl
from . import growing


def follow(spark: SparkSession, path: str, pattern: str = "*.jsonl", start: str = "beginning") -> DataFrame:
    """Lines of the files below path as they grow, each once: a stream of (file_path, line_no, line).

    line_no is the byte at which the line begins, so it orders a file's lines. start="end" leaves out what is there when
    the query first starts. A line without its end waits; one that isn't UTF-8 comes with the replacement character. A
    file that shrank is read anew. An offset holds a number for each file, so that many million files need a folder
    for each query.
    """
    spark.dataSource.register(growing.GrowingLines)
    return spark.readStream.format("growing_lines").option("pattern", pattern).option("start", start).load(path)


def entries(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The canonical entries of logs as they grow."""
    return jsonl.entries(jsonl.parsed(follow(spark, path, **options)))


def states(entries: DataFrame, recent: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Spells of activity of each session in a stream of entries: it is inactive from `recent` after the last entry of a spell on."""
    e = entries.filter("ts is not null").withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", recent).alias("w"), "session_key").agg(F.count("*").alias("entries")).select("session_key", F.col("w.start").alias("active_from"), F.col("w.end").alias("inactive_from"), "entries")


def activity(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type in windows of a stream events(ts, event_type, value); what is later than the watermark is left out."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def active_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users that gaps of inactivity part."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
