"""Session settings that the engine's queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "tracelode", cores: str | int = "*", partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster, spark-submit's own settings win over these defaults."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
