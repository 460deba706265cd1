"""Parquet tables by name below a folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def kept_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, so that what follows doesn't compute it again."""
    path = kept_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: Column | str, name: str = "nr") -> DataFrame:
    """df with the place of each row in this order, from 1. Rows are dealt by ranges and counted within them, so no task sees all; only a row for each range is ordered in one."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = kept(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return dealt.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")
