"""What the operators of this subpackage share: table access and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words in every operator here: space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, a local session gets a folder of its machine's, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with nr, from 0 in this order: rows are dealt by ranges and counted within them, and the ranges follow each other."""
    part, at = unused("part", df.columns), unused("at", df.columns)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(at)), "numbered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = dealt.groupBy(part).agg(F.count("*").alias("nr")).withColumn("nr", F.coalesce(F.sum("nr").over(before), F.lit(0)))
    return dealt.join(offsets, part).withColumn("nr", F.col("nr") + F.col(at)).drop(part, at)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table of written() that nothing reads any more."""
    spark = df.sparkSession
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """name, lengthened until no column has it in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh(seen: set, item, most: int) -> bool:
    """Whether item is not in seen; adds it. The set starts anew when it holds `most`, so it may call an old item fresh."""
    if item in seen:
        return False
    if len(seen) >= most:
        seen.clear()
    seen.add(item)
    return True


def values(column: pa.Array) -> Iterator:
    """The column's values one by one: a batch of long texts isn't held twice."""
    return (x.as_py() for x in column)


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what is made of a slice is small beside the batch itself."""
    for b in batches:
        for low in range(0, b.num_rows, rows):
            yield b.slice(low, rows)


def text_id(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, other characters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
