"""Sources and sinks: parquet tables, generated grids, and feeds written as parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files of a micro-batch.
FILES = 64


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = FILES) -> DataFrame:
    """The same table as a stream of its files."""
    schema = load(spark, folder, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parque[t]")  # a glob: the path may be a file or a folder


def save(df: DataFrame, path: str, by: list[str] | None = None, cluster: list[Column] | None = None, mode: str = "errorifexists") -> None:
    """Write parquet, optionally in folders by some columns, and clustered so that row groups can be skipped."""
    out = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster) if cluster else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def millis(ts: Column) -> Column:
    return F.floor(micros(ts) / 1000).cast("long")


def cells(spark: SparkSession, width: int, height: int) -> DataFrame:
    """Every cell x, y of a grid, generated in parallel."""
    n = spark.range(width * height)
    return n.select((F.col("id") % width).cast("int").alias("x"), F.expr(f"id div {width}").cast("int").alias("y"))
