"""Streaming forms: windowed aggregation, filtered views and keyed state, run over the files at hand and then read as tables.

Each runs with ``availableNow`` and a checkpoint of its own in the shared folder, so it can be run again over new files.
Files come in any order and in batches of ``files_per_batch``, and every row counts, whatever batch it comes in. A ``delay``
sets a watermark, which bounds the state and drops rows that are later than it; without one nothing is late.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import keyed
from tessera.sources.tables import FILES, micros, stream


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _run(writer, path: str) -> None:
    query = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _timed(rows: DataFrame, ts: str, delay: str | None) -> DataFrame:
    rows = rows.withColumn("_t", F.timestamp_micros(micros(F.col(ts))))
    return rows.withWatermark("_t", delay) if delay else rows


def tumbling(spark: SparkSession, folder: str, table: str, ts: str, width: str, keys: list[str], value: str, delay: str | None = None, files_per_batch: int = FILES) -> DataFrame:
    """Count and sum by key and window: keys, start_us, n, total. Each batch upserts the windows it changed."""
    path = _folder(spark, "tumbling")
    rows = _timed(stream(spark, folder, table, files_per_batch), ts, delay)
    sums = rows.groupBy(*keys, F.window("_t", width)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    out = sums.select(*keys, F.unix_micros("window.start").alias("start_us"), "n", "total")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    _run(out.writeStream.outputMode("update").foreachBatch(keep), path)
    got = spark.read.parquet(f"{path}/data")
    rest = ["n", "total"]
    return got.groupBy(*keys, "start_us").agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "start_us", "_r.n", "_r.total")


def filtered(spark: SparkSession, folder: str, table: str, condition: str) -> DataFrame:
    """A view that holds what meets the condition, appended exactly once."""
    path = _folder(spark, "filtered")
    _run(stream(spark, folder, table).where(condition).writeStream.format("parquet").option("path", f"{path}/data"), path)
    return spark.read.schema(stream(spark, folder, table).schema).parquet(f"{path}/data")


def latest_states(spark: SparkSession, folder: str, table: str, key: str, order: list[str], value: str) -> DataFrame:
    """Count and latest value of each key: key, n, latest; state is kept by the engine, changes are upserted."""
    path = _folder(spark, "states")
    rows = stream(spark, folder, table)
    state = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(F.struct(*order, value)).alias("_m")).select(key, "n", F.col(f"_m.{value}").alias("latest"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    _run(state.writeStream.outputMode("update").foreachBatch(keep), path)
    got = spark.read.parquet(f"{path}/data")
    return got.groupBy(key).agg(F.max_by(F.struct("n", "latest"), "_batch").alias("_r")).select(key, "_r.n", "_r.latest")


def fifo(spark: SparkSession, folder: str, table: str, group: str, key: str, order: list[str], n: int, files_per_batch: int = FILES) -> DataFrame:
    """A FIFO cache a group over an appended log: group, position (0 oldest), key.

    What a FIFO holds depends on every row before, so rows of later files that are older cannot be folded into a cache.
    The stream appends the log exactly once, and the log is folded in order.
    """
    path = _folder(spark, "fifo")
    rows = stream(spark, folder, table, files_per_batch).select(group, *order, key)
    _run(rows.writeStream.format("parquet").option("path", f"{path}/data"), path)
    return keyed.fifo(spark.read.schema(rows.schema).parquet(f"{path}/data"), [group], key, order, n)


def deduplicated(spark: SparkSession, folder: str, table: str, ts: str, keys: list[str], delay: str | None = None, files_per_batch: int = FILES) -> DataFrame:
    """One row of each key: keys. With a ``delay``, of each key within the watermark; state is dropped as it passes."""
    path = _folder(spark, "deduplicated")
    rows = _timed(stream(spark, folder, table, files_per_batch), ts, delay).select("_t", *keys)
    once = (rows.dropDuplicatesWithinWatermark(keys) if delay else rows.dropDuplicates(keys)).select(*keys)
    _run(once.writeStream.format("parquet").option("path", f"{path}/data"), path)
    return spark.read.schema(once.schema).parquet(f"{path}/data")


def appended(spark: SparkSession, folder: str, table: str, files_per_batch: int = FILES) -> DataFrame:
    """A long append in batches, each of which is one notification: batch, rows. The stream can be stopped between batches."""
    path = _folder(spark, "appended")

    def note(batch: DataFrame, number: int) -> None:
        batch.agg(F.count("*").alias("rows")).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/notes/number={number}")

    _run(stream(spark, folder, table, files_per_batch).writeStream.foreachBatch(note), path)
    return spark.read.parquet(f"{path}/notes").select("batch", "rows")
