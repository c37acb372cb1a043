"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by a key. A size-weighted sample of keys gives splitters at its quantiles, which cut the order
into ranges; exact bytes and rows of each range follow from one aggregation. Ranges that hold more than their share
are subdivided by a tie-break hash (rows of one key differ in it) or, for identical rows, by a salt. A running sum
inside each range, on top of the ranges before it, places every record at its exact byte offset in the whole order,
and shard boundaries fall at equal shares of the bytes: shards differ by less than one record.

Nulls: a null text has no bytes (size 1); null keys sort first and are subdivided like any other key. Empty tables give
no rows. Repeated rows each get a slot of their own. Input columns beside key and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import written

#: Keys in the sample, and fewest and most ranges (a range's window sorts some 60 bytes a record, not its texts).
SAMPLE, RANGES, MOST_RANGES = 16_384, 512, 16_384
#: Bytes of text a range should hold; more ranges are made for larger inputs.
RANGE_BYTES = 64 << 20


def _step(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are <= value: a search tree of two levels of literal arrays."""
    fan = max(32, math.isqrt(len(bounds)))
    if len(bounds) <= fan:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= value)) if bounds else F.lit(0)
    width = -(-len(bounds) // fan)
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    at = F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lambda b: b <= value))
    table = F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    inner = F.size(F.filter(F.element_at(table, F.greatest(at, F.lit(1))), lambda b: b <= value))
    return F.greatest(at - 1, F.lit(0)) * width + inner


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, sample: int = SAMPLE, ranges: int = RANGES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``key, size, text_crc32, shard, slot`` for every row; shards are ranges of the key of near equal bytes."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).cast("long").alias("k"),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value).alias("text_crc32"),
        F.xxhash64(F.col(key), value).alias("tie"),
        F.monotonically_increasing_id().alias("salt"),
    )
    rows = written(rows, "shard-keys")  # the texts are read once; what follows works on some 40 bytes a record
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return _empty(rows, key)
    count = min(max(ranges, -(-total // range_bytes)), MOST_RANGES)
    # A weighted draw: -ln(u)/size is the row's first arrival at a rate of its size, and those before the time at which
    # ``sample`` arrivals are expected of all bytes are drawn, so that the driver gets some ``sample`` keys, whatever the input.
    u = (F.pmod(F.xxhash64("tie", "salt"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    early = -F.log(u) / F.col("size") <= F.lit(max(sample, 4 * count) / total)
    drawn = sorted(r.k for r in rows.where(F.col("k").isNotNull() & early).select("k").collect())
    bounds = sorted({drawn[i * len(drawn) // count] for i in range(1, count)}) if drawn else []
    rows = rows.withColumn("range", F.when(F.col("k").isNull(), -1).otherwise(_step(F.col("k"), bounds)))
    per = rows.groupBy("range").agg(F.sum("size").alias("bytes")).collect()
    most = max(2 * total // count, 1)
    parts = {r.range: -(-r.bytes // most) for r in per if r.bytes > most}
    # Overfull ranges: keys are few there, so order by (key, tie-break, salt) needs cuts inside one key.
    rows = rows.withColumn("part", F.lit(0)).withColumn("cut", F.col("salt"))
    if parts:
        many = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
        rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("tie", "salt"), many[F.col("range")]), F.lit(0)).cast("int"))
    held = rows.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    before, run = {}, 0
    for r in sorted(held, key=lambda r: (r.range, r.part)):
        before[r.range, r.part] = run
        run += r.bytes
    spark = df.sparkSession
    offsets = spark.createDataFrame([(a, b, v) for (a, b), v in before.items()], "range int, part int, before long")
    inside = Window.partitionBy("range", "part").orderBy("k", "tie", "salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), ["range", "part"])
        .withColumn("at", F.col("before") + F.col("own"))
        .withColumn("shard", F.least(F.floor((F.col("at") + F.col("size") / 2) * shards / F.lit(total)), F.lit(shards - 1)).cast("int"))
    )
    # Rows of a shard that lie in earlier ranges come first; inside a range they are numbered in key order.
    cells = placed.groupBy("range", "part", "shard").agg(F.count("*").alias("rows"))
    got, first = {}, {}
    for r in sorted(cells.collect(), key=lambda r: (r.range, r.part)):
        first[r.range, r.part, r.shard] = got.get(r.shard, 0)
        got[r.shard] = got.get(r.shard, 0) + r.rows
    starts = spark.createDataFrame([(*k, v) for k, v in first.items()], "range int, part int, shard int, first long")
    number = Window.partitionBy("range", "part", "shard").orderBy("k", "tie", "salt")
    return (
        placed.withColumn("n", F.row_number().over(number))
        .join(F.broadcast(starts), ["range", "part", "shard"])
        .select(F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("first") + F.col("n") - 1).alias("slot"))
    )


def _empty(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col("k").alias(key), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
