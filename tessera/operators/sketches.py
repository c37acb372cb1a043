"""Mergeable sketches: relational Bloom filters and count-min tables, HyperLogLog and theta columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest_hash(seed: Column, item: Column) -> Column:
    """A hash that other systems can compute too: 60 bits of the MD5 of ``seed:item``."""
    text = F.concat(seed.cast("string"), F.lit(":"), item.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bloom_shape(items: int, fpr: float = 0.01) -> tuple[int, int]:
    """Bits and hashes for a number of items at a false-positive rate."""
    if items <= 0 or not 0 < fpr < 1:
        raise ValueError("items must be positive and fpr between 0 and 1")
    bits = max(1, math.ceil(-items * math.log(fpr) / math.log(2) ** 2))
    return bits, min(20, max(1, math.ceil(bits / items * math.log(2))))


def _two_hashes(item: Column, bits: int, seed: int, hash_) -> tuple[Column, Column]:
    return F.pmod(hash_(F.lit(seed), item), F.lit(bits)), F.pmod(hash_(F.lit(seed + 1), item).bitwiseOR(F.lit(1)), F.lit(bits))


def _positions(h1: Column, h2: Column, bits: int, hashes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(bits)))


def bloom_positions(item: Column, bits: int, hashes: int, seed: int = 0, hash_=F.xxhash64) -> Column:
    """The array of bit positions of an item: two hashes combined, the second odd."""
    return _positions(*_two_hashes(item, bits, seed, hash_), bits, hashes)


def _bit() -> Column:
    """The column ``bit`` as a mask within its word of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))


def bloom(df: DataFrame, item: Column, bits: int, hashes: int, seed: int = 0, hash_=F.xxhash64) -> DataFrame:
    """The set bits of a filter as words: word, mask. Built by a partial and a final OR."""
    at = df.where(item.isNotNull()).select(F.explode(bloom_positions(item, bits, hashes, seed, hash_)).alias("bit"))
    word, mask = F.expr("bit div 64").alias("word"), _bit().alias("mask")
    return at.select(word, mask).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def bloom_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def bloom_probe(df: DataFrame, item: Column, sketch: DataFrame, bits: int, hashes: int, seed: int = 0, hash_=F.xxhash64) -> DataFrame:
    """``df`` with ``maybe``: whether all bits of the item are set; null items: false. The filter's words are joined by number, not collected.

    Rows find their answer by the two hashes of their item, which say all that is asked of it. A number given to a row would not
    do: both sides of that join are computed by themselves, and the order of rows after a shuffle may differ between them.
    """
    h1, h2 = _two_hashes(item, bits, seed, hash_)
    rows = df.withColumns({"_h1": F.when(item.isNotNull(), h1), "_h2": F.when(item.isNotNull(), h2)})
    asked = rows.select("_h1", "_h2").where(F.col("_h1").isNotNull()).distinct()
    at = asked.select("_h1", "_h2", F.explode(F.array_distinct(_positions(F.col("_h1"), F.col("_h2"), bits, hashes))).alias("bit"))
    hit = F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(_bit()) != 0
    seen = at.withColumn("word", F.expr("bit div 64")).join(sketch, "word", "left").groupBy("_h1", "_h2").agg(F.bool_and(hit).alias("maybe"))
    return rows.join(seen, ["_h1", "_h2"], "left").withColumn("maybe", F.coalesce("maybe", F.lit(False))).drop("_h1", "_h2")


def bloom_semi_join(df: DataFrame, key: str, other: DataFrame, bits: int, hashes: int, seed: int = 0) -> DataFrame:
    """Rows of ``df`` whose key is in ``other``: the filter drops most others before the exact join moves any row."""
    keys = other.select(key).distinct()
    maybe = bloom_probe(df, F.col(key), bloom(keys, F.col(key), bits, hashes, seed), bits, hashes, seed).where("maybe").drop("maybe")
    return maybe.join(keys, key, "left_semi")


def bloom_stats(sketch: DataFrame, bits: int, hashes: int) -> DataFrame:
    """One row: set bits, fill ratio, items estimated from the fill, modelled false-positive rate, bytes of the bits."""
    filled = sketch.agg(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).cast("long").alias("set_bits"))
    fill = F.col("set_bits") / bits
    return filled.select("set_bits", fill.alias("fill_ratio"), F.when(fill < 1, F.rint(-(bits / hashes) * F.log(1 - fill))).cast("long").alias("items"), F.pow(fill, F.lit(hashes)).alias("false_positive_rate"), F.lit(8 * -(-bits // 64)).cast("long").alias("bytes"))


MOST = 4_294_967_295


def cms_shape(error: float, confidence: float = 0.99) -> tuple[int, int]:
    """Width (a power of two) and depth for an error and a confidence."""
    return 1 << math.ceil(math.log2(math.e / error)), math.ceil(math.log(1 / (1 - confidence)))


def _rows(item: Column, width: int, depth: int, seed: int, hash_) -> Column:
    return F.array(*[F.struct(F.lit(d).alias("row"), F.pmod(hash_(F.lit(seed * 1000 + d), item), F.lit(width)).alias("cell")) for d in range(depth)])


def count_min(df: DataFrame, item: Column, width: int = 1024, depth: int = 4, seed: int = 0, count: Column | None = None, hash_=F.xxhash64) -> DataFrame:
    """Cells of a count-min table: row, cell, count. At most depth x width rows, so it may be broadcast."""
    n = F.lit(1) if count is None else count
    sums = df.where(item.isNotNull()).groupBy(item.alias("item")).agg(F.sum(n).cast("long").alias("n"))
    cells = sums.select(F.explode(_rows(F.col("item"), width, depth, seed, hash_)).alias("c"), "n")
    return cells.groupBy("c.row", "c.cell").agg(F.least(F.sum("n"), F.lit(MOST)).cast("long").alias("count"))


def cms_estimate(items: DataFrame, item: Column, sketch: DataFrame, width: int, depth: int, seed: int = 0, hash_=F.xxhash64) -> DataFrame:
    """``items`` with ``estimate``: the least of their cells."""
    at = items.withColumn("_i", F.monotonically_increasing_id()).withColumn("_c", F.explode(_rows(item, width, depth, seed, hash_)))
    at = at.withColumns({"row": F.col("_c.row"), "cell": F.col("_c.cell")}).drop("_c").join(F.broadcast(sketch), ["row", "cell"], "left")
    keep = [c for c in items.columns]
    return at.groupBy("_i", *keep).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate")).drop("_i")


def cms_frequency(estimated: DataFrame, sketch: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Estimates as shares of all counts, and whether they reach a threshold in (0, 1]."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    total = sketch.agg((F.coalesce(F.sum("count"), F.lit(0)) / depth).alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("estimate") / F.col("_total")).otherwise(0.0)
    return estimated.join(F.broadcast(total)).withColumn("frequency", share).withColumn("heavy", F.col("frequency") >= threshold).drop("_total")


def cms_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("row", "cell").agg(F.least(F.sum("count"), F.lit(MOST)).cast("long").alias("count"))


def cms_scale(sketch: DataFrame, factor: float) -> DataFrame:
    """Decay: every cell times a factor in 0..1, truncated."""
    if not 0 <= factor <= 1:
        raise ValueError("factor must lie in 0..1")
    return sketch.withColumn("count", F.floor(F.col("count") * factor).cast("long"))


def cms_stats(spark: SparkSession, sketch: DataFrame, width: int, depth: int) -> DataFrame:
    """Least, greatest and mean cell, share of cells in use, all counts, greatest error and bytes, over all cells, empty ones too."""
    n = width * depth
    got = sketch.agg(F.count_if(F.col("count") > 0).alias("used"), F.max("count").alias("high"), F.sum("count").alias("total"), F.min("count").alias("least"))
    return got.select(F.when(F.col("used") < n, 0).otherwise(F.col("least")).cast("long").alias("low"), F.coalesce("high", F.lit(0)).cast("long").alias("high"), (F.coalesce("total", F.lit(0)) / n).alias("mean"), (F.col("used") / n).alias("fill"), (F.coalesce("total", F.lit(0)) / depth).alias("counted"), (F.coalesce("total", F.lit(0)) / depth * F.lit(math.e / width)).alias("max_error"), F.lit(4 * n).cast("long").alias("bytes"))


def hll(item: Column, bucket_bits: int = 12) -> Column:
    """Distinct-count sketch as an aggregate; merge with hll_union_agg."""
    return F.hll_sketch_agg(item, F.lit(bucket_bits))


def hll_stats(sketches: DataFrame, sketch: str, bucket_bits: int = 12) -> DataFrame:
    """``sketches`` with estimate, standard error, registers and the bytes that the sketch takes now."""
    new = {"estimate": F.hll_sketch_estimate(sketch), "standard_error": F.lit(hll_error(bucket_bits)), "registers": F.lit(1 << bucket_bits), "bytes": F.octet_length(sketch)}
    return sketches.withColumns(new)


def hll_error(bucket_bits: int = 12) -> float:
    return 1.04 / math.sqrt(1 << bucket_bits)


def heavy_hitters(df: DataFrame, item: str, share: float) -> DataFrame:
    """Items of at least a share of all rows, exactly: candidates by a partial count, total by one more aggregate."""
    total = df.agg(F.count(item).alias("total"))
    return df.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("n")).join(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select(item, "n")
