"""Sequences, sets and change feeds. A sequence is a table with an order; small sequences may be arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smallest(df: DataFrame, k: int, by: list) -> DataFrame:
    """Heap: the k least rows, by a distributed top-k."""
    return df.orderBy(*by).limit(k)


def largest(df: DataFrame, k: int, by: list[str]) -> DataFrame:
    return df.orderBy(*[F.desc(b) for b in by]).limit(k)


def bounded(df: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Bounded list: the first ``capacity`` rows are taken, the rest refused."""
    return df.orderBy(*order).limit(capacity)


def pop(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Stack: the last n rows with the order in which they come off (0 first)."""
    off = df.orderBy(*[F.desc(o) for o in order]).limit(n)
    return off.withColumn("popped", (F.row_number().over(Window.orderBy(*[F.desc(o) for o in order])) - 1).cast("int"))  # n rows at most


def dequeue(df: DataFrame, n: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Queue: the first n rows, and what stays behind."""
    out = df.orderBy(*order).limit(n)
    return out, df.join(out.select(order), order, "left_anti").select(df.columns)


def insert_at(values: Column, index: int, value: Column) -> Column:
    """Arrays are counted from 0 here."""
    return F.array_insert(values, index + 1, value)


def remove_at(values: Column, index: int) -> Column:
    return F.filter(values, lambda x, i: i != index)


def swap_remove(values: Column, index: int) -> Column:
    """Remove by putting the last element in the place."""
    n = F.size(values)
    moved = F.transform(values, lambda x, i: F.when(i == index, F.element_at(values, -1)).otherwise(x))
    return F.when(n > index, F.slice(moved, 1, F.greatest(n - 1, F.lit(0)))).otherwise(values)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one set and not the other, by one aggregation."""
    both = a.distinct().withColumn("_s", F.lit(1)).union(b.distinct().withColumn("_s", F.lit(2)))
    return both.groupBy(*a.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def predicates(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of set predicates of a against b, from one pass over both."""
    cols = a.columns
    both = a.distinct().withColumns({"_a": F.lit(1), "_b": F.lit(0)}).union(b.distinct().withColumns({"_a": F.lit(0), "_b": F.lit(1)}))
    got = both.groupBy(*cols).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).agg(
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("only_a"), F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("only_b"), F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("common")
    )
    oa, ob = F.col("only_a") == 0, F.col("only_b") == 0
    return got.select(
        oa.alias("is_subset"), ob.alias("is_superset"), (oa & ~ob).alias("is_proper_subset"), (ob & ~oa).alias("is_proper_superset"), (F.col("common") > 0).alias("overlaps"), (oa & ob).alias("set_equals")
    )


def apply_changes(log: DataFrame, key: str, version: str) -> DataFrame:
    """The set after a change log (action Add, Remove, Replace, Reset): an item is in if its last change since the last Reset adds it."""
    reset = log.where(F.col("action") == "Reset").agg(F.coalesce(F.max(version), F.lit(-1)).alias("_reset"))
    live = log.join(F.broadcast(reset)).where((F.col(version) > F.col("_reset")) & (F.col("action") != "Reset"))
    last = live.groupBy(key).agg(F.max_by("action", version).alias("action"), F.max(version).alias(version))
    return last.where(F.col("action") != "Remove").select(key, version)


def effective_changes(log: DataFrame, key: str, version: str) -> DataFrame:
    """Changes of a set that changed something: adding what is there or removing what is not notifies nobody."""
    by = Window.partitionBy(key).orderBy(version)
    before = F.coalesce(F.lag("action").over(by), F.lit("Remove"))
    return log.withColumn("_b", before).where(F.col("action") != F.col("_b")).drop("_b")


def diff(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The change feed between two states: key, action (Add, Remove, Replace)."""
    a = before.select(key, F.struct(*values).alias("_a"))
    b = after.select(key, F.struct(*values).alias("_b"))
    action = F.when(F.col("_a").isNull(), "Add").when(F.col("_b").isNull(), "Remove").when(~F.col("_a").eqNullSafe(F.col("_b")), "Replace")
    return a.join(b, key, "full").select(key, action.alias("action")).where("action is not null")


def toggle(items: DataFrame, toggles: DataFrame) -> DataFrame:
    """A set after toggles, each of which puts an item in or takes it out: an odd number of them changes what was there."""
    cols = items.columns
    both = items.distinct().withColumns({"_in": F.lit(1), "_n": F.lit(0)}).unionByName(toggles.select(cols).withColumns({"_in": F.lit(0), "_n": F.lit(1)}))
    return both.groupBy(*cols).agg(F.max("_in").alias("_in"), F.sum("_n").alias("_n")).where((F.col("_in") + F.col("_n")) % 2 == 1).select(cols)


def remove_where(items: DataFrame, condition: Column) -> DataFrame:
    """What stays; items for which the condition is unknown stay."""
    return items.where(~F.coalesce(condition, F.lit(False)))
