"""Retention of keyed data from access logs: FIFO, LRU, LFU and multimaps. A log has an order and a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lru(log: DataFrame, key: str, order: list[str], n: int, values: list[str] | None = None) -> DataFrame:
    """The n keys accessed last, most recent first. Exact for logs in which every access stores the key (a miss re-inserts)."""
    last = log.groupBy(key).agg(F.max(F.struct(*order)).alias("_o"), *[F.max_by(v, F.struct(*order)).alias(v) for v in values or []])
    return last.orderBy(F.desc("_o"), key).limit(n).select(key, *[F.col(f"_o.{o}").alias(f"last_{o}") for o in order], *(values or []))


def last_writes(log: DataFrame, key: str, order: list[str], n: int, is_write) -> DataFrame:
    """LRU by the last write; reads do not reorder."""
    return lru(log.where(is_write), key, order, n)


def ends(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row: the key inserted first and the key inserted last, by first insertion."""
    first = log.groupBy(key).agg(F.min(F.struct(*order)).alias("_o"))
    return first.agg(F.min_by(key, "_o").alias("oldest"), F.max_by(key, "_o").alias("newest"))


def recent(log: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows, oldest first; all rows where n is not positive."""
    return (log.orderBy(*map(F.desc, order)).limit(n) if n > 0 else log).orderBy(*order)


def counters(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Accesses of each key and when it reached its count."""
    return log.groupBy(key).agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("_o")).select(key, "n", *[F.col(f"_o.{o}").alias(f"last_{o}") for o in order])


def most_frequent(counted: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """Ties: the key that reached the count last comes first."""
    return counted.orderBy(F.desc("n"), *[F.desc(f"last_{o}") for o in order], key).limit(k)


def least_frequent(counted: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    return counted.orderBy("n", *[F.desc(f"last_{o}") for o in order], key).limit(k)


def evict_least_frequent(counted: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Without the most recent of the least frequent keys."""
    return counted.join(least_frequent(counted, key, order, 1).select(key), key, "left_anti")


def counter_stats(counted: DataFrame) -> DataFrame:
    return counted.agg(F.count("*").alias("keys"), F.sum("n").alias("accesses"), F.min("n").alias("low"), F.max("n").alias("high"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))


def fifo(log: DataFrame, groups: list[str], key: str, order: list[str], n: int, delete=None, refresh: bool = False) -> DataFrame:
    """Contents of one FIFO cache a group after its log: group, position (0 oldest), key.

    A key enters at its first access and after it was evicted or deleted; accesses while it is held keep its place, or, with
    ``refresh`` (which makes the cache an LRU one), move it to the end. What is
    held depends on all that came before, so a group is folded in order; its rows stream through in bounded batches and only
    the cache is kept, so groups of any length work.
    """
    rows = log.select(*groups, *order, F.col(key).alias("_key"), (F.lit(False) if delete is None else delete).alias("_gone"))
    schema = ", ".join(f"{g} {log.schema[g].dataType.simpleString()}" for g in groups) + f", position int, {key} {log.schema[key].dataType.simpleString()}"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for b in batches:
            for row in b.itertuples(index=False):
                group = tuple(row[: len(groups)])
                if group != at:
                    if at is not None:
                        yield contents(at, held)
                    at, held = group, {}
                if row[-1]:
                    held.pop(row[-2], None)
                elif row[-2] not in held:
                    if len(held) == n:
                        held.pop(next(iter(held)))
                    held[row[-2]] = None
                elif refresh:
                    held[row[-2]] = held.pop(row[-2])
        if at is not None:
            yield contents(at, held)

    def contents(group: tuple, held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*group, i, k) for i, k in enumerate(held)], columns=[*groups, "position", key])

    return rows.repartition(*groups).sortWithinPartitions(*groups, *order).mapInPandas(fold, schema)


def multimap(rows: DataFrame, key: str, value: str, order: list[str], duplicates: bool = True) -> DataFrame:
    """Values of each key in order of insertion; without duplicates the first of equals stays."""
    if not duplicates:
        rows = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_o")).select(key, value, *[F.col(f"_o.{o}").alias(o) for o in order])
    pairs = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_v"))
    return pairs.select(key, F.transform("_v", lambda x: x[value]).alias("members"))


def remove_first(rows: DataFrame, gone: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows without the first match of each (key, value) of ``gone``."""
    first = rows.join(gone.select(key, value).distinct(), [key, value], "left_semi").groupBy(key, value).agg(F.min(F.struct(*order)).alias("_o"))
    return rows.join(first.select(key, value, *[F.col(f"_o.{o}").alias(o) for o in order]), [key, value, *order], "left_anti").select(rows.columns)


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Upserts applied: the last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in rest])


def lru_multimap(rows: DataFrame, key: str, value: str, order: list[str], n: int) -> DataFrame:
    """A multimap that keeps the n keys touched last, each with all its values."""
    return multimap(rows.join(lru(rows, key, order, n).select(key), key, "left_semi"), key, value, order)


def keyed_rank(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def probe_counters(probes: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """``probes`` (key) with ``n``, 0 for keys that are not held; a look counts as no access."""
    return probes.join(counted.select(key, "n"), key, "left").na.fill(0, ["n"])


def in_touch_order(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keys with when they were touched last, which orders them: the greatest first."""
    return rows.groupBy(key).agg(F.max(F.struct(*order)).alias("_o")).select(key, *[F.col(f"_o.{o}").alias(f"last_{o}") for o in order])


def occupancy(contents: DataFrame, groups: list[str], n: int) -> DataFrame:
    """Entries, capacity, and whether it is used up, of the caches that ``fifo`` gives."""
    return contents.groupBy(*groups).agg(F.count("*").alias("entries")).withColumns({"capacity": F.lit(n), "full": F.col("entries") == n})


def cache_ends(contents: DataFrame, groups: list[str], key: str) -> DataFrame:
    """A look at both ends of the caches that ``fifo`` gives, which moves nothing: first out, last out."""
    return contents.groupBy(*groups).agg(F.min_by(key, "position").alias("first_out"), F.max_by(key, "position").alias("last_out"))
