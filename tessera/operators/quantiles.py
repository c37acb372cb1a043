"""Quantiles, distribution functions and windowed analytics."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Percentiles of the analytics summary by name.
SUMMARY = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def disc(value: str, q: float, down: bool = False) -> Column:
    """The least value whose cumulative share reaches q, as an aggregate; ``down`` counts from the top."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie in 0..1")
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value}{' DESC' if down else ''})")


def type2(value: str, q: float) -> Column:
    """Hyndman-Fan type 2: the mean of both neighbours where the cumulative share is exactly q."""
    return (disc(value, q) + disc(value, round(1 - q, 12), True)) / 2


def approximate(value: str, qs: list[float], accuracy: int = 10_000) -> Column:
    """Quantile sketch with mergeable partial states, for keys of any size."""
    return F.percentile_approx(value, qs, accuracy)


def weighted(df: DataFrame, keys: list[str], value: str, weight: str, q: float, buckets: int = 64) -> DataFrame:
    """The least value whose cumulative weight reaches q of the total.

    A sketch cuts a key's values into buckets, whose weights tell in which one the quantile lies; only that bucket's distinct
    values are ordered.
    """
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_w"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"))
    met = rows.alias("a").join(cuts.alias("b"), _same(keys)).select(*[F.col(f"a.{k}") for k in keys], "_v", "_w", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_b"))
    by = Window.partitionBy(*keys)
    upto = F.sum("_s").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    sums = met.groupBy(*keys, "_b").agg(F.sum("_w").alias("_s")).select(*keys, "_b", "_s", upto.alias("_c"), (q * F.sum("_s").over(by)).alias("_need"))
    one = sums.where("_c >= _need").groupBy(*keys).agg(F.min_by(F.struct("_b", (F.col("_c") - F.col("_s")).alias("before"), "_need"), "_b").alias("_at"))
    inside = met.alias("a").join(one.alias("b"), _same(keys) & (F.col("a._b") == F.col("b._at._b"))).select(*[F.col(f"a.{k}") for k in keys], "_v", "_w", "_at.before", "_at._need")
    cells = inside.groupBy(*keys, "_v", "before", "_need").agg(F.sum("_w").alias("_w"))
    cum = F.sum("_w").over(by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    reached = cells.select(*keys, "_v", (F.col("before") + cum >= F.col("_need")).alias("_ok")).where("_ok")
    return reached.groupBy(*keys).agg(F.min("_v").alias("quantile"))


def cdf(value: str, x: float) -> Column:
    """Share at or below x as an aggregate: all weight below, and half of the weight of the least value at or above x."""
    v = F.col(value)
    below = F.count_if(v < x)
    return F.when(F.count(v) == 0, None).when(F.min(v) > x, 0.0).when(F.max(v) <= x, 1.0).otherwise((below + 0.5 * F.count_if(v == x)) / F.count(v))


def nearest_rank(value: str, p: float) -> Column:
    """The ceil(p n)-th smallest."""
    return disc(value, p)


#: Accuracy of the sketch that brackets an exact quantile: its ranks are off by at most one in so many.
BRACKET = 10_000


def _same(keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])


def _ranked(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, Column]], extra: list[Column]) -> DataFrame:
    """keys, the aggregates ``extra`` and, by name, the value of each rank (a share near it, and the rank from 1 by ``_n``)."""
    margin = 2 / BRACKET
    ends = [e for q, _ in ranks.values() for e in (max(0.0, q - margin), min(1.0, q + margin))]
    rows = df.withColumn("_v", F.col(value))
    known = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", ends, BRACKET).alias("_e"), *extra)
    names = [c for c in known.columns if c not in (*keys, "_n", "_e")]
    bracket = known.select(*keys, F.col("_e"))
    met = rows.where("_v is not null").select(*keys, "_v").alias("a").join(bracket.alias("b"), _same(keys)).select(*[F.col(f"a.{k}") for k in keys], "_v", "_e")
    # One pass counts what lies below each bracket; what lies inside is counted by value, and only that is ordered.
    below = met.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col("_e")[2 * i]).alias(f"_b{i}") for i in range(len(ranks))])
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(ranks) - 1)), lambda i: F.col("_v").between(F.element_at("_e", i * 2 + 1), F.element_at("_e", i * 2 + 2)))
    cells = met.select(*keys, "_v", F.explode(inside).alias("_i")).groupBy(*keys, "_i", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("_c", upto)
    whole = known.select(*keys, "_n", *names).alias("a").join(below.alias("b"), _same(keys), "left").select("a.*", *[f"_b{i}" for i in range(len(ranks))])
    placed = whole.alias("a").join(cells.alias("b"), _same(keys), "left").select("a.*", "_i", "_v", "_c")
    found = [F.min(F.when((F.col("_i") == i) & (F.col(f"_b{i}") + F.col("_c") >= rank), F.col("_v"))).alias(name) for i, (name, (_, rank)) in enumerate(ranks.items())]
    return placed.groupBy(*keys).agg(*[F.first(n).alias(n) for n in names], *found)


def _rank(q: float) -> Column:
    return F.greatest(F.lit(1), F.col("_n") - F.floor(F.col("_n") - F.col("_n") * q))


def exact(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], extra: list[Column] | None = None) -> DataFrame:
    """Exact discrete quantiles of keys of any size, by name: keys, the aggregates ``extra``, quantiles.

    A mergeable sketch brackets each quantile, a second pass counts what lies below the bracket, and only the values inside it,
    a few in ten thousand of a key's rows, are ordered. No task holds a key's values.
    """
    if not all(0 <= q <= 1 for q in qs.values()):
        raise ValueError("quantiles must lie in 0..1")
    return _ranked(df, keys, value, {n: (q, _rank(q)) for n, q in qs.items()}, extra or [])


def exact_type2(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """``exact`` with the mean of both neighbours where the cumulative share is exactly q (Hyndman-Fan type 2)."""
    ranks = {}
    for name, q in qs.items():
        ranks |= {f"_lo_{name}": (q, _rank(q)), f"_hi_{name}": (q, F.least("_n", F.floor(F.col("_n") * q) + 1))}
    got = _ranked(df, keys, value, ranks, [])
    return got.select(*keys, *[((F.col(f"_lo_{n}") + F.col(f"_hi_{n}")) / 2).alias(n) for n in qs])


def summary(df: DataFrame, keys: list[str], value: str, window_ms: int, approx: bool = False) -> DataFrame:
    """Count, extremes, percentiles and rates of each group: percentiles exact, or by one sketch."""
    plain = [F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")]
    if approx:
        out = df.groupBy(*keys).agg(*plain, F.percentile_approx(value, list(SUMMARY.values())).alias("_q"))
        out = out.select(*keys, "n", "low", "high", *[F.col("_q")[i].alias(n) for i, n in enumerate(SUMMARY)])
    else:
        out = exact(df, keys, value, SUMMARY, plain)
    return out.withColumn("rate_per_second", F.col("n") / F.lit(window_ms / 1000.0))


def merged_summary(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial summaries (n, low, high, total, sketch: KLL of doubles) of one key, merged."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.expr("kll_merge_agg_double(sketch)").alias("sketch"))


def weighted_summary(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Total weight, rows, least and greatest value and weighted mean; rows without a positive weight do not count."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    total = F.sum(weight)
    return rows.groupBy(*keys).agg(total.alias("total_weight"), F.count("*").alias("rows"), F.min(value).alias("low"), F.max(value).alias("high"), (F.sum(F.col(value) * F.col(weight)) / total).alias("mean"))


def in_window(df: DataFrame, ts: Column, as_of: Column, window: int) -> DataFrame:
    """Rows no older than ``window`` at ``as_of`` (same unit), later ones left out."""
    return df.where((ts >= as_of - window) & (ts <= as_of))


def rolling(df: DataFrame, keys: list[str], ts: Column, value: str, q: float, window: int, out: str, stretch: int = 24) -> DataFrame:
    """At every row the q-quantile of its key's rows in the closed window that ends there.

    Time is cut into stretches of ``stretch`` windows; the rows of a window before a stretch go to it too, so that every frame lies
    in one stretch and a key that holds most of the rows is the work of many tasks.
    """
    width = stretch * max(1, window)
    own = df.withColumns({"_t": ts, "_b": F.floor(ts / width).cast("long"), "_before": F.lit(False)})
    before = own.where(F.col("_t") >= (F.col("_b") + 1) * width - window).withColumns({"_b": F.col("_b") + 1, "_before": F.lit(True)})
    frame = Window.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(-window, 0)
    got = own.unionByName(before).withColumn(out, F.expr(f"percentile_approx({value}, {q}, 100000)").over(frame))
    return got.where("not _before").drop("_t", "_b", "_before")


def sessions(df: DataFrame, keys: list[str], ts: Column, gap: int, order: list[str]) -> DataFrame:
    """Adds ``session``: numbered runs of a key's rows with no gap longer than ``gap``."""
    by = Window.partitionBy(*keys).orderBy(ts, *order)
    new = F.coalesce((ts - F.lag(ts).over(by)) > gap, F.lit(True)).cast("int")
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def accuracy(df: DataFrame, keys: list[str], value: str, p: float, tolerance: float, sketch: int = 10_000) -> DataFrame:
    """The sketch's quantile beside the nearest rank, their relative error, and whether it is within a tolerance."""
    got = df.groupBy(*keys).agg(F.percentile_approx(value, p, sketch).alias("estimate"), nearest_rank(value, p).alias("exact"))
    error = F.when(F.col("exact") == 0, F.abs(F.col("estimate"))).otherwise(F.abs((F.col("estimate") - F.col("exact")) / F.col("exact")))
    return got.withColumn("error", error).withColumn("accurate", F.col("error") <= tolerance)


def p_square(df: DataFrame, keys: list[str], value: str, order: list[str], p: float) -> DataFrame:
    """The five-marker estimate of one quantile, in the order of arrival; below five values the nearest rank.

    keys, estimate, n, low, high and markers (the heights: least, three in between, greatest), from which ``between_markers``
    reads other percentiles.

    Markers move by the piecewise-parabolic rule of Jain and Chlamtac. The estimate depends on the order, so a key is folded
    row by row while its rows stream through; only five markers are kept, so keys of any length work.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def fold(batches):
        at, state = None, None
        for b in batches:
            for row in b.itertuples(index=False):
                key = tuple(row[: len(keys)])
                if key != at:
                    if at is not None:
                        yield pd.DataFrame([(*at, *state.row())], columns=columns)
                    at, state = key, Markers(p)
                state.add(float(row[-1]))
        if at is not None:
            yield pd.DataFrame([(*at, *state.row())], columns=columns)

    columns = [*keys, "estimate", "n", "low", "high", "markers"]
    rows = df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("_v"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold, f"{kinds}, estimate double, n long, low double, high double, markers array<double>")


def between_markers(markers: Column, p: float) -> Column:
    """Another percentile than the one the markers follow: linear between them, as if they stood at quarters."""
    at = min(max(p, 0.0), 1.0) * 4
    i = min(int(at), 3)
    low, high = F.element_at(markers, i + 1), F.element_at(markers, i + 2)
    return F.when(F.size(markers) == 5, low + (high - low) * (at - i)).otherwise(F.element_at(markers, F.greatest(F.lit(1), F.ceil(F.size(markers) * p).cast("int"))))


class Markers:
    """Heights and positions of five markers for one quantile."""

    def __init__(self, p: float):
        self.p, self.first = p, []
        self.height: list[float] = []
        self.place = [1, 2, 3, 4, 5]
        self.wanted = [1, 1 + 2 * p, 1 + 4 * p, 3 + 2 * p, 5]
        self.step = [0, p / 2, p, (1 + p) / 2, 1]

    def add(self, x: float) -> None:
        if not self.height:
            self.first.append(x)
            if len(self.first) == 5:
                self.height = sorted(self.first)
            return
        h, n = self.height, self.place
        h[0], h[4] = min(h[0], x), max(h[4], x)
        cell = next((i for i in range(3) if x < h[i + 1]), 3)
        for i in range(cell + 1, 5):
            n[i] += 1
        self.wanted = [w + s for w, s in zip(self.wanted, self.step, strict=True)]
        for i in (1, 2, 3):
            off = self.wanted[i] - n[i]
            d = 1 if off >= 1 and n[i + 1] - n[i] > 1 else -1 if off <= -1 and n[i - 1] - n[i] < -1 else 0
            if d:
                up, down = (h[i + 1] - h[i]) / (n[i + 1] - n[i]), (h[i] - h[i - 1]) / (n[i] - n[i - 1])
                curve = h[i] + d / (n[i + 1] - n[i - 1]) * ((n[i] - n[i - 1] + d) * up + (n[i + 1] - n[i] - d) * down)
                h[i] = curve if h[i - 1] < curve < h[i + 1] else h[i] + d * (h[i + d] - h[i]) / (n[i + d] - n[i])
                n[i] += d

    def row(self) -> tuple:
        heights = self.height or sorted(self.first)
        return self.value(), self.place[4] if self.height else len(self.first), heights[0], heights[-1], heights

    def value(self) -> float:
        if self.height:
            return self.height[2]
        ranked = sorted(self.first)
        return ranked[max(0, -int(-self.p * len(ranked) // 1) - 1)]
