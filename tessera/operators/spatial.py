"""Spatial joins and searches. Pairs come from equality of grid cells, refined by exact distance; only one side is copied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.distance import d2
from tessera.functions.shapes import EDGES, intersects, rect


def cell(v: Column, size: float) -> Column:
    """Cell number; floor, so negative coordinates fall in negative cells."""
    return F.floor(v.cast("double") / size).cast("long")


def within_radius(df: DataFrame, x: str, y: str, cx: float, cy: float, r: float) -> DataFrame:
    """Points at most r away; the bounding box is a filter that reaches the scan."""
    box = F.col(x).between(cx - r, cx + r) & F.col(y).between(cy - r, cy + r)
    return df.where(box & (d2((F.col(x), F.lit(cx)), (F.col(y), F.lit(cy))) <= r * r))


#: Rows of a block of a cell, pairs of rows that a task is to meet, rows that it is to read, and tasks at most.
BLOCK, PAIRS, ROWS, TASKS = 8192, 1 << 27, 1 << 18, 20_000
#: Rows of a part of a block: Spark holds all pairs of two parts in memory before it hands on the first.
PART = 512
#: The same where a task orders its pairs.
NEAR_BLOCK, NEAR_PAIRS = 1024, 1 << 21


def _parts(left: DataFrame, right: DataFrame, cells: list[str], place_a: list[str], place_b: list[str], block: int, pairs: int) -> DataFrame:
    """Pairs of parts of blocks of one cell, as arrays of places with their rows.

    The rows of a cell are cut into blocks by their hash, and each pair of blocks goes out by itself: to as many tasks as the
    pairs ask for, however few bytes the rows are. A block goes in parts of some ``PART`` rows, as a row of the join makes all
    its pairs before the first is handed on. A part holds each place once with the rows that lie there, so that places are
    compared once and copies of a place only written. No side is broadcast: a copied side is larger than Spark's estimate,
    which knows nothing of the copies. Only cells of more than a block are looked up, of which there are few.
    """
    of = lambda df, n: df.groupBy(*cells).agg(F.count("*").alias(n))
    counts = of(left, "_n").hint("merge").join(of(right, "_m"), cells)
    size = counts.agg(F.sum(F.col("_n").cast("double") * F.col("_m")).alias("pairs"), F.sum(F.col("_n") + F.col("_m")).alias("rows")).first()
    tasks = min(TASKS, 1 + int(max((size.pairs or 0) / pairs, (size.rows or 0) / ROWS)))
    blocks = lambda n: F.ceil(F.col(n) / block)
    crowded = counts.where((F.col("_n") > block) | (F.col("_m") > block)).select(*cells, blocks("_n").alias("_as"), blocks("_m").alias("_bs"))

    def dealt(df: DataFrame, place: list[str], own: str, other: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (*cells, *place)]
        hashed = [c for c, kind in df.dtypes if "map<" not in kind]
        number, part = F.pmod(F.xxhash64(*hashed), F.coalesce(f"{own}s", F.lit(1))), F.pmod(F.xxhash64(F.lit(1), *hashed), F.lit(-(-block // PART)))
        rows = df.join(crowded, cells, "left").withColumns({own: number, "_part": part, f"{other}s": F.coalesce(f"{other}s", F.lit(1))})
        key = [*cells, own, "_part", f"{other}s"]
        places = rows.repartition(*cells, own).groupBy(*key, *place).agg(F.collect_list(F.struct(*rest or [F.lit(0)])).alias("_rows"))
        held = places.groupBy(*key).agg(F.collect_list(F.struct(*place, "_rows")).alias(f"{own}_places"))
        return held.select(*cells, own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)).alias(other), f"{own}_places").repartition(tasks, *cells, "_a", "_b")

    return dealt(left, place_a, "_a", "_b").hint("merge").join(dealt(right, place_b, "_b", "_a"), [*cells, "_a", "_b"])


def _meet(left: DataFrame, right: DataFrame, cells: list[str], place_a: list[str], place_b: list[str], on: Column | None = None, block: int | None = None, pairs: int | None = None) -> DataFrame:
    """Pairs of rows of one cell for whose places ``on`` holds. Names but the cells' are distinct; the cells stay out of the result."""
    left, right = left.dropna(subset=cells), right.dropna(subset=cells)
    met = _parts(left, right, cells, place_a, place_b, block or BLOCK, pairs or PAIRS)
    met = met.select(*cells, F.explode("_a_places").alias("_p"), "_b_places").select(*cells, "_p", F.explode("_b_places").alias("_q"))
    met = met.select(*cells, *[F.col(f"_p.{c}").alias(c) for c in place_a], *[F.col(f"_q.{c}").alias(c) for c in place_b], F.col("_p._rows").alias("_p"), F.col("_q._rows").alias("_q"))
    met = (met if on is None else met.where(on)).select(*place_a, *place_b, F.explode("_p").alias("_p"), "_q").select(*place_a, *place_b, "_p", F.explode("_q").alias("_q"))
    out = [F.col(c) if c in place else F.col(f"{row}.{c}").alias(c) for df, place, row in ((left, place_a, "_p"), (right, place_b, "_q")) for c in df.columns if c not in cells]
    return met.select(*out)


def radius_join(a: DataFrame, b: DataFrame, r: float, ax: str = "x", ay: str = "y", bx: str = "x2", by: str = "y2", size: float | None = None) -> DataFrame:
    """Pairs of rows of a and b at most r apart: b is copied to the cells its circle can touch, so each pair meets once.

    Coordinates of a and b need distinct names. Cells are r wide unless ``size`` says otherwise.
    """
    size = size or r
    reach = lambda c: F.explode(F.sequence(cell(F.col(c) - r, size), cell(F.col(c) + r, size)))
    left = a.withColumns({"_cx": cell(F.col(ax), size), "_cy": cell(F.col(ay), size)})
    right = b.withColumn("_cx", reach(bx)).withColumn("_cy", reach(by))
    near = d2((F.col(ax), F.col(bx)), (F.col(ay), F.col(by))) <= r * r
    return _meet(left, right, ["_cx", "_cy"], [ax, ay], [bx, by], near)


def same_cell_pairs(df: DataFrame, id_: str, x: str, y: str, size: float) -> DataFrame:
    """Candidate collisions: pairs of one cell, the smaller id first."""
    a = df.select(F.col(id_).alias("a"), cell(F.col(x), size).alias("cx"), cell(F.col(y), size).alias("cy"))
    return _meet(a, a.withColumnRenamed("a", "b"), ["cx", "cy"], [], []).where("a < b").select("a", "b")


def close_pairs(df: DataFrame, id_: str, x: str, y: str, r: float) -> DataFrame:
    """Exact collisions: pairs at most r apart, the smaller id first."""
    a = df.select(F.col(id_).alias("a"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    b = a.withColumnsRenamed({"a": "b", "x": "x2", "y": "y2"})
    return radius_join(a, b, r).where("a < b").select("a", "b")


def grid_stats(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """One row: occupied cells, points, most, least, mean and upper median of points a cell."""
    per = df.groupBy(cell(F.col(x), size).alias("cx"), cell(F.col(y), size).alias("cy")).agg(F.count("*").alias("n"))
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC)")
    return per.agg(F.count("*").alias("cells"), F.sum("n").alias("points"), F.max("n").alias("most"), F.min("n").alias("least"), F.avg("n").alias("mean"), upper.cast("long").alias("upper_median"))


def nearest(df: DataFrame, k: int, distance: Column, id_: str) -> DataFrame:
    """The k rows of least distance, ties to the smaller id; a distributed top-k."""
    return df.withColumn("distance", distance).orderBy("distance", id_).limit(k)


def knn_places(queries: DataFrame, points: DataFrame, k: int, query_id: str, id_: str, qx: str = "qx", qy: str = "qy", x: str = "x", y: str = "y", levels: int = 34) -> DataFrame:
    """The k nearest points in the plane of each query, exactly; ties to the smaller id. Adds distance2 and rank.

    Cells double in size from level to level. A query takes the lowest level at which the nine cells around it hold k points,
    so that the k-th lies within two cells' diagonals; the nine cells two levels higher reach further than that, and hold its
    candidates. Counts of all levels come from those of the lowest, and points go out once for each level that a query takes.
    Of the points of one place only the k smallest ids can be among the nearest; the others are left out first. A task meets a
    bounded number of pairs, which it orders, and keeps its k best of a query before they are shuffled.
    """
    first = F.row_number().over(Window.partitionBy(x, y).orderBy(id_))
    points = points.withColumn("_first", first).where(F.col("_first") <= k).drop("_first")
    bounds = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in (x, y) for f in (F.min, F.max)]).first()
    wide = max(1e-12, *[float(bounds[f"max_{c}"] or 0) - float(bounds[f"min_{c}"] or 0) for c in (x, y)])
    size = wide / 4 / max(1.0, (bounds.n / max(1, k)) ** 0.5)  # some k points in a square of four by four cells, were they even
    shift = lambda c, up: F.call_function("shiftright", c, up)
    around = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    base = points.groupBy(cell(F.col(x), size).alias("cx"), cell(F.col(y), size).alias("cy")).agg(F.count("*").alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(levels - 3))).alias("level")
    counts = base.select("cx", "cy", "n", every).groupBy("level", shift(F.col("cx"), F.col("level")).alias("cx"), shift(F.col("cy"), F.col("level")).alias("cy")).agg(F.sum("n").alias("n"))
    asked = queries.withColumns({"_qx": cell(F.col(qx), size), "_qy": cell(F.col(qy), size)})
    near = asked.select(query_id, "_qx", "_qy", every).withColumn("_c", F.explode(around))
    near = near.select(query_id, "level", (shift(F.col("_qx"), F.col("level")) + F.col("_c.a")).alias("cx"), (shift(F.col("_qy"), F.col("level")) + F.col("_c.b")).alias("cy"))
    enough = near.hint("merge").join(counts, ["level", "cx", "cy"]).groupBy(query_id, "level").agg(F.sum("n").alias("n")).where(F.col("n") >= k).groupBy(query_id).agg(F.min("level").alias("level"))
    # Fewer than k points anywhere: the highest level, whose nine cells hold them all.
    taken = asked.join(enough, query_id, "left").withColumn("level", F.coalesce(F.col("level") + 2, F.lit(levels - 1)))
    reach = taken.withColumn("_c", F.explode(around)).withColumns({"_cx": shift(F.col("_qx"), F.col("level")) + F.col("_c.a"), "_cy": shift(F.col("_qy"), F.col("level")) + F.col("_c.b")})
    used = taken.select("level").distinct()  # ``levels`` rows at most
    dealt = points.withColumns({"_px": cell(F.col(x), size), "_py": cell(F.col(y), size)}).join(F.broadcast(used))
    dealt = dealt.withColumns({"_cx": shift(F.col("_px"), F.col("level")), "_cy": shift(F.col("_py"), F.col("level"))})
    at, keep = ["level", "_cx", "_cy"], [*queries.columns, *points.columns]
    pairs = _meet(reach.select(*at, *queries.columns), dealt.select(*at, *points.columns), at, [], [], block=NEAR_BLOCK, pairs=NEAR_PAIRS)
    pairs = pairs.withColumn("distance2", d2((F.col(qx), F.col(x)), (F.col(qy), F.col(y))))
    best = Window.partitionBy(query_id).orderBy("distance2", id_)
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*keep, "distance2", "rank")


def knn_join(queries: DataFrame, points: DataFrame, k: int, query_id: str, id_: str, distance: Column, blocks: int = 64) -> DataFrame:
    """For a stated query set the k nearest points of each query under any metric; ``knn_places`` prunes, in the plane.

    Points are dealt into blocks; each block keeps its k best of a query before blocks meet, so that no window holds more
    than k rows a block. ``queries`` has to be small: Spark broadcasts it only below its own threshold of size.
    """
    dealt = points.withColumn("_block", F.pmod(F.xxhash64(id_), F.lit(blocks)))
    pairs = dealt.crossJoin(queries).withColumn("distance", distance)
    local = Window.partitionBy(query_id, "_block").orderBy("distance", id_)
    best = pairs.withColumn("_n", F.row_number().over(local)).where(F.col("_n") <= k)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy("distance", id_))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).drop("_n", "_block")


#: Orders of the metrics by name.
ORDERS = {"manhattan": 1.0, "euclidean": 2.0, "chebyshev": float("inf")}


def knn_vectors(df: DataFrame, queries: DataFrame, k: int, id_: str, vector: str, metric: str | float = "euclidean", query_block: int = 4096, block: int = 2048) -> DataFrame:
    """k nearest vectors to each of a stated set of query vectors, exactly: query_id, rank, id, distance; ties to the smaller id.

    ``metric`` is a name or an order p >= 1. Queries go out in blocks of a bounded number; a block of rows keeps its k best of each
    query, which is all that is shuffled. Null vectors take no part; vectors of unequal length are an error.
    """
    p = float(ORDERS.get(metric, metric))
    if p < 1:
        raise ValueError("p must be at least 1")
    spark, kind = df.sparkSession, df.schema[id_].dataType.simpleString()
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    first = asked.limit(query_block + 1).collect()
    blocks = 1 if len(first) <= query_block else -(-asked.count() // query_block)
    best = Window.partitionBy("query_id").orderBy("distance", id_)
    out = None
    for n in range(blocks):
        part = first if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).collect()  # some query_block rows
        sent = spark.sparkContext.broadcast(([r.id for r in part], [r.v for r in part]))
        found = rows.mapInPandas(_nearest_by(sent, k, p, id_, block), f"query_id {kind}, {id_} {kind}, distance double")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id_, "distance")
        out = found if out is None else out.unionByName(found)
    return out


def _nearest_by(sent, k: int, p: float, id_: str, block: int):
    def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = np.abs(x - q)
        if p == 1:
            return d.sum(axis=1)
        if p == 2:
            return np.sqrt((d * d).sum(axis=1))
        return d.max(axis=1, initial=0.0) if p == float("inf") else (d**p).sum(axis=1) ** (1 / p)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = sent.value
        for b in batches:
            for lo in range(0, len(b), block):
                own = b["id"].to_numpy()[lo : lo + block]
                x = np.array(b["v"].tolist()[lo : lo + block])  # unequal lengths fail here
                out = []
                for q, v in zip(ids, vectors, strict=True):
                    if x.shape[1] != len(v):
                        raise ValueError("vectors differ in length")
                    d = distances(x, np.asarray(v))
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                    top = near[np.lexsort((own[near], d[near]))[:k]]
                    out.append(pd.DataFrame({"query_id": [q] * len(top), id_: own[top], "distance": d[top]}))
                if out:
                    yield pd.concat(out)

    return nearest


def rect_join(a: DataFrame, b: DataFrame, size: float, prefix_a: str = "", prefix_b: str = "o_", on=intersects) -> DataFrame:
    """Pairs of rectangles that meet: both are copied to the cells they cover, and a pair counts in the cell of the lower
    left corner of what the two share, once.
    """
    ra, rb = rect(prefix_a), rect(prefix_b)
    cover = lambda df, r: df.withColumn("_cx", F.explode(F.sequence(cell(r[0], size), cell(r[2], size)))).withColumn("_cy", F.explode(F.sequence(cell(r[1], size), cell(r[3], size))))
    first = (F.col("_cx") == cell(F.greatest(ra[0], rb[0]), size)) & (F.col("_cy") == cell(F.greatest(ra[1], rb[1]), size))
    return _meet(cover(a, ra), cover(b, rb), ["_cx", "_cy"], [prefix_a + e for e in EDGES], [prefix_b + e for e in EDGES], first & on(ra, rb))


def at_point(df: DataFrame, x: str, y: str, px: float, py: float, tolerance: float = 0.001) -> DataFrame:
    """Points that differ from a place by less than a tolerance in each coordinate."""
    return df.where((F.abs(F.col(x) - px) < tolerance) & (F.abs(F.col(y) - py) < tolerance))


def candidates_at(df: DataFrame, x: str, y: str, px: float, py: float, size: float) -> DataFrame:
    """Points of the cell that holds a place."""
    return df.where((cell(F.col(x), size) == cell(F.lit(px), size)) & (cell(F.col(y), size) == cell(F.lit(py), size)))


def box_cells(df: DataFrame, x: str, y: str, w: str, h: str, size: float) -> DataFrame:
    """Boxes given by centre and extent, once for each cell they touch: adds cx, cy."""
    span = lambda c, e: F.explode(F.sequence(cell(F.col(c) - F.col(e) / 2, size), cell(F.col(c) + F.col(e) / 2, size)))
    return df.withColumn("cx", span(x, w)).withColumn("cy", span(y, h))


def close_in_space(df: DataFrame, id_: str, r: float, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Pairs of points in three dimensions at most r apart, the smaller id first; equal places of one id count once."""
    a = df.select(F.col(id_).alias("a"), *[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])
    b = a.withColumnsRenamed({"a": "b", "x": "x2", "y": "y2", "z": "z2"})
    near = d2((F.col("x"), F.col("x2")), (F.col("y"), F.col("y2")), (F.col("z"), F.col("z2"))) <= r * r
    left = a.withColumn("_cz", cell(F.col("z"), r))
    right = b.withColumn("_cz", F.explode(F.sequence(cell(F.col("z2") - r, r), cell(F.col("z2") + r, r))))
    reach = lambda c: F.explode(F.sequence(cell(F.col(c) - r, r), cell(F.col(c) + r, r)))
    left = left.withColumns({"_cx": cell(F.col("x"), r), "_cy": cell(F.col("y"), r)})
    right = right.withColumn("_cx", reach("x2")).withColumn("_cy", reach("y2"))
    return _meet(left, right, ["_cx", "_cy", "_cz"], ["x", "y", "z"], ["x2", "y2", "z2"], near).where("a < b").select("a", "b")


def without(df: DataFrame, gone: DataFrame, id_: str) -> DataFrame:
    """Points (or boxes) but those removed, by id."""
    return df.join(gone.select(id_), id_, "left_anti")
