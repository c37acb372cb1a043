"""Bit grids, layered rasters and hexagonal maps as tables of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import hexes
from tessera.operators.graph import _cut
from tessera.sources.tables import cells

# Offsets of the four and the eight neighbours.
FOUR = [(0, -1), (-1, 0), (1, 0), (0, 1)]
EIGHT = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def inside(width: int, height: int) -> Column:
    return F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)


def in_area(x: int, y: int, w: int, h: int) -> Column:
    return F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)


# A bit grid is the table x, y of its set cells.
def bit_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x", "y").intersect(b.select("x", "y"))


def bit_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x", "y").union(b.select("x", "y")).distinct()


def bit_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells set in one of both: one aggregation over the two sets."""
    both = a.select("x", "y").distinct().union(b.select("x", "y").distinct())
    return both.groupBy("x", "y").agg(F.count("*").alias("n")).where("n = 1").select("x", "y")


def fill(grid: DataFrame, width: int, height: int, x: int, y: int, w: int, h: int, value: bool = True) -> DataFrame:
    """Set or clear an area, clipped to the grid."""
    if not value:
        return grid.where(~in_area(x, y, w, h))
    return bit_or(grid, cells(grid.sparkSession, width, height).where(in_area(x, y, w, h)))


def toggle(grid: DataFrame, at: DataFrame) -> DataFrame:
    return bit_xor(grid, at)


def line_of(grid: DataFrame, width: int, height: int, row: int | None = None, column: int | None = None) -> DataFrame:
    """One row or column as an array of booleans."""
    axis, n, on = ("x", width, F.col("y") == row) if row is not None else ("y", height, F.col("x") == column)
    got = grid.where(on).agg(F.collect_set(axis).alias("s"))
    return got.select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains("s", i)).alias("bits"))


def neighbour_counts(grid: DataFrame, width: int, height: int, offsets=EIGHT) -> DataFrame:
    """For each cell beside a set one, how many of its neighbours are set."""
    moves = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in offsets])
    return grid.select(F.explode(moves).alias("c")).select("c.*").where(inside(width, height)).groupBy("x", "y").agg(F.count("*").alias("n"))


def words(grid: DataFrame, width: int) -> DataFrame:
    """Packed form: 64 cells in a number, row by row."""
    bit = F.col("y").cast("long") * width + F.col("x")
    return grid.select(F.expr(f"(cast(y as bigint) * {width} + x) div 64").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


# A raster is the table layer, x, y, value.
def raster(spark, width: int, height: int, layers: int, value: Column) -> DataFrame:
    return cells(spark, width, height).withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1)))).select("layer", "x", "y", value.alias("value"))


def fill_layers(grid: DataFrame, value: Column, where: Column, layer: int | None = None) -> DataFrame:
    on = where if layer is None else where & (F.col("layer") == layer)
    return grid.withColumn("value", F.when(on, value).otherwise(F.col("value")))


def copy_layer(grid: DataFrame, src: int, dst: int) -> DataFrame:
    """A layer replaced by another: the source is read once more under the other number."""
    return grid.where(F.col("layer") != dst).unionByName(grid.where(F.col("layer") == src).withColumn("layer", F.lit(dst).cast(grid.schema["layer"].dataType)))


def swap_cells(grid: DataFrame, a: tuple[int, int, int], b: tuple[int, int, int]) -> DataFrame:
    """Two cells (layer, x, y) change places."""
    is_ = lambda c: (F.col("layer") == c[0]) & (F.col("x") == c[1]) & (F.col("y") == c[2])
    move = lambda i, n: F.when(is_(a), b[i]).when(is_(b), a[i]).otherwise(F.col(n)).cast(grid.schema[n].dataType).alias(n)
    return grid.select(move(0, "layer"), move(1, "x"), move(2, "y"), *[c for c in grid.columns if c not in ("layer", "x", "y")])


def layers_as_columns(grid: DataFrame, layers: list[int]) -> DataFrame:
    return grid.groupBy("x", "y").pivot("layer", layers).agg(F.first("value")).withColumnsRenamed({str(n): f"layer_{n}" for n in layers})


def layer_neighbours(grid: DataFrame, agg: Column, offsets=FOUR) -> DataFrame:
    """An aggregate of ``value`` over the neighbours of every cell, layer by layer."""
    moves = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in offsets])
    sent = grid.select("layer", F.explode(moves).alias("c"), "value").select("layer", "c.*", "value")
    got = sent.groupBy("layer", "x", "y").agg(agg.alias("around"))
    return grid.join(got, ["layer", "x", "y"], "left")


# A hexagonal map is the table q, r, ...
def hex_bounds(grid: DataFrame) -> DataFrame:
    zero = lambda f, c: F.coalesce(f(c), F.lit(0))
    return grid.agg(zero(F.min, "q").alias("min_q"), zero(F.min, "r").alias("min_r"), zero(F.max, "q").alias("max_q"), zero(F.max, "r").alias("max_r"))


def populated(grid: DataFrame, shape: DataFrame, include_empty: bool = False) -> DataFrame:
    """Cells of a shape (q, r) with what the map holds there."""
    return shape.join(grid, ["q", "r"], "left" if include_empty else "inner")


def hex_costs(cells_: DataFrame, start: tuple[int, int], most: float | None = None, max_rounds: int = 100_000) -> DataFrame:
    """Least cost of entering each known, unblocked cell from the start: q, r, cost. cells: q, r, enter_cost, blocked.

    The start is never checked; the plane ends where known cells end, so an enclosed goal ends the search too. If
    ``max_rounds`` end with cells left to relax, that is an error.
    """
    open_ = cells_.where("not blocked").select("q", "r", F.col("enter_cost").cast("double").alias("w"))
    spark = cells_.sparkSession
    known = _cut(spark.range(1).select(F.lit(start[0]).alias("q"), F.lit(start[1]).alias("r"), F.lit(0.0).alias("cost")))
    frontier = known
    for _ in range(max_rounds):
        out = frontier.select(F.explode(hexes.neighbours(F.col("q"), F.col("r"))).alias("c"), "cost").select("c.q", "c.r", "cost")
        got = out.join(open_, ["q", "r"]).select("q", "r", (F.col("cost") + F.col("w")).alias("c"))
        if most is not None:
            got = got.where(F.col("c") <= most)
        best = got.groupBy("q", "r").agg(F.min("c").alias("_c"))
        merged = known.join(best, ["q", "r"], "full").select("q", "r", F.least("cost", "_c").alias("cost"), F.coalesce(F.col("_c") < F.col("cost"), F.col("cost").isNull()).alias("_new"))
        merged = _cut(merged)
        known, frontier = merged.drop("_new"), merged.where("_new").drop("_new")
        if frontier.isEmpty():
            break
    else:
        raise RuntimeError(f"cells are left to relax after {max_rounds} rounds")
    return known


def hex_path(cells_: DataFrame, start: tuple[int, int], goal: tuple[int, int]) -> DataFrame:
    """step, q, r, cost of one cheapest path, ties to the smaller (q, r); empty if the goal is blocked or cut off.

    The way back is found by pointer doubling over each cell's cheapest neighbour.
    """
    costs = hex_costs(cells_, start)
    enter = cells_.select("q", "r", F.col("enter_cost").cast("double").alias("w"))
    out = costs.select(F.struct("q", "r").alias("before"), F.col("cost").alias("c"), F.explode(hexes.neighbours(F.col("q"), F.col("r"))).alias("n")).select("before", "c", "n.q", "n.r")
    goes = costs.join(enter, ["q", "r"]).join(out, ["q", "r"]).where(F.abs(F.col("c") + F.col("w") - F.col("cost")) < 1e-9)
    jump = _cut(goes.where(~((F.col("q") == start[0]) & (F.col("r") == start[1]))).groupBy("q", "r").agg(F.min("before").alias("b")).select(F.struct("q", "r").alias("at"), F.col("b").alias("back")))
    on_path, far = costs.where((F.col("q") == goal[0]) & (F.col("r") == goal[1])).select(F.struct("q", "r").alias("at"), F.lit(0).alias("steps")), 1
    while True:
        more = on_path.join(jump, "at").select(F.col("back").alias("at"), (F.col("steps") + far).alias("steps"))
        if more.isEmpty():
            break
        on_path = _cut(on_path.unionByName(more))
        jump = _cut(jump.alias("a").join(jump.alias("b"), F.col("a.back") == F.col("b.at")).select("a.at", "b.back"))
        far *= 2
    length = on_path.agg(F.max("steps").alias("_n"))
    path = on_path.join(F.broadcast(length)).select((F.col("_n") - F.col("steps")).alias("step"), "at.q", "at.r")
    return path.join(costs, ["q", "r"]).select("step", "q", "r", "cost").orderBy("step")


def path_cost(path: DataFrame, cells_: DataFrame) -> DataFrame:
    """Sum of the costs of entering every cell of a path (step, q, r) but the first."""
    return path.where("step > 0").join(cells_.select("q", "r", "enter_cost"), ["q", "r"], "left").agg(F.coalesce(F.sum("enter_cost"), F.lit(0.0)).cast("double").alias("total_cost"))


def clear_lines(pairs: DataFrame, blocked: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (keys, q1, r1, q2, r2) whose line has no blocked cell between its ends."""
    cells_ = pairs.select(*keys, F.posexplode(hexes.line(F.col("q1"), F.col("r1"), F.col("q2"), F.col("r2"))).alias("i", "c"), hexes.distance(F.col("q1"), F.col("r1"), F.col("q2"), F.col("r2")).alias("d"))
    between = cells_.where("i > 0 and i < d").select(*keys, "c.q", "c.r")
    hit = between.join(blocked.select("q", "r").distinct(), ["q", "r"], "left_semi").select(*keys).distinct()
    return pairs.join(hit, keys, "left_anti")


def visible(blocked: DataFrame, centre: tuple[int, int], reach: int) -> DataFrame:
    """Cells within reach that the centre sees: q, r."""
    spark = blocked.sparkSession
    disc = spark.range(1).select(F.explode(hexes.disc(F.lit(centre[0]), F.lit(centre[1]), reach)).alias("c")).select(F.col("c.q").alias("q2"), F.col("c.r").alias("r2"))
    pairs = disc.withColumns({"q1": F.lit(centre[0]), "r1": F.lit(centre[1])})
    return clear_lines(pairs, blocked, ["q2", "r2"]).select(F.col("q2").alias("q"), F.col("r2").alias("r"))


def threat_map(enemies: DataFrame, blocked: DataFrame, area: DataFrame, reach: int) -> DataFrame:
    """For every cell of an area, how many enemies (id, q, r) within reach see it; zeros stay."""
    disc = enemies.select("id", F.col("q").alias("q1"), F.col("r").alias("r1"), F.explode(hexes.disc(F.col("q"), F.col("r"), reach)).alias("c"))
    pairs = disc.select("id", "q1", "r1", F.col("c.q").alias("q2"), F.col("c.r").alias("r2")).join(area.select(F.col("q").alias("q2"), F.col("r").alias("r2")), ["q2", "r2"], "left_semi")
    seen = clear_lines(pairs, blocked, ["id", "q2", "r2"]).groupBy(F.col("q2").alias("q"), F.col("r2").alias("r")).agg(F.count("*").alias("threat"))
    return area.select("q", "r").join(seen, ["q", "r"], "left").na.fill(0, ["threat"])


def attack_positions(cells_: DataFrame, start: tuple[int, int], points: float, target: tuple[int, int], reach: int) -> DataFrame:
    """Reachable cells within reach of a target that they see: q, r, cost."""
    at = hex_costs(cells_, start, points)
    seen = visible(cells_.where("blocked"), target, reach)
    return at.join(seen, ["q", "r"], "left_semi")


def safe_positions(cells_: DataFrame, start: tuple[int, int], points: float, enemies: DataFrame, reach: int) -> DataFrame:
    """Reachable cells with their threat, the safest and then the cheapest first: q, r, threat, cost."""
    at = hex_costs(cells_, start, points)
    return threat_map(enemies, cells_.where("blocked"), at, reach).join(at, ["q", "r"]).orderBy("threat", "cost", "q", "r")


def look_up(cells_: DataFrame, at: DataFrame) -> DataFrame:
    """Places ``at`` (x, y) of a bit grid with ``bit``."""
    return at.join(cells_.select("x", "y").distinct().withColumn("bit", F.lit(True)), ["x", "y"], "left").na.fill(False, ["bit"])


def write_bits(grid: DataFrame, writes: DataFrame, order: list[str]) -> DataFrame:
    """A bit grid after writes (x, y, bit), of which the last of a place wins."""
    last = writes.groupBy("x", "y").agg(F.max_by("bit", F.struct(*order)).alias("bit"))
    return grid.select("x", "y").distinct().withColumn("_old", F.lit(True)).join(last, ["x", "y"], "full").where(F.coalesce("bit", "_old")).select("x", "y")


def write_cells(grid: DataFrame, writes: DataFrame, order: list[str]) -> DataFrame:
    """A raster after writes (layer, x, y, value), of which the last of a cell wins; writes beyond the raster are an error."""
    last = writes.groupBy("layer", "x", "y").agg(F.max_by("value", F.struct(*order)).alias("_new"))
    both = grid.join(last, ["layer", "x", "y"], "full")
    beyond = F.assert_true(F.col("value").isNotNull() | F.col("_new").isNull(), "a cell lies beyond the raster").isNull()
    return both.select("layer", "x", "y", F.when(beyond, F.coalesce("_new", "value")).alias("value"))


def layer_line(grid: DataFrame, layer: int, row: int | None = None, column: int | None = None) -> DataFrame:
    """One row or column of a layer, left to right or top to bottom, as an array."""
    axis, on = ("x", F.col("y") == row) if row is not None else ("y", F.col("x") == column)
    got = grid.where(on & (F.col("layer") == layer)).agg(F.array_sort(F.collect_list(F.struct(axis, "value"))).alias("_c"))
    return got.select(F.transform("_c", lambda c: c["value"]).alias("cells"))


def set_hexes(grid: DataFrame, writes: DataFrame, order: list[str]) -> DataFrame:
    """A map (q, r, value) after writes, of which the last of a cell wins; new cells enter."""
    last = writes.groupBy("q", "r").agg(F.max_by("value", F.struct(*order)).alias("_new"))
    return grid.join(last, ["q", "r"], "full").select("q", "r", F.coalesce("_new", "value").alias("value"))


def fill_hexes(grid: DataFrame, shape: Column, value: Column) -> DataFrame:
    """A map after every cell of a shape (an array of struct(q, r) that depends on no column) got a value."""
    spark = grid.sparkSession
    at = spark.range(1).select(F.explode(shape).alias("c")).select("c.q", "c.r", value.alias("value"), F.lit(0).alias("_order"))
    return set_hexes(grid, at, ["_order"])


def remove_hexes(grid: DataFrame, gone: DataFrame) -> DataFrame:
    return grid.join(gone.select("q", "r"), ["q", "r"], "left_anti").select(grid.columns)
