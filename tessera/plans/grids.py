"""Queries on bit grids, rasters and hexagons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import hexes
from tessera.operators import grids
from tessera.plans.registry import query
from tessera.sources.tables import cells, load

_W, _H = 64, 64


def _bits(spark, d, flag):
    li = load(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    return li.select((F.col("l_partkey") % _W).cast("int").alias("x"), (F.col("l_suppkey") % _H).cast("int").alias("y")).distinct()


_B = "(SELECT DISTINCT CAST(l_partkey % 64 AS INTEGER) AS x, CAST(l_suppkey % 64 AS INTEGER) AS y FROM lineitem WHERE l_returnflag = '{}')"
_A, _N = _B.format("A"), _B.format("N")


@query(f"SELECT x, y FROM {_A} INTERSECT SELECT x, y FROM {_N}")
def bitgrid_and(spark, d):
    return grids.bit_and(_bits(spark, d, "A"), _bits(spark, d, "N"))


@query(f"SELECT x, y FROM {_A} UNION SELECT x, y FROM {_N}")
def bitgrid_or(spark, d):
    return grids.bit_or(_bits(spark, d, "A"), _bits(spark, d, "N"))


@query(f"(SELECT x, y FROM {_A} EXCEPT SELECT x, y FROM {_N}) UNION (SELECT x, y FROM {_N} EXCEPT SELECT x, y FROM {_A})")
def bitgrid_xor(spark, d):
    return grids.bit_xor(_bits(spark, d, "A"), _bits(spark, d, "N"))


@query(f"SELECT count(*) AS set_bits FROM {_A}")
def bitgrid_count(spark, d):
    return grids.words(_bits(spark, d, "A"), _W).agg(F.sum(F.bit_count("mask")).cast("long").alias("set_bits"))


@query(f"""SELECT x + dx AS x, y + dy AS y, count(*) AS n FROM {_A}, (SELECT * FROM (VALUES (-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)) o(dx, dy)) o
    WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 63 GROUP BY ALL""")
def bitgrid_neighbors(spark, d):
    return grids.neighbour_counts(_bits(spark, d, "A"), _W, _H)


@query(f"SELECT x, y FROM {_A} WHERE NOT (x BETWEEN 10 AND 19 AND y BETWEEN 10 AND 19) UNION SELECT CAST(a AS INTEGER), CAST(b AS INTEGER) FROM range(60, 64) s(a), range(0, 5) t(b)")
def bitgrid_fill_area(spark, d):
    cleared = grids.fill(_bits(spark, d, "A"), _W, _H, 10, 10, 10, 10, False)
    return grids.fill(cleared, _W, _H, 60, 0, 10, 5)


@query(f"SELECT list(i IN (SELECT x FROM {_A} WHERE y = 5) ORDER BY i) AS bits FROM range(0, 64) r(i)")
def bitgrid_row(spark, d):
    return grids.line_of(_bits(spark, d, "A"), _W, _H, row=5)


# Quantities by place in three layers (the line number), 24 x 18 cells, 0 where nothing lies.
_L = """(SELECT CAST(l AS INTEGER) AS layer, CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y, coalesce(v, 0) AS value FROM range(0, 3) s(l), range(0, 24) t(a), range(0, 18) u(b)
    LEFT JOIN (SELECT l_linenumber % 3 AS cl, l_partkey % 24 AS cx, l_suppkey % 18 AS cy, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3) ON cl = l AND cx = a AND cy = b)"""


def _raster(spark, d):
    li = load(spark, d, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("layer"), (F.col("l_partkey") % 24).cast("int").alias("x"), (F.col("l_suppkey") % 18).cast("int").alias("y"), F.col("l_quantity").cast("long").alias("v"))
    held = li.groupBy("layer", "x", "y").agg(F.sum("v").alias("v"))
    return grids.raster(spark, 24, 18, 3, F.lit(0).cast("long")).join(held, ["layer", "x", "y"], "left").select("layer", "x", "y", F.coalesce("v", "value").alias("value"))


@query(f"SELECT layer, x, y, CASE WHEN layer = 1 AND x BETWEEN 2 AND 4 AND y BETWEEN 1 AND 2 THEN -1 ELSE value END AS value FROM {_L}")
def layer_fill(spark, d):
    return grids.fill_layers(_raster(spark, d), F.lit(-1).cast("long"), grids.in_area(2, 1, 3, 2), layer=1)


@query(f"SELECT CASE WHEN n = 1 THEN 2 ELSE layer END AS layer, x, y, value FROM {_L}, (VALUES (0), (1)) v(n) WHERE (n = 0 AND layer <> 2) OR (n = 1 AND layer = 0)")
def layer_copy(spark, d):
    return grids.copy_layer(_raster(spark, d), 0, 2)


@query(f"SELECT x, y, max(value) FILTER (layer = 0) AS layer_0, max(value) FILTER (layer = 1) AS layer_1, max(value) FILTER (layer = 2) AS layer_2 FROM {_L} GROUP BY x, y")
def layer_pivot(spark, d):
    return grids.layers_as_columns(_raster(spark, d), [0, 1, 2])


@query(f"SELECT a.layer, a.x, a.y, a.value, CAST(sum(b.value) AS BIGINT) AS around FROM {_L} a JOIN {_L} b ON a.layer = b.layer AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL")
def layer_neighbors(spark, d):
    return grids.layer_neighbours(_raster(spark, d), F.sum("value")).select("layer", "x", "y", "value", "around")


@query(f"""SELECT CASE WHEN (layer, x, y) = (0, 1, 1) THEN 2 WHEN (layer, x, y) = (2, 5, 3) THEN 0 ELSE layer END AS layer, CASE WHEN (layer, x, y) = (0, 1, 1) THEN 5 WHEN (layer, x, y) = (2, 5, 3) THEN 1 ELSE x END AS x,
    CASE WHEN (layer, x, y) = (0, 1, 1) THEN 3 WHEN (layer, x, y) = (2, 5, 3) THEN 1 ELSE y END AS y, value FROM {_L}""")
def layer_swap(spark, d):
    return grids.swap_cells(_raster(spark, d), (0, 1, 1), (2, 5, 3))


_HEX = "(SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag, CAST(l_partkey % 21 - 10 AS INTEGER) AS q, CAST(l_suppkey % 21 - 10 AS INTEGER) AS r FROM lineitem)"


def _at(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", (F.col("l_partkey") % 21 - 10).cast("int").alias("q"), (F.col("l_suppkey") % 21 - 10).cast("int").alias("r"))


@query(f"SELECT q, r, count(*) AS n, max((abs(q - 3) + abs(q - 3 + r + 2) + abs(r + 2)) // 2) AS distance FROM {_HEX} GROUP BY q, r")
def hex_distance(spark, d):
    return _at(spark, d).groupBy("q", "r").agg(F.count("*").alias("n"), F.max(hexes.distance(F.col("q"), F.col("r"), F.lit(3), F.lit(-2))).alias("distance"))


_DISC = "(SELECT CAST(a AS INTEGER) AS q, CAST(b AS INTEGER) AS r, (abs(a - {q}) + abs(a - {q} + b - {r}) + abs(b - {r})) // 2 AS dist FROM range(-30, 31) x(a), range(-30, 31) y(b))"


_SUPP = "(SELECT s_suppkey, CAST(s_suppkey % 13 - 6 AS INTEGER) AS q0, CAST(s_nationkey % 11 - 5 AS INTEGER) AS r0 FROM supplier)"


def _places(spark, d):
    """Suppliers on hexagons: s_suppkey, q0, r0."""
    return load(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 13 - 6).cast("int").alias("q0"), (F.col("s_nationkey") % 11 - 5).cast("int").alias("r0"))


_AROUND = f"(SELECT s_suppkey, CAST(a AS INTEGER) AS q, CAST(b AS INTEGER) AS r, (abs(a - q0) + abs(a - q0 + b - r0) + abs(b - r0)) // 2 AS dist FROM {_SUPP}, range(-12, 13) x(a), range(-12, 13) y(b))"


@query(f"SELECT s_suppkey, q, r FROM {_AROUND} WHERE dist <= 4")
def hex_disc(spark, d):
    return _places(spark, d).select("s_suppkey", F.explode(hexes.disc(F.col("q0"), F.col("r0"), 4)).alias("c")).select("s_suppkey", "c.q", "c.r")


@query(f"SELECT s_suppkey, q, r FROM {_AROUND} WHERE dist = 4")
def hex_ring(spark, d):
    return _places(spark, d).select("s_suppkey", F.explode(hexes.ring(F.col("q0"), F.col("r0"), 4)).alias("c")).select("s_suppkey", "c.q", "c.r")


@query(f"SELECT s_suppkey, side, q0 + dq AS q, r0 + dr AS r FROM {_SUPP}, (VALUES (0, 1, 0), (1, 1, -1), (2, 0, -1), (3, -1, 0), (4, -1, 1), (5, 0, 1)) v(side, dq, dr)")
def hex_neighbors(spark, d):
    """The six neighbours in their order."""
    return _places(spark, d).select("s_suppkey", F.explode(hexes.neighbours(F.col("q0"), F.col("r0"))).alias("c")).select("s_suppkey", "c.side", "c.q", "c.r")


@query(f"SELECT s_suppkey, q0 AS x, -q0 - r0 AS y, r0 AS z, q0 AS q, r0 AS r FROM {_SUPP}")
def hex_cube(spark, d):
    """Cube coordinates and back."""
    c = _places(spark, d).select("s_suppkey", hexes.to_cube(F.col("q0"), F.col("r0")).alias("c")).select("s_suppkey", "c.*")
    return c.withColumn("a", hexes.from_cube(F.col("x"), F.col("y"), F.col("z"))).select("s_suppkey", "x", "y", "z", "a.q", "a.r")


@query(f"""SELECT s_suppkey, round((sqrt(3.0) * q0 + sqrt(3.0) / 2 * r0) * 2.5 + 1, 6) AS pointy_x, round(1.5 * r0 * 2.5 - 1, 6) AS pointy_y, round(1.5 * q0 * 2.5 + 1, 6) AS flat_x, round((sqrt(3.0) / 2 * q0 + sqrt(3.0) * r0) * 2.5 - 1, 6) AS flat_y,
    q0 AS q, r0 AS r FROM {_SUPP}""")
def hex_pixel(spark, d):
    """Middles of hexagons in both layouts, and the hexagon around the middle again."""
    q, r = F.col("q0"), F.col("r0")
    (px, py), (fx, fy) = (hexes.to_pixel(q, r, 2.5, layout, 1.0, -1.0) for layout in (hexes.POINTY, hexes.FLAT))
    c = _places(spark, d).select("s_suppkey", px.alias("px"), py.alias("py"), fx.alias("fx"), fy.alias("fy"))
    back = [hexes.from_pixel(F.col("px"), F.col("py"), 2.5, hexes.POINTY, 1.0, -1.0), hexes.from_pixel(F.col("fx"), F.col("fy"), 2.5, hexes.FLAT, 1.0, -1.0)]
    c = c.withColumns({"a": back[0], "b": back[1]})
    return c.select("s_suppkey", F.round("px", 6).alias("pointy_x"), F.round("py", 6).alias("pointy_y"), F.round("fx", 6).alias("flat_x"), F.round("fy", 6).alias("flat_y"), F.when(F.col("a.q") == F.col("b.q"), F.col("a.q")).alias("q"), F.when(F.col("a.r") == F.col("b.r"), F.col("b.r")).alias("r"))


_ROUND = """(SELECT {keep}, CASE WHEN abs(a - q) > abs(b - r) AND abs(a - q) > abs(c - s) THEN -b - c ELSE a END AS q,
    CASE WHEN abs(a - q) > abs(b - r) AND abs(a - q) > abs(c - s) THEN b WHEN abs(b - r) > abs(c - s) THEN -a - c ELSE b END AS r
    FROM (SELECT *, -q - r AS s, round_even(q, 0) AS a, round_even(r, 0) AS b, round_even(-q - r, 0) AS c FROM {source}))"""
_ENDS = f"(SELECT *, (abs(q0 - 5) + abs(q0 - 5 + r0 + 5) + abs(r0 + 5)) // 2 AS d FROM {_SUPP})"
_STEPS = f"(SELECT s_suppkey, i, q0 + (5 - q0) * (CASE WHEN d = 0 THEN 0.0 ELSE i / d::DOUBLE END) AS q, r0 + (-5 - r0) * (CASE WHEN d = 0 THEN 0.0 ELSE i / d::DOUBLE END) AS r FROM {_ENDS}, range(0, 40) t(i) WHERE i <= d)"
_LINE = _ROUND.format(keep="s_suppkey, i", source=_STEPS)


@query(f"SELECT s_suppkey, CAST(i AS INTEGER) AS i, CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r FROM {_LINE}")
def hex_line(spark, d):
    line = hexes.line(F.col("q0"), F.col("r0"), F.lit(5), F.lit(-5))
    return _places(spark, d).select("s_suppkey", F.posexplode(line).alias("i", "c")).select("s_suppkey", "i", "c.q", "c.r")


_BIN = _ROUND.format(keep="n", source="(SELECT 1 AS n, (sqrt(3.0) / 3 * (l_quantity / 4.0) - 1 / 3.0 * (l_extendedprice / 1000 / 4.0)) AS q, 2 / 3.0 * (l_extendedprice / 1000 / 4.0) AS r FROM lineitem)")


@query(f"SELECT CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r, count(*) AS n FROM {_BIN} GROUP BY ALL")
def hex_bin(spark, d):
    at = hexes.from_pixel(F.col("l_quantity"), F.col("l_extendedprice") / 1000, 4.0)
    return load(spark, d, "lineitem").select(at.alias("c")).groupBy("c.q", "c.r").agg(F.count("*").alias("n"))


_FLAT = _ROUND.format(keep="n", source="(SELECT 1 AS n, 2 / 3.0 * (l_quantity / 4.0) AS q, (-1 / 3.0 * (l_quantity / 4.0) + sqrt(3.0) / 3 * (l_extendedprice / 1000 / 4.0)) AS r FROM lineitem)")


@query(f"SELECT CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r, count(*) AS n FROM {_FLAT} GROUP BY ALL")
def hex_bin_flat(spark, d):
    at = hexes.from_pixel(F.col("l_quantity"), F.col("l_extendedprice") / 1000, 4.0, hexes.FLAT)
    return load(spark, d, "lineitem").select(at.alias("c")).groupBy("c.q", "c.r").agg(F.count("*").alias("n"))


# What lies on a hexagon makes it dear to enter, and every seventh of some order blocks it.
_MAP = """(SELECT CAST(l_partkey % 15 - 7 AS INTEGER) AS q, CAST((l_partkey * 3 + l_suppkey) % 15 - 7 AS INTEGER) AS r, 1.0 + CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) % 4 AS enter_cost,
    (count(*) + CAST(sum(l_linenumber) AS BIGINT)) % 7 = 0 AND NOT (l_partkey % 15 = 7 AND (l_partkey * 3 + l_suppkey) % 15 = 7) AS blocked
    FROM lineitem GROUP BY l_partkey % 15, (l_partkey * 3 + l_suppkey) % 15 HAVING (abs(l_partkey % 15 - 7) + abs(l_partkey % 15 - 7 + (l_partkey * 3 + l_suppkey) % 15 - 7) + abs((l_partkey * 3 + l_suppkey) % 15 - 7)) // 2 <= 7)"""


def hex_map(spark, d):
    """Hexagons within seven of the middle, with costs and walls, from the order lines that fall on them."""
    li = load(spark, d, "lineitem").select((F.col("l_partkey") % 15 - 7).cast("int").alias("q"), ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % 15 - 7).cast("int").alias("r"), F.col("l_quantity").cast("long").alias("v"), "l_linenumber")
    q, r = F.col("q"), F.col("r")
    near = li.where(hexes.distance(q, r, F.lit(0), F.lit(0)) <= 7).groupBy("q", "r").agg(F.sum("v").alias("v"), (F.count("*") + F.sum("l_linenumber")).alias("n"))
    return near.select("q", "r", (1.0 + F.col("v") % 4).alias("enter_cost"), ((F.col("n") % 7 == 0) & ((q != 0) | (r != 0))).alias("blocked"))


_DIRS = "(VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) v(dq, dr)"
_REACH = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT * FROM {_MAP} WHERE NOT blocked), b AS (SELECT CAST(0 AS INTEGER) AS q, CAST(0 AS INTEGER) AS r, 0.0::DOUBLE AS cost UNION
    SELECT m.q, m.r, b.cost + m.enter_cost FROM b, {_DIRS}, m WHERE m.q = b.q + dq AND m.r = b.r + dr AND b.cost + m.enter_cost <= {{}}), h AS (SELECT q, r, min(cost) AS cost FROM b GROUP BY q, r) """


@query(_REACH.format(12) + "SELECT q, r, cost FROM h")
def hex_reachable(spark, d):
    return grids.hex_costs(hex_map(spark, d), (0, 0), 12)


_GOAL = (3, -1)
_BACK = _REACH.format(24) + f""", p AS (SELECT h.q, h.r, min([g.q, g.r]) AS b FROM h JOIN m ON m.q = h.q AND m.r = h.r, {_DIRS}, h g WHERE g.q = h.q + dq AND g.r = h.r + dr AND abs(g.cost + m.enter_cost - h.cost) < 1e-9 AND NOT (h.q = 0 AND h.r = 0) GROUP BY h.q, h.r),
    w AS (SELECT CAST({_GOAL[0]} AS INTEGER) AS q, CAST({_GOAL[1]} AS INTEGER) AS r FROM h WHERE q = {_GOAL[0]} AND r = {_GOAL[1]} UNION SELECT p.b[1], p.b[2] FROM w JOIN p ON p.q = w.q AND p.r = w.r) """


@query(_BACK + "SELECT CAST(row_number() OVER (ORDER BY cost) - 1 AS INTEGER) AS step, w.q, w.r, cost FROM w JOIN h ON h.q = w.q AND h.r = w.r")
def hex_path(spark, d):
    """The cells of the cheapest path, and what each costs so far."""
    return grids.hex_path(hex_map(spark, d), (0, 0), _GOAL).select(F.col("step").cast("int").alias("step"), "q", "r", "cost")


@query(_BACK + "SELECT coalesce(max(cost), 0.0) AS total_cost FROM w JOIN h ON h.q = w.q AND h.r = w.r")
def hex_path_cost(spark, d):
    m = hex_map(spark, d)
    return grids.path_cost(grids.hex_path(m, (0, 0), _GOAL), m)


_LOS = """SELECT t.q AS q2, t.r AS r2, i, d, CASE WHEN abs(a - fq) > abs(b - fr) AND abs(a - fq) > abs(c - fs) THEN -b - c ELSE a END AS q, CASE WHEN abs(a - fq) > abs(b - fr) AND abs(a - fq) > abs(c - fs) THEN b WHEN abs(b - fr) > abs(c - fs) THEN -a - c ELSE b END AS r, id
    FROM (SELECT *, -fq - fr AS fs, round_even(fq, 0) AS a, round_even(fr, 0) AS b, round_even(-fq - fr, 0) AS c FROM (SELECT t.*, i, q1 + (q - q1) * (i / d::DOUBLE) AS fq, r1 + (r - r1) * (i / d::DOUBLE) AS fr
    FROM (SELECT *, (abs(q1 - q) + abs(q1 - q + r1 - r) + abs(r1 - r)) // 2 AS d FROM {pairs}) t, range(1, 20) s(i) WHERE i < d)) t"""
_PAIRS1 = f"(SELECT 1 AS id, 0 AS q1, 0 AS r1, q, r FROM {_DISC.format(q=0, r=0)} WHERE dist <= 5)"


@query(f"""WITH l AS ({_LOS.format(pairs=_PAIRS1)}), hit AS (SELECT DISTINCT q2, r2 FROM l JOIN {_MAP} m ON m.blocked AND m.q = l.q AND m.r = l.r)
    SELECT p.q, p.r FROM {_PAIRS1} p LEFT JOIN hit ON q2 = p.q AND r2 = p.r WHERE q2 IS NULL""")
def hex_visible(spark, d):
    return grids.visible(hex_map(spark, d).where("blocked"), (0, 0), 5)


_PAIRS0 = f"(SELECT s_suppkey AS id, q0 AS q1, r0 AS r1, 4 AS q, -2 AS r FROM {_SUPP} WHERE NOT (q0 = 4 AND r0 = -2))"


@query(f"""WITH l AS ({_LOS.format(pairs=_PAIRS0)}), hit AS (SELECT DISTINCT id FROM l JOIN {_MAP} m ON m.blocked AND m.q = l.q AND m.r = l.r) SELECT s_suppkey, s_suppkey NOT IN (SELECT id FROM hit) AS clear FROM {_SUPP}""")
def hex_los(spark, d):
    """Whether every supplier sees one hexagon."""
    pairs = _places(spark, d).select("s_suppkey", F.col("q0").alias("q1"), F.col("r0").alias("r1"), F.lit(4).alias("q2"), F.lit(-2).alias("r2"))
    free = grids.clear_lines(pairs, hex_map(spark, d).where("blocked"), ["s_suppkey"]).select("s_suppkey", F.lit(True).alias("clear"))
    return pairs.select("s_suppkey").join(free, "s_suppkey", "left").na.fill(False, ["clear"])


_ENEMIES = f"(SELECT s_suppkey AS id, q0 AS q1, r0 AS r1 FROM {_SUPP})"
_PAIRS3 = f"(SELECT id, q1, r1, q, r FROM {_ENEMIES}, {_MAP} WHERE (abs(q1 - q) + abs(q1 - q + r1 - r) + abs(r1 - r)) // 2 <= 4)"
_THREAT = f"""l AS ({_LOS.format(pairs=_PAIRS3)}), hit AS (SELECT DISTINCT id, q2, r2 FROM l JOIN {_MAP} m ON m.blocked AND m.q = l.q AND m.r = l.r),
    th AS (SELECT p.q, p.r, count(*) AS threat FROM {_PAIRS3} p LEFT JOIN hit ON hit.id = p.id AND q2 = p.q AND r2 = p.r WHERE q2 IS NULL GROUP BY ALL)"""


def _enemies(spark, d):
    return _places(spark, d).select(F.col("s_suppkey").alias("id"), F.col("q0").alias("q"), F.col("r0").alias("r"))


@query(f"WITH {_THREAT} SELECT m.q, m.r, coalesce(threat, 0) AS threat FROM {_MAP} m LEFT JOIN th ON th.q = m.q AND th.r = m.r")
def hex_threat_map(spark, d):
    m = hex_map(spark, d)
    return grids.threat_map(_enemies(spark, d), m.where("blocked"), m, 4)


@query(_REACH.format(9) + f", {_THREAT} SELECT h.q, h.r, coalesce(threat, 0) AS threat, cost FROM h LEFT JOIN th ON th.q = h.q AND th.r = h.r")
def hex_safe_positions(spark, d):
    return grids.safe_positions(hex_map(spark, d), (0, 0), 9, _enemies(spark, d), 4)


_PAIRS2 = f"(SELECT 1 AS id, 2 AS q1, 2 AS r1, q, r FROM {_DISC.format(q=2, r=2)} WHERE dist <= 3)"


@query(_REACH.format(12) + f""", l AS ({_LOS.format(pairs=_PAIRS2)}), hit AS (SELECT DISTINCT q2, r2 FROM l JOIN {_MAP} m ON m.blocked AND m.q = l.q AND m.r = l.r)
    SELECT h.q, h.r, cost FROM h JOIN {_PAIRS2} p ON p.q = h.q AND p.r = h.r LEFT JOIN hit ON q2 = h.q AND r2 = h.r WHERE q2 IS NULL""")
def hex_attack_positions(spark, d):
    return grids.attack_positions(hex_map(spark, d), (0, 0), 12, (2, 2), 3)


@query(f"SELECT min(q) AS min_q, min(r) AS min_r, max(q) AS max_q, max(r) AS max_r FROM {_HEX}")
def hex_bounds(spark, d):
    return grids.hex_bounds(_at(spark, d))


_CELLS = f"(SELECT q, r, max(l_orderkey) AS value FROM {_HEX} WHERE l_returnflag <> 'R' GROUP BY q, r)"


def _held(spark, d):
    """A map that holds something on some hexagons: the last order there whose lines were not returned."""
    return _at(spark, d).where("l_returnflag <> 'R'").groupBy("q", "r").agg(F.max("l_orderkey").alias("value"))


@query(f"""WITH c AS {_CELLS}, w AS (SELECT q, r, arg_max(l_linenumber, [l_orderkey, l_linenumber, l_partkey]) AS v FROM {_HEX} WHERE l_linenumber > 5 GROUP BY q, r)
    SELECT coalesce(c.q, w.q) AS q, coalesce(c.r, w.r) AS r, coalesce(w.v, c.value) AS value FROM c FULL JOIN w ON c.q = w.q AND c.r = w.r WHERE NOT coalesce(c.q, w.q) = 3""")
def hex_edits(spark, d):
    """Cells set (the last write wins), and those of one column removed."""
    writes = _at(spark, d).where("l_linenumber > 5").select("q", "r", F.col("l_linenumber").cast("long").alias("value"), "l_orderkey", "l_linenumber", "l_partkey")
    m = grids.set_hexes(_held(spark, d), writes, ["l_orderkey", "l_linenumber", "l_partkey"])
    return grids.remove_hexes(m, m.where("q = 3"))


@query(f"""WITH c AS {_CELLS}, f AS (SELECT CAST(a AS INTEGER) AS q, CAST(b AS INTEGER) AS r, -1 AS v FROM range(-2, 4) x(a), range(9, 13) y(b)),
    h AS (SELECT q, r, -2 AS v FROM {_DISC.format(q=-8, r=0)} WHERE dist <= 3), g AS (SELECT q, r, -3 AS v FROM {_DISC.format(q=5, r=-5)} WHERE dist = 2), a AS (SELECT * FROM f UNION ALL SELECT * FROM h UNION ALL SELECT * FROM g)
    SELECT coalesce(c.q, a.q) AS q, coalesce(c.r, a.r) AS r, CAST(coalesce(a.v, c.value) AS BIGINT) AS value FROM c FULL JOIN a ON c.q = a.q AND c.r = a.r""")
def hex_fill(spark, d):
    """A rectangle, a hexagon and a ring filled."""
    shapes = [(hexes.rectangle(-2, 3, 9, 12), -1), (hexes.disc(F.lit(-8), F.lit(0), 3), -2), (hexes.ring(F.lit(5), F.lit(-5), 2), -3)]
    m = _held(spark, d)
    for shape, value in shapes:
        m = grids.fill_hexes(m, shape, F.lit(value).cast("long"))
    return m


@query(f"SELECT s.q, s.r, c.value FROM {_DISC.format(q=1, r=2)} s JOIN {_CELLS} c ON c.q = s.q AND c.r = s.r WHERE dist <= 3")
def hex_populated(spark, d):
    """What a map holds around a place; empty hexagons are left out."""
    shape = spark.range(1).select(F.explode(hexes.disc(F.lit(1), F.lit(2), 3)).alias("c")).select("c.q", "c.r")
    return grids.populated(_held(spark, d), shape)


@query(f"SELECT s.q, s.r, c.value FROM {_DISC.format(q=-9, r=9)} s LEFT JOIN {_CELLS} c ON c.q = s.q AND c.r = s.r WHERE dist = 2")
def hex_populated_ring(spark, d):
    """A ring with its empty hexagons."""
    shape = spark.range(1).select(F.explode(hexes.ring(F.lit(-9), F.lit(9), 2)).alias("c")).select("c.q", "c.r")
    return grids.populated(_held(spark, d), shape, include_empty=True)


@query(f"SELECT CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y, (a, b) IN (SELECT (x, y) FROM {_A}) AS bit FROM range(0, 64) s(a), range(0, 64) t(b)")
def bitgrid_get(spark, d):
    return grids.look_up(_bits(spark, d, "A"), cells(spark, _W, _H))


@query(f"""WITH w AS (SELECT CAST(l_partkey % 64 AS INTEGER) AS x, CAST(l_suppkey % 64 AS INTEGER) AS y, arg_max(l_linestatus = 'O', [l_orderkey, l_linenumber, l_partkey]) AS bit FROM lineitem GROUP BY 1, 2)
    SELECT coalesce(g.x, w.x) AS x, coalesce(g.y, w.y) AS y FROM {_A} g FULL JOIN w ON g.x = w.x AND g.y = w.y WHERE coalesce(w.bit, TRUE)""")
def bitgrid_set(spark, d):
    w = load(spark, d, "lineitem").select((F.col("l_partkey") % _W).cast("int").alias("x"), (F.col("l_suppkey") % _H).cast("int").alias("y"), (F.col("l_linestatus") == "O").alias("bit"), "l_orderkey", "l_linenumber", "l_partkey")
    return grids.write_bits(_bits(spark, d, "A"), w, ["l_orderkey", "l_linenumber", "l_partkey"])


@query(f"(SELECT x, y FROM {_A} EXCEPT SELECT x, y FROM {_B.format('R')}) UNION (SELECT x, y FROM {_B.format('R')} EXCEPT SELECT x, y FROM {_A})")
def bitgrid_toggle(spark, d):
    return grids.toggle(_bits(spark, d, "A"), _bits(spark, d, "R"))


@query(f"SELECT list(i IN (SELECT y FROM {_A} WHERE x = 7) ORDER BY i) AS bits FROM range(0, 64) r(i)")
def bitgrid_column(spark, d):
    return grids.line_of(_bits(spark, d, "A"), _W, _H, column=7)


@query(f"SELECT CAST(y * 64 + x AS BIGINT) AS place, x, y FROM {_A}")
def bitgrid_cells(spark, d):
    """Set cells, numbered row by row, as the packed form holds them."""
    w = grids.words(_bits(spark, d, "A"), _W)
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(F.lit(1)) == 1))
    place = w.select("word", bit.alias("bit")).select((F.col("word") * 64 + F.col("bit")).alias("place"))
    return place.select("place", (F.col("place") % _W).cast("int").alias("x"), F.expr(f"cast(place div {_W} as int)").alias("y"))


@query(f"""WITH w AS (SELECT l_linenumber % 3 AS layer, l_partkey % 24 AS x, l_suppkey % 18 AS y, arg_max(l_orderkey, [l_orderkey, l_linenumber, l_partkey]) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3)
    SELECT g.layer, g.x, g.y, coalesce(w.v, g.value) AS value FROM {_L} g LEFT JOIN w ON w.layer = g.layer AND w.x = g.x AND w.y = g.y""")
def layer_set(spark, d):
    w = load(spark, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_linenumber") % 3).cast("int").alias("layer"), (F.col("l_partkey") % 24).cast("int").alias("x"), (F.col("l_suppkey") % 18).cast("int").alias("y"), F.col("l_orderkey").alias("value"), "l_orderkey", "l_linenumber", "l_partkey")
    return grids.write_cells(_raster(spark, d), w, ["l_orderkey", "l_linenumber", "l_partkey"])


@query(f"SELECT layer, x, y, value FROM {_L} WHERE (layer, x, y) IN (SELECT (l_linenumber % 3, l_partkey % 24, l_suppkey % 18) FROM lineitem WHERE l_returnflag = 'A')")
def layer_get(spark, d):
    """Cells looked up by place."""
    at = load(spark, d, "lineitem").where("l_returnflag = 'A'").select((F.col("l_linenumber") % 3).cast("int").alias("layer"), (F.col("l_partkey") % 24).cast("int").alias("x"), (F.col("l_suppkey") % 18).cast("int").alias("y")).distinct()
    return _raster(spark, d).join(at, ["layer", "x", "y"], "left_semi")


@query(f"SELECT list(value ORDER BY x) AS cells FROM {_L} WHERE layer = 1 AND y = 4")
def layer_row(spark, d):
    return grids.layer_line(_raster(spark, d), 1, row=4)


@query(f"SELECT list(value ORDER BY y) AS cells FROM {_L} WHERE layer = 2 AND x = 5")
def layer_column(spark, d):
    return grids.layer_line(_raster(spark, d), 2, column=5)


@query(f"SELECT layer, x, y, value FROM {_L} WHERE x BETWEEN 3 AND 12 AND y BETWEEN 2 AND 9")
def layer_area(spark, d):
    """All cells of an area, layer by layer."""
    return _raster(spark, d).where(grids.in_area(3, 2, 10, 8))
