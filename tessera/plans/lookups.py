"""Queries on keyed tables that change: vertices, rectangles, points, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import distance
from tessera.functions import shapes as S
from tessera.operators import graph, keyed, spatial
from tessera.plans.registry import query
from tessera.plans.shapes import points, points3, rects
from tessera.sources.tables import load, micros

# Vertices: customers with their balance.
_V = "(SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_mktsegment <> 'BUILDING')"
_W = "(SELECT o_custkey AS id, o_totalprice AS value, o_orderdate, o_orderkey FROM orders)"
_BY = ["o_orderdate", "o_orderkey"]


def _vertices(spark, d):
    return load(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))


def _writes(spark, d):
    return load(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), *_BY)


@query(f"""WITH w AS (SELECT id, arg_max(value, [epoch_us(o_orderdate::TIMESTAMP), o_orderkey]) AS v FROM {_W} GROUP BY id)
    SELECT coalesce(a.id, w.id) AS id, coalesce(w.v, a.value) AS value FROM {_V} a FULL JOIN w ON w.id = a.id""")
def vertex_upsert(spark, d):
    """Vertices after a log of writes: the last of each id wins, new ids enter."""
    return graph.upsert_vertices(_vertices(spark, d), _writes(spark, d), _BY)


@query(f"""WITH w AS (SELECT id, arg_min(value, [epoch_us(o_orderdate::TIMESTAMP), o_orderkey]) AS v, count(*) AS n FROM {_W} GROUP BY id)
    SELECT coalesce(a.id, w.id) AS id, coalesce(a.value, w.v) AS value, coalesce(n - CASE WHEN a.id IS NULL THEN 1 ELSE 0 END, 0) AS refused FROM {_V} a FULL JOIN w ON w.id = a.id""")
def vertex_add(spark, d):
    """Added vertices: ids that are there already are refused."""
    return graph.add_vertices(_vertices(spark, d), _writes(spark, d), _BY)


@query(f"SELECT p.id, a.id IS NOT NULL AS found, a.value FROM (SELECT DISTINCT o_custkey AS id FROM orders) p LEFT JOIN {_V} a ON a.id = p.id")
def vertex_lookup(spark, d):
    return graph.lookup_vertices(load(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct(), _vertices(spark, d)).select("id", "found", "value")


@query(f"SELECT id, value FROM {_V} WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def vertex_listing(spark, d):
    """Ids and values of what is left after some vertices were removed."""
    v = _vertices(spark, d)
    none = spark.createDataFrame([], "src long, dst long")
    gone = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct()
    return graph.remove_vertices(v, none, gone)[0].select("id", "value")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst, min(l_quantity) AS weight FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2)
    SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e""")
def edges_both_ways(spark, d):
    """Edges between parts and suppliers, added in both directions.

    Parts and suppliers number their keys by themselves, and at size a part may have the number of a supplier; so parts are
    the even vertices and suppliers the odd ones, and the numbers that are shown come last.
    """
    part, supplier = (lambda k: F.col(k).cast("long") * 2), (lambda k: F.col(k).cast("long") * 2 + 1)
    v = load(spark, d, "part").select(part("p_partkey").alias("id")).union(load(spark, d, "supplier").select(supplier("s_suppkey")))
    li = load(spark, d, "lineitem").select(part("l_partkey").alias("src"), supplier("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"))
    shown = lambda c: (F.shiftright(c, 1) + F.when(F.col(c).bitwiseAND(1) == 1, 1_000_000).otherwise(0)).alias(c)
    return graph.add_edges(v, li.limit(0), li, ["weight"], both_ways=True).select(shown("src"), shown("dst"), "weight")


# Keyed rectangles: one a part; order lines write new ones.
_R = "(SELECT p_partkey AS key, p_size - 1.5::DOUBLE AS min_x, p_retailprice - 1.0 AS min_y, p_size + 1.5::DOUBLE AS max_x, p_retailprice + 1.0 AS max_y FROM part)"
_U = """(SELECT l_partkey AS key, arg_max({'a': l_quantity - 1.0, 'b': l_extendedprice / 1000 - 1.0, 'c': l_quantity + 1.0, 'd': l_extendedprice / 1000 + 1.0}, [l_orderkey, l_linenumber, l_partkey]) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)"""
_NOW = f"(SELECT coalesce(r.key, u.key) AS key, coalesce(u.v.a, r.min_x) AS min_x, coalesce(u.v.b, r.min_y) AS min_y, coalesce(u.v.c, r.max_x) AS max_x, coalesce(u.v.d, r.max_y) AS max_y FROM {_R} r FULL JOIN {_U} u ON u.key = r.key)"


def _rects_now(spark, d):
    """The rectangles after a bulk of upserts, the last of each key."""
    x, y = F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000
    new = load(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("key"), (x - 1.0).alias("min_x"), (y - 1.0).alias("min_y"), (x + 1.0).alias("max_x"), (y + 1.0).alias("max_y"), "l_orderkey", "l_linenumber", "l_partkey")
    old = rects(spark, d).withColumns({"l_orderkey": F.lit(-1).cast("long"), "l_linenumber": F.lit(-1).cast(new.schema["l_linenumber"].dataType), "l_partkey": F.lit(-1).cast("long")})
    return keyed.last_wins(old.unionByName(new), "key", ["l_orderkey", "l_linenumber", "l_partkey"]).select("key", *S.EDGES)


def _rounded(df, *more):
    return df.select("key", *more, *[F.round(e, 6).alias(e) for e in S.EDGES])


_EDGES = ", ".join(f"round({e}, 6) AS {e}" for e in S.EDGES)


@query(f"SELECT key, {_EDGES} FROM {_NOW}")
def rect_upsert(spark, d):
    return _rounded(_rects_now(spark, d))


@query(f"SELECT p.key, r.key IS NOT NULL AS found, {_EDGES} FROM (SELECT DISTINCT l_suppkey * 3 AS key FROM lineitem) p LEFT JOIN {_NOW} r ON r.key = p.key")
def rect_lookup(spark, d):
    """Rectangles looked up by key."""
    p = load(spark, d, "lineitem").select((F.col("l_suppkey") * 3).alias("key")).distinct()
    got = p.join(_rects_now(spark, d).withColumn("found", F.lit(True)), "key", "left").na.fill(False, ["found"])
    return _rounded(got, "found")


_GONE = "(SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"


@query(f"SELECT key, {_EDGES} FROM {_NOW} WHERE key NOT IN {_GONE} AND min_x <= 30 AND max_x >= 10 AND min_y <= 960 AND max_y >= 20")
def rect_delete(spark, d):
    """What a search finds after some keys were deleted."""
    gone = load(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key")).distinct()
    left = _rects_now(spark, d).join(gone, "key", "left_anti")
    return _rounded(left.where(S.intersects(S.rect(), (10, 20, 30, 960))))


@query(f"""SELECT count(*) AS entries, round(min(min_x), 6) AS min_x, round(min(min_y), 6) AS min_y, round(max(max_x), 6) AS max_x, round(max(max_y), 6) AS max_y, round(sum((max_x - min_x) * (max_y - min_y)), 4) AS area,
    round(avg((min_x + max_x) / 2), 6) AS mean_x, round(avg((min_y + max_y) / 2), 6) AS mean_y FROM {_NOW}""")
def rect_stats(spark, d):
    r = S.rect()
    x, y = S.centre(r)
    edges = [F.round((F.min if e.startswith("min") else F.max)(e), 6).alias(e) for e in S.EDGES]
    return _rects_now(spark, d).agg(F.count("*").alias("entries"), *edges, F.round(F.sum(S.area(r)), 4).alias("area"), F.round(F.avg(x), 6).alias("mean_x"), F.round(F.avg(y), 6).alias("mean_y"))


# Points that go.
_P = "(SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"
_SOLD = "(SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"


def _without_sold(spark, d):
    gone = load(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id")).distinct()
    return spatial.without(points(spark, d), gone, "id")


@query(f"SELECT id, x, y FROM {_P} WHERE id NOT IN {_SOLD} AND (x - 25) * (x - 25) + (y - 950) * (y - 950) <= 2500")
def points_after_removal(spark, d):
    return spatial.within_radius(_without_sold(spark, d), "x", "y", 25, 950, 50)


@query(f"SELECT id FROM {_P} WHERE id NOT IN {_SOLD} AND x >= 10 AND x < 30 AND y >= 900 AND y < 1000")
def range_after_removal(spark, d):
    return _without_sold(spark, d).where(S.in_half_open(F.col("x"), F.col("y"), 10, 900, 20, 100)).select("id")


_P3 = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"
_D3 = "(x - 25) * (x - 25) + (y - 35) * (y - 35) + (z - 5) * (z - 5)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt({_D3}), 6) AS distance FROM {_P3} ORDER BY round({_D3}, 9), l_orderkey, l_linenumber, l_partkey LIMIT 12")
def nearest_in_space(spark, d):
    d2 = F.round(distance.d2((F.col("x"), F.lit(25)), (F.col("y"), F.lit(35)), (F.col("z"), F.lit(5))), 9)
    best = points3(spark, d).withColumn("d2", d2).orderBy("d2", "l_orderkey", "l_linenumber", "l_partkey").limit(12)
    return best.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.sqrt("d2"), 6).alias("distance"))


_PLANES = [(1, 0, 0, -5), (-1, 0, 0, 20), (0, 1, 0, -8), (0, -1, 0, 30), (0.5, 0, -1, 1.05), (0, 0, 1, -1.5)]
_CORNER = " AND ".join(" + ".join(f"({n}) * ({c} {'+' if n >= 0 else '-'} 1.25)" for n, c in zip(p[:3], "xyz", strict=True)) + f" + ({p[3]}) >= 0" for p in _PLANES)


def _boxes(spark, d):
    """A box of 2.5 around every point in space: low and high corners."""
    low, high = ([F.col(c) + s for c in "xyz"] for s in (-1.25, 1.25))
    return points3(spark, d), low, high


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM {_P3} WHERE {_CORNER}")
def frustum_boxes(spark, d):
    p, low, high = _boxes(spark, d)
    return p.where(S.box_in_frustum(low, high, _PLANES)).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM {_P3} WHERE x - 1.25 <= 12 AND x + 1.25 >= 10 AND y - 1.25 <= 20 AND y + 1.25 >= 10 AND z - 1.25 <= 4.6 AND z + 1.25 >= 1.6")
def boxes_meet(spark, d):
    p, low, high = _boxes(spark, d)
    on = S.boxes_meet(low, high, [F.lit(v) for v in (10.0, 10.0, 1.6)], [F.lit(v) for v in (12.0, 20.0, 4.6)])
    return p.where(on).select("l_orderkey", "l_linenumber", "l_partkey")


# Caches whose content depends on every access: folds, which SQL expresses by recursion over the log.
def _fold(group: str, key: str, capacity: int, refresh: bool = False, delete: str = "FALSE") -> str:
    """SQL rows (g, position, k) of a cache a group after its log."""
    grown = f"list_append(CASE WHEN len(held) = {capacity} THEN held[2:] ELSE held END, k)"
    again = "list_append(list_filter(held, lambda x: x <> k), k)" if refresh else "held"
    return f"""WITH RECURSIVE l AS (SELECT {group} AS g, {key} AS k, {delete} AS gone, row_number() OVER (PARTITION BY {group} ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT g, CAST(0 AS BIGINT) AS n, k[:0] AS held FROM (SELECT g, list(k) AS k FROM l GROUP BY g)
            UNION ALL SELECT r.g, l.n, CASE WHEN l.gone THEN list_filter(held, lambda x: x <> k) WHEN list_contains(held, k) THEN {again} ELSE {grown} END FROM r JOIN l ON l.g = r.g AND l.n = r.n + 1),
        e AS (SELECT g, arg_max(held, n) AS held FROM r GROUP BY g),
        c AS (SELECT g, unnest(range(0, len(held))) AS position, held FROM e) """


def _log(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("us"))


_O = ["us", "event_id"]


@query(_fold("event_type", "user_id", 3) + "SELECT g AS event_type, CAST(position AS INTEGER) AS position, held[position + 1] AS user_id FROM c")
def fifo_cache(spark, d):
    """What a FIFO of three users holds for each event type after the log."""
    return keyed.fifo(_log(spark, d), ["event_type"], "user_id", _O, 3)


_DELETES = "value < 20"


@query(_fold("user_id", "event_type", 2, delete=_DELETES) + "SELECT g AS user_id, CAST(position AS INTEGER) AS position, held[position + 1] AS event_type FROM c")
def fifo_with_deletes(spark, d):
    """The two event types that each user's FIFO holds, where events of small value delete their type."""
    return keyed.fifo(_log(spark, d), ["user_id"], "event_type", _O, 2, F.expr(_DELETES))


@query(_fold("user_id", "event_type", 3, refresh=True, delete=_DELETES) + "SELECT g AS user_id, CAST(position AS INTEGER) AS position, held[position + 1] AS event_type FROM c")
def lru_with_deletes(spark, d):
    """The three event types that each user's LRU cache holds, least recent first, where events of small value delete their type."""
    return keyed.fifo(_log(spark, d), ["user_id"], "event_type", _O, 3, F.expr(_DELETES), refresh=True)


@query(_fold("user_id", "event_type", 3, refresh=True, delete=_DELETES) + "SELECT g AS user_id, arg_min(held[position + 1], position) AS first_out, arg_max(held[position + 1], position) AS last_out FROM c GROUP BY g")
def lru_peek(spark, d):
    """A look at both ends of each LRU cache."""
    return keyed.cache_ends(lru_with_deletes(spark, d), ["user_id"], "event_type")


@query(_fold("user_id", "event_type", 3, refresh=True, delete=_DELETES) + "SELECT g AS user_id, count(*) AS entries, 3 AS capacity, count(*) = 3 AS full FROM c GROUP BY g")
def cache_stats(spark, d):
    return keyed.occupancy(lru_with_deletes(spark, d), ["user_id"], 3)


@query(_fold("user_id", "event_type", 3, refresh=True, delete=_DELETES) + "SELECT p.user_id, p.event_type, list_contains(e.held, p.event_type) AS held FROM (SELECT a.user_id, b.event_type FROM (SELECT DISTINCT user_id FROM events) a, (SELECT DISTINCT event_type FROM events) b) p JOIN e ON e.g = p.user_id")
def cache_read(spark, d):
    """Whether each cache holds each event type; a look moves nothing."""
    e = load(spark, d, "events")
    probes = e.select("user_id").distinct().join(F.broadcast(e.select("event_type").distinct()))
    held = lru_with_deletes(spark, d).select("user_id", "event_type", F.lit(True).alias("held"))
    return probes.join(held, ["user_id", "event_type"], "left").na.fill(False, ["held"])


@query("SELECT p.c_custkey AS user_id, coalesce(n, 0) AS n FROM customer p LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) c ON c.user_id = p.c_custkey")
def counter_probe(spark, d):
    """Access counts of some keys, held or not."""
    probes = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return keyed.probe_counters(probes, keyed.counters(_log(spark, d), "user_id", _O), "user_id")


@query("SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def multimap_keys(spark, d):
    """Keys with the last touch that orders them."""
    return keyed.in_touch_order(load(spark, d, "conversations"), "conv_id", ["turn"])


@query("""WITH k AS (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY max(turn) DESC, conv_id LIMIT 15)
    SELECT conv_id, list(role ORDER BY turn, role) AS members FROM conversations WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY conv_id""")
def multimap_recent(spark, d):
    """The fifteen keys touched last, each with all its values."""
    return keyed.lru_multimap(load(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "role", ["turn"], 15)
