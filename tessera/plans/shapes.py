"""Spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import distance
from tessera.functions import shapes as S
from tessera.operators import spatial
from tessera.plans.registry import query
from tessera.sources.tables import load

_P = "(SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"


def points(spark, d):
    """Parts as points: id, x, y."""
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


@query(f"SELECT id, x, y FROM {_P} WHERE (x - 25) * (x - 25) + (y - 950) * (y - 950) <= 100")
def radius_filter(spark, d):
    return spatial.within_radius(points(spark, d), "x", "y", 25, 950, 10)


@query(f"SELECT a.id AS a, b.id AS b FROM {_P} a JOIN {_P} b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4")
def radius_join(spark, d):
    """Every part with all parts within two."""
    p = points(spark, d)
    b = p.select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return spatial.radius_join(p.withColumnRenamed("id", "a"), b, 2).select("a", "b")


@query(f"SELECT id FROM {_P} WHERE x BETWEEN 10 AND 20 AND y BETWEEN 920 AND 940")
def box_filter_closed(spark, d):
    return points(spark, d).where(S.in_box([F.col("x"), F.col("y")], [10, 920], [20, 940])).select("id")


@query(f"SELECT id FROM {_P} WHERE x >= 10 AND x < 20 AND y >= 920 AND y < 940")
def box_filter_half_open(spark, d):
    return points(spark, d).where(S.in_half_open(F.col("x"), F.col("y"), 10, 920, 10, 20)).select("id")


@query(f"SELECT a.id AS a, b.id AS b FROM {_P} a JOIN {_P} b ON floor(a.x / 2) = floor(b.x / 2) AND floor(a.y / 2) = floor(b.y / 2) AND a.id < b.id")
def collision_pairs_same_cell(spark, d):
    return spatial.same_cell_pairs(points(spark, d), "id", "x", "y", 2)


@query(f"SELECT a.id AS a, b.id AS b FROM {_P} a JOIN {_P} b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1")
def collision_pairs_exact(spark, d):
    return spatial.close_pairs(points(spark, d), "id", "x", "y", 1)


@query(f"""WITH c AS (SELECT count(*) AS n FROM {_P} GROUP BY floor(x / 5), floor(y / 5))
    SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS points, max(n) AS most, min(n) AS least, round(avg(n), 9) AS mean, (SELECT n FROM c ORDER BY n LIMIT 1 OFFSET (SELECT count(*) // 2 FROM c)) AS upper_median FROM c""")
def grid_stats(spark, d):
    return spatial.grid_stats(points(spark, d), "x", "y", 5).withColumn("mean", F.round("mean", 9))


@query(f"SELECT id, round(sqrt((x - 25) * (x - 25) + (y - 950) * (y - 950)), 9) AS distance FROM {_P} ORDER BY (x - 25) * (x - 25) + (y - 950) * (y - 950), id LIMIT 1")
def nearest_one(spark, d):
    dist = F.sqrt(distance.d2((F.col("x"), F.lit(25)), (F.col("y"), F.lit(950))))
    return spatial.nearest(points(spark, d), 1, dist, "id").select("id", F.round("distance", 9).alias("distance"))


@query(f"""SELECT a.id AS query_id, b.id, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rank
    FROM {_P} a, {_P} b WHERE a.id % 100 = 0 QUALIFY rank <= 5""")
def knn_join(spark, d):
    """The five nearest parts of every hundredth part."""
    p = points(spark, d)
    q = p.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    got = spatial.knn_places(q, p, 5, "query_id", "id")
    return got.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


def _vectors(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e, e.where("vec_id % 100 = 0")


_DIST = {
    "euclidean": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))))",
    "manhattan": "list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))",
    "chebyshev": "list_max(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))",
    "minkowski3": "list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]) ** 3)) ** (1 / 3.0)",
}


def _knn(name: str, metric):
    sql = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, {_DIST[name]} AS d FROM e a, e b WHERE a.vec_id % 100 = 0)
        SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank, round(d, 6) AS distance FROM p QUALIFY rank <= 10"""

    def run(spark, d):
        e, q = _vectors(spark, d)
        return spatial.knn_vectors(e, q, 10, "vec_id", "v", metric).withColumn("distance", F.round("distance", 6))

    run.__name__ = f"knn_metric_{name}"
    run.__doc__ = f"Ten nearest vectors of every hundredth by the {name} metric."
    query(sql)(run)


for _n, _m in (("euclidean", "euclidean"), ("manhattan", "manhattan"), ("chebyshev", "chebyshev"), ("minkowski3", 3)):
    _knn(_n, _m)


@query("SELECT vec_id FROM embeddings WHERE embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.1 AND 0.1 AND embedding[3] BETWEEN -0.2 AND 0.2")
def kd_box(spark, d):
    v = [F.col("embedding")[i].cast("double") for i in range(3)]
    return load(spark, d, "embeddings").where(S.in_box(v, [-0.1, -0.1, -0.2], [0.1, 0.1, 0.2])).select("vec_id")


@query("""SELECT b.vec_id FROM embeddings b, (SELECT embedding FROM embeddings WHERE vec_id = 0) a
    WHERE sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i])))) <= 1.3""")
def kd_radius(spark, d):
    e, _ = _vectors(spark, d)
    q = e.where("vec_id = 0").select(F.col("v").alias("q"))
    return e.join(F.broadcast(q)).where(distance.euclidean(F.col("v"), F.col("q")) <= 1.3).select("vec_id")


_P3 = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"


def points3(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM {_P3} WHERE (x - 25) * (x - 25) + (y - 35) * (y - 35) + (z - 5) * (z - 5) <= 25.3")
def sphere_filter(spark, d):
    r = distance.d2((F.col("x"), F.lit(25)), (F.col("y"), F.lit(35)), (F.col("z"), F.lit(5)))
    return points3(spark, d).where(r <= 25.3).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM {_P3} WHERE x BETWEEN 10 AND 12 AND y BETWEEN 10 AND 20 AND z BETWEEN 1.5 AND 4.5")
def oct_box(spark, d):
    return points3(spark, d).where(S.in_box([F.col("x"), F.col("y"), F.col("z")], [10, 10, 1.5], [12, 20, 4.5])).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM {_P3} WHERE x - 5 >= 0 AND -x + 20 >= 0 AND y - 8 >= 0 AND -y + 30 >= 0 AND 0.5 * x - z + 1.05 >= 0 AND z - 1.5 >= 0")
def frustum_filter(spark, d):
    planes = [(1, 0, 0, -5), (-1, 0, 0, 20), (0, 1, 0, -8), (0, -1, 0, 30), (0.5, 0, -1, 1.05), (0, 0, 1, -1.5)]
    return points3(spark, d).where(S.in_frustum(F.col("x"), F.col("y"), F.col("z"), planes)).select("l_orderkey", "l_linenumber", "l_partkey")


_R = "(SELECT p_partkey AS key, p_size - 1.5 AS min_x, p_retailprice - 1.0 AS min_y, p_size + 1.5 AS max_x, p_retailprice + 1.0 AS max_y FROM part)"


def rects(spark, d):
    p = load(spark, d, "part")
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    return p.select(F.col("p_partkey").alias("key"), (x - 1.5).alias("min_x"), (y - 1.0).alias("min_y"), (x + 1.5).alias("max_x"), (y + 1.0).alias("max_y"))


@query(f"SELECT a.key AS a, b.key AS b FROM {_R} a JOIN {_R} b ON a.min_x <= b.max_x AND a.max_x >= b.min_x AND a.min_y <= b.max_y AND a.max_y >= b.min_y")
def rect_intersect_join(spark, d):
    r = rects(spark, d)
    b = r.withColumnsRenamed({"key": "b"} | {e: f"o_{e}" for e in S.EDGES})
    return spatial.rect_join(r.withColumnRenamed("key", "a"), b, 4.0).select("a", "b")


@query(f"SELECT key FROM {_R} WHERE min_x >= 10 AND min_y >= 920 AND max_x <= 30 AND max_y <= 950")
def rect_contained(spark, d):
    return rects(spark, d).where(S.contained(S.rect(), (10, 920, 30, 950))).select("key")


@query(f"SELECT key FROM {_R} WHERE min_x <= 15 AND min_y <= 925 AND max_x >= 10 AND max_y >= 920")
def rect_intersect(spark, d):
    return rects(spark, d).where(S.intersects(S.rect(), (10, 920, 15, 925))).select("key")


@query(f"SELECT key FROM {_R} WHERE 25 BETWEEN min_x AND max_x AND 950 BETWEEN min_y AND max_y")
def rect_stab(spark, d):
    return rects(spark, d).where(S.holds_point(S.rect(), 25, 950)).select("key")


@query("SELECT p_brand, CAST(min(p_size - 1.5) AS DOUBLE) AS min_x, min(p_retailprice - 1.0) AS min_y, CAST(max(p_size + 1.5) AS DOUBLE) AS max_x, max(p_retailprice + 1.0) AS max_y FROM part GROUP BY p_brand")
def rect_union_agg(spark, d):
    r = rects(spark, d).join(load(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_brand"), "key")
    return r.groupBy("p_brand").agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


@query(f"SELECT key, round((greatest(max_x, 30) - least(min_x, 10)) * (greatest(max_y, 950) - least(min_y, 920)) - (max_x - min_x) * (max_y - min_y), 6) AS increase FROM {_R}")
def rect_area_increase(spark, d):
    return rects(spark, d).select("key", F.round(S.area_increase(S.rect(), (10, 920, 30, 950)), 6).alias("increase"))


@query(f"SELECT id FROM {_P} WHERE abs(x - 25) < 4.5 AND abs(y - 950) < 4.5")
def points_at(spark, d):
    return spatial.at_point(points(spark, d), "x", "y", 25, 950, 4.5).select("id")


@query(f"SELECT id FROM {_P} WHERE floor(x / 8) = 3 AND floor(y / 8) = 118")
def candidates_at(spark, d):
    return spatial.candidates_at(points(spark, d), "x", "y", 25, 950, 8).select("id")


@query("SELECT p_partkey AS id, count(*) AS cells FROM (SELECT p_partkey, p_size AS x, p_retailprice AS y FROM part), range(-2, 30) a(cx), range(200, 300) b(cy) WHERE cx BETWEEN floor((x - 3) / 4) AND floor((x + 3) / 4) AND cy BETWEEN floor((y - 5) / 4) AND floor((y + 5) / 4) GROUP BY p_partkey")
def box_cells(spark, d):
    p = points(spark, d).withColumns({"w": F.lit(6.0), "h": F.lit(10.0)})
    return spatial.box_cells(p, "x", "y", "w", "h", 4.0).groupBy("id").agg(F.count("*").alias("cells"))


_V3 = "(SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


@query(f"SELECT a.id AS a, b.id AS b FROM {_V3} a JOIN {_V3} b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.03 * 0.03")
def collision_pairs_3d(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")])
    return spatial.close_in_space(e, "id", 0.03)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM {_P3} WHERE pow(greatest(10 - x, x - 12, 0), 2) + pow(greatest(10 - y, y - 20, 0), 2) + pow(greatest(1.5 - z, z - 4.5, 0), 2) <= 4.1")
def near_box(spark, d):
    v = [F.col("x"), F.col("y"), F.col("z")]
    return points3(spark, d).where(S.box_distance2(v, [10, 10, 1.5], [12, 20, 4.5]) <= 4.1).select("l_orderkey", "l_linenumber", "l_partkey")
