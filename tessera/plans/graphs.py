"""Graph queries: customers and suppliers, transitions between event types, and a functional graph over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.registry import query
from tessera.sources.tables import load

_CS = "(SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, min(l_extendedprice) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def trade(spark, d):
    """Vertices and edges from customers to suppliers, weighted by the least price."""
    e = load(spark, d, "orders").select("o_orderkey", "o_custkey").join(load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = e.groupBy(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).agg(F.min("l_extendedprice").alias("weight"))
    v = load(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")))
    return v, e


_LINKS = """(SELECT p_partkey AS src, (p_partkey * 7 + 3) % n AS dst, 1.0 + p_size AS weight FROM part, (SELECT count(*) AS n FROM part)
    UNION ALL SELECT p_partkey, (p_partkey * 3 + 1) % n, 20.0 + p_size FROM part, (SELECT count(*) AS n FROM part))"""


def links(spark, d):
    """A graph over all parts with two edges from each."""
    p = load(spark, d, "part")
    k, s, n = F.col("p_partkey"), F.col("p_size"), F.col("n")
    both = p.join(F.broadcast(p.agg(F.count("*").alias("n"))))
    e = both.select(k.alias("src"), ((k * 7 + 3) % n).alias("dst"), (s + 1.0).alias("weight")).union(both.select(k, (k * 3 + 1) % n, s + 20.0))
    return p.select(k.alias("id")), e


@query(f"SELECT dst, weight FROM {_CS} WHERE src = 'c10'")
def graph_neighbors(spark, d):
    return graph.neighbours(trade(spark, d)[1], F.lit("c10")).select("dst", "weight")


@query(f"""WITH e AS (SELECT src, count(*) AS k FROM {_CS} GROUP BY src), v AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier),
    k AS (SELECT id, coalesce(k, 0) AS k FROM v LEFT JOIN e ON src = id)
    SELECT count(*) AS vertices, CAST(sum(k) AS BIGINT) AS edges, round(avg(k), 9) AS mean_degree, max(k) AS max_degree, min(k) AS min_degree, round(sum(k) / (count(*) * (count(*) - 1.0)), 9) AS density FROM k""")
def graph_stats(spark, d):
    return graph.statistics(*trade(spark, d)).withColumns({"mean_degree": F.round("mean_degree", 9), "density": F.round("density", 9)})


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_LINKS}), b AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS hops UNION SELECT e.dst, hops + 1 FROM b JOIN e ON e.src = b.id WHERE hops < 6)
    SELECT id, CAST(min(hops) AS DOUBLE) AS hops FROM b GROUP BY id""")
def bfs_hops(spark, d):
    src = spark.range(1).select(F.lit(1).cast("long").alias("id"))
    return graph.distances(links(spark, d)[1], src, weighted=False, most=6).select("id", F.col("distance").alias("hops"))


_DIST = f"""WITH RECURSIVE e AS (SELECT src, dst, min(weight) AS w FROM {_LINKS} GROUP BY src, dst), b AS (SELECT CAST(1 AS BIGINT) AS id, 0.0::DOUBLE AS dist UNION SELECT e.dst, dist + w FROM b JOIN e ON e.src = b.id WHERE dist + w <= {{}}),
    r AS (SELECT id, min(dist) AS dist FROM b GROUP BY id) """


@query(_DIST.format(140) + "SELECT id, dist AS distance FROM r WHERE id <> 1")
def nodes_within_distance(spark, d):
    src = spark.range(1).select(F.lit(1).cast("long").alias("id"))
    return graph.distances(links(spark, d)[1], src, most=140).where("id <> source").select("id", "distance")


# Before each vertex on the way the smallest id of those that give its distance.
_WAY = ", p AS (SELECT a.id, min(e.src) AS via FROM {r} a JOIN e ON e.dst = a.id AND e.src <> a.id JOIN {r} b ON b.id = e.src AND b.{x} + {w} = a.{x} WHERE a.id <> 1 GROUP BY a.id), w AS (SELECT CAST({end} AS BIGINT) AS id, [CAST({end} AS BIGINT)] AS path UNION ALL SELECT p.via, list_prepend(p.via, w.path) FROM w JOIN p ON p.id = w.id) "


@query(_DIST.format(140) + _WAY.format(r="r", x="dist", w="e.w", end=73) + "SELECT path, dist AS total_weight, CAST(len(path) AS INTEGER) AS length FROM w, r WHERE w.id = 1 AND r.id = 73")
def shortest_path_weight(spark, d):
    return graph.shortest_path(spark, links(spark, d)[1], 1, 73)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_LINKS}), b AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS hops UNION SELECT e.dst, hops + 1 FROM b JOIN e ON e.src = b.id WHERE hops < 9)
    , h AS (SELECT id, min(hops) AS hops FROM b GROUP BY id)""" + _WAY.format(r="h", x="hops", w="1", end=94) + "SELECT path, CAST(hops AS DOUBLE) AS total_weight, CAST(len(path) AS INTEGER) AS length FROM w, h WHERE w.id = 1 AND h.id = 94")
def shortest_unweighted(spark, d):
    return graph.shortest_path(spark, links(spark, d)[1], 1, 94, weighted=False)


@query(f"""WITH e AS (SELECT DISTINCT src, dst FROM {_LINKS} WHERE src <> dst), k AS (SELECT src AS id, count(*) AS k FROM e GROUP BY src),
    t AS (SELECT a.src AS id, count(*) AS t FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst JOIN e c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src)
    SELECT k.id, CASE WHEN k < 2 THEN 0.0 ELSE round(coalesce(t, 0) / (k * (k - 1) / 2.0), 9) END AS coefficient FROM k LEFT JOIN t ON t.id = k.id""")
def clustering_coefficient(spark, d):
    return graph.clustering(links(spark, d)[1]).withColumn("coefficient", F.round("coefficient", 9))


_F = "(SELECT p_partkey AS src, CASE WHEN p_partkey % 5 = 0 THEN p_partkey // 2 ELSE (p_partkey * 7 + 3) % 400 END AS dst FROM part)"


@query(f"""WITH RECURSIVE r AS (SELECT src AS a, dst AS b FROM {_F} UNION SELECT r.a, e.dst FROM r JOIN {_F} e ON e.src = r.b), v AS (SELECT p_partkey AS id FROM part)
    SELECT v.id, least(v.id, coalesce(min(x.b), v.id)) AS component FROM v LEFT JOIN (SELECT r.a, r.b FROM r JOIN r s ON r.a = s.b AND r.b = s.a) x ON x.a = v.id GROUP BY v.id""")
def scc_components(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"))
    k = F.col("id")
    e = p.select(k.alias("src"), F.when(k % 5 == 0, F.expr("id div 2")).otherwise((k * 7 + 3) % 400).alias("dst"))
    return graph.strong_components(p, e)


@query("SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, arg_min(l_extendedprice, [l_orderkey, l_linenumber, l_partkey, l_extendedprice]) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def edge_add_first_wins(spark, d):
    v, e = trade(spark, d)
    new = load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    new = new.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_extendedprice").alias("weight"), "l_orderkey", "l_linenumber", "l_partkey")
    none = e.withColumns({"l_orderkey": F.lit(0).cast("long"), "l_linenumber": F.lit(0), "l_partkey": F.lit(0).cast("long")}).limit(0)
    return graph.add_edges(v, none, new, ["l_orderkey", "l_linenumber", "l_partkey", "weight"]).select("src", "dst", "weight")


@query(f"SELECT src, dst FROM {_CS} WHERE src NOT IN ('c10', 'c20') AND dst NOT IN ('s3')")
def vertex_remove(spark, d):
    v, e = trade(spark, d)
    return graph.remove_vertices(v, e, v.where("id in ('c10', 'c20', 's3')"))[1].select("src", "dst")


@query("WITH t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM t WHERE dst IS NOT NULL GROUP BY ALL")
def graph_transitions(spark, d):
    return graph.transitions(load(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(f"""WITH o AS (SELECT src, count(*) AS k FROM {_CS} GROUP BY 1), i AS (SELECT dst, count(*) AS k FROM {_CS} GROUP BY 1), v AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier)
    SELECT id, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) AS in_degree FROM v LEFT JOIN o ON o.src = id LEFT JOIN i ON i.dst = id""")
def graph_degrees(spark, d):
    return graph.degrees(*trade(spark, d))


@query(f"SELECT src, dst, weight FROM {_CS} WHERE NOT (src = 'c10' AND dst IN ('s1', 's2', 's3', 's4', 's5'))")
def edge_remove(spark, d):
    e = trade(spark, d)[1]
    return graph.remove_edges(e, e.where("src = 'c10' and dst in ('s1', 's2', 's3', 's4', 's5')"))
