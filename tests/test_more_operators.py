"""Snapshots, seeks, mergeable quantiles, planar neighbours, vertices, caches and maps, by hand or by brute force."""

import collections as std
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import hexes, shapes
from tessera.operators import collections, graph, grids, keyed, quantiles, sketches, spatial, temporal
from tests.test_operators import plan, rows


# time
def test_snapshots_keep_what_does_not_move(spark):
    log = spark.createDataFrame([(5, 1, "a", 1.0, False), (12, 2, "b", 2.0, False), (38, 3, "b", 0.0, True), (40, 4, "b", 4.0, False), (41, 5, "b", 5.0, False)], "ts long, n long, obj string, x double, gone boolean")
    got = rows(temporal.snapshots(log, "obj", "ts", ["n"], ["x"], 10, F.col("gone")))
    assert got == [(10, "a", 1.0), (20, "a", 1.0), (20, "b", 2.0), (30, "a", 1.0), (30, "b", 2.0), (40, "a", 1.0), (40, "b", 4.0), (50, "a", 1.0), (50, "b", 5.0)]
    assert temporal.snapshots(log.limit(0), "obj", "ts", ["n"], ["x"], 10).count() == 0


def test_snapshots_by_brute_force(spark):
    rnd = random.Random(1)
    data = [(rnd.randrange(-200, 1000), n, rnd.randrange(6), rnd.randrange(100), rnd.random() < 0.2) for n in range(300)]
    log = spark.createDataFrame(data, "ts long, n long, obj long, x long, gone boolean")
    first, last = min(data)[0], max(data)[0]
    want = []
    for tick in range(-(-first // 70) * 70, -(-last // 70) * 70 + 1, 70):
        for obj in range(6):
            own = max(((t, n, x, g) for t, n, o, x, g in data if o == obj and t <= tick), default=None)
            if own and not own[3]:
                want.append((tick, obj, own[2]))
    assert rows(temporal.snapshots(log, "obj", "ts", ["n"], ["x"], 70, F.col("gone"))) == sorted(want)


def test_snapshot_of_a_time(spark):
    s = spark.createDataFrame([(10, "a"), (20, "b"), (20, "c"), (40, "d")], "tick long, obj string")
    at = lambda t, closest=False: [o for _, o in rows(temporal.snapshot_at(s, t, closest))]
    assert [at(9), at(10), at(39), at(40), at(41)] == [[], ["a"], ["b", "c"], ["d"], []]
    assert [at(-5, True), at(15, True), at(30, True), at(31, True), at(99, True)] == [["a"], ["a"], ["b", "c"], ["d"], ["d"]]
    assert rows(temporal.snapshot_steps(s)) == [(10, 1, None, 20), (20, 2, 10, 40), (40, 1, 20, None)]


def test_cursors_stay_within_a_timeline(spark):
    log = spark.createDataFrame([("k", 10, 1, "a"), ("k", 20, 2, "b"), ("k", 20, 3, "c"), ("k", 30, 4, "d")], "k string, ts long, n long, v string")
    cursors = spark.createDataFrame([("k", t) for t in (9, 10, 19, 20, 30, 31)] + [("none", 10)], "k string, at long")
    got = rows(temporal.seek(log, ["k"], "ts", ["n"], cursors, "at", ["v"]))
    assert got == rows(spark.createDataFrame([("k", 9, False, None, None, None), ("k", 10, True, 0, 10, "a"), ("k", 19, True, 0, 10, "a"), ("k", 20, True, 2, 20, "c"), ("k", 30, True, 3, 30, "d"), ("k", 31, False, None, None, None), ("none", 10, False, None, None, None)], "k string, at long, ok boolean, p long, f long, v string"))


@pytest.mark.parametrize("buckets", [1, 7, 256])
def test_as_of_in_any_number_of_buckets(spark, buckets):
    rnd = random.Random(buckets)
    log = [(rnd.choice(["a", "b", None]), rnd.randrange(300), n) for n in range(120)]
    probes = [(rnd.choice(["a", "b", "c", None]), rnd.randrange(-20, 320)) for _ in range(80)]
    want = []
    for k, t in probes:
        own = [(ts, n) for key, ts, n in log if key == k]
        best = max(((ts, n) for ts, n in own if ts <= t), default=(None, None)) if own and t <= max(own)[0] else (None, None)
        want.append((k, t, *best))
    got = temporal.as_of(spark.createDataFrame(probes, "k string, at long"), spark.createDataFrame(log, "k string, ts long, n long"), ["k"], "at", "ts", ["n"], ["n"], buckets=buckets)
    assert std.Counter(map(tuple, got.collect())) == std.Counter(want)


def test_as_of_an_empty_log(spark):
    log = spark.createDataFrame([], "k string, ts long, n long")
    got = temporal.as_of(spark.createDataFrame([("a", 1)], "k string, at long"), log, ["k"], "at", "ts", ["n"], ["n"])
    assert rows(got) == [("a", 1, None, None)]


# quantiles
def test_exact_quantiles_by_brute_force(spark):
    rnd = random.Random(3)
    data = [(k, rnd.choice([None, float(rnd.randrange(30)), rnd.gauss(0, 1)])) for k in ("x", "y", None) for _ in range(rnd.randrange(1, 400))] + [("one", 5.0), ("none", None)]
    qs = {"lo": 0.0, "q": 0.37, "half": 0.5, "p": 0.999, "hi": 1.0}
    got = quantiles.exact(spark.createDataFrame(data, "k string, v double"), ["k"], "v", qs, [F.count("*").alias("n")])
    for r in got.collect():
        own = sorted(v for k, v in data if k == r.k and v is not None)
        assert r.n == sum(k == r.k for k, _ in data)
        assert [r[n] for n in qs] == [own[max(0, -int(-q * len(own) // 1) - 1)] if own else None for q in qs.values()]


def test_exact_quantiles_beyond_the_sketch(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    got = quantiles.exact(df, ["k"], "v", {"a": 0.25, "b": 0.9999}).first()
    want = df.agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY v)"), F.expr("percentile_disc(0.9999) WITHIN GROUP (ORDER BY v)")).first()
    assert (got.a, got.b) == tuple(want)
    medians = quantiles.exact_type2(df, ["k"], "v", {"m": 0.5}).first().m
    assert medians == df.agg(F.expr("percentile(v, 0.5)")).first()[0]


@pytest.mark.parametrize("stretch", [1, 3, 24])
def test_rolling_quantiles_by_brute_force(spark, stretch):
    rnd = random.Random(stretch)
    data = [(rnd.choice("ab"), rnd.randrange(-300, 900), n, float(rnd.randrange(20))) for n in range(200)]
    got = quantiles.rolling(spark.createDataFrame(data, "k string, t long, n long, v double"), ["k"], F.col("t"), "v", 0.7, 50, "q", stretch)
    want = []
    for k, t, n, v in data:
        own = sorted(x for key, u, _, x in data if key == k and t - 50 <= u <= t)
        want.append((k, t, n, v, own[max(0, -int(-0.7 * len(own) // 1) - 1)]))
    assert got.columns == ["k", "t", "n", "v", "q"] and rows(got) == sorted(want)


def test_markers_give_other_percentiles_and_counts(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(101)] + [("b", 0, 3.0), ("b", 1, 1.0)], "k string, n long, v double")
    got = {r.k: r for r in quantiles.p_square(df, ["k"], "v", ["n"], 0.5).withColumn("q", quantiles.between_markers(F.col("markers"), 0.25)).collect()}
    assert (got["a"].n, got["a"].low, got["a"].high, len(got["a"].markers)) == (101, 0.0, 100.0, 5) and abs(got["a"].q - 25) < 5
    assert (got["b"].n, got["b"].low, got["b"].high, got["b"].q) == (2, 1.0, 3.0, 1.0)


# sketches
def test_a_small_filter_errs_and_a_table_shaped_by_error_is_near(spark):
    inside = spark.range(500).toDF("x")
    tight = sketches.bloom(inside, F.col("x"), 600, 2)
    out = spark.range(1000, 2000).toDF("x")
    assert sketches.bloom_probe(out, F.col("x"), tight, 600, 2).where("maybe").count() > 300
    s = sketches.bloom_stats(tight, 600, 2).first()
    assert abs(s.items - 500) < 60 and s.bytes == 80 and 0.5 < s.fill_ratio < 1
    width, depth = sketches.cms_shape(0.01, 0.99)
    log = spark.range(5000).select((F.col("id") % 321).alias("x"))
    sketch = sketches.count_min(log, F.col("x"), width, depth)
    stats = sketches.cms_stats(spark, sketch, width, depth).first()
    exact = log.groupBy("x").agg(F.count("*").alias("n"))
    assert stats.counted == 5000 and sketches.cms_estimate(exact, F.col("x"), sketch, width, depth).where(F.col("estimate") > F.col("n") + stats.max_error).count() <= 5


def test_a_probe_holds_when_rows_come_in_another_order(spark):
    def anyhow(batches):
        for b in batches:
            yield b.sample(frac=1)  # another order whenever it is computed

    inside = spark.range(0, 600, 3).toDF("x")
    sketch = sketches.bloom(inside, F.col("x"), 1 << 16, 7)
    probes = spark.range(600).selectExpr("if(id = 1, null, id) as x").repartition(1).mapInPandas(anyhow, "x long")
    got = sketches.bloom_probe(probes.withColumn("y", F.col("x") + 1), F.col("x"), sketch, 1 << 16, 7)
    assert got.columns == ["x", "y", "maybe"] and got.count() == 600
    got = {r.x: r.maybe for r in got.collect()}
    assert all(got[x] for x in range(0, 600, 3)) and sum(got.values()) <= 210 and got[None] is False


def test_a_filter_before_a_join_changes_nothing(spark):
    a, b = spark.range(300).selectExpr("id % 70 as x", "id"), spark.range(40).selectExpr("id * 3 as x")
    got = sketches.bloom_semi_join(a, "x", b, 64, 2).select("id")
    assert rows(got) == rows(a.join(b, "x", "left_semi").select("id"))


# space
def inner_broadcasts(df):
    return [line for line in plan(df).splitlines() if "BroadcastHashJoin" in line and "Inner" in line or "NestedLoop" in line]


def most_in_a_task(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


def crowd(spark):
    """Points of which most lie in one cell, some alike, some without an id, some ids twice."""
    rnd = random.Random(11)
    data = [(i, rnd.uniform(2, 3), rnd.uniform(2, 3)) for i in range(60)] + [(100 + i, 2.5, 2.5) for i in range(12)] + [(200 + i, rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for i in range(60)]
    data += [(5, 2.5, 2.5), (5, 2.5, 2.6), (None, 2.5, 2.5), (300, None, 2.5), (301, 2.5, None)]
    return data, spark.createDataFrame(data, "id long, x double, y double")


def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 7), ("PAIRS", 200)):
        monkeypatch.setattr(spatial, name, value, raising=False)


def test_exact_collisions_of_a_crowded_cell(spark, monkeypatch):
    small_blocks(monkeypatch)
    data, df = crowd(spark)
    near = [(a, b) for a, x, y in data for b, u, v in data if None not in (a, b, x, y, u, v) and a < b and (x - u) ** 2 + (y - v) ** 2 <= 1]
    got = spatial.close_pairs(df, "id", "x", "y", 1)
    assert rows(got) == sorted(near)
    assert not inner_broadcasts(got) and most_in_a_task(got) < 0.3
    solid = df.withColumn("z", F.col("x"))
    near = [(a, b) for a, x, y in data for b, u, v in data if None not in (a, b, x, y, u, v) and a < b and 2 * (x - u) ** 2 + (y - v) ** 2 <= 1]
    got = spatial.close_in_space(solid, "id", 1.0)
    assert rows(got) == sorted(near)
    assert not inner_broadcasts(got) and most_in_a_task(got) < 0.3


def test_radius_join_keeps_all_columns_of_a_crowded_cell(spark, monkeypatch):
    small_blocks(monkeypatch)
    data, df = crowd(spark)
    a = df.select("x", F.col("id").alias("a"), "y", (F.col("id") * 2).cast("string").alias("name"))
    b = df.select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    got = spatial.radius_join(a, b, 2.0)
    assert got.columns == ["x", "a", "y", "name", "b", "x2", "y2"]
    want = [(x, i, y, None if i is None else str(2 * i), j, u, v) for i, x, y in data for j, u, v in data if None not in (x, y, u, v) and (x - u) ** 2 + (y - v) ** 2 <= 4]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert not inner_broadcasts(got) and most_in_a_task(got) < 0.3


def test_a_row_of_the_join_makes_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PART", 8, raising=False)
    monkeypatch.setattr(spatial, "BLOCK", 200)
    sent, parts = [], spatial._parts
    monkeypatch.setattr(spatial, "_parts", lambda *rest: sent.append(parts(*rest)) or sent[-1])
    data = [(i, 2.0 + i % 7 / 10, 2.5) for i in range(200)]
    a = spark.createDataFrame(data, "a long, x double, y double")
    b = a.withColumnsRenamed({"a": "b", "x": "x2", "y": "y2"})
    got = spatial.radius_join(a, b, 0.45, size=4.0).select("a", "b")
    assert rows(got) == sorted((i, j) for i, x, y in data for j, u, v in data if (x - u) ** 2 + (y - v) ** 2 <= 0.45**2)
    of = lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + F.size(p["_rows"]))
    made = [r.n * r.m for r in sent[0].select(of("_a_places").alias("n"), of("_b_places").alias("m")).collect()]
    assert sum(made) == 200 * 200 and max(made) <= 24 * 24


def test_rectangles_of_a_crowded_cell(spark, monkeypatch):
    small_blocks(monkeypatch)
    rnd = random.Random(3)
    boxes = [(i, x, y, x + rnd.uniform(0, 5), y + rnd.uniform(0, 5)) for i, x, y in crowd(spark)[0] if None not in (i, x, y)] + [(400 + i, 2.0, 2.0, 3.0, 3.0) for i in range(30)]
    r = spark.createDataFrame(boxes, "a long, min_x double, min_y double, max_x double, max_y double")
    other = r.withColumnsRenamed({"a": "b"} | {e: f"o_{e}" for e in shapes.EDGES})
    got = spatial.rect_join(r, other, 4.0).select("a", "b")
    assert rows(got) == sorted((p[0], q[0]) for p in boxes for q in boxes if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    assert not inner_broadcasts(got) and most_in_a_task(got) < 0.3


def test_pairs_of_one_cell_go_to_many_tasks(spark, monkeypatch):
    small_blocks(monkeypatch)
    data, df = crowd(spark)
    same = [(a, b) for a, x, y in data for b, u, v in data if None not in (a, b, x, y, u, v) and a < b and x // 2 == u // 2 and y // 2 == v // 2]
    got = spatial.same_cell_pairs(df, "id", "x", "y", 2)
    assert rows(got) == sorted(same)
    assert not inner_broadcasts(got) and most_in_a_task(got) < 0.3


def test_planar_neighbours_by_brute_force(spark):
    rnd = random.Random(7)
    points = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(300)] + [(300 + i, 5.0, 5.0) for i in range(20)] + [(400, 900.0, -900.0)]
    queries = [(i, rnd.uniform(-6, 6), rnd.uniform(-6, 6)) for i in range(25)] + [(90, 5.0, 5.0), (91, -4000.0, 10.0)]
    p, q = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(queries, "query_id long, qx double, qy double")
    got = spatial.knn_places(q, p, 6, "query_id", "id")
    assert "CartesianProduct" not in plan(got)
    want = [(i, r + 1, n) for i, a, b in queries for r, (_, n) in enumerate(sorted(((a - x) * (a - x) + (b - y) * (b - y), n) for n, x, y in points)[:6])]
    assert rows(got.select("query_id", "rank", "id")) == sorted(want)
    few = spatial.knn_places(q, p.where("id < 3"), 6, "query_id", "id")
    assert few.groupBy("query_id").count().where("count <> 3").isEmpty() and few.count() == 3 * len(queries)


def test_planar_neighbours_among_copies(spark, monkeypatch):
    for name, value in (("NEAR_BLOCK", 5), ("NEAR_PAIRS", 100)):
        monkeypatch.setattr(spatial, name, value, raising=False)
    sent, meet = [], spatial._meet
    monkeypatch.setattr(spatial, "_meet", lambda a, b, *rest, **more: sent.append(b) or meet(a, b, *rest, **more))
    rnd = random.Random(13)
    places = [(rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(30)] + [(50.0, 50.0 + i / 100) for i in range(30)]
    points = [(n * 60 + i, x, y) for i, (x, y) in enumerate(places) for n in range(20)]
    queries = [(i, *rnd.choice(places)) for i in range(10)] + [(20 + i, rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for i in range(10)]
    p, q = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(queries, "query_id long, qx double, qy double")
    got = spatial.knn_places(q, p, 6, "query_id", "id")
    want = [(i, r + 1, n) for i, a, b in queries for r, (_, n) in enumerate(sorted(((a - x) * (a - x) + (b - y) * (b - y), n) for n, x, y in points)[:6])]
    assert rows(got.select("query_id", "rank", "id")) == sorted(want)
    assert sent[0].groupBy("level").count().where("count > 6 * 60").isEmpty()
    of = [c for c in sent[0].columns if c != "id"]
    assert sent[0].groupBy(*of).count().where("count > 6").isEmpty()  # of the 20 rows of a place only six go out
    assert not [b for b in inner_broadcasts(got) if "query_id" in b or "_cx" in b]


@pytest.mark.parametrize(("metric", "of"), [("euclidean", lambda d: sum(x * x for x in d) ** 0.5), ("manhattan", sum), ("chebyshev", max), (3, lambda d: sum(x**3 for x in d) ** (1 / 3))])
def test_nearest_vectors_by_brute_force(spark, metric, of):
    rnd = random.Random(9)
    data = [(i, [float(rnd.randrange(6)) for _ in range(3)]) for i in range(120)] + [(500, None)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    got = spatial.knn_vectors(df, df.where("id % 20 = 0"), 4, "id", "v", metric, query_block=3, block=50)
    want = []
    for q in range(0, 120, 20):
        near = sorted((round(of([abs(a - b) for a, b in zip(v, data[q][1], strict=True)]), 9), i) for i, v in data[:-1])[:4]
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert [(q, r, i, round(d, 9)) for q, r, i, d in rows(got)] == want
    with pytest.raises(ValueError):
        spatial.knn_vectors(df, df, 1, "id", "v", 0.5)


def test_boxes_against_frusta_and_boxes(spark):
    planes = [(1, 0, 0, 0), (-1, 0, 0, 10), (0, 1, 0, 0), (0, -1, 0, 10), (0, 0, 1, 0), (0, 0, -1, 10)]
    df = spark.createDataFrame([(0, 1.0), (1, -1.0), (2, 11.0), (3, 10.5), (4, -3.0)], "id long, v double")
    low, high = [F.col("v") - 1] * 3, [F.col("v") + 1] * 3
    assert [i for (i,) in rows(df.where(shapes.box_in_frustum(low, high, planes)).select("id"))] == [0, 1, 2, 3]
    assert [i for (i,) in rows(df.where(shapes.boxes_meet(low, high, [F.lit(0.0)] * 3, [F.lit(1.0)] * 3)).select("id"))] == [0, 1]


# graphs
def test_vertices_are_written_added_and_looked_up(spark):
    v = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "p", 1), (3, "q", 2), (3, "r", 3)], "id long, v string, n long")
    assert rows(graph.upsert_vertices(v, new, ["n"])) == [(1, "a"), (2, "y"), (3, "r")]
    assert rows(graph.add_vertices(v, new, ["n"])) == [(1, "a", 0), (2, "b", 2), (3, "p", 2)]
    assert rows(graph.lookup_vertices(spark.createDataFrame([(2,), (9,)], "id long"), v).select("id", "found", "v")) == [(2, True, "b"), (9, False, None)]


def test_edges_in_both_directions(spark):
    v = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    new = spark.createDataFrame([(1, 2, 5.0), (2, 1, 7.0), (2, 3, 1.0), (3, 9, 1.0)], "src long, dst long, weight double")
    assert rows(graph.add_edges(v, new.limit(0), new, ["weight"], both_ways=True).select("src", "dst", "weight")) == [(1, 2, 5.0), (2, 1, 5.0), (2, 3, 1.0), (3, 2, 1.0)]


def test_paths_by_doubling(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1, 1.0) for i in range(37)] + [(rnd.randrange(38), rnd.randrange(38), float(rnd.randrange(3, 30))) for _ in range(60)]
    best = {0: (0.0, [0])}
    for _ in range(40):
        for a, b, w in edges:
            if a in best and a != b:
                best[b] = min(best.get(b, (9e9, [])), (best[a][0] + w, [*best[a][1], b]), key=lambda x: x[0])
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    for end in (0, 1, 23, 37):
        (got,) = graph.shortest_path(spark, e, 0, end).collect()
        assert got.total_weight == best[end][0] and got.length == len(got.path) and (got.path[0], got.path[-1]) == (0, end)
        assert sum(min(w for a, b, w in edges if (a, b) == step) for step in zip(got.path, got.path[1:], strict=False)) == got.total_weight
    assert graph.shortest_path(spark, e, 37, 900).count() == 0


def test_many_rounds_merge_what_they_changed(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)] + [(0, 15, 30.0)], "src long, dst long, weight double")
    got = graph.distances(e, spark.createDataFrame([(0,)], "id long"))
    assert [(i, d) for _, i, d, _ in rows(got)] == [(i, float(i)) for i in range(21)]


# caches
def test_lru_with_deletes_by_brute_force(spark):
    rnd = random.Random(8)
    log = [(g, n, rnd.choice("abcdef"), rnd.random() < 0.15) for n, g in enumerate(rnd.choices("xyz", k=300))]
    held = std.defaultdict(list)
    for g, _, k, gone in log:
        was = k in held[g]
        if was:
            held[g].remove(k)
        if not gone:
            held[g].append(k)
            held[g][:] = held[g][-3:]
    got = keyed.fifo(spark.createDataFrame(log, "g string, n long, k string, gone boolean"), ["g"], "k", ["n"], 3, F.col("gone"), refresh=True)
    assert rows(got) == sorted((g, i, k) for g, ks in held.items() for i, k in enumerate(ks))
    assert rows(keyed.cache_ends(got, ["g"], "k")) == sorted((g, ks[0], ks[-1]) for g, ks in held.items() if ks)


def test_toggles_and_predicates(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x long, y string")
    t = spark.createDataFrame([(1, "a"), (3, "c"), (2, "b"), (2, "b")], "x long, y string")
    assert rows(collections.toggle(a, t)) == [(2, "b"), (3, "c")]
    assert rows(collections.remove_where(spark.createDataFrame([(1,), (None,), (3,)], "x long"), F.col("x") > 2)) == rows(spark.createDataFrame([(1,), (None,)], "x long"))


# grids
def test_bits_and_cells_are_written(spark):
    g = spark.createDataFrame([(0, 0), (1, 0)], "x int, y int")
    w = spark.createDataFrame([(0, 0, False, 1), (2, 2, True, 1), (1, 0, False, 1), (1, 0, True, 2)], "x int, y int, bit boolean, n int")
    assert rows(grids.write_bits(g, w, ["n"])) == [(1, 0), (2, 2)]
    assert rows(grids.look_up(g, w.select("x", "y").distinct())) == [(0, 0, True), (1, 0, True), (2, 2, False)]
    r = grids.raster(spark, 2, 2, 1, F.lit(7))
    new = spark.createDataFrame([(0, 1, 0, 5, 1), (0, 1, 0, 6, 2)], "layer int, x int, y int, value int, n int")
    assert rows(grids.write_cells(r, new, ["n"])) == [(0, 0, 0, 7), (0, 0, 1, 7), (0, 1, 0, 6), (0, 1, 1, 7)]
    with pytest.raises(Exception, match="beyond the raster"):
        grids.write_cells(r, new.withColumn("x", F.lit(5)), ["n"]).collect()
    assert grids.layer_line(r, 0, row=1).first().cells == [7, 7]


def test_hexagons_are_written_and_cubes_checked(spark):
    m = spark.createDataFrame([(0, 0, 1), (1, 0, 2)], "q int, r int, value int")
    w = spark.createDataFrame([(1, 0, 9, 1), (4, 4, 3, 1)], "q int, r int, value int, n int")
    assert rows(grids.set_hexes(m, w, ["n"])) == [(0, 0, 1), (1, 0, 9), (4, 4, 3)]
    assert rows(grids.fill_hexes(m, hexes.rectangle(0, 1, 0, 1), F.lit(5))) == [(0, 0, 5), (0, 1, 5), (1, 0, 5), (1, 1, 5)]
    assert rows(grids.remove_hexes(m, m.where("q = 1"))) == [(0, 0, 1)]
    bad = spark.createDataFrame([(1, 1, 1)], "x int, y int, z int")
    with pytest.raises(Exception, match="sum to 0"):
        bad.select(hexes.from_cube(F.col("x"), F.col("y"), F.col("z"))).collect()
