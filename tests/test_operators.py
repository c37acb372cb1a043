"""Operators on small inputs with answers worked out by hand or by brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import distance, hexes, shapes
from tessera.operators import collections, graph, grids, keyed, quantiles, sketches, spatial, temporal

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def ordered(got):
    got = list(got)
    try:
        return sorted(got)
    except TypeError:
        return sorted(got, key=repr)


def rows(df):
    return ordered(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# sketches
@QUICK
@given(st.sets(st.integers(-(2**40), 2**40), min_size=50, max_size=200))
def test_bloom_has_no_false_negatives_and_few_false_positives(spark, items):
    bits, k = sketches.bloom_shape(len(items), 0.01)
    inside = spark.createDataFrame([(i,) for i in items], "x long")
    sketch = sketches.bloom(inside, F.col("x"), bits, k)
    assert sketches.bloom_probe(inside, F.col("x"), sketch, bits, k).where("not maybe").isEmpty()
    out = spark.createDataFrame([(i + 2**50,) for i in range(300)], "x long")
    assert sketches.bloom_probe(out, F.col("x"), sketch, bits, k).where("maybe").count() <= 30


@QUICK
@given(st.lists(st.integers(0, 40), min_size=1, max_size=300))
def test_count_min_never_counts_under(spark, items):
    df = spark.createDataFrame([(i,) for i in items], "x long")
    sketch = sketches.count_min(df, F.col("x"), 64, 4)
    exact = df.groupBy("x").agg(F.count("*").alias("n"))
    got = sketches.cms_estimate(exact, F.col("x"), sketch, 64, 4)
    assert got.where("estimate < n").isEmpty()
    assert got.count() == len(set(items))


def test_sketch_shapes():
    assert sketches.bloom_shape(1000, 0.01) == (9586, 7)
    assert sketches.cms_shape(0.001, 0.99) == (4096, 5)
    with pytest.raises(ValueError):
        sketches.bloom_shape(0)


def test_count_min_stats_see_empty_cells(spark):
    sketch = sketches.count_min(spark.createDataFrame([(1,), (1,)], "x int"), F.col("x"), 8, 2)
    assert rows(sketches.cms_stats(spark, sketch, 8, 2).select("low", "high", "mean", "fill")) == [(0, 2, 0.25, 0.125)]
    assert rows(sketches.cms_scale(sketch, 0.5).agg(F.sum("count"))) == [(2,)]


# quantiles and windows
def test_type2_median_of_a_thousand(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    assert df.agg(quantiles.type2("v", 0.5)).first()[0] == 500.5
    assert spark.range(0).select(F.col("id").cast("double").alias("v")).agg(quantiles.type2("v", 0.5)).first()[0] is None


def test_window_keeps_rows_at_its_edge(spark):
    df = spark.createDataFrame([(-200, 10.0), (-150, 20.0), (-100, 50.0), (0, 200.0)], "ms long, v double")
    assert rows(quantiles.in_window(df, F.col("ms"), F.lit(0), 100).select("v")) == [(50.0,), (200.0,)]


def test_cdf_counts_half_of_the_value_itself(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert df.agg(quantiles.cdf("v", 2), quantiles.cdf("v", 0), quantiles.cdf("v", 4)).first() == (0.375, 0.0, 1.0)


def test_weighted_quantile_by_brute_force(spark):
    rnd = random.Random(4)
    data = [("ab"[rnd.randrange(2)], float(rnd.randrange(20)), rnd.randrange(1, 5)) for _ in range(200)]
    got = dict(rows(quantiles.weighted(spark.createDataFrame(data, "k string, v double, w long"), ["k"], "v", "w", 0.7)))
    for k in "ab":
        flat = sorted(v for a, v, w in data if a == k for _ in range(w))
        assert got[k] == next(v for i, v in enumerate(flat, 1) if i >= 0.7 * len(flat))


def test_five_markers_follow_the_median():
    rnd = random.Random(7)
    m = quantiles.Markers(0.5)
    for _ in range(5000):
        m.add(rnd.gauss(10, 2))
    assert abs(m.value() - 10) < 0.2
    few = quantiles.Markers(0.5)
    for x in (3.0, 1.0, 2.0):
        few.add(x)
    assert few.value() == 2.0


# timelines
LOG = [(0, 1, "before"), (500, 2, "during1"), (800, 3, "during2"), (1500, 4, "after")]


def timeline(spark, data=LOG):
    return spark.createDataFrame([("k", *r) for r in data], "k string, ts long, seq long, v string")


def test_as_of_and_its_bounds(spark):
    probes = spark.createDataFrame([("k", t) for t in (-1, 0, 799, 800, 1500, 1501)] + [("other", 5)], "k string, at long")
    got = {(r.k, r.at): r.v for r in temporal.as_of(probes, timeline(spark), ["k"], "at", "ts", ["seq"], ["v"]).collect()}
    assert got == {("k", -1): None, ("k", 0): "before", ("k", 799): "during1", ("k", 800): "during2", ("k", 1500): "after", ("k", 1501): None, ("other", 5): None}


def test_nearest_prefers_the_earlier_of_equals(spark):
    probes = spark.createDataFrame([("k", t) for t in (-9, 250, 651, 9999)], "k string, at long")
    got = {r.at: r.v for r in temporal.nearest(probes, timeline(spark), ["k"], "at", "ts", ["seq"], ["v"]).collect()}
    assert got == {-9: "before", 250: "before", 651: "during2", 9999: "after"}


def test_replay_last_n_and_resample(spark):
    log = timeline(spark)
    assert [r.v for r in temporal.replay(log, F.col("ts"), 400, 1000).orderBy("ts").collect()] == ["during1", "during2"]
    assert rows(temporal.last_n(log, 3, "ts", ["seq"], ["k"]).select("v")) == [("after",), ("during1",), ("during2",)]
    frames = spark.createDataFrame([("k", t, t, str(t)) for t in (0, 500, 1000)], "k string, ts long, seq long, v string")
    assert rows(temporal.resample(frames, ["k"], "ts", ["seq"], ["v"], 2).select("tick", "v")) == [(0, "0"), (500, "500"), (1000, "1000")]
    with pytest.raises(ValueError):
        temporal.resample(frames, ["k"], "ts", ["seq"], ["v"], 2000)


# space
def test_edges_of_boxes_and_rectangles(spark):
    p = spark.createDataFrame([(1, 25.0, 25.0), (2, 75.0, 25.0), (3, 25.0, 75.0), (4, 50.0, 10.0)], "id int, x double, y double")
    assert rows(p.where(shapes.in_half_open(F.col("x"), F.col("y"), 0, 0, 50, 50)).select("id")) == [(1,)]
    r = spark.createDataFrame([("inside", 10.0, 10.0, 20.0, 20.0), ("partial", 15.0, 15.0, 25.0, 25.0), ("outside", 30.0, 30.0, 40.0, 40.0)], "key string, min_x double, min_y double, max_x double, max_y double")
    assert rows(r.where(shapes.intersects(shapes.rect(), (5, 5, 15, 15))).select("key")) == [("inside",), ("partial",)]


def test_joins_by_cells_equal_brute_force(spark):
    rnd = random.Random(1)
    pts = [(i, rnd.uniform(-20, 20), rnd.uniform(-20, 20)) for i in range(150)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    near = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 9}
    got = spatial.close_pairs(df, "id", "x", "y", 3)
    assert set(rows(got)) == near and got.count() == len(near)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    boxes = [(i, x, y, x + rnd.uniform(0, 6), y + rnd.uniform(0, 6)) for i, x, y in pts]
    r = spark.createDataFrame(boxes, "a int, min_x double, min_y double, max_x double, max_y double")
    other = r.withColumnsRenamed({"a": "b"} | {e: f"o_{e}" for e in shapes.EDGES})
    meet = [(p[0], q[0]) for p in boxes for q in boxes if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]]
    assert rows(spatial.rect_join(r, other, 4.0).select("a", "b")) == ordered(meet)


def test_knn_breaks_ties_by_id(spark):
    p = spark.createDataFrame([(i, 10.0 * i, 10.0 * i) for i in range(10)], "id int, x double, y double")
    d = F.sqrt(distance.d2((F.col("x"), F.lit(25)), (F.col("y"), F.lit(25))))
    assert [r.id for r in spatial.nearest(p, 3, d, "id").collect()] == [2, 3, 1]
    assert spatial.nearest(p, 30, d, "id").count() == 10


def test_metrics(spark):
    v = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 6.0, 3.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = v.select(distance.euclidean(a, b), distance.manhattan(a, b), distance.chebyshev(a, b), distance.minkowski(3)(a, b)).first()
    assert [round(x, 9) for x in got] == [5.0, 7.0, 4.0, round((27 + 64) ** (1 / 3), 9)]
    with pytest.raises(ValueError):
        distance.minkowski(0.5)


# graphs
def edges(spark, *e):
    return spark.createDataFrame(list(e), "src string, dst string, weight double")


def test_paths(spark):
    weighted = edges(spark, ("a", "b", 10.0), ("a", "c", 1.0), ("c", "b", 1.0))
    assert rows(graph.shortest_path(spark, weighted, "a", "b")) == [(["a", "c", "b"], 2.0, 3)]
    assert rows(graph.shortest_path(spark, weighted, "a", "b", weighted=False)) == [(["a", "b"], 1.0, 2)]
    assert rows(graph.shortest_path(spark, weighted, "a", "a")) == [(["a"], 0.0, 1)]
    assert rows(graph.shortest_path(spark, weighted, "b", "a")) == []
    chain = edges(spark, ("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 5.0))
    start = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.distances(chain, start, most=2).where("id <> source").select("id")) == [("b",), ("c",)]
    with pytest.raises(Exception, match="negative"):
        graph.distances(edges(spark, ("a", "b", -1.0)), start).collect()


def test_strong_components(spark):
    v = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    e = edges(spark, ("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0))
    assert rows(graph.strong_components(v, e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")]


def test_clustering_counts_a_pair_once(spark):
    e = edges(spark, ("a", "b", 1.0), ("a", "c", 1.0), ("a", "d", 1.0), ("b", "c", 1.0), ("d", "c", 1.0))
    assert dict(rows(graph.clustering(e)))["a"] == pytest.approx(1 / 3)
    assert dict(rows(graph.clustering(e, directed_once=False)))["a"] == pytest.approx(2 / 3)


# grids
def hex_cells(spark, blocked=(), costly=(), reach=4):
    c = [(q, r) for q in range(-reach, reach + 1) for r in range(max(-reach, -q - reach), min(reach, -q + reach) + 1)]
    return spark.createDataFrame([(q, r, dict(costly).get((q, r), 1.0), (q, r) in blocked) for q, r in c], "q int, r int, enter_cost double, blocked boolean")


def test_hex_paths(spark):
    around = grids.hex_path(hex_cells(spark, blocked={(1, 0)}), (0, 0), (3, 0)).collect()
    assert around[-1].cost == 4.0 and (1, 0) not in {(r.q, r.r) for r in around}
    avoided = grids.hex_path(hex_cells(spark, costly={(1, 0): 100.0}.items()), (0, 0), (2, 0)).collect()
    assert (1, 0) not in {(r.q, r.r) for r in avoided} and avoided[-1].cost == 3.0
    ring = {(3 + a, b) for a, b in hexes.DIRECTIONS}
    assert grids.hex_path(hex_cells(spark, blocked=ring), (0, 0), (3, 0)).isEmpty()


def test_hex_shapes(spark):
    one = spark.range(1)
    n = one.select(F.size(hexes.disc(F.lit(0), F.lit(0), 3)), F.size(hexes.ring(F.lit(2), F.lit(-1), 3)), F.size(hexes.line(F.lit(0), F.lit(0), F.lit(3), F.lit(-1)))).first()
    assert tuple(n) == (37, 18, 4)


def test_bit_grid_words(spark):
    g = spark.createDataFrame([(0, 0), (1, 0), (63, 1)], "x int, y int")
    assert grids.words(g, 64).agg(F.sum(F.bit_count("mask"))).first()[0] == 3
    assert rows(grids.bit_xor(g, g)) == []
    assert rows(grids.fill(g, 64, 64, 62, 0, 10, 1)) == [(0, 0), (1, 0), (62, 0), (63, 0), (63, 1)]


# caches
def test_fifo_keeps_the_place_of_held_keys(spark):
    rnd = random.Random(2)
    log = [("g" + str(rnd.randrange(3)), i, rnd.randrange(8)) for i in range(300)]
    got = keyed.fifo(spark.createDataFrame(log, "g string, seq int, k int"), ["g"], "k", ["seq"], 3)
    want = []
    for g in ("g0", "g1", "g2"):
        held = []
        for a, _, k in log:
            if a == g and k not in held:
                held = [*held, k][-3:]
        want += [(g, i, k) for i, k in enumerate(held)]
    assert rows(got) == ordered(want)


def test_counters_and_multimaps(spark):
    log = spark.createDataFrame([(i, k) for i, k in enumerate(["low", "high", "medium", "high", "high", "medium"])], "seq int, k string")
    c = keyed.counters(log, "k", ["seq"])
    assert [(r.k, r.n) for r in keyed.most_frequent(c, "k", ["seq"], 3).collect()] == [("high", 3), ("medium", 2), ("low", 1)]
    m = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 5), ("b", 4, 1)], "k string, seq int, v int")
    assert dict(rows(keyed.multimap(m, "k", "v", ["seq"]))) == {"a": [5, 6, 5], "b": [1]}
    assert dict(rows(keyed.multimap(m, "k", "v", ["seq"], duplicates=False))) == {"a": [5, 6], "b": [1]}
    assert rows(keyed.remove_first(m, spark.createDataFrame([("a", 5)], "k string, v int"), "k", "v", ["seq"])) == [("a", 2, 6), ("a", 3, 5), ("b", 4, 1)]


# sets and feeds
@QUICK
@given(st.sets(st.integers(0, 6)), st.sets(st.integers(0, 6)))
def test_set_predicates(spark, a, b):
    x, y = (spark.createDataFrame([(i,) for i in s], "x int") for s in (a, b))
    assert tuple(collections.predicates(x, y).first()) == (a <= b, a >= b, a < b, a > b, bool(a & b), a == b)
    assert {r.x for r in collections.symmetric_difference(x, y).collect()} == a ^ b


def test_changes_after_a_reset(spark):
    log = spark.createDataFrame([(1, "Add", "x"), (2, "Add", "y"), (3, "Reset", None), (4, "Add", "y"), (5, "Add", "z"), (6, "Remove", "z")], "version long, action string, item string")
    assert rows(collections.apply_changes(log, "item", "version")) == [("y", 4)]


def test_array_edits(spark):
    a = spark.createDataFrame([([1, 2, 3],)], "v array<int>")
    got = a.select(collections.insert_at(F.col("v"), 1, F.lit(9)), collections.remove_at(F.col("v"), 0), collections.swap_remove(F.col("v"), 0)).first()
    assert [list(x) for x in got] == [[1, 9, 2, 3], [2, 3], [3, 2]]


def test_rounds_that_do_not_suffice_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)], "src long, dst long, weight double")
    start = spark.range(1)
    with pytest.raises(RuntimeError, match="2 rounds"):
        graph.distances(chain, start, max_rounds=2)
    assert graph.distances(chain, start, max_rounds=5).count() == graph.distances(chain, start).count() == 5
    line = spark.createDataFrame([(i, 0, 1.0, False) for i in range(5)], "q int, r int, enter_cost double, blocked boolean")
    with pytest.raises(RuntimeError, match="2 rounds"):
        grids.hex_costs(line, (0, 0), max_rounds=2)
    assert grids.hex_costs(line, (0, 0)).count() == 5


def test_streams_count_late_files(spark, tmp_path):
    """Files out of time order, one or three a batch: as if all were one."""
    from tessera.streaming import feeds

    hours = [40, 3, 2000, 0, 41, 7, 2001, 3, 900, 40]
    spark.sql("SET spark.sql.shuffle.partitions=2")
    for n, h in enumerate(hours):  # files are read by age: the first hours come after the last
        part = spark.sql(f"SELECT {n} * 30 + id AS event_id, id % 3 AS kind, (id * 7 + {h}) % 11 AS user, 1.0D AS value, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, {h}, CAST(id AS INT)) AS ts FROM range(30)")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log.parquet")
    whole = spark.read.parquet(f"{tmp_path}/log.parquet")
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) * 3600000000")
    sums = whole.groupBy("kind", hour.alias("start_us")).agg(F.count("*"), F.sum("value"))
    order = ["ts", "event_id"]
    for files in (1, 3):
        assert rows(feeds.tumbling(spark, str(tmp_path), "log", "ts", "1 hour", ["kind"], "value", files_per_batch=files)) == rows(sums)
        assert rows(feeds.deduplicated(spark, str(tmp_path), "log", "ts", ["user", "kind"], files_per_batch=files)) == rows(whole.select("user", "kind").distinct())
        assert rows(feeds.fifo(spark, str(tmp_path), "log", "kind", "user", order, 3, files_per_batch=files)) == rows(keyed.fifo(whole, ["kind"], "user", order, 3))
    spark.sql("SET spark.sql.shuffle.partitions=4")


def test_filters_and_columns_reach_the_scan(spark):
    from tessera.sources.tables import load

    got = spatial.within_radius(load(spark, "/root/testdata/sf0.001", "lineitem").select("l_quantity", "l_discount"), "l_quantity", "l_discount", 10, 0, 3).select("l_quantity", "l_discount")
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in text and "l_extendedprice" not in text
