"""Directed graphs as two tables, vertices(id, ...) and edges(src, dst, weight, ...).

Traversals grow a frontier round by round; each round is one join and one aggregation, and its result is checkpointed (to the
shared folder of the session), which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import tempfile
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    done = df.checkpoint()
    return done.select(*[F.col(c).alias(c) for c in done.columns])  # fresh attributes: the old ones' constraints may not fit a union


def add_edges(vertices: DataFrame, edges: DataFrame, new: DataFrame, order: list[str], both_ways: bool = False) -> DataFrame:
    """Edges with the new ones whose endpoints exist; of one (src, dst) the first stays."""
    if both_ways:
        back = new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in new.columns if c not in ("src", "dst")])
        new = new.unionByName(back)
    ids = vertices.select("id")
    ok = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ok = ok.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    rest = [c for c in new.columns if c not in ("src", "dst")]
    first = ok.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_e"))
    return edges.unionByName(first.select("src", "dst", *[F.col(f"_e.{c}") for c in rest]).select(edges.columns))


def remove_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without some vertices and the edges that touch them. gone: id."""
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return vertices.join(gone, "id", "left_anti"), left.select(edges.columns)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those listed. gone: src, dst."""
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti").select(edges.columns)


def neighbours(edges: DataFrame, vertex: Column) -> DataFrame:
    """Out-edges of a vertex."""
    return edges.where(F.col("src") == vertex)


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Every vertex with its out- and in-degree."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return vertices.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0, ["out_degree", "in_degree"])


def statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, mean, most and least out-degree, density."""
    got = degrees(vertices, edges).agg(F.count("*").alias("vertices"), F.sum("out_degree").alias("edges"), F.avg("out_degree").alias("mean_degree"), F.max("out_degree").alias("max_degree"), F.min("out_degree").alias("min_degree"))
    n = F.col("vertices")
    return got.withColumn("density", F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0))


def distances(edges: DataFrame, sources: DataFrame, weighted: bool = True, most: float | None = None, target: Column | None = None, max_rounds: int | None = None) -> DataFrame:
    """Least distance from each source to each vertex it reaches: source, id, distance, via (the vertex before, the smallest of equals).

    sources: id. Rounds relax only from vertices whose distance fell. Weights have to be non-negative; ``most`` bounds the
    distance; unweighted edges count 1. With a ``target``, for one source, the rounds end when nothing on the frontier is nearer than it.
    Rounds go on until the frontier is empty; if ``max_rounds`` end with a frontier left, that is an error.
    """
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    if weighted:
        w = F.when(F.assert_true(F.col("weight") >= 0, "weights must not be negative").isNull(), w)
    steps = _cut(edges.where("src <> dst").groupBy("src", "dst").agg(F.min(w).alias("w")))  # each round reads it
    empty = F.lit(None).cast(steps.schema["src"].dataType)
    at = ["source", "id"]
    base = _cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance"), empty.alias("via")))
    frontier, changed = base, []
    found = None if target is None else base.where(F.col("id") == target).agg(F.min("distance")).first()[0]

    def merged(parts: list[DataFrame]) -> DataFrame:
        """The best known of each vertex: the least distance, of equals the smallest vertex before it."""
        both = reduce(DataFrame.unionByName, parts).groupBy(*at).agg(F.min(F.struct("distance", "via")).alias("n"))
        return both.select(*at, "n.distance", "n.via")

    for _ in count() if max_rounds is None else range(max_rounds):
        reach = frontier.join(steps, frontier["id"] == steps["src"]).select("source", F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("distance"), F.col("src").alias("via"))
        if most is not None:
            reach = reach.where(F.col("distance") <= most)
        best = reach.groupBy(*at).agg(F.min(F.struct("distance", "via")).alias("n"))
        # A round writes what it changed; the changes are merged into what was known every few rounds.
        got = best.join(base.select(*at, F.struct("distance", "via").alias("k0")), at, "left")
        if changed:  # a change is always for the better
            got = got.join(merged(changed).select(*at, F.struct("distance", "via").alias("k1")), at, "left")
        got = got.withColumn("k", F.coalesce("k1", "k0") if changed else F.col("k0"))
        nearer = F.col("k").isNull() | (F.col("n.distance") < F.col("k.distance"))
        tie = (F.col("n.distance") == F.col("k.distance")) & (F.col("n.via") < F.col("k.via"))
        delta = _cut(got.where(nearer | tie).select(*at, "n.distance", "n.via", nearer.alias("_new")))
        changed.append(delta.drop("_new"))
        frontier = delta.where("_new").drop("_new")
        if len(changed) == 8:
            base, changed = _cut(merged([base, *changed])), []
        if target is not None:
            here = delta.where(F.col("id") == target).agg(F.min("distance")).first()[0]
            found = here if found is None or here is not None and here < found else found
            if found is not None and frontier.where(F.col("distance") < found).isEmpty():
                break
        if frontier.isEmpty():
            break
    else:
        raise RuntimeError(f"vertices are left to relax after {max_rounds} rounds")
    return merged([base, *changed]) if changed else base


def shortest_path(spark: SparkSession, edges: DataFrame, start, end, weighted: bool = True) -> DataFrame:
    """One row path, total_weight, length (vertices); none where there is no path.

    The way back is found by pointer doubling: after k rounds every vertex of the tree knows the one 2^k steps before it, and
    the vertices already known to lie on the path give twice as many. Only the path itself comes to the driver.
    """
    kind = edges.schema["src"].dataType.simpleString()
    sources = spark.range(1).select(F.lit(start).cast(kind).alias("id"))
    tree = distances(edges, sources, weighted, target=F.lit(end))
    jump = tree.select("id", F.col("via").alias("back"))
    on_path = tree.where(F.col("id") == F.lit(end)).select("id", F.lit(0).alias("steps"))
    far = 1
    while True:
        more = on_path.join(jump, "id").where("back is not null").select(F.col("back").alias("id"), (F.col("steps") + far).alias("steps"))
        if more.isEmpty():
            break
        on_path = _cut(on_path.unionByName(more))
        jump = _cut(jump.alias("a").join(jump.alias("b"), F.col("a.back") == F.col("b.id")).select("a.id", "b.back").where("back is not null"))
        far *= 2
    rows = on_path.join(tree.select("id", "distance"), "id").orderBy(F.desc("steps")).collect()  # the path
    if not rows:
        return spark.createDataFrame([], f"path array<{kind}>, total_weight double, length int")
    return spark.createDataFrame([([r.id for r in rows], rows[-1].distance, len(rows))], f"path array<{kind}>, total_weight double, length int")


def clustering(edges: DataFrame, directed_once: bool = True) -> DataFrame:
    """Clustering coefficient of every vertex with out-edges: linked pairs of its out-neighbours over all pairs.

    A pair a < b counts if a has an edge to b; with ``directed_once`` off, in either direction. Fewer than two neighbours: 0.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    k = e.groupBy("src").agg(F.count("*").alias("k"))
    a, b = e.select(F.col("src").alias("id"), F.col("dst").alias("a")), e.select(F.col("src").alias("id"), F.col("dst").alias("b"))
    ends = e if directed_once else e.union(e.select("dst", "src")).distinct()
    # Wedges meet the edges that close them: pairs are not made where no edge joins them.
    closed = ends.where("src < dst").join(a, F.col("src") == F.col("a")).join(b, (F.col("dst") == F.col("b")) & (a["id"] == b["id"])).groupBy(a["id"].alias("src")).agg(F.count("*").alias("t"))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    return k.join(closed, "src", "left").select(F.col("src").alias("id"), F.when(F.col("k") < 2, 0.0).otherwise(F.coalesce("t", F.lit(0)) / pairs).alias("coefficient"))


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Least label that reaches each vertex along the edges, to the fixed point. label: id, label."""
    now = _cut(label)
    frontier = now
    while True:
        got = frontier.join(edges, frontier["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("_l"))
        merged = now.join(got, "id", "left").select("id", F.least("label", F.coalesce("_l", "label")).alias("label"), (F.col("_l") < F.col("label")).alias("_new"))
        merged = _cut(merged)
        now, frontier = merged.drop("_new"), merged.where("_new").drop("_new")
        if frontier.isEmpty():
            return now


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its least id). Forward colouring by least label, backward reach inside a colour, rest again.

    Vertices without in- or out-edges among those left are components of their own and are set aside first, so that the
    acyclic part, however long, takes no rounds of its own colour.
    """
    left = vertices.select("id").distinct()
    e = edges.select("src", "dst").where("src <> dst").distinct()
    done = None
    while True:
        while True:  # trim
            live = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
            alone = _cut(left.join(live, "id", "left_anti"))
            if alone.isEmpty():
                break
            one = alone.select("id", F.col("id").alias("component"))
            done = one if done is None else done.unionByName(one)
            left = _cut(left.join(alone, "id", "left_anti"))
            e = _cut(e.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
        if left.isEmpty():
            return done if done is not None else vertices.select("id", F.col("id").alias("component")).limit(0)
        colour = _spread(e, left.select("id", F.col("id").alias("label")))
        # Edges inside a colour, backwards, from the vertex that gave the colour.
        s, d = colour.withColumnsRenamed({"id": "src", "label": "ls"}), colour.withColumnsRenamed({"id": "dst", "label": "ld"})
        inner = _cut(e.join(s, "src").join(d, "dst").where("ls = ld").select(F.col("dst").alias("at"), F.col("src").alias("before"), F.col("ls").alias("own")))
        reach = _cut(colour.where("id = label").select("id", "label"))
        frontier = reach
        while True:
            new = frontier.join(inner, F.expr("id = at AND label = own")).select(F.col("before").alias("id"), "label").distinct()
            frontier = _cut(new.join(reach, "id", "left_anti"))
            if frontier.isEmpty():
                break
            reach = _cut(reach.unionByName(frontier))
        one = reach.select("id", F.col("label").alias("component"))
        done = one if done is None else done.unionByName(one)
        left = _cut(left.join(reach, "id", "left_anti"))
        if left.isEmpty():
            return done
        e = _cut(e.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))


def transitions(log: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Edges between consecutive states of a key: src, dst, weight (how often)."""
    by = Window.partitionBy(key).orderBy(*order)
    pairs = log.select(F.col(state).alias("src"), F.lead(state).over(by).alias("dst")).where("dst is not null")
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def upsert_vertices(vertices: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Vertices (id, value columns) after writes: of an id the last write wins, in ``order``; new ids enter."""
    rest = [c for c in vertices.columns if c != "id"]
    last = new.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_new"))
    both = vertices.select("id", F.struct(*rest).alias("_old")).join(last, "id", "full")
    return both.select("id", F.coalesce("_new", "_old").alias("_v")).select("id", *[F.col(f"_v.{c}") for c in rest])


def add_vertices(vertices: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Vertices with new ones added: those whose id is there already are refused, and of new ones of an id all but the first.

    Adds ``refused``, the number of refused rows of the id.
    """
    rest = [c for c in vertices.columns if c != "id"]
    first = new.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_new"), F.count("*").alias("_n"))
    both = vertices.select("id", F.struct(*rest).alias("_old")).join(first, "id", "full")
    refused = F.coalesce(F.col("_n") - F.when(F.col("_old").isNull(), 1).otherwise(0), F.lit(0))
    return both.select("id", F.coalesce("_old", "_new").alias("_v"), refused.alias("refused")).select("id", *[F.col(f"_v.{c}") for c in rest], "refused")


def lookup_vertices(probes: DataFrame, vertices: DataFrame) -> DataFrame:
    """``probes`` (id) with ``found`` and the vertex's columns."""
    return probes.join(vertices.withColumn("found", F.lit(True)), "id", "left").na.fill(False, ["found"])
