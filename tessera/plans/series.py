"""Queries on windows, quantiles, timelines and moving objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.distance import d2, to_segment2
from tessera.operators import quantiles, spatial, temporal
from tessera.plans.registry import query
from tessera.sources.tables import load, micros, millis

DAY = 86_400_000_000


def events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.withColumns({"us": micros(F.col("ts")), "ms": millis(F.col("ts"))})


def moving(spark: SparkSession, d: str) -> DataFrame:
    """Users as moving objects: us, event_id, obj, x, y."""
    e = events(spark, d)
    return e.select("us", "event_id", F.col("user_id").alias("obj"), F.col("value").alias("x"), (F.col("event_id") % 1000).cast("double").alias("y"))


_E = "(SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms FROM events)"
_M = "(SELECT epoch_us(ts) AS us, event_id, user_id AS obj, value AS x, CAST(event_id % 1000 AS DOUBLE) AS y FROM events)"
_QS = ", ".join(f"quantile_disc(value, {q}) AS {n}" for n, q in quantiles.SUMMARY.items())


@query(f"""SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, {_QS}, round(count(value) / 604800.0, 9) AS rate_per_second
    FROM {_E} WHERE us >= (SELECT max(epoch_us(ts)) FROM events) - {7 * DAY} GROUP BY event_type""")
def window_analytics(spark, d):
    e = events(spark, d)
    now = e.agg(F.max("us").alias("now"))
    live = quantiles.in_window(e.join(F.broadcast(now)), F.col("us"), F.col("now"), 7 * DAY)
    out = quantiles.summary(live, ["event_type"], "value", 7 * 86_400_000)
    return out.withColumn("rate_per_second", F.round("rate_per_second", 9))


@query("""SELECT event_id, user_id, quantile_disc(value, 0.95) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS p95 FROM events""")
def rolling_percentile_1h(spark, d):
    return quantiles.rolling(events(spark, d), ["user_id"], F.col("us"), "value", 0.95, 3_600_000_000, "p95").select("event_id", "user_id", "p95")


@query(f"""SELECT event_type, count(*) AS n, round(count(*) / 604800.0, 9) AS per_second, round(count(*) / 10080.0, 9) AS per_minute, round(count(*) / 168.0, 9) AS per_hour
    FROM {_E} WHERE us >= (SELECT max(epoch_us(ts)) FROM events) - {7 * DAY} GROUP BY event_type""")
def rate_analytics(spark, d):
    e = events(spark, d)
    live = quantiles.in_window(e.join(F.broadcast(e.agg(F.max("us").alias("now")))), F.col("us"), F.col("now"), 7 * DAY)
    n = F.count("*")
    return live.groupBy("event_type").agg(n.alias("n"), *[F.round(n / s, 9).alias(c) for c, s in (("per_second", 604800.0), ("per_minute", 10080.0), ("per_hour", 168.0))])


@query("""SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n, min(value) AS low, max(value) AS high, quantile_disc(value, 0.5) AS p50, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def tumbling_window_stats(spark, d):
    e = events(spark, d).withColumn("hour", F.expr("us div 3600000000"))
    plain = [F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean")]
    return quantiles.exact(e, ["hour", "event_type"], "value", {"p50": 0.5}, plain)


@query("""WITH h AS (SELECT unnest([epoch_us(ts) // 3600000000, epoch_us(ts) // 3600000000 - 1]) AS hour, value FROM events)
    SELECT hour, count(*) AS n, quantile_disc(value, 0.9) AS p90 FROM h GROUP BY hour""")
def sliding_window_stats(spark, d):
    """Windows of two hours that begin every hour, named by the hour in which they begin."""
    at = F.expr("us div 3600000000")
    rows = events(spark, d).select(F.explode(F.array(at, at - 1)).alias("hour"), "value")
    return quantiles.exact(rows, ["hour"], "value", {"p90": 0.9}, [F.count("*").alias("n")])


@query("""WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY user_id, session""")
def session_gap_stats(spark, d):
    s = quantiles.sessions(events(spark, d), ["user_id"], F.col("us"), 1_800_000_000, ["event_id"])
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("""SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.95) > 50 AS p95_above, quantile_disc(value, 0.99) > 200 AS p99_above FROM events GROUP BY event_type""")
def threshold_alerts(spark, d):
    out = quantiles.exact(events(spark, d), ["event_type"], "value", {"p95": 0.95, "p99": 0.99})
    return out.withColumns({"p95_above": F.col("p95") > 50, "p99_above": F.col("p99") > 200})


@query("""SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS high, quantile_disc(value, 0.5) AS median, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def dps_analytics(spark, d):
    """The mean beside the median that goes by the name of an average elsewhere."""
    plain = [F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean")]
    return quantiles.exact(events(spark, d), ["event_type"], "value", {"p95": 0.95, "p99": 0.99, "median": 0.5}, plain)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, round(avg(CASE WHEN i IN (CAST(ceil(n * 0.5) AS BIGINT), CAST(floor(n * 0.5) AS BIGINT) + 1) THEN value END), 9) AS median,
           round(avg(CASE WHEN i IN (CAST(ceil(n * 0.75) AS BIGINT), CAST(floor(n * 0.75) AS BIGINT) + 1) THEN value END), 9) AS upper FROM r GROUP BY event_type""")
def quantile_type2(spark, d):
    got = quantiles.exact_type2(events(spark, d), ["event_type"], "value", {"median": 0.5, "upper": 0.75})
    return got.select("event_type", F.round("median", 9).alias("median"), F.round("upper", 9).alias("upper"))


@query("""WITH w AS (SELECT l_returnflag, l_extendedprice AS v, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY ALL),
    c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM w)
    SELECT l_returnflag, min(v) AS quantile FROM c WHERE cum >= 0.9 * total GROUP BY l_returnflag""")
def weighted_quantile(spark, d):
    li = load(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", F.col("l_quantity").cast("long").alias("w"))
    return quantiles.weighted(li, ["l_returnflag"], "l_extendedprice", "w", 0.9)


@query("""SELECT event_type, round((count(*) FILTER (value < 50) + 0.5 * count(*) FILTER (value = 50)) / count(value), 9) AS share FROM events GROUP BY event_type""")
def cdf_at(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.round(quantiles.cdf("value", 50), 9).alias("share"))


@query("""SELECT event_type, TRUE AS within_bound FROM events GROUP BY event_type""")
def quantile_sketch_bound(spark, d):
    """The approximate 95th percentile lies between the exact 94th and 96th."""
    g = events(spark, d).groupBy("event_type").agg(quantiles.approximate("value", [0.95]).alias("a"), quantiles.disc("value", 0.94).alias("lo"), quantiles.disc("value", 0.96).alias("hi"))
    return g.select("event_type", F.col("a")[0].between(F.col("lo"), F.col("hi")).alias("within_bound"))


@query("""SELECT event_type, TRUE AS within_bound FROM events GROUP BY event_type""")
def kll_quantile_bound(spark, d):
    """A KLL sketch's median, merged from sketches by user, lies between the exact 45th and 55th percentiles."""
    e = events(spark, d)
    parts = e.groupBy("event_type", "user_id").agg(F.expr("kll_sketch_agg_double(value)").alias("s"))
    merged = parts.groupBy("event_type").agg(F.expr("kll_merge_agg_double(s)").alias("s"))
    exact = e.groupBy("event_type").agg(quantiles.disc("value", 0.45).alias("lo"), quantiles.disc("value", 0.55).alias("hi"))
    return merged.join(exact, "event_type").select("event_type", F.expr("kll_sketch_get_quantile_double(s, 0.5D)").between(F.col("lo"), F.col("hi")).alias("within_bound"))


_PROBES = "(SELECT DISTINCT p.event_type, g.at FROM events p CROSS JOIN (SELECT unnest(range(1704067200000000, 1706659200000001, 43200000000)) AS at) g)"


def _probes(spark, d):
    at = spark.range(1).select(F.explode(F.sequence(F.lit(1704067200000000), F.lit(1706659200000000), F.lit(43200000000))).alias("at"))
    return events(spark, d).select("event_type").distinct().crossJoin(F.broadcast(at))


@query(f"""SELECT p.event_type, p.at, CASE WHEN p.at <= e.last THEN f.us END AS found_ts, CASE WHEN p.at <= e.last THEN f.event_id END AS event_id, CASE WHEN p.at <= e.last THEN f.value END AS value
    FROM {_PROBES} p ASOF LEFT JOIN {_E} f ON p.event_type = f.event_type AND p.at >= f.us
    JOIN (SELECT event_type, max(epoch_us(ts)) AS last FROM events GROUP BY event_type) e ON e.event_type = p.event_type""")
def asof_lookup(spark, d):
    return temporal.as_of(_probes(spark, d), events(spark, d), ["event_type"], "at", "us", ["event_id"], ["event_id", "value"])


@query(f"""SELECT p.event_type, p.at, arg_min(f.us, [abs(f.us - p.at), f.us, f.event_id]) AS found_ts, arg_min(f.event_id, [abs(f.us - p.at), f.us, f.event_id]) AS event_id
    FROM {_PROBES} p JOIN {_E} f ON p.event_type = f.event_type GROUP BY p.event_type, p.at""")
def nearest_snapshot(spark, d):
    return temporal.nearest(_probes(spark, d), events(spark, d), ["event_type"], "at", "us", ["event_id"], ["event_id"]).select("event_type", "at", "found_ts", "event_id")


@query("""SELECT event_id, user_id, epoch_us(ts) AS us, value FROM events WHERE epoch_us(ts) BETWEEN 1704499200000000 AND 1705104000000000""")
def replay_range(spark, d):
    return temporal.replay(events(spark, d), F.col("us"), 1704499200000000, 1705104000000000).select("event_id", "user_id", "us", "value")


_RES = "(SELECT event_type, event_id, value, epoch_us(ts) // 1000000 AS sec FROM events)"


@query(f"""WITH s AS (SELECT event_type, min(sec) AS a, max(sec) AS b FROM {_RES} GROUP BY event_type), t AS (SELECT event_type, unnest(range(a, b + 1, 1000)) AS tick FROM s),
    l AS (SELECT event_type, sec, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM {_RES} GROUP BY event_type, sec)
    SELECT t.event_type, t.tick, l.sec AS found_ts, l.value FROM t ASOF JOIN l ON t.event_type = l.event_type AND t.tick >= l.sec""")
def resample_fps(spark, d):
    """One frame a thousand units: the log's seconds stand for the operator's milliseconds."""
    e = events(spark, d).select("event_type", "event_id", "value", F.expr("us div 1000000").alias("sec"))
    return temporal.resample(e, ["event_type"], "sec", ["event_id"], ["value"], 1).select("event_type", "tick", "found_ts", "value")


@query("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""")
def timeline_last_n(spark, d):
    return temporal.last_n(events(spark, d), 3, "us", ["event_id"], ["user_id"]).select("user_id", "event_id", "value")


@query("""SELECT event_id, user_id, epoch_us(ts) AS us FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def timeline_ring(spark, d):
    return temporal.last_n(events(spark, d), 100, "us", ["event_id"]).select("event_id", "user_id", "us")


@query("""SELECT event_id, lag(event_id) OVER w AS previous_frame, lead(event_id) OVER w AS next_frame FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def timeline_step(spark, d):
    return temporal.steps(events(spark, d), ["user_id"], "us", ["event_id"], "event_id").select("event_id", "previous_frame", "next_frame")


@query("""SELECT user_id, count(*) AS frames, min(epoch_us(ts)) AS start_ts, max(epoch_us(ts)) AS end_ts, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration,
    CASE WHEN count(*) > 1 THEN round((max(epoch_us(ts)) - min(epoch_us(ts))) / (count(*) - 1), 3) END AS mean_frame FROM events GROUP BY user_id""")
def timeline_stats(spark, d):
    return temporal.stats(events(spark, d), ["user_id"], "us").withColumn("mean_frame", F.round("mean_frame", 3))


@query(f"""SELECT us, event_id, x, y FROM {_M} WHERE obj = 7 AND us BETWEEN 1704499200000000 AND 1705708800000000""")
def trajectory(spark, d):
    return temporal.replay(moving(spark, d).where("obj = 7"), F.col("us"), 1704499200000000, 1705708800000000).select("us", "event_id", "x", "y")


# Whole states at the end of each day: an object that does not move is still there.
_TICKS = f"(SELECT unnest(range(CAST(ceil(a / {DAY}.0) AS BIGINT) * {DAY}, CAST(ceil(b / {DAY}.0) AS BIGINT) * {DAY} + 1, {DAY})) AS tick FROM (SELECT min(us) AS a, max(us) AS b FROM {_M}))"
_SNAP = f"(SELECT t.tick, m.obj, arg_max(m.x, [m.us, m.event_id]) AS x, arg_max(m.y, [m.us, m.event_id]) AS y, arg_max(m.event_id, [m.us, m.event_id]) AS e FROM {_TICKS} t JOIN {_M} m ON m.us <= t.tick GROUP BY t.tick, m.obj)"


def _snapshots(spark, d, removals=False):
    return temporal.snapshots(moving(spark, d), "obj", "us", ["event_id"], ["x", "y"], DAY, (F.col("event_id") % 7 == 0) if removals else None)


@query(f"SELECT tick, obj, x, y FROM {_SNAP}")
def state_at_tick(spark, d):
    return temporal.state_at_ticks(moving(spark, d), "obj", "us", ["event_id"], ["x", "y"], DAY)


@query(f"SELECT tick, obj, x, y FROM {_SNAP} WHERE e % 7 <> 0")
def snapshots_with_removals(spark, d):
    """An object whose last row before a tick removed it is missing there, and back with its next row."""
    return _snapshots(spark, d, True)


@query(f"SELECT obj, x, y FROM {_SNAP} WHERE tick = (SELECT max(tick) FROM {_TICKS} WHERE tick <= 1705190000000000)")
def state_at_time(spark, d):
    return temporal.snapshot_at(_snapshots(spark, d), 1705190000000000).select("obj", "x", "y")


@query(f"SELECT tick, obj, x, y FROM {_SNAP} WHERE tick BETWEEN 1704499200000000 AND 1705104000000000")
def snapshot_history(spark, d):
    return temporal.replay(_snapshots(spark, d), F.col("tick"), 1704499200000000, 1705104000000000)


@query(f"SELECT tick, count(*) AS objects, lag(tick) OVER (ORDER BY tick) AS previous, lead(tick) OVER (ORDER BY tick) AS next FROM {_SNAP} GROUP BY tick")
def snapshot_steps(spark, d):
    return temporal.snapshot_steps(_snapshots(spark, d))


@query(f"SELECT tick, count(*) AS objects FROM {_SNAP} WHERE tick >= (SELECT max(tick) FROM {_TICKS}) - {10 * DAY} GROUP BY tick")
def snapshot_retention(spark, d):
    """Snapshots of a cadence of one day, kept for ten."""
    s = _snapshots(spark, d)
    now = s.agg(F.max("tick").alias("now"))
    return temporal.retained(s.join(F.broadcast(now)), F.col("tick"), F.col("now"), 10 * DAY).groupBy("tick").agg(F.count("*").alias("objects"))


_NEAR = 1705150000000000


@query(f"SELECT tick, obj, x, y FROM {_SNAP} WHERE tick = (SELECT arg_min(tick, [abs(tick - {_NEAR}), tick]) FROM {_TICKS}) AND x * x + (y - 400) * (y - 400) <= 90000")
def radius_at_nearest_snapshot(spark, d):
    return spatial.within_radius(temporal.snapshot_at(_snapshots(spark, d), _NEAR, closest=True), "x", "y", 0, 400, 300)


@query(f"""SELECT CAST(floor(x / 20) AS BIGINT) AS cx, CAST(floor(y / 20) AS BIGINT) AS cy, count(*) AS n FROM {_SNAP}
    WHERE tick BETWEEN 1704499200000000 AND 1705708800000000 AND x BETWEEN 0 AND 100 AND y BETWEEN 100 AND 700 GROUP BY ALL""")
def heat_map_span(spark, d):
    """How often objects stood in each cell of a box, over the snapshots of a span."""
    s = temporal.replay(_snapshots(spark, d), F.col("tick"), 1704499200000000, 1705708800000000)
    return temporal.heat_map(s, "x", "y", 20, (0, 100, 100, 700))


_JUMPS = [0, 90_000_000_000, 600_000_000_000, -7_200_000_000, 90 * DAY]
_CURSORS = f"(SELECT event_type, a, s.jump, a + s.jump AS at FROM (SELECT event_type, min(epoch_us(ts)) + {DAY} AS a FROM events GROUP BY event_type), (SELECT unnest({_JUMPS}) AS jump) s)"


@query(f"""SELECT c.event_type, c.jump, c.at BETWEEN min(e.us) AND max(e.us) AS ok, CASE WHEN ok THEN count(*) FILTER (e.us <= c.at) - 1 END AS position,
    CASE WHEN ok THEN arg_max(e.event_id, [e.us, e.event_id]) FILTER (e.us <= c.at) END AS event_id
    FROM {_CURSORS} c JOIN {_E} e ON e.event_type = c.event_type GROUP BY c.event_type, c.jump, c.at""")
def timeline_seek(spark, d):
    """A cursor a day into each timeline rewinds there and jumps forward and back; outside it stays where it is."""
    e = events(spark, d)
    start = e.groupBy("event_type").agg((F.min("us") + DAY).alias("a"))
    c = start.select("event_type", F.explode(F.array(*[F.lit(j).cast("long") for j in _JUMPS])).alias("jump"), "a").withColumn("at", F.col("a") + F.col("jump"))
    return temporal.seek(e, ["event_type"], "us", ["event_id"], c, "at", ["event_id"]).select("event_type", "jump", "ok", "position", "event_id")


@query(f"""SELECT CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 5 / 10) AS BIGINT) AS cy, count(*) AS n FROM (SELECT x, y FROM {_M}) GROUP BY ALL""")
def heat_map(spark, d):
    return temporal.heat_map(moving(spark, d).withColumn("y", F.col("y") / 5), "x", "y", 10)


_O2 = "[us, event_id]"
_LAST = f"(SELECT obj, max(us) AS us, arg_max(x, {_O2}) AS x, arg_max(y, {_O2}) AS y FROM {_M} GROUP BY obj)"


def _state(spark, d, upto=None):
    return temporal.latest(moving(spark, d), "obj", "us", ["event_id"], ["x", "y"], upto)


@query(f"""SELECT obj, x, y FROM {_LAST} WHERE x * x + (y - 400) * (y - 400) <= 40000""")
def live_radius(spark, d):
    return spatial.within_radius(_state(spark, d), "x", "y", 0, 400, 200).select("obj", "x", "y")


@query(f"""SELECT obj, x, y FROM (SELECT obj, arg_max(x, {_O2}) AS x, arg_max(y, {_O2}) AS y FROM {_M} WHERE us <= 1705104000000000 GROUP BY obj) WHERE x BETWEEN 0 AND 60 AND y BETWEEN 100 AND 700""")
def past_box(spark, d):
    return _state(spark, d, 1705104000000000).where(F.col("x").between(0, 60) & F.col("y").between(100, 700)).select("obj", "x", "y")


@query(f"""SELECT obj, round(x + 15, 6) AS x, round(y - 20, 6) AS y FROM {_LAST} WHERE (x + 15 - 50) * (x + 15 - 50) + (y - 20 - 500) * (y - 20 - 500) <= 90000""")
def predicted_radius(spark, d):
    s = _state(spark, d).withColumns({"vx": F.lit(1.5), "vy": F.lit(-2.0)})
    p = spatial.within_radius(temporal.predicted(s, "x", "y", "vx", "vy", 10.0), "x", "y", 50, 500, 300)
    return p.select("obj", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH s AS (SELECT *, greatest(0, least(1, (x * 100 + y * 900) / (100 * 100 + 900 * 900.0))) AS t FROM {_LAST})
    SELECT obj, x, y FROM s WHERE (x - t * 100) * (x - t * 100) + (y - t * 900) * (y - t * 900) <= 400""")
def corridor(spark, d):
    s = _state(spark, d)
    return s.where(to_segment2(F.col("x"), F.col("y"), 0, 0, 100, 900) <= 20 * 20).select("obj", "x", "y")


@query(f"""WITH s AS (SELECT obj, arg_max(x, {_O2}) AS x, arg_max(y, {_O2}) AS y FROM {_M} WHERE us <= 1705104000000000 GROUP BY obj)
    SELECT a.obj AS a, b.obj AS b FROM s a JOIN s b ON a.obj < b.obj AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100""")
def collided_at(spark, d):
    return spatial.close_pairs(_state(spark, d, 1705104000000000), "obj", "x", "y", 10)


@query(f"""SELECT a.obj AS a, b.obj AS b, a.obj = b.obj OR (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 40000 AS colliding FROM {_LAST} a, {_LAST} b WHERE a.obj IN (3, 4, 5, 6) AND b.obj IN (3, 5, 7, 11)""")
def pair_collision(spark, d):
    """Stated pairs of objects, an object with itself among them."""
    s = _state(spark, d).select("obj", "x", "y").where("obj in (3, 4, 5, 6, 7, 11)")
    a, b = s.where("obj in (3, 4, 5, 6)").withColumnRenamed("obj", "a"), s.where("obj in (3, 5, 7, 11)").toDF("b", "x2", "y2")
    near = d2((F.col("x"), F.col("x2")), (F.col("y"), F.col("y2"))) <= 200 * 200
    return a.join(F.broadcast(b)).select("a", "b", ((F.col("a") == F.col("b")) | near).alias("colliding"))


@query("""SELECT event_type, TRUE AS within_bound FROM events GROUP BY event_type""")
def p_square_bound(spark, d):
    """The five-marker estimate of the 90th percentile lies between the exact 85th and 95th."""
    e = events(spark, d)
    exact = e.groupBy("event_type").agg(quantiles.disc("value", 0.85).alias("lo"), quantiles.disc("value", 0.95).alias("hi"))
    return quantiles.p_square(e, ["event_type"], "value", ["us", "event_id"], 0.9).join(exact, "event_type").select("event_type", F.col("estimate").between(F.col("lo"), F.col("hi")).alias("within_bound"))


@query("""SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, TRUE AS ordered, round(min(value), 6) AS p0, round(max(value), 6) AS p100 FROM events GROUP BY event_type""")
def p_square_stats(spark, d):
    """What the five markers know beside their quantile: count, extremes, and other percentiles read between them."""
    got = quantiles.p_square(events(spark, d), ["event_type"], "value", ["us", "event_id"], 0.5)
    at = lambda p: quantiles.between_markers(F.col("markers"), p)
    ordered = (at(0.0) <= at(0.25)) & (at(0.25) <= at(0.5)) & (at(0.5) == F.col("estimate")) & (at(0.5) <= at(0.6)) & (at(0.6) <= at(1.0))
    return got.select("event_type", "n", "low", "high", ordered.alias("ordered"), F.round(at(0.0), 6).alias("p0"), F.round(at(1.0), 6).alias("p100"))


@query("""SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, round(sum(value), 4) AS total, TRUE AS median_within, TRUE AS share_within FROM events GROUP BY event_type""")
def merged_windows(spark, d):
    """Summaries of single hours merged to the whole: exact where they add up, and a sketch whose median and share below 50 are near."""
    e = events(spark, d)
    parts = e.groupBy("event_type", F.expr("us div 3600000000").alias("hour")).agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"), F.expr("kll_sketch_agg_double(value)").alias("sketch"))
    got = quantiles.merged_summary(parts, ["event_type"])
    truth = e.groupBy("event_type").agg(F.percentile_approx("value", [0.46, 0.54], 10_000).alias("b"), (F.count_if(F.col("value") <= 50) / F.count("value")).alias("share"))
    median = F.expr("kll_sketch_get_quantile_double(sketch, 0.5D)").between(F.col("b")[0], F.col("b")[1])
    share = F.abs(F.expr("kll_sketch_get_rank_double(sketch, 50D)") - F.col("share")) <= 0.04
    return got.join(truth, "event_type").select("event_type", "n", "low", "high", F.round("total", 4).alias("total"), median.alias("median_within"), share.alias("share_within"))


@query("""SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_weight, count(*) AS rows, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(sum(l_extendedprice * CAST(l_quantity AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)), 4) AS mean
    FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 0 GROUP BY l_returnflag""")
def weighted_totals(spark, d):
    li = load(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", F.col("l_quantity").cast("long").alias("w"))
    return quantiles.weighted_summary(li, ["l_returnflag"], "l_extendedprice", "w").withColumn("mean", F.round("mean", 4))


@query("""SELECT event_type, quantile_disc(value, 0.95) AS exact, TRUE AS accurate FROM events GROUP BY event_type""")
def quantile_accuracy(spark, d):
    return quantiles.accuracy(events(spark, d), ["event_type"], "value", 0.95, 0.05).select("event_type", "exact", "accurate")


@query(f"""SELECT obj, us, event_id, x, y FROM {_M} m WHERE (us >= 1706659200000000 - 172800000000 OR event_id = (SELECT arg_max(n.event_id, [n.us, n.event_id]) FROM {_M} n WHERE n.obj = m.obj AND n.us <= 1706659200000000)) AND us <= 1706659200000000""")
def trajectory_lookback(spark, d):
    return temporal.lookback(moving(spark, d), "obj", "us", ["event_id"], ["x", "y"], 1706659200000000, 172800000000)


@query(f"""SELECT obj, x, y FROM (SELECT obj, arg_max(x, {_O2}) AS x, arg_max(y, {_O2}) AS y, arg_max(event_id, {_O2}) AS e FROM {_M} GROUP BY obj) WHERE e % 7 <> 0""")
def objects_after_removals(spark, d):
    """Objects whose last row is no removal."""
    return temporal.latest(moving(spark, d), "obj", "us", ["event_id"], ["x", "y"], gone=F.col("event_id") % 7 == 0).select("obj", "x", "y")
