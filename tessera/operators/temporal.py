"""Time travel: as-of lookups, replay, resampling, steps, and states of moving objects at past times.

No operator reads the clock; what "now" is comes in as an argument.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(probes: DataFrame, log: DataFrame, keys: list[str], at: str, ts: str, order: list[str], values: list[str], bounded: bool = True, buckets: int = 256) -> DataFrame:
    """Each probe with the latest log row of its key at or before it (ties: the last in ``order``).

    The span of the log is cut into ``buckets`` of time. Probes and log rows of one key and bucket are sorted together and the
    last log row carries on; what a bucket begins with is the last row of the buckets before, of which there is one a bucket. So
    a key that holds most of the log is the work of many tasks. ``bounded`` gives null to probes after the key's last row, as a
    finished timeline does.
    """
    span = log.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    low, width = span.a or 0, max(1, -(-((span.b or 0) - (span.a or 0) + 1) // buckets))
    bucket = F.floor((F.greatest(F.least(F.col("_t"), F.lit(span.b or 0)), F.lit(low)) - low) / width).cast("int")
    log_row = log.select(*keys, F.col(ts).alias("_t"), F.lit(0).alias("_side"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(F.col(ts).alias("found_ts"), *values).alias("_v"))
    kinds = {f.name: f.dataType for f in log_row.schema.fields}
    places = [f"_o{i}" for i in range(len(order))]
    probe = probes.withColumns({"_t": F.col(at), "_side": F.lit(1), "_v": F.lit(None).cast(kinds["_v"])} | {o: F.lit(None).cast(kinds[o]) for o in places})
    both = probe.unionByName(log_row, allowMissingColumns=True).withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", *places).rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_f", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    ends = both.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct("_t", *places))).alias("_e"), F.max(F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    by_key = Window.partitionBy(*keys)
    carried = ends.select(*keys, "_b", F.last("_e", ignorenulls=True).over(by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"), F.max("_last").over(by_key).alias("_end"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_b"]]
    got = got.alias("p").join(carried.alias("c"), reduce(lambda x, y: x & y, same), "left")
    found = F.coalesce("_f", "_c")
    if bounded:
        found = F.when(F.col("_t") <= F.col("_end"), found)
    got = got.select(*[F.col(f"p.{c}") for c in probes.columns], found.alias("_f"))
    return got.select(*probes.columns, F.col("_f.found_ts"), *[F.col(f"_f.{v}") for v in values])


def nearest(probes: DataFrame, log: DataFrame, keys: list[str], at: str, ts: str, order: list[str], values: list[str]) -> DataFrame:
    """Each probe with the log row of its key nearest in time, the earlier of two as near; none only where the key has none."""
    back = as_of(probes, log, keys, at, ts, order, values, bounded=False)
    names = ["found_ts", *values]
    flip = lambda df, c: df.withColumn(c, -F.col(c))
    log2 = log.withColumn("_neg", -F.col(ts))
    for i, o in enumerate(order):
        log2 = log2.withColumn(f"_n{i}", -F.col(o))
    ahead = as_of(flip(back.withColumnsRenamed({n: f"_b_{n}" for n in names}), at), log2, keys, at, "_neg", [f"_n{i}" for i in range(len(order))], [ts, *values], bounded=False)
    ahead = flip(ahead, at)
    use = F.col("_b_found_ts").isNotNull() & (F.col(ts).isNull() | (F.col(at) - F.col("_b_found_ts") <= F.col(ts) - F.col(at)))
    return ahead.select(*probes.columns, F.when(use, F.col("_b_found_ts")).otherwise(F.col(ts)).alias("_fts"), *[F.when(use, F.col(f"_b_{v}")).otherwise(F.col(v)).alias(f"_v_{v}") for v in values]).withColumnsRenamed({"_fts": "found_ts"} | {f"_v_{v}": v for v in values})


def replay(log: DataFrame, ts: Column, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of the closed span; a filter that reaches the scan."""
    if start is not None:
        log = log.where(ts >= start)
    return log if end is None else log.where(ts <= end)


def resample(log: DataFrame, keys: list[str], ts: str, order: list[str], values: list[str], fps: int, start: int | None = None) -> DataFrame:
    """Sample and hold at ticks 1000 // fps ms apart, from ``start`` (else the first row of a key) through its last row."""
    if not 1 <= fps <= 1000:
        raise ValueError("fps must lie in 1..1000")
    step = 1000 // fps
    spans = log.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    first = F.col("_a") if start is None else F.lit(start).cast("long")
    ticks = spans.where(first <= F.col("_b")).select(*keys, F.explode(F.sequence(first, F.col("_b"), F.lit(step).cast("long"))).alias("tick"))
    return as_of(ticks, log, keys, "tick", ts, order, values).where(F.col("found_ts").isNotNull())


def last_n(log: DataFrame, n: int, ts: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The newest n rows, of each key or of all; without keys a distributed top-n."""
    newest = [F.desc(ts), *map(F.desc, order)]
    if not keys:
        return log.orderBy(*newest).limit(n)
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where(F.col("_n") <= n).drop("_n")


def steps(log: DataFrame, keys: list[str], ts: str, order: list[str], value: str) -> DataFrame:
    """Adds the previous and the next frame's value."""
    by = Window.partitionBy(*keys).orderBy(ts, *order)
    return log.withColumns({"previous_frame": F.lag(value).over(by), "next_frame": F.lead(value).over(by)})


def stats(log: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Frames, first and last time, duration and mean frame time of each timeline."""
    out = log.groupBy(*keys).agg(F.count("*").alias("frames"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
    duration = F.col("end_ts") - F.col("start_ts")
    return out.withColumns({"duration": duration, "mean_frame": F.when(F.col("frames") > 1, duration / (F.col("frames") - 1))})


def latest(log: DataFrame, obj: str, ts: str, order: list[str], values: list[str], upto: int | None = None, gone: Column | None = None) -> DataFrame:
    """The state of each object at a time (else at the end): last write wins; a partial and a final max, no sort.

    Objects whose last row is a removal (``gone``) are left out.
    """
    rows = log if upto is None else log.where(F.col(ts) <= upto)
    rows = rows.withColumn("_gone", F.lit(False) if gone is None else gone)
    best = rows.groupBy(obj).agg(F.max_by(F.struct(ts, *values, "_gone"), F.struct(ts, *order)).alias("_s")).where("not _s._gone")
    return best.select(obj, *[F.col(f"_s.{v}") for v in [ts, *values]])


def snapshots(log: DataFrame, obj: str, ts: str, order: list[str], values: list[str], every: int, gone: Column | None = None) -> DataFrame:
    """Whole states at ticks, the multiples of ``every`` from the first row on to the first one that has the last row behind it.

    At a tick every object stands where its last row at or before the tick put it, whenever that was, until a removal
    (``gone``). Rows shrink to the last one of each object and tick before they are ordered, so an object of many rows has no
    more than one a tick to order. Columns: tick, obj, values.
    """
    tick = (F.ceil(F.col(ts) / every).cast("long") * every).alias("tick")
    rows = log.withColumn("_gone", F.lit(False) if gone is None else gone)
    last = rows.groupBy(tick, F.col(obj)).agg(F.max_by(F.struct(*values, "_gone"), F.struct(ts, *order)).alias("_s"))
    end = log.agg((F.ceil(F.max(ts) / every).cast("long") * every).alias("_end"))
    until = F.coalesce(F.lead("tick").over(Window.partitionBy(obj).orderBy("tick")) - every, F.col("_end"))
    held = last.join(F.broadcast(end)).withColumn("_until", until).where("not _s._gone")
    ticks = F.explode(F.sequence("tick", "_until", F.lit(every).cast("long"))).alias("tick")
    return held.select(ticks, obj, *[F.col(f"_s.{v}") for v in values])


def snapshot_at(states: DataFrame, at: int, closest: bool = False) -> DataFrame:
    """The snapshot that stands for a time: the last one at or before it, or the ``closest`` (of two as near the earlier).

    A time before the first or after the last snapshot has none, or the first or last as the closest.
    """
    ticks = states.select("tick").distinct()
    away = F.abs(F.col("tick") - at)
    if closest:
        one = ticks.agg(F.min_by("tick", F.struct(away, "tick")).alias("_tick"))
    else:
        one = ticks.agg(F.max(F.when(F.col("tick") <= at, F.col("tick"))).alias("_tick"), F.max("tick").alias("_end")).where(F.col("_end") >= at).select("_tick")
    return states.join(F.broadcast(one), F.col("tick") == F.col("_tick")).drop("_tick")


def snapshot_steps(states: DataFrame) -> DataFrame:
    """tick, objects, previous, next: the time line of snapshots, which holds one row a tick."""
    by = Window.orderBy("tick")
    per = states.groupBy("tick").agg(F.count("*").alias("objects"))
    return per.select("tick", "objects", F.lag("tick").over(by).alias("previous"), F.lead("tick").over(by).alias("next"))


def seek(log: DataFrame, keys: list[str], ts: str, order: list[str], cursors: DataFrame, at: str, values: list[str]) -> DataFrame:
    """Cursors of timelines: ``cursors`` with ok (whether the time lies within the timeline), position (frames before) and the frame.

    Where the time lies outside, a cursor does not move: position and frame are null. ``cursors`` is a stated list.
    """
    best = F.max_by(F.struct(F.col(ts).alias("found_ts"), *values), F.struct(ts, *order))
    per = log.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    asked = cursors.select(*keys, F.col(at).alias("_at")).distinct()
    near = log.join(F.broadcast(asked), keys).where(F.col(ts) <= F.col("_at")).groupBy(*keys, "_at").agg(best.alias("_f"), (F.count("*") - 1).alias("_n"))
    got = cursors.withColumn("_at", F.col(at)).join(near, [*keys, "_at"], "left").join(per, keys, "left")
    ok = F.coalesce(F.col("_at").between(F.col("_a"), F.col("_b")), F.lit(False))
    frame = [F.when(ok, F.col(f"_f.{v}")).alias(v) for v in ["found_ts", *values]]
    return got.select(*cursors.columns, ok.alias("ok"), F.when(ok, F.col("_n")).alias("position"), *frame)


def state_at_ticks(log: DataFrame, obj: str, ts: str, order: list[str], values: list[str], every: int) -> DataFrame:
    """The whole state at each tick: ``snapshots`` without removals."""
    return snapshots(log, obj, ts, order, values, every)


def heat_map(log: DataFrame, x: str, y: str, cell: float, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows by square cell, of a closed box (min_x, min_y, max_x, max_y) if given; negative coordinates floor."""
    if box:
        log = log.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    return log.groupBy(at(x).alias("cx"), at(y).alias("cy")).agg(F.count("*").alias("n"))


def predicted(state: DataFrame, x: str, y: str, vx: str, vy: str, dt: float) -> DataFrame:
    """States moved on by their velocity."""
    return state.withColumns({x: F.col(x) + F.col(vx) * dt, y: F.col(y) + F.col(vy) * dt})


def retained(log: DataFrame, ts: Column, now: Column, keep: int) -> DataFrame:
    """Snapshots no older than ``keep`` at ``now``."""
    return log.where(ts >= now - keep)


def lookback(log: DataFrame, obj: str, ts: str, order: list[str], values: list[str], now: int, back: int) -> DataFrame:
    """Trajectories: each object's rows since now - back, and its current state even if that is older, in order of time."""
    upto = log.where(F.col(ts) <= now)
    last = upto.groupBy(obj).agg(F.max(F.struct(ts, *order)).alias("_m"))
    keep = (F.col(ts) >= now - back) | (F.struct(ts, *order) == F.col("_m"))
    return upto.join(last, obj).where(keep).select(obj, ts, *order, *values)
