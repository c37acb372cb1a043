"""Queries on caches, counters, multimaps, sequences, sets and change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import collections as C
from tessera.operators import keyed
from tessera.plans import lookups  # noqa: F401  registers the cache whose SQL serves here too
from tessera.plans.registry import ORACLES, query
from tessera.sources.tables import load, micros
from tessera.streaming import feeds


def log(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("us"))


_O = ["us", "event_id"]


@query("SELECT user_id, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id ORDER BY max([epoch_us(ts), event_id]) DESC, user_id LIMIT 20")
def lru_content(spark, d):
    return keyed.lru(log(spark, d), "user_id", _O, 20).select("user_id", "last_us")


@query("SELECT user_id, max(epoch_us(ts)) AS last_us FROM events WHERE event_type = 'purchase' GROUP BY user_id ORDER BY max([epoch_us(ts), event_id]) DESC, user_id LIMIT 20")
def lru_by_write(spark, d):
    return keyed.last_writes(log(spark, d), "user_id", _O, 20, F.col("event_type") == "purchase").select("user_id", "last_us")


@query("SELECT arg_min(user_id, f) AS oldest, arg_max(user_id, f) AS newest FROM (SELECT user_id, min(epoch_us(ts)) AS f FROM events GROUP BY user_id)")
def cache_ends(spark, d):
    return keyed.ends(log(spark, d), "user_id", _O)


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_window(spark, d):
    return keyed.recent(log(spark, d), _O, 50).select("event_id", "user_id")


_C = "(SELECT user_id, count(*) AS n, max([epoch_us(ts), event_id]) AS last_us FROM events GROUP BY user_id)"


def _counted(spark, d):
    return keyed.counters(log(spark, d), "user_id", _O)


@query(f"SELECT user_id, n FROM {_C} ORDER BY n DESC, last_us DESC LIMIT 10")
def lfu_top_k(spark, d):
    return keyed.most_frequent(_counted(spark, d), "user_id", _O, 10).select("user_id", "n")


@query(f"SELECT user_id, n FROM {_C} ORDER BY n, last_us DESC LIMIT 10")
def lfu_bottom_k(spark, d):
    return keyed.least_frequent(_counted(spark, d), "user_id", _O, 10).select("user_id", "n")


@query(f"SELECT user_id, n FROM {_C} WHERE user_id <> (SELECT user_id FROM {_C} ORDER BY n, last_us DESC LIMIT 1)")
def lfu_evict(spark, d):
    return keyed.evict_least_frequent(_counted(spark, d), "user_id", _O).select("user_id", "n")


@query(f"SELECT n, count(*) AS users FROM {_C} GROUP BY n")
def items_by_count(spark, d):
    return _counted(spark, d).groupBy("n").agg(F.count("*").alias("users"))


@query(f"SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS accesses, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM {_C}")
def counter_stats(spark, d):
    return keyed.counter_stats(_counted(spark, d)).withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("SELECT conv_id, list(role ORDER BY turn) AS members FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY conv_id")
def multimap_values(spark, d):
    return keyed.multimap(load(spark, d, "conversations").select("conv_id", "turn", "role").distinct(), "conv_id", "role", ["turn"])


@query("SELECT conv_id, list(role ORDER BY t) AS members FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def multimap_dedupe(spark, d):
    return keyed.multimap(load(spark, d, "conversations"), "conv_id", "role", ["turn"], duplicates=False)


@query("""WITH c AS (SELECT DISTINCT conv_id, turn, role FROM conversations) SELECT conv_id, turn, role FROM c
    WHERE NOT (role = 'user' AND turn = (SELECT min(turn) FROM c x WHERE x.conv_id = c.conv_id AND x.role = 'user'))""")
def multimap_remove_first(spark, d):
    c = load(spark, d, "conversations").select("conv_id", "turn", "role").distinct()
    return keyed.remove_first(c, c.where("role = 'user'"), "conv_id", "role", ["turn"])


@query("SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def multimap_counts(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles"))


@query("SELECT user_id, arg_max(event_type, [epoch_us(ts), event_id]) AS event_type, arg_max(value, [epoch_us(ts), event_id]) AS value FROM events GROUP BY user_id")
def upsert_last_wins(spark, d):
    return keyed.last_wins(log(spark, d), "user_id", _O).select("user_id", "event_type", "value")


_K = "l_extendedprice, l_orderkey, l_linenumber, l_partkey"
_KEYS = _K.split(", ")


@query(f"SELECT {_K} FROM lineitem ORDER BY {_K} LIMIT 25")
def heap_top_k_min(spark, d):
    return C.smallest(load(spark, d, "lineitem"), 25, _KEYS).select(*_KEYS)


@query("SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC LIMIT 25")
def heap_top_k_max(spark, d):
    return C.largest(load(spark, d, "lineitem"), 25, _KEYS).select(*_KEYS)


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def heap_top_k_per_key(spark, d):
    return keyed.keyed_rank(log(spark, d), ["user_id"], [F.desc("value"), "event_id"], 3).select("user_id", "event_id", "value")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100")
def bounded_list(spark, d):
    return C.bounded(log(spark, d), 100, _O).select("event_id")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1 AS INTEGER) AS popped FROM events QUALIFY popped < 40")
def stack_pop_n(spark, d):
    return C.pop(log(spark, d), 40, _O).select("event_id", "popped")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY ts, event_id) > 30")
def queue_dequeue_n(spark, d):
    """What stays after thirty are taken."""
    return C.dequeue(log(spark, d), 30, _O)[1].select("event_id")


@query("SELECT conv_id, list_concat(list(turn ORDER BY turn)[:1], [-1], list(turn ORDER BY turn)[2:]) AS turns FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def array_insert(spark, d):
    a = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t")).where(F.size("t") > 1)
    return a.select("conv_id", C.insert_at(F.col("t"), 1, F.lit(-1).cast("long")).alias("turns"))


@query("SELECT conv_id, list_concat([t[-1]], t[2:-2]) AS turns FROM (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id HAVING count(*) > 1)")
def array_swap_remove(spark, d):
    a = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t")).where(F.size("t") > 1)
    return a.select("conv_id", C.swap_remove(F.col("t"), 0).alias("turns"))


def _users(spark, d, kind):
    """On which days each user did a kind of thing: user_id, day."""
    return log(spark, d).where(F.col("event_type") == kind).select("user_id", F.expr("us div 86400000000").alias("day")).distinct()


_U = "(SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS day FROM events WHERE event_type = '{}')"
_CL, _PU = _U.format("click"), _U.format("purchase")


@query(f"SELECT * FROM {_CL} UNION SELECT * FROM {_PU}")
def set_union(spark, d):
    return _users(spark, d, "click").union(_users(spark, d, "purchase")).distinct()


@query(f"SELECT * FROM {_CL} INTERSECT SELECT * FROM {_PU}")
def set_intersect(spark, d):
    return _users(spark, d, "click").intersect(_users(spark, d, "purchase"))


@query(f"SELECT * FROM {_CL} EXCEPT SELECT * FROM {_PU}")
def set_except(spark, d):
    return _users(spark, d, "click").subtract(_users(spark, d, "purchase"))


@query(f"(SELECT * FROM {_CL} EXCEPT SELECT * FROM {_PU}) UNION (SELECT * FROM {_PU} EXCEPT SELECT * FROM {_CL})")
def set_symdiff(spark, d):
    return C.symmetric_difference(_users(spark, d, "click"), _users(spark, d, "purchase"))


@query(f"""WITH x AS (SELECT (SELECT count(*) FROM (SELECT * FROM {_CL} EXCEPT SELECT * FROM {_PU})) AS oa, (SELECT count(*) FROM (SELECT * FROM {_PU} EXCEPT SELECT * FROM {_CL})) AS ob, (SELECT count(*) FROM (SELECT * FROM {_CL} INTERSECT SELECT * FROM {_PU})) AS c)
    SELECT oa = 0 AS is_subset, ob = 0 AS is_superset, oa = 0 AND ob > 0 AS is_proper_subset, ob = 0 AND oa > 0 AS is_proper_superset, c > 0 AS overlaps, oa = 0 AND ob = 0 AS set_equals FROM x""")
def set_predicates(spark, d):
    return C.predicates(_users(spark, d, "click"), _users(spark, d, "purchase"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' AND n_chars > 2000")
def filtered_view(spark, d):
    return load(spark, d, "documents").where("lang = 'de' AND n_chars > 2000").select("doc_id", "lang")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 1")
def list_find_first(spark, d):
    return C.smallest(log(spark, d).where("event_type = 'purchase'"), 1, _O).select("event_id", "user_id")


_ACT = "CASE WHEN event_id % 97 = 0 AND event_id < 500 THEN 'Reset' WHEN event_type = 'purchase' THEN 'Remove' ELSE 'Add' END"


def _changes(spark, d):
    action = F.when((F.col("event_id") % 97 == 0) & (F.col("event_id") < 500), "Reset").when(F.col("event_type") == "purchase", "Remove").otherwise("Add")
    return load(spark, d, "events").select(F.col("event_id").alias("version"), F.col("user_id").alias("item"), action.alias("action"))


@query(f"""WITH c AS (SELECT event_id AS version, user_id AS item, {_ACT} AS action FROM events), r AS (SELECT coalesce(max(version), -1) AS v FROM c WHERE action = 'Reset')
    SELECT item, max(version) AS version FROM c, r WHERE version > v AND action <> 'Reset' GROUP BY item HAVING arg_max(action, version) <> 'Remove'""")
def changelog_apply(spark, d):
    return C.apply_changes(_changes(spark, d), "item", "version")


@query("""WITH c AS (SELECT event_id AS version, user_id AS item, CASE WHEN event_type = 'purchase' THEN 'Remove' ELSE 'Add' END AS action FROM events)
    SELECT version, item, action FROM c QUALIFY action <> coalesce(lag(action) OVER (PARTITION BY item ORDER BY version), 'Remove')""")
def effective_changes(spark, d):
    c = load(spark, d, "events").select(F.col("event_id").alias("version"), F.col("user_id").alias("item"), F.when(F.col("event_type") == "purchase", "Remove").otherwise("Add").alias("action"))
    return C.effective_changes(c, "item", "version")


@query("""WITH a AS (SELECT user_id, max(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT user_id, max(value) AS v FROM events GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'Add' WHEN b.user_id IS NULL THEN 'Remove' ELSE 'Replace' END AS action FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.v IS DISTINCT FROM b.v""")
def change_feed(spark, d):
    e = load(spark, d, "events")
    a = e.where(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).groupBy("user_id").agg(F.max("value").alias("v"))
    return C.diff(a, e.groupBy("user_id").agg(F.max("value").alias("v")), "user_id", ["v"])


@query("SELECT c_name, CAST(row_number() OVER (ORDER BY c_name DESC) AS INTEGER) AS place FROM customer QUALIFY place <= 200")
def list_sort_reverse(spark, d):
    return C.pop(load(spark, d, "customer").select("c_name"), 200, ["c_name"]).select("c_name", (F.col("popped") + 1).alias("place"))


@query("SELECT event_type, epoch_us(ts) // 3600000000 AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    """Tumbling hours by a streaming aggregation, run over all files at hand."""
    got = feeds.tumbling(spark, d, "events", "ts", "1 hour", ["event_type"], "value")
    return got.select("event_type", F.expr("start_us div 3600000000").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50")
def stream_filtered_feed(spark, d):
    """A filtered view kept by a stream."""
    return feeds.filtered(spark, d, "events", "event_type = 'purchase' AND value > 50").select("event_id", "user_id", "value")


@query("SELECT user_id, count(*) AS n, arg_max(event_type, [epoch_us(ts), event_id]) AS last_type FROM events GROUP BY user_id")
def stream_latest_state(spark, d):
    """Counts and latest states of keys, upserted batch by batch."""
    return feeds.latest_states(spark, d, "events", "user_id", ["ts", "event_id"], "event_type").select("user_id", "n", F.col("latest").alias("last_type"))


@query(ORACLES["fifo_cache"])
def stream_fifo(spark, d):
    """The FIFO of ``fifo_cache`` over a log that a stream appends."""
    return feeds.fifo(spark, d, "events", "event_type", "user_id", ["ts", "event_id"], 3)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    return feeds.deduplicated(spark, d, "events", "ts", ["user_id", "event_type"])


@query("""WITH t AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id), b AS (SELECT DISTINCT c_custkey AS user_id FROM customer)
    SELECT coalesce(b.user_id, t.user_id) AS user_id FROM b FULL JOIN t ON t.user_id = b.user_id WHERE (CASE WHEN b.user_id IS NULL THEN 0 ELSE 1 END + coalesce(n, 0)) % 2 = 1""")
def set_toggle(spark, d):
    """Customers, put in or taken out by each purchase."""
    base = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return C.toggle(base, load(spark, d, "events").where("event_type = 'purchase'").select("user_id"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 0 OR c_mktsegment = 'MACHINERY', FALSE)")
def set_remove_where(spark, d):
    gone = (F.col("c_acctbal") < 0) | (F.col("c_mktsegment") == "MACHINERY")
    return C.remove_where(load(spark, d, "customer"), gone).select("c_custkey", "c_acctbal")


@query("SELECT conv_id, t[1] AS first_turn, t[-1] AS last_turn, CAST(coalesce(list_position(t, 2), 0) - 1 AS INTEGER) AS place_of_2, list_contains(t, 3) AS has_3, list_transform(t, lambda x: x * 10) AS tens, t[2:] AS without_first FROM (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)")
def array_reads(spark, d):
    """Reads of small sequences: ends, place of a value (-1 where it is missing), membership, a map, a removal."""
    a = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    t = F.col("t")
    return a.select("conv_id", F.element_at(t, 1).alias("first_turn"), F.element_at(t, -1).alias("last_turn"), (F.array_position(t, 2) - 1).cast("int").alias("place_of_2"), F.array_contains(t, 3).alias("has_3"), F.transform(t, lambda x: x * 10).alias("tens"), C.remove_at(t, 0).alias("without_first"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, TRUE AS notified FROM events")
def stream_batches(spark, d):
    """A long append that notifies batch by batch."""
    got = feeds.appended(spark, d, "events")
    return got.agg(F.sum("rows").alias("rows"), (F.count("*") >= 1).alias("notified"))
