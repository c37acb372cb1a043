"""Queries on sketches. Estimates are checked against their bounds, so that the SQL knows the answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sketches
from tessera.plans.registry import query
from tessera.sources.tables import load

_BITS = 12


def _close(estimate, exact, bits: int = _BITS):
    return F.abs(estimate - exact) <= 5 * sketches.hll_error(bits) * F.greatest(exact, F.lit(1))


@query("""SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, TRUE AS within_bound FROM lineitem GROUP BY l_returnflag""")
def hll_within_bound(spark, d):
    g = load(spark, d, "lineitem").groupBy("l_returnflag").agg(sketches.hll(F.col("l_partkey"), _BITS).alias("s"), F.count_distinct("l_partkey").alias("exact"))
    return g.select("l_returnflag", "exact", _close(F.hll_sketch_estimate("s"), F.col("exact")).alias("within_bound"))


@query("""SELECT count(DISTINCT l_partkey) AS exact, TRUE AS within_bound FROM lineitem""")
def hll_union_bound(spark, d):
    """Sketches of parts of the table, merged."""
    li = load(spark, d, "lineitem")
    parts = li.groupBy("l_returnflag", "l_linestatus").agg(sketches.hll(F.col("l_partkey"), _BITS).alias("s"))
    whole = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("e"))
    return li.agg(F.count_distinct("l_partkey").alias("exact")).join(F.broadcast(whole)).select("exact", _close(F.col("e"), F.col("exact")).alias("within_bound"))


@query("""SELECT count(*) AS exact, TRUE AS within_bound FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N')""")
def hll_intersection_bound(spark, d):
    """Inclusion and exclusion of two sketches; the error is that of all three estimates."""
    li = load(spark, d, "lineitem").where("l_returnflag in ('A', 'N')")
    by = li.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "N").alias("n"))
    e = by.agg(F.count_if(F.col("a") & F.col("n")).alias("exact"), F.count("*").alias("u"), *[sketches.hll(F.when(F.col(c), F.col("l_partkey")), _BITS).alias(f"s{c}") for c in "an"])
    a, b, u = F.hll_sketch_estimate("sa"), F.hll_sketch_estimate("sn"), F.hll_sketch_estimate(F.hll_union("sa", "sn"))
    got = F.greatest(F.lit(0), a + b - u)
    return e.select("exact", (F.abs(got - F.col("exact")) <= 15 * sketches.hll_error(_BITS) * F.col("u")).alias("within_bound"))


@query("""SELECT count(*) AS exact, TRUE AS within_bound FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N')""")
def theta_intersection_bound(spark, d):
    li = load(spark, d, "lineitem").where("l_returnflag in ('A', 'N')")
    by = li.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "N").alias("n"))
    e = by.agg(F.count_if(F.col("a") & F.col("n")).alias("exact"), F.count("*").alias("u"), *[F.expr(f"theta_sketch_agg(CASE WHEN {c} THEN l_partkey END)").alias(f"s{c}") for c in "an"])
    return e.select("exact", (F.abs(F.expr("theta_sketch_estimate(theta_intersection(sa, sn))") - F.col("exact")) <= 0.1 * F.col("u")).alias("within_bound"))


def _bloom(spark, d):
    inside = load(spark, d, "labels").select(F.col("doc_id"))
    bits, k = sketches.bloom_shape(max(1, inside.count()), 0.01)
    return inside, sketches.bloom(inside, F.col("doc_id"), bits, k), bits, k


@query("""SELECT doc_id, TRUE AS maybe FROM labels""")
def bloom_no_false_negative(spark, d):
    inside, sketch, bits, k = _bloom(spark, d)
    return sketches.bloom_probe(inside, F.col("doc_id"), sketch, bits, k).select("doc_id", "maybe")


@query("""SELECT count(*) AS absent, TRUE AS within_bound FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def bloom_fpr_bound(spark, d):
    inside, sketch, bits, k = _bloom(spark, d)
    out = load(spark, d, "documents").select("doc_id").join(inside, "doc_id", "left_anti")
    got = sketches.bloom_probe(out, F.col("doc_id"), sketch, bits, k)
    return got.agg(F.count("*").alias("absent"), (F.count_if("maybe") <= 0.02 * F.count("*") + 3).alias("within_bound"))


@query("""SELECT TRUE AS same_as_whole, TRUE AS items_within_bound""")
def bloom_union(spark, d):
    """Filters of two halves united are the filter of the whole; the item count is estimated from the fill."""
    inside, sketch, bits, k = _bloom(spark, d)
    a, b = (sketches.bloom(inside.where(F.col("doc_id") % 2 == i), F.col("doc_id"), bits, k) for i in (0, 1))
    both = sketches.bloom_union(a, b)
    differ = sketch.exceptAll(both).agg(F.count("*").alias("differ"))
    n = inside.agg(F.count_distinct("doc_id").alias("n"))
    s = sketches.bloom_stats(both, bits, k)
    return s.join(F.broadcast(differ)).join(F.broadcast(n)).select((F.col("differ") == 0).alias("same_as_whole"), (F.abs(F.col("items") - F.col("n")) <= 0.05 * F.col("n") + 5).alias("items_within_bound"))


_W, _D = 4096, 5


def _cms(spark, d):
    o = load(spark, d, "orders")
    sketch = sketches.count_min(o, F.col("o_custkey"), _W, _D)
    exact = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return o, exact, sketches.cms_estimate(exact, F.col("o_custkey"), sketch, _W, _D), sketch


@query("""SELECT o_custkey, count(*) AS n, TRUE AS never_under FROM orders GROUP BY o_custkey""")
def cms_never_under(spark, d):
    return _cms(spark, d)[2].select("o_custkey", "n", (F.col("estimate") >= F.col("n")).alias("never_under"))


@query("""SELECT count(DISTINCT o_custkey) AS items, TRUE AS within_bound FROM orders""")
def cms_upper_bound(spark, d):
    o, _, est, _ = _cms(spark, d)
    total = o.agg(F.count("*").alias("total"))
    ok = F.col("estimate") <= F.col("n") + F.col("total") * 2.718281828 / _W
    return est.join(F.broadcast(total)).agg(F.count("*").alias("items"), (F.count_if(ok) >= 0.95 * F.count("*")).alias("within_bound"))


@query("""SELECT TRUE AS merged_is_whole, TRUE AS decayed_below""")
def cms_merge_and_decay(spark, d):
    o, _, _, sketch = _cms(spark, d)
    a, b = (sketches.count_min(o.where(F.col("o_orderkey") % 2 == i), F.col("o_custkey"), _W, _D) for i in (0, 1))
    differ = sketch.exceptAll(sketches.cms_merge(a, b)).agg((F.count("*") == 0).alias("merged_is_whole"))
    half = sketches.cms_scale(sketch, 0.5).agg(F.sum("count").alias("h")).join(F.broadcast(sketch.agg(F.sum("count").alias("s"))))
    return differ.join(F.broadcast(half.select((F.col("h") * 2 <= F.col("s")).alias("decayed_below"))))


@query("""SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 0.0105 * (SELECT count(*) FROM lineitem)""")
def heavy_hitters(spark, d):
    return sketches.heavy_hitters(load(spark, d, "lineitem"), "l_suppkey", 0.0105)


@query("""SELECT o_custkey, TRUE AS heavy_found FROM orders GROUP BY o_custkey HAVING count(*) >= 0.001 * (SELECT count(*) FROM orders)""")
def cms_heavy(spark, d):
    """Every item of at least a thousandth of all rows is heavy by its estimate too."""
    o, _, est, sketch = _cms(spark, d)
    got = sketches.cms_frequency(est, sketch, _D, 0.001).join(F.broadcast(o.agg(F.count("*").alias("total"))))
    return got.where(F.col("n") >= 0.001 * F.col("total")).select("o_custkey", F.col("heavy").alias("heavy_found"))


# Sketches over a hash that SQL can compute too: their very content is compared, not only their bounds.
_H = "('0x' || substr(md5('{}:' || {}), 1, 15))::BIGINT"
_SHAPE = """n AS (SELECT count(DISTINCT doc_id) AS n FROM labels), s AS (SELECT n, CAST(ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits FROM n),
    k AS (SELECT n, bits, CAST(least(20, greatest(1, ceil(bits / n::DOUBLE * ln(2)))) AS BIGINT) AS k FROM s)"""
_PLACES = "SELECT DISTINCT doc_id, ({} % bits + i * (({} | 1) % bits)) % bits AS bit FROM {{}}, k, range(0, 20) r(i) WHERE i < k".format(_H.format(0, "doc_id"), _H.format(1, "doc_id"))
_SET = f"WITH {_SHAPE}, b AS (SELECT DISTINCT bit FROM ({_PLACES.format('labels')}))"


def _portable(spark, d):
    inside = load(spark, d, "labels").select("doc_id").distinct()
    bits, k = sketches.bloom_shape(inside.count(), 0.01)
    return inside, sketches.bloom(inside, F.col("doc_id"), bits, k, hash_=sketches.digest_hash), bits, k


@query(f"{_SET} SELECT doc_id, count(b.bit) = count(*) AS maybe FROM ({_PLACES.format('documents')}) p LEFT JOIN b ON b.bit = p.bit GROUP BY doc_id")
def bloom_probe(spark, d):
    """What a filter of the labelled ids says of every document, false positives and all."""
    _, sketch, bits, k = _portable(spark, d)
    docs = load(spark, d, "documents").select("doc_id").distinct()
    return sketches.bloom_probe(docs, F.col("doc_id"), sketch, bits, k, hash_=sketches.digest_hash).select("doc_id", "maybe")


@query(f"""{_SET}, f AS (SELECT count(*) AS set_bits FROM b) SELECT set_bits, round(set_bits / bits::DOUBLE, 9) AS fill_ratio, CAST(round_even(-(bits / k::DOUBLE) * ln(1 - set_bits / bits::DOUBLE), 0) AS BIGINT) AS items,
    round(pow(set_bits / bits::DOUBLE, k), 9) AS false_positive_rate, 8 * ((bits + 63) // 64) AS bytes FROM f, k""")
def bloom_stats(spark, d):
    _, sketch, bits, k = _portable(spark, d)
    got = sketches.bloom_stats(sketch, bits, k)
    return got.withColumns({c: F.round(c, 9) for c in ("fill_ratio", "false_positive_rate")})


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def bloom_semi_join(spark, d):
    """Documents of good labels: a filter in front of the exact join."""
    good = load(spark, d, "labels").where("quality = 1").select("doc_id")
    bits, k = sketches.bloom_shape(max(1, good.count()), 0.01)
    return sketches.bloom_semi_join(load(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", good, bits, k)


_WIDTH, _DEPTH = sketches.cms_shape(0.02, 0.98)
_CMS = f"""WITH e AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT o_custkey, n, d, CASE {' '.join(f"WHEN d = {i} THEN {_H.format(i, 'o_custkey')}" for i in range(_DEPTH))} END % {_WIDTH} AS cell FROM e, range(0, {_DEPTH}) s(d)),
    c AS (SELECT d, cell, CAST(sum(n) AS BIGINT) AS count FROM r GROUP BY d, cell)"""


def _portable_cms(spark, d):
    o = load(spark, d, "orders")
    sketch = sketches.count_min(o, F.col("o_custkey"), _WIDTH, _DEPTH, hash_=sketches.digest_hash)
    exact = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return sketch, sketches.cms_estimate(exact, F.col("o_custkey"), sketch, _WIDTH, _DEPTH, hash_=sketches.digest_hash)


@query(f"""{_CMS}, t AS (SELECT count(*) AS total FROM orders) SELECT o_custkey, n, min(count) AS estimate, round(min(count) / any_value(total)::DOUBLE, 9) AS frequency, min(count) / any_value(total)::DOUBLE >= 0.01 AS heavy
    FROM r JOIN c USING (d, cell), t GROUP BY o_custkey, n""")
def cms_frequency(spark, d):
    """Estimates and shares of a table shaped by its error, and which items are heavy by them."""
    sketch, est = _portable_cms(spark, d)
    return sketches.cms_frequency(est, sketch, _DEPTH, 0.01).select("o_custkey", "n", "estimate", F.round("frequency", 9).alias("frequency"), "heavy")


@query(f"""{_CMS} SELECT {_WIDTH} AS width, {_DEPTH} AS depth, CASE WHEN count(*) < {_WIDTH * _DEPTH} THEN 0 ELSE min(count) END AS low, max(count) AS high, round(sum(count) / {_WIDTH * _DEPTH}.0, 9) AS mean, round(count(*) / {_WIDTH * _DEPTH}.0, 9) AS fill,
    round(sum(count) / {_DEPTH}.0, 6) AS counted, round(sum(count) / {_DEPTH}.0 * exp(1) / {_WIDTH}, 6) AS max_error, CAST({4 * _WIDTH * _DEPTH} AS BIGINT) AS bytes FROM c""")
def cms_stats(spark, d):
    got = sketches.cms_stats(spark, _portable_cms(spark, d)[0], _WIDTH, _DEPTH)
    return got.select(F.lit(_WIDTH).alias("width"), F.lit(_DEPTH).alias("depth"), "low", "high", F.round("mean", 9).alias("mean"), F.round("fill", 9).alias("fill"), F.round("counted", 6).alias("counted"), F.round("max_error", 6).alias("max_error"), "bytes")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, round(1.04 / 64, 9) AS standard_error, 4096 AS registers, TRUE AS within_bound, TRUE AS small FROM lineitem GROUP BY l_returnflag")
def hll_stats(spark, d):
    """Estimate, error and size of distinct-count sketches."""
    g = load(spark, d, "lineitem").groupBy("l_returnflag").agg(sketches.hll(F.col("l_partkey"), _BITS).alias("s"), F.count_distinct("l_partkey").alias("exact"))
    got = sketches.hll_stats(g, "s", _BITS)
    return got.select("l_returnflag", "exact", F.round("standard_error", 9).alias("standard_error"), "registers", _close(F.col("estimate"), F.col("exact")).alias("within_bound"), F.col("bytes").between(1, 2 * (1 << _BITS)).alias("small"))
