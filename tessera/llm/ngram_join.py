"""N-gram Jaccard join by filters under several global token orders, and the groups its links form.

A document's set holds the distinct shingles of its words. Documents of equal sets are one class from the start. Two sets of
Jaccard similarity t share a token among the first n - ceil(t n) + 1 tokens of each under *any* global order of tokens, so a
candidate pair must share prefix tokens under every order tried: the filters of all orders are intersected before sets are
compared exactly. In every order frequent tokens (found by lossy counting over all documents, the most frequent kept in a
bounded table) come last, each order shuffling tokens of like frequency by a hash of its own, so that passages which many
documents share seldom stand in a prefix.

Pairs inside a group that is already known to be linked add nothing to it, and near copies come in groups. So groups come
first: classes that agree in a least hash (one of four) form a bucket, buckets are cut into blocks of a bounded number of
classes and shingles, and each pair of blocks is a group of rows of its own. There the prefixes under all orders make the
candidates, those not yet linked are compared by bit sets, and what spans the linked parts comes back. Buckets beyond a bound
are compared with one pivot, the class of fewest rare tokens. What is left are pairs of different components that no bucket
has met: prefix tokens that occur in two or more components are joined, with the bound that token positions put on the
overlap, and every pair that passes all orders is verified. Groups are exact; no pair is left out for the size of its group.

Defined results: null and word-less texts have empty sets, link with nothing and form groups of their own. A text of fewer
words than a shingle has one shingle, the whole. Repeated rows are one class. The id of a group is its smallest id; null ids
are ignored where another member has one. Empty tables give no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType

from tessera.llm._shared import Scratch, discard, hashed_words, maybe_among, mix, range_hash, written

SHINGLE, PERCENT = 3, 90
#: Global token orders that a pair must pass.
ORDERS = 3
#: Frequent tokens kept; a token counts as frequent in a batch from this share of its documents on.
FREQUENT, SHARE = 65_536, 0.002
#: Bins of the one-permutation sketch, buckets of a class, and least agreement worth a comparison with a pivot.
BINS, STARS, AGREE = 32, 4, 0.75
#: Least agreement with the pivot of a bucket for a class to be decided in it.
LIKE = 0.25
#: Classes and shingles of a bucket that is decided pair by pair of its blocks, and of a block.
BUCKET, BUCKET_SHINGLES = 4096, 2_000_000
BLOCK, BLOCK_SHINGLES = 200, 200_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: Iterable[str | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of k consecutive words, of all words if they are fewer."""
    for _, w in hashed_words(texts, lower=True):
        h = w.hash + np.uint64(k)
        rolled = h
        for i in range(1, k):
            rolled = mix(rolled[:-1]) * _GOLD + h[i:] if len(h) > i else h[:0]
        rolled = mix(rolled)
        for first, n in zip(w.first.tolist(), w.sizes.tolist(), strict=True):
            if n >= k:
                yield np.unique(rolled[first : first + n - k + 1])
            elif n:
                whole = range_hash(h, np.array([first]), np.array([first + n]))
                yield whole
            else:
                yield h[:0]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def _frequent(k: int, share: float):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingles(b["text"], k))
            tokens, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
            keep = n >= max(3, share * len(sets))
            yield pd.DataFrame({"token": tokens[keep].view(np.int64), "n": n[keep].astype(np.int64)})

    return count


def levels(tokens: np.ndarray, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The level of frequency of each token, 0 for those not in the table (whose tokens are sorted)."""
    if not len(common):
        return np.zeros(len(tokens), np.uint64)
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    return np.where(common[at] == tokens, level[at], np.uint64(0))


def order_keys(tokens: np.ndarray, order: int, level: np.ndarray) -> np.ndarray:
    """Where tokens stand in a global order: level of frequency in the six high bits, a hash of the order's own below."""
    seed = np.uint64((0x51_7C_C1_B7_27_22_0A_95 * (order + 1)) & (2**64 - 1))
    return mix(tokens ^ seed) >> np.uint64(6) | level << np.uint64(58)


def sketch(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four least hashes (one in each quarter of the hash range) and 16 bits of the least hash of each bin."""
    m = np.sort(mix(tokens * _GOLD + np.uint64(1)))
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(59)
    at = np.searchsorted(m, edges)
    ends = np.append(at[1:], len(m))
    full = at < ends
    low = np.zeros(BINS, np.uint16)
    low[full] = (m[at[full]] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    step = BINS // STARS
    least = np.array([m[at[s]] if at[s] < ends[s + step - 1] else (q + 1) * 0x1234567 for q, s in enumerate(range(0, BINS, step))], dtype=np.uint64)
    return least, low


def _signs(k: int, percent: int, common: np.ndarray, level: np.ndarray):
    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingles(b["text"], k))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            lev = levels(flat, common, level)
            keys = [order_keys(flat, order, lev) for order in range(ORDERS)]
            out, at = [], 0
            for s in sets:
                n = len(s)
                if not n:
                    out.append((0, None, None, None, None, None, None))
                    continue
                p = min(n, prefix_length(n, percent))
                pre = [np.sort(np.partition(x[at : at + n], p - 1)[:p]) for x in keys]
                rare = int((lev[at : at + n] == 0).sum())
                # Of the other orders' tokens 16 bits are kept: more pairs may pass, none that should is lost.
                short = [x.astype("<u2").tobytes() for x in pre[1:]]
                least, low = sketch(s)
                out.append((n, hashlib.md5(s.tobytes()).digest(), pre[0].astype("<u8").tobytes(), short, least.view(np.int64), low.tobytes(), rare))
                at += n
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pd.DataFrame({"row": b["row"], "doc_id": b["doc_id"], "_d": b["_d"], "_th": b["_th"], "n": pd.Series(cols[0], dtype="int64"), "class": cols[1], "prefix": cols[2], "others": cols[3], "least": cols[4], "low": cols[5], "rare": pd.Series(cols[6], dtype="Int32")})

    return signs


SIGNS = "row long, doc_id long, _d long, _th long, n long, class binary, prefix binary, others array<binary>, least array<long>, low binary, rare int"


@F.pandas_udf(ArrayType(LongType()))
def _tokens(packed: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(x, dtype="<i8") for x in packed])


@F.pandas_udf(DoubleType())
def _agreement(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean()) for a, b in zip(x, y, strict=True)], dtype=float)


def _meet(percent: int):
    """Whether the prefixes of two classes share, in each of the other orders, as many tokens as similar sets must.

    Similar sets share at least percent (n + m) / (100 + percent) tokens. Of the prefix that ends first in the order, all but
    n less that number are shared, and lie in the other prefix too.
    """

    @F.pandas_udf(BooleanType())
    def meet(n: pd.Series, x: pd.Series, m: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, p, b, q in zip(n, x, m, y, strict=True):
            both = -(-percent * (a + b) // (100 + percent))
            need = max(1, min(len(p[0]) // 2 - (a - both), len(q[0]) // 2 - (b - both)))
            out.append(all(np.isin(np.frombuffer(s, "<u2"), np.frombuffer(t, "<u2")).sum() >= need for s, t in zip(p, q, strict=True)))
        return pd.Series(out, dtype=bool)

    return meet


def _linked(k: int, percent: int):
    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        last, out = (None, None), []
        for a, b in zip(x, y, strict=True):
            if last[0] != b:  # pairs come in order of y
                last = b, next(shingles([b], k))
            s, t = next(shingles([a], k)), last[1]
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * both >= percent * (len(s) + len(t) - both))
        return pd.Series(out, dtype=bool)

    return linked


class Bits:
    """Sets as rows of bits over the tokens that two or more of them hold."""

    def __init__(self, sets: list[np.ndarray], most: int = 1 << 26):
        tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        met = np.bincount(at, minlength=len(tokens)) > 1
        column = np.cumsum(met) - 1
        width = -(-int(met.sum()) // 64)
        ends = np.cumsum([len(s) for s in sets])
        self.rows = np.zeros((len(sets), width), np.uint64)
        step = max(1, most // max(1, width * 64))  # rows unpacked at a time
        for lo in range(0, len(sets) if width else 0, step):
            part = slice(ends[lo] - len(sets[lo]), ends[min(lo + step, len(sets)) - 1])
            row = np.repeat(np.arange(len(sets[lo : lo + step])), [len(s) for s in sets[lo : lo + step]])
            own = met[at[part]]
            bits = np.zeros((len(sets[lo : lo + step]), width * 64), np.uint8)
            bits[row[own], column[at[part][own]]] = 1
            self.rows[lo : lo + step] = np.packbits(bits, axis=1).view(np.uint64)

    def shared(self, i: int, js: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.rows[js] & self.rows[i]).sum(axis=1, dtype=np.int64)

    def meet(self, i: int, js: np.ndarray) -> np.ndarray:
        return (self.rows[js] & self.rows[i]).any(axis=1)


def prefixes(sets: list[np.ndarray], percent: int, common: np.ndarray, level: np.ndarray, orders: int = ORDERS) -> list[list[np.ndarray]]:
    """For each global order the prefix of each set, as places in that order."""
    flat = np.concatenate(sets)
    ends, lev = np.cumsum([len(s) for s in sets]).tolist(), levels(flat, common, level)
    out = []
    for order in range(orders):
        keys = order_keys(flat, order, lev)
        own = []
        for s, end in zip(sets, ends, strict=True):
            p = min(len(s), prefix_length(len(s), percent))
            own.append(np.partition(keys[end - len(s) : end], p - 1)[:p])
        out.append(own)
    return out


def spanning(sets: list[np.ndarray], percent: int, common: np.ndarray, level: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (indexes of non-empty sets: a member, the least member) of the parts that similar pairs make.

    A pair is a candidate if its prefixes meet under every order; candidates not yet linked are compared in full. With ``side``
    only pairs of different sides count.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    side = None if side is None else side[order]
    sizes = np.array([len(s) for s in sets])
    filters = [Bits(p) for p in prefixes(sets, percent, common, level)]
    whole = Bits(sets)
    root = np.arange(len(sets))
    for i in range(len(sets) - 1):
        js = np.arange(i + 1, np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        js = js[root[js] != root[i]]
        if side is not None:
            js = js[side[js] != side[i]]
        for f in filters:
            if len(js):
                js = js[f.meet(i, js)]
        if not len(js):
            continue
        both = whole.shared(i, js)
        for j in js[100 * both >= percent * (sizes[js] + sizes[i] - both)].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
    least = {}
    for r, i in zip(root.tolist(), order.tolist(), strict=True):
        least[r] = min(i, least.get(r, i))
    return [(i, least[r]) for r, i in zip(root.tolist(), order.tolist(), strict=True) if least[r] != i]


def _sets(k: int):
    """Shingles of texts as bytes, once for all the blocks that a class goes to."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b[lo : lo + 256]
                yield pd.DataFrame({"node": part["node"], "done": part["done"], "set": [s.tobytes() for s in shingles(part["text"], k)]})

    return packed


def _decide(percent: int, common: np.ndarray, level: np.ndarray):
    """Pairs of blocks, sorted, one after the other: the links that span each. A class stands once in a pair of blocks."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(key: tuple, nodes: list[int], blocks: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
            side = None if key[1] == key[2] else np.array(blocks)
            found = spanning(sets, percent, common, level, side)
            return pd.DataFrame([(nodes[a], nodes[b]) for a, b in found], columns=["x", "y"])

        at, nodes, blocks, sets = None, [], [], []
        for b in batches:
            for *key, block, node, packed in zip(*(b[c].tolist() for c in ("bucket", "i", "j", "block", "node")), b["set"], strict=True):
                if key != at:
                    if len(nodes) > 1:
                        yield links(at, nodes, blocks, sets)
                    at, nodes, blocks, sets = key, [], [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node), blocks.append(block), sets.append(np.frombuffer(bytes(packed), np.uint64))
        if len(nodes) > 1:
            yield links(at, nodes, blocks, sets)

    return decide


def components(edges: DataFrame, written=written) -> DataFrame:
    """node, component (the least node reachable) for every node of the edges x, y; alternating large and small stars."""
    now = written(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        # Large star: each neighbour above u goes to the least of u and its neighbours.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written apart, so that Spark can split the edges of a vertex that has very many.
        lows = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-low")
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its neighbours below go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        last, now = now, written(small.distinct(), "links")
        discard(last)
        discard(lows)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def groups(df: DataFrame, id_: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, share: float = SHARE, frequent: int = FREQUENT, bucket: int = BUCKET, bucket_shingles: int = BUCKET_SHINGLES, block: int = BLOCK, rows_apart: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; with ``rows_apart`` also text_hash (xxhash64) and group, which no null id hides."""
    spark = df.sparkSession
    scratch = Scratch()
    written = scratch.written
    texts = df.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = texts.withColumns({"_d": F.coalesce("doc_id", F.lit(0)), "_th": F.xxhash64("text")})
    heavy = texts.select("text").mapInPandas(_frequent(shingle, share), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    heavy = written(heavy.select("token", F.least(F.length(F.bin("n")), F.lit(63)).alias("level")), "join-heavy")
    # The highest levels of frequency that fit the table as wholes: at most 63 rows tell which, and ``frequent`` rows are collected.
    total, least = 0, 64
    for r in sorted(heavy.groupBy("level").count().collect(), key=lambda r: -r.level):
        total += r["count"]
        if total > frequent:
            break
        least = r.level
    rows = heavy.where(F.col("level") >= least).collect()
    common = np.array([r.token for r in rows], dtype=np.int64).view(np.uint64)
    level = np.array([r.level for r in rows], dtype=np.uint64)
    by_token = np.argsort(common)
    common, level = common[by_token], level[by_token]
    signs = texts.withColumn("row", F.monotonically_increasing_id()).mapInPandas(_signs(shingle, percent, common, level), SIGNS)
    signs = written(signs, "join-signs")
    reps = written(signs.where("n > 0").groupBy("class").agg(F.min("row").alias("node"), F.min("doc_id").alias("low")), "join-classes")
    nodes = written(signs.drop("class", "doc_id").join(reps.select("node").hint("merge"), F.col("row") == F.col("node")).drop("row"), "join-nodes")
    members = written(signs.select("doc_id", "n", "class", *(["_th"] if rows_apart else [])), "join-members")
    scratch.clear(reps, nodes, members)
    del heavy, signs
    where = nodes.select("node", "_d", "_th")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs x, y of classes whose texts are similar enough."""
        pairs = written(pairs, "join-pairs")
        need = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct().join(where, "node")
        need = written(need, "join-need")
        got = maybe_among(texts.select("_d", "_th", "text"), need, ["_d", "_th"]).join(need, ["_d", "_th"]).select("node", "text")
        fetched = written(got, "join-texts")
        got = fetched.dropDuplicates(["node"])
        x, y = got.select(F.col("node").alias("x"), F.col("text").alias("tx")), got.select(F.col("node").alias("y"), F.col("text").alias("ty"))
        links = pairs.join(x, "x").join(y, "y").where(_linked(shingle, percent)(F.col("tx"), F.col("ty"))).select("x", "y")
        links = written(links, "join-links")
        del got, fetched, x, y
        return links

    # Buckets of two or more classes; those within the bound are decided in full.
    own = [F.xxhash64(F.lit(q), F.col("least")[q]) for q in range(STARS)]
    stars = nodes.select("node", "n", "low", "rare", F.array(*own).alias("all")).withColumn("bucket", F.explode("all"))
    # Classes meet by chance too: who hardly agrees with the bucket's pivot leaves it, and is then not held decided there.
    first = stars.groupBy("bucket").agg(F.min_by(F.struct("low", "n"), F.struct("rare", F.xxhash64("node", "bucket"))).alias("p"), F.count("*").alias("m")).where("m > 1")
    stars = stars.join(written(first.drop("m"), "join-first"), "bucket").where(_agreement(F.col("low"), F.col("p.low")) >= LIKE)
    stars = written(stars.select("node", "n", "all", "bucket"), "join-stars")
    shared = [F.when(F.min(F.col("all")[q]) == F.max(F.col("all")[q]), F.min(F.col("all")[q])) for q in range(STARS)]
    sizes = stars.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("sum"), F.array(*shared).alias("shared")).where("m > 1")
    sizes = written(sizes.withColumn("fits", (F.col("m") <= bucket) & (F.col("sum") <= bucket_shingles)), "join-buckets")
    # A bucket whose classes all lie in a larger one (of equals the lesser key) is decided there.
    over = sizes.select(F.col("bucket").alias("o"), F.col("m").alias("om")).where("fits")
    inside = sizes.select("bucket", "m", F.explode("shared").alias("o")).where("o <> bucket").join(over, "o").where("om > m OR om = m AND o < bucket")
    whole = sizes.where("fits").join(inside.select("bucket").distinct(), "bucket", "left_anti").select("bucket")
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("sum") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    whole = written(sizes.where("fits").join(inside.select("bucket").distinct(), "bucket", "left_anti").select("bucket", blocks), "join-whole")
    decided = stars.select("node", "bucket").join(whole, "bucket")
    mine = decided.groupBy("node").agg(F.collect_set(F.struct("bucket", "blocks")).alias("done")).join(where, "node")  # four at most
    mine = written(mine, "join-done")
    sets = maybe_among(texts.select("_d", "_th", "text"), mine, ["_d", "_th"]).join(mine, ["_d", "_th"]).select("node", "done", "text")
    sets = written(sets.mapInPandas(_sets(shingle), "node long, done array<struct<bucket:long,blocks:int>>, set binary"), "join-sets")
    send = sets.select("node", "set", F.explode("done").alias("one")).select("node", "set", "one.*")
    send = send.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    send = send.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    send = send.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "set")
    links = send.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInPandas(_decide(percent, common, level), "x long, y long")
    links = written(links, "join-links")
    discard(sets)
    mine = mine.withColumn("done", F.col("done.bucket"))
    del send, decided, whole, inside, over
    large = sizes.where("not fits").select("bucket")
    if not large.isEmpty():
        near = written(stars.select("node", "bucket").join(large, "bucket").join(nodes.select("node", "n", "low", "rare"), "node"), "join-large")
        pivot = near.groupBy("bucket").agg(F.min_by(F.struct("node", "n", "low"), F.struct("rare", F.xxhash64("node", "bucket"))).alias("p"))
        near = near.join(written(pivot, "join-pivots"), "bucket").where((F.col("node") != F.col("p.node")) & (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")))
        links = links.union(verified(near.where(_agreement(F.col("low"), F.col("p.low")) >= AGREE).select(F.col("node").alias("x"), F.col("p.node").alias("y")).distinct()))
    joined = scratch.written(_joined(nodes, links, written), "join-components")
    tokens = nodes.select("node", "n", F.posexplode(_tokens("prefix")).alias("i", "token"))
    met = written(tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "join-met")
    shared = written(tokens.join(met.hint("merge"), "token"), "join-shared")
    del tokens
    placed = written(shared.join(joined, "node").join(mine.select("node", "done"), "node", "left"), "join-placed")
    discard(shared)
    crossing = written(placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token"), "join-tokens")
    left = written(placed.join(crossing.hint("merge"), "token"), "join-crossing")
    discard(placed)
    a, b = left.alias("a"), left.alias("b")
    size = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    # If this is the first token they share, no more than what follows it can be shared.
    place = (100 + percent) * F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= percent * (F.col("a.n") + F.col("b.n"))
    apart = (F.col("a.component") != F.col("b.component")) & ~F.coalesce(F.arrays_overlap("a.done", "b.done"), F.lit(False))
    pairs = a.join(b, F.col("a.token") == F.col("b.token")).where((F.col("a.node") < F.col("b.node")) & apart & size & place)
    pairs = written(pairs.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct(), "join-candidates")
    discard(left)
    ends = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct()
    end = written(maybe_among(nodes.select("node", "n", "others"), ends, ["node"]).join(ends, "node"), "join-ends")
    x, y = (end.select(F.col("node").alias(c), F.struct("n", "others").alias(f"p{c}")) for c in "xy")
    pairs = pairs.join(x, "x").join(y, "y").where(_meet(percent)(F.col("px.n"), F.col("px.others"), F.col("py.n"), F.col("py.others"))).select("x", "y")
    links = links.union(verified(pairs))
    joined = scratch.written(_joined(nodes, links, written), "join-components")
    lows = reps.select("node", "low").join(joined, "node")
    least = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = reps.select("class", "node").join(joined, "node").join(least, "component").select("class", "component_id", "component")
    by_class = written(by_class, "join-groups")
    scratch.clear(members, by_class)
    del reps, nodes, joined, lows, least, left, a, b, x, y, ends, end, pairs, links, mine, stars, sizes, shared, placed
    out = members.withColumnRenamed("n", "n_shingles").join(by_class, "class", "left")
    more = [F.col("_th").alias("text_hash"), F.col("component").alias("group")] if rows_apart else []
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)


def _joined(nodes: DataFrame, links: DataFrame, written=written) -> DataFrame:
    """node, component for all nodes."""
    return nodes.select("node").join(components(links, written), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
