"""Approximate nearest neighbours by a hash-prefix forest.

A row's hash bits are the signs of ``pool`` projections of its centred vector; a tree's hash string is ``bits`` of them in the
tree's own order, as one unsigned number. Rows are cut into blocks of a bounded number; in a block each tree is the sorted
array of its strings. A query descends every tree to its longest matching prefix, and then ascends all trees together, one bit
at a time. At each depth it meets the rows that share the prefix in some tree, until ``reach`` times as many rows are met as
are wanted; the wanted ones are those met most often, over trees and depths, and all that tie with the last of them, so that
no group of copies is cut. They are measured exactly, and the block keeps its k best of each query, which is all that is
shuffled. Queries are a stated set, handled in blocks too, each small enough to broadcast, one after the other; each result
is written and its broadcast dropped before the next.

``share`` of a block's rows (``least`` at least) are wanted. In data without structure (independent directions in many
dimensions) near and far rows differ in few bits, and this share is what recall takes; in clustered data it can be lower.

Vectors that are null, zero, of another length than ``dims`` (else the most frequent length), or hold null or non-finite
components take no part, nor do rows without an id. Rows with the query's own id are not its candidates. Rows that repeat an
id count once each. Ties go to the smaller id. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import written

TREES, BITS, POOL = 160, 24, 512
#: Rows to be measured, as a share of a block's rows, and at least; rows to be met, as a multiple of them.
SHARE, LEAST, REACH = 0.22, 200, 4
#: Rows of a block of the index, and queries of a block that is broadcast (64 components: 4 MB).
BLOCK, QUERIES = 8192, 8192
NEIGHBOURS = "query_id long, vec_id long, score double"
RANKED = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


class Hashes:
    """The projections, and which of their signs each tree reads in which order."""

    def __init__(self, centre: np.ndarray, trees: int = TREES, bits: int = BITS, pool: int = POOL, seed: int = 7):
        rng, dims = np.random.default_rng(seed), len(centre)
        # Directions in orthogonal sets: their signs say more than those of independent ones.
        sets = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-pool // dims))]
        self.centre, self.planes = centre, np.concatenate(sets)[:pool]
        self.picks = np.stack([rng.permutation(pool)[:bits] for _ in range(trees)])
        self.bits = bits

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """trees x rows, uint32: the first bit a tree reads is the highest."""
        signs = ((vectors - self.centre) @ self.planes.T > 0).T
        out = np.zeros((len(self.picks), len(vectors)), np.uint32)
        for t, pick in enumerate(self.picks):
            for b in pick:
                out[t] = (out[t] << np.uint32(1)) | signs[b]
        return out


class Forest:
    """Sorted arrays of hash strings over the rows of one block."""

    def __init__(self, vectors: np.ndarray, hashes: Hashes):
        self.hashes = hashes
        keys = hashes.strings(vectors)
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(keys, self.order, axis=1)

    def candidates(self, queries: np.ndarray, wanted: int, reach: int = REACH) -> Iterator[np.ndarray]:
        """For each query the ``wanted`` rows, and their ties, that it meets most often while it ascends."""
        trees, n = self.sorted.shape
        bits = self.hashes.bits
        keys = self.hashes.strings(queries).astype(np.uint64)
        lo, hi = (np.zeros((bits + 1, trees, len(queries)), np.int32) for _ in range(2))
        for depth in range(bits + 1):
            drop = np.uint64(bits - depth)
            low = (keys >> drop) << drop
            high = low + ((np.uint64(1) << drop) - np.uint64(1))
            for t in range(trees):
                lo[depth, t] = np.searchsorted(self.sorted[t], low[t].astype(np.uint32), "left")
                hi[depth, t] = np.searchsorted(self.sorted[t], high[t].astype(np.uint32), "right")
        wanted = min(wanted, n)
        for q in range(len(queries)):
            met = np.zeros(n, np.int32)
            for depth in range(bits, -1, -1):
                for t in np.flatnonzero(hi[depth, :, q] > lo[depth, :, q]):
                    met[self.order[t, lo[depth, t, q] : hi[depth, t, q]]] += 1
                if np.count_nonzero(met) >= min(n, reach * wanted):
                    break
            seen = np.flatnonzero(met)
            if len(seen) > wanted:
                seen = seen[met[seen] >= np.partition(met[seen], len(seen) - wanted)[len(seen) - wanted]]
            yield seen


def neighbours(df: DataFrame, is_query: Column, k: int = 10, id_: str = "vec_id", vector: str = "embedding", dims: int | None = None, trees: int = TREES, bits: int = BITS, pool: int = POOL, share: float = SHARE, least: int = LEAST, block: int = BLOCK, query_block: int = QUERIES, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query`` holds."""
    spark = df.sparkSession
    rows = df.where(is_query.isNotNull()).select(F.col(id_).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    dims = dims or rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").select("d").limit(1).agg(F.max("d")).first()[0]
    if dims is None:
        return spark.createDataFrame([], RANKED)
    rows = rows.where(F.size("v") == dims)
    centre = np.array([x or 0.0 for x in rows.agg(*[F.avg(F.col("v")[i]) for i in range(dims)]).first()])
    hashes = Hashes(centre, trees, bits, pool, seed)
    asked = rows.where("q").select("vec_id", "v")
    blocks = max(1, -(-asked.count() // query_block))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = None
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()  # some query_block rows
        if not part:
            continue
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in part]), np.array([r.v for r in part])))
        del part
        found = rows.select("vec_id", "v").mapInPandas(_search(sent, hashes, k, share, least, block), NEIGHBOURS)
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = written(found, "neighbours")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], RANKED) if out is None else out


def _search(sent, hashes: Hashes, k: int, share: float, least: int, block: int):
    dims = len(hashes.centre)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for b in batches:
            held.append((b["vec_id"].to_numpy(np.int64), np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, dims))))
            count += len(b)
            if count >= block:
                yield in_block(held)
                held, count = [], 0
        if count:
            yield in_block(held)

    def in_block(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        asked, points = sent.value
        own, x = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
        forest = Forest(x, hashes)
        norms = (x * x).sum(1)
        out_q, out_v, out_s = [], [], []
        for lo in range(0, len(asked), 256):
            part = points[lo : lo + 256]
            for q, p, near in zip(asked[lo : lo + 256], part, forest.candidates(part, max(least, int(share * len(x)))), strict=True):
                near = near[own[near] != q]
                if not len(near):
                    continue
                rough = norms[near] - 2.0 * (x[near] @ p)
                if len(near) > k:  # rounding of the rough measure is far below this margin
                    bound = np.partition(rough, k - 1)[k - 1]
                    near = near[rough <= bound + 1e-9 * (1 + abs(bound) + norms[near].max() + p @ p)]
                score = np.sqrt(((x[near] - p) ** 2).sum(1))
                top = np.lexsort((own[near], score))[:k]
                out_q.append(np.full(len(top), q)), out_v.append(own[near][top]), out_s.append(score[top])
        if not out_q:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return search
