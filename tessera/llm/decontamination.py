"""Benchmark decontamination: documents that hold a benchmark item within an edit distance.

Words are the letters and digits between other characters, lower-cased, so case, punctuation and spacing do not matter. An
item of n words is found if some stretch of a document is at most floor(n / 5) word edits away from it (a similarity of 0.8).

1. A lossless count filter picks where to look: a stretch within e edits shares at least n - q + 1 - q e of the item's
   q-grams with it, on diagonals that differ by at most e.
2. There, windows as long as the item are embedded by CGK walks: a pointer moves along the words, emits the word under it
   at each of 3 n steps, and advances or stays as a random bit for (step, word) says. Few edits leave few differing steps, so
   bit sampling finds them: each of several walks has tables keyed by a few sampled steps, enough that a window at the
   largest distance misses all of them less often than one in a hundred.
3. Windows that share a key with the item are verified by the exact edit distance of the item to the stretch around them.

Items go out to the executors in blocks of a bounded number and size, all of them in one pass over the documents; nothing
is shuffled. Items of fewer than ``least`` words are skipped: a word or two in a row tell no leak from chance.
Null and empty texts hold nothing; null items are skipped; items of equal text are each reported. Very long texts are read
whole. Of stretches equally near to an item the first in the text is reported. Repeated rows are judged alike; empty tables
give no rows. Other columns pass through; ``leaks`` replaces a column of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import mix, shipped, unpacked

#: Edits allowed: one in so many words.
EDIT_EVERY = 5
WALKS, TABLES, SAMPLED = 12, 24, 2
#: Items of one broadcast, and characters of them.
BLOCK, BLOCK_CHARS = 5000, 4_000_000
#: Words an item must have.
LEAST = 3
LEAKS = "array<struct<item_id:long,start:int,end:int,edits:int>>"
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def gram_size(n: int, every: int = EDIT_EVERY) -> int:
    """The longest q-gram, 3 at most, for which the count filter still asks for one shared gram."""
    return next((q for q in (3, 2, 1) if n >= q and n - q + 1 - q * (n // every) >= 1), 1)


def walk(ids: np.ndarray, starts: np.ndarray, steps: int, end: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """What CGK walks emit from each start (rows) under each seed: rows x walks x steps, -1 beyond the window's end."""
    at = np.repeat(starts[:, None], len(seeds), axis=1)
    stop = end[:, None]
    out = np.empty((len(starts), len(seeds), steps), np.int64)
    for j in range(steps):
        inside = at < stop
        word = np.where(inside, ids[np.minimum(at, len(ids) - 1)], -1)
        out[:, :, j] = word
        bit = mix(word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seeds[None, :] + np.uint64(j)) & np.uint64(1)
        at += (bit.astype(np.int64)) & inside
    return out


def edits_within(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of text nearest to the item, the first of equals; None beyond ``most`` edits."""
    far = most + 1
    cost, origin = [0] * (len(text) + 1), list(range(len(text) + 1))
    for i, w in enumerate(item, 1):
        last, last_from = cost[0], origin[0]
        cost[0] = i
        for j, x in enumerate(text, 1):
            up, up_from = cost[j], origin[j]
            best, came = last + (w != x), last_from
            if up + 1 < best:
                best, came = up + 1, up_from
            if cost[j - 1] + 1 < best:
                best, came = cost[j - 1] + 1, origin[j - 1]
            last, last_from = up, up_from
            cost[j], origin[j] = best, came
    end = min(range(len(text) + 1), key=lambda j: (cost[j], j))
    return (cost[end], origin[end], end) if cost[end] < far else None


class Index:
    """Grams and embeddings of the items of one block."""

    def __init__(self, items: list[tuple[int, str]], every: int = EDIT_EVERY, least: int = LEAST, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int, int]] = []  # id, words, edits, gram size
        grams: dict[int, list[tuple[int, int, int]]] = {1: [], 2: [], 3: []}
        for item_id, text in items:
            ws = words(text)
            if len(ws) < max(1, least):
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], dtype=np.int64)
            q = gram_size(len(ids), every)
            for at, code in enumerate(self._codes(ids, q).tolist()):
                grams[q].append((code, len(self.items), at))
            self.items.append((item_id, ids, len(ids) // every, q))
        self.grams = {q: np.array(sorted(g), dtype=np.int64) for q, g in grams.items() if g}
        self.seeds = rng.integers(0, 2**63, WALKS, dtype=np.uint64)
        self.draws = rng.random((TABLES, SAMPLED))

    @staticmethod
    def _codes(ids: np.ndarray, q: int) -> np.ndarray:
        """A number for every q words; -1 where one of them is in no item."""
        n = len(ids) - q + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(q):
            out = out * (1 << 21) + ids[k : k + n]
            known &= ids[k : k + n] > 0
        return np.where(known, out, -1)

    def keys(self, ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Sampled steps of the embeddings of windows of n words: windows x walks x tables x samples."""
        emitted = walk(ids, starts, 3 * n, np.minimum(starts + n, len(ids)), self.seeds)
        return emitted[:, :, (self.draws * 2 * n).astype(np.int64)]  # later steps are mostly beyond the end

    def near(self, ids: np.ndarray, item: int, lo: int, hi: int) -> bool:
        """Whether a window that starts in lo..hi shares a key with the item."""
        own = self.items[item][1]
        if not hasattr(self, "_own"):
            self._own: dict[int, np.ndarray] = {}
        if item not in self._own:
            self._own[item] = self.keys(own, np.zeros(1, np.int64), len(own))
        lo, hi = max(0, lo), min(hi, len(ids) - 1)
        if lo > hi:
            return False
        got = self.keys(ids, np.arange(lo, hi + 1), len(own))
        return bool((got == self._own[item]).all(axis=3).any())

    def leaks(self, ws: list[str]) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of every item that the words hold, in the order of items."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in ws], dtype=np.int64)
        hits: dict[int, list[int]] = {}
        for q, table in self.grams.items():
            codes = self._codes(ids, q)
            at = np.flatnonzero(codes >= 0)
            if not len(at):
                continue
            lo, hi = np.searchsorted(table[:, 0], codes[at], "left"), np.searchsorted(table[:, 0], codes[at], "right")
            some = hi > lo
            n = (hi - lo)[some]
            if not len(n):
                continue
            row = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for item, diagonal in zip(table[row, 1].tolist(), (np.repeat(at[some], n) - table[row, 2]).tolist(), strict=True):
                hits.setdefault(item, []).append(diagonal)
        out = []
        for item in sorted(hits):
            item_id, own, most, q = self.items[item]
            need = len(own) - q + 1 - q * most
            if len(hits[item]) < need:
                continue
            best, text = None, None
            for lo, hi in _regions(sorted(hits[item]), need, most):
                if not self.near(ids, item, lo - most, hi + most):
                    continue
                a, b = max(0, lo - 2 * most), min(len(ids), hi + len(own) + 2 * most)
                got = edits_within(own.tolist(), ids[a:b].tolist(), most)
                if got and (best is None or got[0] < best[3]):
                    best = (item_id, a + got[1], a + got[2], got[0])
                    if not got[0]:
                        break
            if best:
                out.append(best)
        return out


def _regions(diagonals: list[int], need: int, width: int) -> Iterator[tuple[int, int]]:
    """Stretches of diagonals around ``need`` hits no more than ``width`` apart, those that overlap as one."""
    at = [(diagonals[i], diagonals[i + need - 1]) for i in range(len(diagonals) - need + 1) if diagonals[i + need - 1] - diagonals[i] <= width]
    held = None
    for lo, hi in at:
        if held and lo <= held[1] + 1 and hi - held[0] <= 8 * width + 8:
            held = held[0], max(hi, held[1])
        else:
            if held:
                yield held
            held = lo, hi
    if held:
        yield held


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", every: int = EDIT_EVERY, least: int = LEAST, block: int = BLOCK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` with ``leaks``: the items that each text holds, where, and how many edits away."""
    spark = df.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // block), -(-size.chars // block_chars))
    sent = []
    for n in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n).orderBy("i", "t").collect()  # some ``block`` items
        sent.append(shipped(spark, Index([(r.i, r.t) for r in part], every, least)))
    return df.drop("leaks").withColumn("leaks", _held(sent)(F.col(text)))


def _held(sent: list):
    @F.pandas_udf(LEAKS)
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        indexes = [unpacked(s) for s in sent]
        names = ("item_id", "start", "end", "edits")
        for b in batches:
            found = ([x for index in indexes for x in index.leaks(ws)] for ws in map(words, b))
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in sorted(own)] for own in found], dtype=object)

    return held
