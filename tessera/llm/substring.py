"""Substring deduplication: remove every word of a window of ``length`` words that also starts somewhere else.

Reference shards hold the passages that may repeat. In a window, the k-gram with the least hash is its anchor, so equal
windows have equal anchors, and the windows of one anchor occurrence are consecutive: together they are a passage, and
each window of the corpus lies in exactly one passage. Anchors that occur once are done with. Of the others, equal
passages are counted before any text moves; one occurrence of each distinct passage is then sent to the shard that its
anchor's hash names, bounded batches of whole anchors become suffix automata there, and every passage is streamed through
its automaton for matching statistics, counting copies. Where a factor of at least ``length`` words occurs twice or more,
its windows are marked; marks return to all occurrences of the passage, and the maximal covered spans are removed.

Automata of the whole reference are not broadcast: the reference grows with the corpus, and each document would have to
be streamed through each shard. Shards are met by anchor instead, so that a document meets only the shards its passages
name. An anchor with more distinct passages than ``crowd`` (a phrase set in ever different surroundings) would make a shard
without bound; the passages of such anchors are reference and documents of a finer round, whose anchors are twice as long.
Where the anchor is the whole window, a shard is one window, so the rounds end, and each marks by automata.

Rows are told apart by id and text hash, so repeated ids do no harm; repeated rows are occurrences of each other. Null and
short texts have no windows and are kept whole. Empty tables give no rows. Other columns pass through; new columns are
n_words, n_removed, kept (the kept words joined by one space) and remains (the text without the removed words, what stands
between the others as it was), which replace columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import BASE, OTHER, Scratch, discard, hashed_words, maybe_among, mix, range_hash, utf8, words
from tessera.llm.suffix import SuffixAutomaton

LENGTH, GRAM = 35, 12
#: Distinct passages of one anchor that a shard may hold, and words of the passages that make one automaton.
CROWD, SHARD_WORDS = 256, 20_000

NEW = ("n_words", "n_removed", "kept", "remains")
_BITS = np.uint64(26)  # of a word's position in a chunk of texts


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * np.uint64(BASE) + y)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, built from halves."""
    size, have, out, done = 1, h, None, 0
    while done < k:
        if k & size:
            out = have if out is None else _joined(out[: len(h) - done - size + 1], have[done:][: len(h) - done - size + 1])
            done += size
        if done < k:
            have = _joined(have[:-size], have[size:]) if len(have) > size else have[:0]
            size *= 2
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive entries."""
    size, have = 1, x
    while size * 2 <= width:
        have, size = np.minimum(have[:-size], have[size:]), size * 2
    rest = width - size
    return np.minimum(have[:-rest], have[rest:]) if rest else have


def passages(h: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Passages of texts laid end to end: text, first and last window start (in the chunk), anchor hash, content hash."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(h) < length:
        return none
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    g = grams(h, gram)
    key = ((g >> _BITS) << _BITS) | np.arange(len(g), dtype=np.uint64)
    owner = (_least(key, length - gram + 1) & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
    at = np.flatnonzero(np.arange(len(owner)) + length <= (starts + sizes)[text[: len(owner)]])
    if not len(at):
        return none
    own = owner[at]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    lo, hi = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1]
    return text[lo], lo, hi, mix(g[own[new]] ^ np.uint64(OTHER)), range_hash(h, lo, hi + length)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _find(length: int, gram: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d, th, copies = (b[c].to_numpy(np.int64) for c in ("_d", "_th", "copies"))
            for first, w in hashed_words(b["text"]):
                text, lo, _, anchor, content = passages(w.hash, w.sizes, length, gram)
                yield pd.DataFrame({"a": _signed(anchor), "c": _signed(content), "_d": d[first + text], "_th": th[first + text], "copies": copies[first + text], "lo": (lo - w.first[text]).astype(np.int32)})

    return find


def _fetch(length: int, gram: int):
    """The bytes of the passages whose first windows are listed, each with the copies that it stands for."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = [dict(zip(x.tolist(), n.tolist(), strict=True)) for x, n in zip(b["at"], b["n"], strict=True)]
            for first, w in hashed_words(b["text"]):
                text, lo, hi, anchor, content = passages(w.hash, w.sizes, length, gram)
                at = (lo - w.first[text]).tolist()
                n = np.array([asked[first + t].get(s, 0) for t, s in zip(text.tolist(), at, strict=True)], dtype=np.int64)
                keep = np.flatnonzero(n)
                begin, end = w.start[lo[keep]].tolist(), w.end[hi[keep] + length - 1].tolist()
                yield pd.DataFrame({"a": _signed(anchor[keep]), "c": _signed(content[keep]), "n": n[keep], "passage": [w.raw[s:e] for s, e in zip(begin, end, strict=True)]})

    return fetch


def _match(length: int, shard_words: int):
    """Marks of passages sorted by anchor: automata of whole anchors, then matching statistics."""

    def marks(rows: list[tuple[int, int, int, list[bytes]]]) -> pd.DataFrame:
        automaton = SuffixAutomaton((ws, n) for _, _, n, ws in rows)
        out = []
        for a, c, _, ws in rows:
            hits = [i - length + 1 for i, x in enumerate(automaton.matching_statistics(ws, 2)) if x >= length]
            if hits:
                out.append((a, c, hits))
        return pd.DataFrame(out, columns=["a", "c", "windows"])

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, anchor = [], 0, None
        for b in batches:
            for a, c, n, p in zip(b["a"].tolist(), b["c"].tolist(), b["n"].tolist(), b["passage"], strict=True):
                if a != anchor and size >= shard_words:
                    yield marks(held)
                    held, size = [], 0
                ws = bytes(p).split()
                held.append((a, c, n, ws))
                size += len(ws)
                anchor = a
        if held:
            yield marks(held)

    return match


def repeated_windows(df: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """_d, _th, starts: the first words of the repeated windows of each row that has some.

    ``df``: _d, _th, text (string or its UTF-8), copies (how many rows of the same text a row stands for).
    """
    scratch = Scratch()
    found = scratch.written(df.select("_d", "_th", "copies", "text").mapInPandas(_find(length, gram), "a long, c long, _d long, _th long, copies long, lo int"), "passages")
    # Written apart: a join of two fresh exchanges is one whose hot keys Spark can split.
    again = scratch.written(found.groupBy("a").agg(F.sum("copies").alias("n")).where("n > 1").select("a"), "anchors-repeated")
    met = scratch.written(found.join(again, "a"), "passages-met")
    scratch.clear(met)
    distinct = scratch.written(met.groupBy("a", "c").agg(F.sum("copies").alias("n"), F.min(F.struct("_d", "_th", "lo")).alias("at")), "passages-distinct")
    asked = distinct.select("at._d", "at._th", F.struct("at.lo", "n").alias("one")).groupBy("_d", "_th").agg(F.collect_set("one").alias("asked"))
    # Rows that repeat an id and its text send the same passages, each of which has copies then anyway.
    asked = asked.select("_d", "_th", F.col("asked.lo").alias("at"), F.col("asked.n").alias("n"))
    asked = scratch.written(asked, "passages-asked")
    sent = maybe_among(df, asked, ["_d", "_th"]).join(asked, ["_d", "_th"]).select("text", "at", "n").mapInPandas(_fetch(length, gram), "a long, c long, n long, passage binary")
    sent = scratch.written(sent, "passages-sent")
    small, finer = sent, None
    if gram < length:  # else a shard is one window
        crowded = scratch.written(distinct.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > crowd).select("a"), "anchors-crowded")
        if not crowded.isEmpty():
            small, hot = sent.join(crowded, "a", "left_anti"), sent.join(crowded, "a", "left_semi")
            hot = hot.select(F.col("a").alias("_d"), F.col("c").alias("_th"), F.col("passage").alias("text"), F.col("n").alias("copies"))
            finer = repeated_windows(hot, length, min(2 * gram, length), crowd, shard_words)
    marks = small.repartition("a").sortWithinPartitions("a", "c").mapInPandas(_match(length, shard_words), "a long, c long, windows array<int>")
    if finer is not None:
        marks = marks.unionByName(finer.select(F.col("_d").alias("a"), F.col("_th").alias("c"), F.col("starts").alias("windows")))
    marks = scratch.written(marks, "passages-marked")
    if finer is not None:
        discard(finer)
    starts = met.join(marks, ["a", "c"]).select("_d", "_th", F.transform("windows", lambda w: w + F.col("lo")).alias("s"))
    starts = scratch.written(starts.groupBy("_d", "_th").agg(F.flatten(F.collect_set("s")).alias("starts")), "passages-starts")
    scratch.clear(starts)
    return starts


_RUN = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+")


def without(text: bytes, keep: np.ndarray) -> bytes:
    """A text of which only the words marked remain, each with the white space before it; none at the beginning if words go there."""
    runs = _RUN.findall(text)
    end = text[sum(map(len, runs)) :]
    out = b"".join(r for r, k in zip(runs, keep.tolist(), strict=True) if k) + end
    return out if not len(keep) or keep[0] else out.lstrip(b" \t\n\x0b\x0c\r")


def _keep(length: int):
    @F.pandas_udf("n_words long, n_removed long, kept string, remains string")
    def keep(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, starts, strict=True):
            ws = words(t)
            removed, rest = 0, t
            if s is not None and len(s):
                edge = np.zeros(len(ws) + 1, dtype=np.int64)
                s = np.unique(np.asarray(s, dtype=np.int64))
                edge[s] += 1
                np.subtract.at(edge, s + length, 1)
                keep = np.cumsum(edge[:-1]) == 0
                removed = len(ws) - int(keep.sum())
                rest = without(utf8(t), keep).decode("utf-8", "surrogatepass")
                ws = [ws[i] for i in np.flatnonzero(keep)]
            out.append((len(ws) + removed, removed, b" ".join(ws).decode("utf-8", "surrogatepass"), rest))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "remains"])

    return keep


def deduplicate(df: DataFrame, id_: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``df`` with n_words, n_removed, kept and remains."""
    d, th, at = "_tessera_d", "_tessera_th", "_tessera_starts"  # apart from columns that pass through
    keyed = df.drop(*NEW).withColumns({d: F.coalesce(F.col(id_).cast("long"), F.lit(0)), th: F.xxhash64(F.col(text))})
    starts = repeated_windows(keyed.select(F.col(d).alias("_d"), F.col(th).alias("_th"), F.col(text).alias("text"), F.lit(1).cast("long").alias("copies")), length, gram, crowd, shard_words)
    got = keyed.join(starts.withColumnsRenamed({"_d": d, "_th": th, "starts": at}), [d, th], "left").withColumn("_tessera_kept", _keep(length)(F.col(text), F.col(at)))
    return got.withColumns({x: F.col(f"_tessera_kept.{x}") for x in NEW}).drop(d, th, at, "_tessera_kept")
