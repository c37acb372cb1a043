"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and applied in numpy.

A word enters twice: as a vector of its own (words of the training sample) and as the mean of vectors of its character
trigrams (any word). The network reads windows of 32 words, each half over the next; attention pools the states of both
directions into a score, and the score of a text is that of its worst window, so length does not dilute it. Labels are of
whole texts: training starts from the windows whose words speak most for the label, and then takes, round by round, the
windows the network itself scores highest, in toxic and in clean texts alike.

Only the sample for training is bounded: up to ``sample`` labelled texts of each class (least hashes of the id first) of
at most ``longest`` characters. Every window of every text is scored.

Defined results: texts without words (null ones too) score 0. If the sample lacks a class, every text with words gets the
share of label 1 in it, at most 0.49 unless it is all. Repeated rows get equal scores, up to rounding; very long texts are read whole; empty tables give no rows; null labels
are not learned from. Other columns pass through; score and predicted replace columns of those names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import chunks, mix, shipped, unpacked

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, TRIGRAMS = 8, 8, 8, 4096
SAMPLE, LONGEST, VOCABULARY = 1500, 20_000, 20_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def window_starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> range:
    """First words of the overlapping windows; the last one reaches the end."""
    return range(0, max(1, n - window + stride), stride) if n else range(0)


def trigrams(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the UTF-8 trigrams of each word with its ends marked, and where each word's begin."""
    packed = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in ws]
    sizes = np.array([len(p) for p in packed], dtype=np.int64)
    b = np.frombuffer(b"".join(packed), dtype=np.uint8).astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(ws), np.int64)
    code = mix(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) & np.uint64(TRIGRAMS - 1)
    ends = np.cumsum(sizes)
    inside = np.ones(len(code) + 2, dtype=bool)
    inside[ends - 1] = inside[ends - 2] = False
    return code[inside[: len(code)]].astype(np.int64), np.cumsum(sizes - 2) - (sizes - 2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """Parameters by name, with the forward pass and its gradient."""

    def __init__(self, vocabulary: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        init = lambda *shape: (rng.standard_normal(shape) * (0.6 / np.sqrt(shape[0]))).astype(np.float32)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.p = {"word": (rng.standard_normal((len(vocabulary) + 1, WORD_DIM)) * 0.1).astype(np.float32), "char": (rng.standard_normal((TRIGRAMS, CHAR_DIM)) * 0.3).astype(np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": init(d, 3 * h), f"u{way}": init(h, 3 * h), f"b{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": init(2 * h, h), "ab": np.zeros(h, np.float32), "v": init(h, 1)[:, 0], "o": init(2 * h, 1)[:, 0], "ob": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        self.shift = 0.0

    def inputs(self, ws: list[str], blank: np.ndarray | None = None):
        """Vectors of some words; ``blank`` marks those whose own vector is left out."""
        own = np.array([self.index.get(w, 0) for w in ws], dtype=np.int64)
        if blank is not None:
            own[blank] = 0
        code, at = trigrams(ws)
        sizes = np.diff(np.append(at, len(code)))
        mean = np.add.reduceat(self.p["char"][code], at, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][own], mean], axis=1), own, code, sizes

    def run(self, way: str, x: np.ndarray, keep: bool = False):
        """States over time of one direction; x: time x batch x 3 hidden, already in reading order."""
        u, h = self.p[f"u{way}"], np.zeros((x.shape[1], HIDDEN), np.float32)
        states, saved = np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            g = h @ u
            rz = _sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            if keep:
                saved.append((h, r, z, n, g[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            states[t] = h
        return states, saved

    def pooled(self, states: np.ndarray, mask: np.ndarray):
        k = np.tanh(states @ self.p["a"] + self.p["ab"])
        e = np.where(mask, k @ self.p["v"], np.float32(-30))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        c = (w[:, :, None] * states).sum(0)
        return c @ self.p["o"] + self.p["ob"][0], (k, w, c)

    def logits(self, projected: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows (time x batch); projected: words' inputs after both directions' input matrices."""
        f, _ = self.run("f", projected[:, :, : 3 * HIDDEN])
        b, _ = self.run("b", projected[::-1, :, 3 * HIDDEN :])
        return self.pooled(np.concatenate([f, b[::-1]], axis=2), mask)[0]

    def projection(self, ws: list[str]) -> np.ndarray:
        x = self.inputs(ws)[0]
        return np.concatenate([x @ self.p["xf"] + self.p["bf"], x @ self.p["xb"] + self.p["bb"]], axis=1)

    def gradient(self, ws: list[str], at: np.ndarray, mask: np.ndarray, y: np.ndarray, blank: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows ``at`` (time x batch, indexes into ws; masked ones are padding)."""
        p, hid = self.p, HIDDEN
        x, own, code, sizes = self.inputs(ws, blank)
        xs = x[at] * mask[:, :, None]
        f, sf = self.run("f", xs @ p["xf"] + p["bf"], True)
        b, sb = self.run("b", xs[::-1] @ p["xb"] + p["bb"], True)
        states = np.concatenate([f, b[::-1]], axis=2)
        logit, (k, w, c) = self.pooled(states, mask)
        g = {n: np.zeros_like(v) for n, v in p.items()}
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["o"], g["ob"] = c.T @ d, np.array([d.sum()], np.float32)
        dc = d[:, None] * p["o"]
        dw = (states * dc).sum(2)
        de = w * (dw - (w * dw).sum(0)) * mask
        g["v"] = np.einsum("tbk,tb->k", k, de)
        dk = de[:, :, None] * p["v"] * (1 - k * k)
        g["a"], g["ab"] = np.einsum("tbi,tbk->ik", states, dk), dk.sum((0, 1))
        ds = w[:, :, None] * dc + dk @ p["a"].T
        dx = np.zeros_like(xs)
        for way, saved, upstream, read in (("f", sf, ds[:, :, :hid], xs), ("b", sb, ds[::-1, :, hid:], xs[::-1])):
            u, dh = p[f"u{way}"], np.zeros((len(y), hid), np.float32)
            back = dx if way == "f" else dx[::-1]
            for t in range(len(saved) - 1, -1, -1):
                h, r, z, n, un = saved[t]
                dh = dh + upstream[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                rec, inp = np.concatenate([dr, dz, dn * r], axis=1), np.concatenate([dr, dz, dn], axis=1)
                g[f"u{way}"] += h.T @ rec
                g[f"x{way}"] += read[t].T @ inp
                g[f"b{way}"] += inp.sum(0)
                back[t] += inp @ p[f"x{way}"].T
                dh = dh * z + rec @ u.T
        by_word = np.zeros_like(x)
        np.add.at(by_word, at, dx * mask[:, :, None])
        np.add.at(g["word"], own, by_word[:, :WORD_DIM])
        g["word"][0] = 0
        np.add.at(g["char"], code, np.repeat(by_word[:, WORD_DIM:] / sizes[:, None].astype(np.float32), sizes, axis=0))
        return g

    def fit(self, windows: list[list[str]], y: np.ndarray, steps: int, rate: float = 0.01, batch: int = 128, seed: int = 5) -> None:
        """Adam over shuffled batches; a third of the words go without their own vector, so that characters are learned too."""
        rng = np.random.default_rng(seed)
        m, s = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        step = 0
        while step < steps:
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), batch):
                part = [windows[i] for i in order[lo : lo + batch]]
                ws = list(dict.fromkeys(w for x in part for w in x))
                place = {w: i for i, w in enumerate(ws)}
                at, mask = np.zeros((WINDOW, len(part)), np.int64), np.zeros((WINDOW, len(part)), bool)
                for j, x in enumerate(part):
                    at[: len(x), j] = [place[w] for w in x]
                    mask[: len(x), j] = True
                g = self.gradient(ws, at, mask, y[order[lo : lo + batch]], rng.random(len(ws)) < 0.33)
                step += 1
                for n, v in self.p.items():
                    m[n] += 0.1 * (g[n] - m[n])
                    s[n] += 0.001 * (g[n] * g[n] - s[n])
                    v -= (rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


class Scorer:
    """Window logits of texts; words met before keep their projected inputs, ``most`` at a time."""

    def __init__(self, net: Network, most: int = 200_000, batch: int = 4096):
        self.net, self.most, self.batch = net, most, batch
        self.seen: dict[str, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)
        self.used = 1

    def _rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list({w for ws in texts for w in ws if w not in self.seen})
        if self.used + len(new) > self.most:
            self.seen, self.used = {}, 1
            new = list({w for ws in texts for w in ws})
        if new:
            if self.used + len(new) > len(self.table):
                grown = np.zeros((max(self.used + len(new), min(2 * len(self.table), self.most)), 6 * HIDDEN), np.float32)
                grown[: self.used] = self.table[: self.used]
                self.table = grown
            for lo in range(0, len(new), 20_000):
                part = new[lo : lo + 20_000]
                self.table[self.used : self.used + len(part)] = self.net.projection(part)
                self.seen.update(zip(part, range(self.used, self.used + len(part)), strict=True))
                self.used += len(part)
        self.table[0] = np.concatenate([self.net.p["bf"], self.net.p["bb"]])  # padding: an input of zeros
        return [np.fromiter(map(self.seen.__getitem__, ws), np.int64, len(ws)) for ws in texts]

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, text and first word of every window."""
        rows = self._rows(texts)
        n = np.array([len(r) for r in rows])
        counts = np.array([len(window_starts(x)) for x in n])
        text = np.repeat(np.arange(len(rows)), counts)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
        flat = np.concatenate([*rows, np.zeros(WINDOW, np.int64)])
        base = (np.cumsum(n) - n)[text] + first
        size = np.minimum(n[text] - first, WINDOW)
        out = np.empty(len(text), np.float32)
        step = np.arange(WINDOW)[:, None]
        for lo in range(0, len(text), self.batch):
            at = slice(lo, lo + self.batch)
            mask = step < size[at]
            out[at] = self.net.logits(self.table[np.where(mask, flat[base[at] + step], 0)], mask)
        return out, text, first

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Worst window of each text as a probability; 0 for texts without words."""
        out, text, _ = self.windows(texts)
        worst = np.full(len(texts), -np.inf, np.float64)
        np.maximum.at(worst, text, out.astype(np.float64))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(worst - self.net.shift)))


def train(texts: list[list[str]], y: np.ndarray, rounds: int = 2, steps: int = 500, seed: int = 3) -> Network:
    """Fit a network to labelled texts (as words), both labels present."""
    rng = np.random.default_rng(seed)
    df = [Counter(), Counter()]
    for ws, label in zip(texts, y, strict=True):
        df[int(label)].update(set(ws))
    total = [int((y == 0).sum()), int((y == 1).sum())]
    vocabulary = [w for w, _ in sorted((df[0] + df[1]).items(), key=lambda kv: (-kv[1], kv[0]))[:VOCABULARY] if df[0][w] + df[1][w] > 1]
    odds = {w: np.log((df[1][w] + 0.5) / (total[1] + 1)) - np.log((df[0][w] + 0.5) / (total[0] + 1)) for w in df[1] if df[1][w] >= min(3, max(2, total[1] // 4))}
    net = Network(vocabulary)
    cut = lambda ws: [ws[s : s + WINDOW] for s in window_starts(len(ws))]
    speak = lambda win: sum(sorted((max(0.0, odds.get(w, 0.0)) for w in set(win)), reverse=True)[:3])
    windows, labels = [], []
    for ws, label in zip(texts, y, strict=True):
        own = cut(ws)
        if not own:
            continue
        said = np.array([speak(w) for w in own])
        if label:
            windows.append(own[int(said.argmax())]), labels.append(1)
            own = [w for w, s in zip(own, said, strict=True) if s < 0.5]
        for i in rng.permutation(len(own))[: 1 if label else 3]:
            windows.append(own[i]), labels.append(0)
    net.fit(windows, np.array(labels, np.float32), steps)
    for r in range(rounds):
        out, text, first = Scorer(net).windows(texts)
        top = {}
        for o, t, f in zip(out.tolist(), text.tolist(), first.tolist(), strict=True):
            if t not in top or o > top[t][0]:
                top[t] = (o, f)
        more = [(texts[t][f : f + WINDOW], int(y[t])) for t, (_, f) in top.items()]
        net.fit(windows + [w for w, _ in more], np.array(labels + [v for _, v in more], np.float32), steps // 3, rate=0.004, seed=seed + r)
    out, text, _ = Scorer(net).windows(texts)
    worst = np.full(len(texts), -20.0)
    np.maximum.at(worst, text, out)
    # The boundary between the classes: least weighted error, in the middle of the gap where it is least.
    order = np.argsort(worst, kind="stable")
    edges = np.concatenate([[worst[order[0]] - 1], (worst[order][1:] + worst[order][:-1]) / 2, [worst[order[-1]] + 1]])
    missed = np.concatenate([[0], np.cumsum(y[order] == 1)]) / max(1, total[1])
    wrong = 1 - np.concatenate([[0], np.cumsum(y[order] == 0)]) / max(1, total[0])
    cost = missed + 2 * wrong
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    net.shift = float((edges[best[0]] + edges[best[-1]]) / 2)
    return net


def sample_of(labels: DataFrame, learn: Column, label: str, id_: str, sample: int) -> DataFrame:
    """Up to ``sample`` ids of each label, by the least hash: a bounded table."""
    known = labels.where(learn & F.col(label).isin(0, 1)).select(F.col(id_).alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    of = lambda y: known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    return of(0).union(of(1))


def score(df: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_: str = "doc_id", text: str = "text", sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """``df`` with score and predicted. ``learn`` (over columns of ``labels``) says which labels may be learned from."""
    spark = df.sparkSession
    chosen = F.broadcast(sample_of(labels, learn, label, id_, sample))
    texts = df.where(F.length(text) <= longest).select(F.col(id_).alias("_id"), F.col(text).alias("_t")).join(chosen, "_id").select("_t", "_y", "_id")
    # One row an id and label: of rows that repeat it the one with the least text.
    rows = texts.groupBy("_id", "_y").agg(F.min("_t").alias("_t")).orderBy("_id", "_y").collect()  # 2 * sample at most
    y = np.array([r._y for r in rows], dtype=np.int64)
    if len(set(y.tolist())) == 2:
        sent = shipped(spark, train([words(r._t) for r in rows], y))
    else:
        sent = shipped(spark, float(y.mean()) if len(y) else 0.0)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = unpacked(sent)
        scorer = Scorer(model) if isinstance(model, Network) else None
        for b in batches:
            if scorer is None:
                yield pd.Series([(model if model == 1 else min(model, 0.49)) if words(t) else 0.0 for t in b], dtype=float)
            else:
                parts = [scorer.scores([words(t) for t in part]) for part in chunks(b)]
                yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    out = df.drop("score", "predicted").withColumn("score", scored(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
