"""Best-fit packing by hierarchical residual rounds.

Each partition packs its own pieces best-fit, longest first, and emits bins that are nearly full. Bins that are not travel
on as items: they are dealt anew into groups of some ``group`` bins, which are packed best-fit again, round after round, as
long as a round merges enough of them. Groups keep their size and grow fewer with the bins, until one holds them all; where
rounds end with more bins than that, the emptiest of them, as many as one group holds, are packed together once more. A bin
carries its pieces as packed bytes (at most ``capacity`` pieces), so no piece is looked up again. Groups are dealt by a hash
and sorted before they are packed, and each round is written, so a task that runs twice gives the same bins.

Nulls: a null text is an empty document: one piece, the end mark. Empty tables give no rows; repeated rows and equal
doc_ids are packed as rows of their own. Columns beside id and text are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import written

CAPACITY, END = 1024, 2
#: A bin with so few free places is emitted at once.
SLACK = 2
#: Bins of one group of a later round.
GROUP = 4096
#: A round merges enough if it leaves at most this share of the bins.
HELPS = 0.98

_PIECE = np.dtype([("row", "<i8"), ("doc", "<i8"), ("has", "<i4"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BINS = "bin long, fill int, pieces binary, done boolean"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes by bin: items longest first (ties: in the order given), each into the fullest bin that has room."""
    order = np.argsort(-sizes, kind="stable")
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free places
    rooms: list[int] = []  # the sorted free places that some bin has
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = free[room].pop()
            if not free[room]:
                del rooms[at]
        bins[b].append(i)
        left = room - size
        if left:
            if not free[left]:
                bisect.insort(rooms, left)
            free[left].append(b)
    return bins


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first takes what full pieces leave over."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


class Encoder:
    """Ids as the tokenizer file gives them.

    Byte-level BPE over characters of the Latin blocks goes through tiktoken, which reads the same merges several times as
    fast; all other texts, and files whose ids are not in merge order, go through tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = _merges_as_ranks(path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not _BEYOND_LATIN.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


_BEYOND_LATIN = re.compile("[^\t\n\r -~\u00a1-\u024f]")


def _merges_as_ranks(path: str):
    """A tiktoken encoding of a byte-level BPE file whose ids are the bytes and then the merges in order; else None."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    shape = spec.get("pre_tokenizer") or {}
    plain = shape.get("type") == "ByteLevel" and not shape.get("add_prefix_space") and shape.get("use_regex") and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain:
        return None
    # Byte-level vocabularies write printable bytes as themselves and the others as characters from U+0100 on, in order.
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if token not in special}
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [model["vocab"].get(m) for m in made] != list(range(256, 256 + len(made))):
        return None
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _packed(items: list[tuple[int, bytes]], capacity: int, slack: int, base: int) -> pd.DataFrame:
    """Bins of items (fill, pieces) as rows of BINS, numbered from ``base``."""
    sizes = np.array([s for s, _ in items], dtype=np.int64)
    out = []
    for n, members in enumerate(best_fit(sizes, capacity)):
        fill = int(sizes[members].sum())
        out.append((base + n, fill, b"".join(items[i][1] for i in members), capacity - fill <= slack))
    return pd.DataFrame(out, columns=["bin", "fill", "pieces", "done"])


def pack(df: DataFrame, tokenizer_path: str, id_: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, slack: int = SLACK, group: int = GROUP) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = Encoder(tokenizer_path)
        base = TaskContext.get().partitionId() << 32
        made, items, row = 0, [], base

        def emit(done: list[tuple[int, bytes]]) -> pd.DataFrame:
            nonlocal made
            out = pd.DataFrame({"bin": np.arange(base + made, base + made + len(done)), "fill": [s for s, _ in done], "pieces": [p for _, p in done], "done": True})
            made += len(done)
            return out

        for b in batches:
            full: list[tuple[int, bytes]] = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(encode(text or ""), end).astype("<u4")
                has = not pd.isna(doc)
                for n, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    piece = np.array([(row, int(doc) if has else 0, has, n, start, length, crc)], dtype=_PIECE).tobytes()
                    (full if capacity - length <= slack else items).append((length, piece))
                row += 1
            if full:
                yield emit(full)
            if len(items) >= 50_000:  # bounded: what is left of these goes through the later rounds
                out = _packed(items, capacity, slack, base + made)
                made, items = made + len(out), []
                yield out
        if items:
            yield _packed(items, capacity, slack, base + made)

    rows = df.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bins = written(rows.mapInPandas(local, BINS), "packing-0")
    done, left, level, helps = [bins.where("done")], bins.where("not done"), 0, True
    count = left.count()
    while count > 1 and helps:
        level += 1
        groups = -(-count // group)
        packed = written(_round(left, groups, level, capacity, slack), f"packing-{level}")
        done.append(packed.where("done"))
        left = packed.where("not done")
        before, count = count, left.count()
        helps = groups > 1 and count <= before * HELPS
    if count > group:
        bound = _emptiest(left, group)
        if bound is not None:
            level += 1
            packed = written(_round(left.where(F.col("fill") <= bound), 1, level, capacity, slack), f"packing-{level}")
            done += [left.where(F.col("fill") > bound).withColumn("_level", F.lit(level - 1)), packed]
            left = None
    if left is not None:
        done.append(left.withColumn("_level", F.lit(level)))
    all_bins = None
    for n, d in enumerate(done):
        d = d.select("bin", "pieces", (F.col("_level") if "_level" in d.columns else F.lit(n)).alias("level"))
        all_bins = d if all_bins is None else all_bins.unionByName(d)

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            parts = [np.frombuffer(p, dtype=_PIECE) for p in b["pieces"]]
            p, sizes = np.concatenate(parts), [len(x) for x in parts]
            ends = np.concatenate([np.cumsum(x["length"], dtype=np.int64) for x in parts])
            yield pd.DataFrame({
                "doc_id": pd.array(p["doc"], dtype="Int64").copy() if p["has"].all() else pd.Series(p["doc"]).astype("Int64").mask(p["has"] == 0),
                "piece": p["piece"],
                "start": p["start"],
                "length": p["length"].astype(np.int64),
                "ids_crc32": p["crc"].astype(np.int64),
                "sequence_id": np.repeat(b["level"].to_numpy(np.int64) * (1 << 58) + b["bin"].to_numpy(np.int64), sizes),
                "offset": ends - p["length"],
            })

    return all_bins.select("level", "bin", "pieces").mapInPandas(opened, PIECES)


def _emptiest(left: DataFrame, group: int) -> int | None:
    """The greatest fill up to which there are no more than ``group`` bins; a row for each fill is all that is collected."""
    bound, total = None, 0
    for r in sorted(left.groupBy("fill").count().collect()):
        total += r["count"]
        if total > group:
            break
        bound = r.fill
    return bound


def _round(left: DataFrame, groups: int, level: int, capacity: int, slack: int) -> DataFrame:
    """Deal the underfull bins into groups by a hash, and pack each group."""

    def again(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        return _packed(list(zip(b["fill"].tolist(), b["pieces"], strict=True)), capacity, slack, int(key[0]) << 32)

    return _dealt(left, groups, level).groupBy("g").applyInPandas(again, BINS)


def _dealt(left: DataFrame, groups: int, level: int) -> DataFrame:
    return left.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)))
