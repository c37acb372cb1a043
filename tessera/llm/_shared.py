"""Helpers shared by the training-data operators: scratch tables, batches, word splitting."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    A temporary folder stands in only on a local master, where driver and executors are one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **changes: str):
    """Session settings (dots written as two underscores) for the time of an action; the caller's come back."""
    names = {k.replace("__", "."): v for k, v in changes.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: On a local file system (a shared mount, say) scratch tables go without checksum side files: each would cost a second file
#: and a second process that sets its mode. Other file systems have none and don't read these options.
NO_SIDE_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Bytes of an Arrow batch that goes to a Python worker while a scratch table is written.
BATCH_BYTES = 1 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later reads survive lost executors.

    Shuffle files of the write go as soon as it ends, and Arrow batches are bounded by bytes, not by rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES)):
        df.write.options(compression="zstd", **NO_SIDE_FILES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)  # twice does no harm
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that one run of an operator writes; ``clear`` deletes those that its result does not read."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(written(df, name))
        return self.tables[-1]

    def clear(self, *keep: DataFrame) -> None:
        for t in self.tables:
            if not any(t is k for k in keep):
                discard(t)
        self.tables = list(keep)


#: Bits of the bounded filter below: 2 MB, whatever the number of keys.
FILTER_BITS = 1 << 24


def maybe_among(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys``, before a join that settles it.

    The keys set bits of a bitmap of fixed size, which is broadcast. Rows of other keys pass as often as bits are set, so a
    crowded bitmap only spares less of the shuffle.
    """
    at = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)) + 1
    made = keys.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_map"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_map", F.expr("1") + (place / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(made), F.bitmap_bucket_number(at) == F.col("_bucket")).where(is_set).select(df.columns)


def shipped(spark: SparkSession, value):
    """Broadcast a value together with the code of its class; ``unpacked`` gives it back on an executor."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpacked(sent):
    return cloudpickle.loads(sent.value)


def chunks(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[list[str | None]]:
    """Runs of texts of some ``most`` characters, one text at least."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def utf8(text: str | bytes | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)


def words(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of the text in UTF-8; bytes.split() cuts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), element by element."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


_tables: dict[int, np.ndarray] = {}
BASE, OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of the odd base (first row) and of its inverse modulo 2^64."""
    if base not in _tables or _tables[base].shape[1] < n:
        steps = np.ones((2, max(n, 1 << 16)), dtype=np.uint64)
        steps[0, 1:], steps[1, 1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        _tables[base] = np.multiply.accumulate(steps, axis=1)
    return _tables[base][:, :n]


def range_hash(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of x[lo:hi] (uint64) for each pair of bounds, by prefix sums of a polynomial."""
    up, down = _powers(base, len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)


class Words(NamedTuple):
    """Words of some texts laid end to end: their bytes, their bounds in them, their hashes, and how many each text has."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    sizes: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Where the words of each text begin."""
        return np.cumsum(self.sizes) - self.sizes


def hashed_words(texts: Iterable[str | bytes | None], lower: bool = False, most: int = 1 << 20) -> Iterator[tuple[int, Words]]:
    """Runs of texts of some ``most`` bytes: the index of the first text, and the words. ``lower`` lower-cases A-Z."""
    first, held, size = 0, [], 0
    for n, t in enumerate(texts):
        b = utf8(t)
        if held and size + len(b) > most:
            yield first, _hashed(held, lower)
            first, held, size = n, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, _hashed(held, lower)


def _hashed(texts: list[bytes], lower: bool) -> Words:
    raw = b" ".join(texts)
    if lower:
        raw = raw.lower()  # bytes: A-Z only
    b = np.frombuffer(raw, np.uint8)
    gap = np.ones(len(b) + 2, dtype=bool)
    gap[1:-1] = _SPACE[b]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[::2], edges[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return Words(raw, start, end, range_hash(_LETTER[b], start, end), np.diff(np.searchsorted(start, ends), prepend=0))
