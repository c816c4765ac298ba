"""What the operators share: tables, written intermediate results, and words and hashes of many texts at once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 19

SPACES = b" \t\n\x0b\x0c\r"
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without that setting gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="eventlink-shared-")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and kept when executors are lost."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Keyed:
    """A table dealt out by one key into ``n`` files, as many as there are shuffle partitions if not given.

    Joins with it by that key move the other side only. ``drop`` it when no lazy frame reads it any more.
    """

    def __init__(self, df: DataFrame, key: str, dealt: bool = False, n: int | None = None):
        """``dealt``: a shuffle by the key into so many parts comes last in ``df`` already."""
        self.spark, self.name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
        self.n = n = n or partitions(self.spark)
        (
            (df if dealt else df.repartition(n, key))
            .write.option("compression", "zstd")
            .bucketBy(n, key)
            .sortBy(key)
            .saveAsTable(self.name)
        )

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as bytes (null: empty), and further columns."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), *more)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a binary column one after the other, and where each begins (with the end)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with about ``size`` bytes of text, the bytes, and where each text begins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = as_bytes(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
            yield batch.slice(row, end - row), raw[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


_powers = np.ones(1, U64), np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers = tuple(
            np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, b & _MASK, U64))])
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        )
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """Each value scrambled, one to one."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Rolling:
    """Hashes of any stretch of a sequence, from running sums of value times power."""

    def __init__(self, values: np.ndarray):
        self.power, self.inverse = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values.astype(U64, copy=False) * self.power[: len(values)], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))

    def windows(self, length: int) -> np.ndarray:
        """Of every stretch of ``length`` values."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, U64)
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + U64(length))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts: their hashes, their places, and each text's first word."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = False):
        raw = LOWER[raw] if lower else raw
        word = IS_WORD[raw]
        n = len(raw)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = at[:-1][at[:-1] < n]
        before[inner] = False
        ends = at[1:][at[1:] > 0] - 1
        after[ends] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.hash = Rolling(raw.astype(U64) + U64(1)).between(self.start, self.end)
        self.first = np.searchsorted(self.start, at).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(at) - 1), self.count)
        self.place = np.arange(len(self.start)) - self.first[self.doc]

    def inside(self, length: int) -> np.ndarray:
        """For each stretch of ``length`` words, whether it lies in one text."""
        n = len(self.start) - length + 1
        if n <= 0:
            return np.empty(0, bool)
        return self.doc[:n] == self.doc[length - 1 :]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    rest = -len(values) % width
    padded = np.concatenate([values, np.full(rest, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(grams: np.ndarray, width: int, inside: np.ndarray) -> np.ndarray:
    """Places of grams that are the least of some window of ``width`` neighbours (all of equal ones).

    ``inside`` tells for each window whether it lies in one text; others do not count. Which of a window's grams is
    chosen depends on the window alone, so equal windows have equal anchors.
    """
    if len(grams) < width:
        return np.empty(0, np.int64)
    least = np.where(inside, sliding_min(grams, width), U64(0))
    # A gram is the least of a window exactly if it equals the greatest least value of the windows that hold it.
    highest = np.iinfo(U64).max
    edge = np.zeros(width - 1, U64)
    around = highest - sliding_min(highest - np.concatenate([edge, least, edge]), width)
    return np.flatnonzero((grams == around) & (around > 0))
