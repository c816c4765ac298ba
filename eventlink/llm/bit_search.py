"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Index: every unit vector is turned into ``BITS`` coordinates by a random rotation (of the space it is padded to; vectors of few
dimensions get more bits than dimensions so that the bounds are narrow); its code holds their signs, packed
to bits, and its correction scalar is the inner product of the vector with its own code. Blocks hold codes and scalars, no vectors.

Search: a query's turned coordinates are rounded to ``LEVELS`` bits and packed plane by plane, so its inner product with a
code is a weighted sum of counts of common bits. Divided by the scalar it estimates the cosine without bias, and scalar and rounding bound the error. Queries
meet the codes in blocks of bounded size (``BLOCK`` rows), twice: first each block gives a query its k best lower bounds, and the k-th best
of all blocks is what a row's upper bound must reach; then the blocks give the rows that reach it. Only for these are the
original vectors fetched, and compared in double precision.

Equal vectors are reduced to the copies with the smallest ids that any result can need before they are dealt out.

Vectors that are null, zero, or hold null or non-finite components take no part; a vector is compared with vectors of its own length.
Ties go to the smaller id. Rows repeated with the same id and vector count once. Null ids take no part. Columns other
than the named ones are left out. Fewer candidates than k give fewer rows, an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlink.llm.common import U64, written
from eventlink.operators.joins import attach

#: Codes that a query meets at once.
BLOCK = 8192
#: Queries worked on at once.
QUERIES = 512
#: Bits of a code at least, a multiple of 64.
BITS = 1024
#: Bits of a query's rounded coordinate.
LEVELS = 4
#: Standard deviations of the estimate that the error bound spans.
DEVIATIONS = 3.0
INDEX = "row long, vec_id long, dim int, code binary, scalar double"
ASKED = "query long, vec_id long, dim int, planes binary, least double, step double, total double"


def width(dim: int) -> int:
    return max(BITS, -(-dim // 64) * 64)


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """The first ``dim`` columns of a random rotation of ``width(dim)`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((width(dim), dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, dim, vector) of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad)
        .where(F.exists("vector", lambda v: v != 0))
        .select("vec_id", F.size("vector").alias("dim"), "vector")
    )


def needed(vectors: DataFrame, k: int) -> DataFrame:
    """(row, vec_id, dim, vector) of the rows that any result of k neighbours can need, numbered and written."""
    copies = Window.partitionBy("vector").orderBy("vec_id")
    some = vectors.distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    return written(some.withColumn("row", F.monotonically_increasing_id()))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Rows of one length, the length, and their vectors of length one, turned."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            part = batch.take(pa.array(np.flatnonzero(dims == dim)))
            yield part, dim, units(matrix(part.column("vector"), dim)) @ rotation(dim).T


def index(rows: DataFrame) -> DataFrame:
    """The codes of numbered rows (see ``INDEX``)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, dim, turned in _by_length(batches):
            codes = [c.tobytes() for c in np.packbits(turned > 0, axis=1)]
            scalars = np.abs(turned).sum(axis=1) / np.sqrt(width(dim))
            columns = [*(part.column(c) for c in ("row", "vec_id", "dim")), pa.array(codes, pa.binary()), pa.array(scalars)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])

    return rows.mapInArrow(encode, INDEX)


def rounded(queries: DataFrame) -> DataFrame:
    """The bit planes of numbered queries (see ``ASKED``)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, turned in _by_length(batches):
            least = turned.min(axis=1)
            step = (turned.max(axis=1) - least) / ((1 << LEVELS) - 1)
            level = np.rint((turned - least[:, None]) / np.where(step > 0, step, 1.0)[:, None]).astype(np.uint8)
            planes = [b"".join(np.packbits(x >> j & 1).tobytes() for j in range(LEVELS)) for x in level]
            total = least * turned.shape[1] + step * level.sum(axis=1)
            columns = [*(part.column(c) for c in ("query", "vec_id", "dim")), pa.array(planes, pa.binary()), *map(pa.array, (least, step, total))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ASKED.split(", ")])

    return queries.mapInArrow(encode, ASKED)


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Block:
    """Codes of one length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, dim: int, codes: list[bytes], scalars: np.ndarray):
        self.rows, self.ids, self.bits, self.scalars = rows, ids, width(dim), scalars
        self.words = np.frombuffer(b"".join(codes), U64).reshape(len(ids), -1)
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)

    def bounds(self, planes: bytes, least: float, step: float, total: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the cosines with a query, from counts of common bits."""
        common = np.zeros(len(self.ids), np.int64)
        for j, plane in enumerate(np.frombuffer(planes, U64).reshape(LEVELS, -1)):
            common += np.bitwise_count(self.words & plane).sum(axis=1, dtype=np.int64) << j
        near = (2 * (least * self.ones + step * common) - total) / np.sqrt(self.bits) / self.scalars
        spread = (1 - self.scalars**2) / (self.bits - 1) + step * step / 12
        error = DEVIATIONS * np.sqrt(np.maximum(0, spread)) / self.scalars
        return near - error, near + error

    def best(self, q: dict, k: int) -> pa.RecordBatch:
        """The k best lower bounds for a query (see ``candidates``) among rows of other ids."""
        low = self.bounds(q["planes"], q["least"], q["step"], q["total"])[0][self.ids != q["vec_id"]]
        low = np.partition(low, -k)[-k:] if len(low) > k else low
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(low), q["query"])), pa.array(low)], names=["query", "low"])

    def reaching(self, q: dict, k: int) -> pa.RecordBatch:
        """Rows of other ids whose upper bounds reach what is asked (null: all)."""
        high = self.bounds(q["planes"], q["least"], q["step"], q["total"])[1]
        rows = self.rows[(self.ids != q["vec_id"]) & (high >= (-np.inf if q["reach"] is None else q["reach"]))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), q["query"])), pa.array(rows)], names=["query", "row"])


def candidates(codes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, row) of all rows that may be among the k nearest of a query by their bounds."""
    blocks = max(1, -(-codes.count() // BLOCK))
    asked = written(asked)
    lows = _met(codes, asked.withColumn("reach", F.lit(None).cast("double")), blocks, lambda block, q: block.best(q, k), "query long, low double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
    kth = lows.withColumn("place", place).where(F.col("place") <= k).groupBy(F.col("query").alias("_query"))
    # With fewer than k other rows every one of them is needed.
    kth = kth.agg(F.when(F.count("*") == k, F.min("low")).alias("reach"))
    reach = attach(asked, kth, [(F.col("query"), "_query")], "inner")
    return _met(codes, reach, blocks, lambda block, q: block.reaching(q, k), "query long, row long")


def _met(codes: DataFrame, asked: DataFrame, blocks: int, answer: Callable[[Block, dict], pa.RecordBatch], schema: str) -> DataFrame:
    """What every block answers to every query of its length."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    query = F.struct("query", "vec_id", "planes", "least", "step", "total", "reach")
    rows = codes.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.lit(0).alias("asks"), *names)
    rows = rows.withColumn("q", F.lit(None).cast(asked.select(query.alias("q")).schema["q"].dataType))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    nothing = {"row": "long", "vec_id": "long", "code": "binary", "scalar": "double"}
    questions = asked.select(every.alias("block"), F.lit(1).alias("asks"), "dim", query.alias("q")).withColumns({n: F.lit(None).cast(t) for n, t in nothing.items()})
    work = rows.unionByName(questions).repartition(blocks, "block").sortWithinPartitions("block", "dim", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "asks")), strict=True))
            start = 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start] and end - start < QUERIES:
                    end += 1
                part, (number, dim, asks) = batch.slice(start, end - start), keys[start]
                start = end
                if (number, dim) != key:
                    key, held, block = (number, dim), [], None
                if not asks:
                    held.append(part)
                elif held:
                    if block is None:
                        whole = pa.Table.from_batches(held).combine_chunks()
                        block = Block(whole["row"].to_numpy(), whole["vec_id"].to_numpy(), dim, whole["code"].to_pylist(), whole["scalar"].to_numpy())
                    for q in part.column("q").to_pylist():
                        yield answer(block, q)

    return work.mapInArrow(run, schema)


def reranked(pairs: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of the candidates by the vectors themselves."""
    joined = pairs.join(rows.select("row", F.col("vec_id").alias("near_id"), "vector"), "row")
    joined = joined.join(queries.select("query", F.col("vec_id").alias("query_id"), F.col("vector").alias("wanted")), "query")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(size).tolist():
                part = batch.take(pa.array(np.flatnonzero(size == dim)))
                score = (units(matrix(part.column(2), dim)) * units(matrix(part.column(3), dim))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])

    scored = joined.select("query_id", "near_id", "vector", "wanted").mapInArrow(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``, among all other rows."""
    clean = usable(vectors, key, vector)
    rows = needed(clean, k)
    asked = clean.where(F.col("vec_id") % every == 0).distinct()
    queries = written(asked.withColumn("query", F.monotonically_increasing_id()))
    return reranked(candidates(written(index(rows)), rounded(queries), k), rows, queries, k)
