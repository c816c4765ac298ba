"""MinHash near-duplicates with tensored banding.

A text's set holds its distinct five-word shingles (fewer words: all of them as one; no words: an empty set, linked
with nothing). Texts whose shared shingles are at least three quarters of all their shingles are linked; groups are the
connected components.

1. Equal sets form one class; the smallest doc_id stands for it.
2. Two small collections of ``PARTS`` part keys each, a part of ``ROWS`` minhashes. A table's key combines one part of
   either collection, so ``PARTS`` squared tables cost ``2 * PARTS * ROWS`` minhashes only. Part keys that no other
   text has are dropped before they are combined. At a similarity of exactly 0.75 a pair shares a table with probability
   0.997, at 0.8 with 0.9996.
3. Tables make families: every text of a table is joined with the smallest one there, never with all, and the
   components of these candidates hold all links that the tables can show.
4. Within a family links are confirmed on full sets. Only what may still join two components is compared: one text with all
   others at once, the most central first. A family too large for one task is dealt out in shards of bounded size;
   each is compared within itself and with some hubs of the family, then the texts outside the family's largest
   component are compared with all shards. No link that could join components is left out.

Repeated rows are equal texts. Null texts are empty. Columns other than doc_id and text are left out. An empty table gives
an empty table. A null doc_id takes part as the id -2^63 does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlink.llm.common import U64, Rolling, Words, chunks, mixed, partitions, texts, written
from eventlink.llm.components import components

SHINGLE = 5
#: Part keys in either collection, and minhashes in a part key.
PARTS, ROWS = 12, 3
#: A pair is linked if 100 times the intersection is at least this many times the union.
LIKE = 75
#: Shingles of a family that one task compares at once (a longer text comes alone).
SHARD = 2_000_000
#: Texts of a large family that every shard is compared with first.
HUBS = 64

_random = np.random.default_rng(8)
_FACTORS = _random.integers(0, 2**63, 2 * PARTS * ROWS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_TERMS = _random.integers(0, 2**63, 2 * PARTS * ROWS, dtype=np.int64).astype(U64)


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text of a chunk, sorted, one text after the other; and where each begins."""
    words = Words(raw, at, lower=True)
    rolling = Rolling(words.hash)
    starts = np.flatnonzero(words.inside(SHINGLE))
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    doc = np.concatenate([words.doc[starts], short])
    value = np.concatenate([rolling.windows(SHINGLE)[starts], rolling.between(words.first[short], words.first[short + 1])])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(at)))


SIGNATURE = "doc_id long, n_shingles long, one long, two long, parts array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """Per text: the size of its set, a digest of the set (two numbers) and its part keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches):
            value, first = shingle_sets(raw, at)
            size = np.diff(first)
            some = np.flatnonzero(size)
            one, two = np.zeros(len(size), U64), np.zeros(len(size), U64)
            parts = np.zeros((len(size), 2 * PARTS), U64)
            if len(some):
                begin = first[:-1][some]
                one[some] = np.add.reduceat(mixed(value), begin)
                two[some] = np.add.reduceat(mixed(value ^ U64(0xA5A5A5A5A5A5A5A5)), begin)
                for p in range(2 * PARTS):
                    key = np.full(len(some), p, U64)
                    for r in range(p * ROWS, (p + 1) * ROWS):
                        key = mixed(key ^ np.minimum.reduceat(value * _FACTORS[r] + _TERMS[r], begin))
                    parts[some, p] = key
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(size) + 1) * 2 * PARTS, pa.int32()), pa.array(parts.view(np.int64).ravel())
            )
            numbers = [pa.array(x) for x in (size.astype(np.int64), one.view(np.int64), two.view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, lists], names=[c.split()[0] for c in SIGNATURE.split(", ")])

    lowest = F.lit(-(2**63)).cast("long")
    return texts(docs).select(F.coalesce("doc_id", lowest).alias("doc_id"), "text").mapInArrow(sign, SIGNATURE)


def families(classes: DataFrame) -> DataFrame:
    """(node, component) of texts (doc, parts) that share tables."""
    parts = classes.select("doc", F.posexplode("parts").alias("part", "value"))
    shared = parts.groupBy("part", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    kept = parts.join(shared, ["part", "value"], "left_semi")

    def side(condition: str) -> F.Column:
        return F.collect_list(F.when(F.expr(condition), F.struct("part", "value")))

    both = kept.groupBy("doc").agg(side(f"part < {PARTS}").alias("one"), side(f"part >= {PARTS}").alias("two"))
    tables = both.select("doc", F.explode("one").alias("one"), "two").select("doc", "one", F.explode("two").alias("two"))
    keys = tables.select("doc", F.xxhash64("one", "two").alias("key"))
    least = keys.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    stars = keys.join(least, "key").where("doc <> least").select(F.col("doc").alias("a"), F.col("least").alias("b"))
    return components(stars.distinct())


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc and further columns) with ``shingles``, each text's sorted set as bytes. One text per doc."""
    columns = [c for c in wanted.columns if c != "doc"]
    lowest = F.lit(-(2**63)).cast("long")
    said = texts(docs).select(F.coalesce("doc_id", lowest).alias("doc"), "text")
    joined = said.join(wanted, "doc").select("doc", "text", *columns)
    schema = T.StructType([f for f in joined.schema if f.name != "text"]).add("shingles", "binary")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches):
            value, first = shingle_sets(raw, at)
            data = value.tobytes()
            sets = [data[8 * a : 8 * b] for a, b in zip(first[:-1], first[1:], strict=True)]
            rest = [batch.column(c) for c in ("doc", *columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], names=["doc", *columns, "shingles"])

    return joined.mapInArrow(collect, schema)


def compare(docs: list[int], sets: list[np.ndarray], asks: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Links of asking texts that join two of the given groups, each found by comparing one text with all at once."""
    size = np.array([len(s) for s in sets], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    spread = np.bincount(local)
    central = np.add.reduceat(spread[local], first[:-1]) / size
    group, out = group.copy(), []
    flag = np.zeros(len(spread), np.int8)
    alive = np.flatnonzero(asks)
    for k in alive[np.argsort(-central[alive], kind="stable")]:
        other = (group != group[k]) & (100 * np.minimum(size, size[k]) >= LIKE * np.maximum(size, size[k]))
        if not other.any():
            continue
        mine = local[first[k] : first[k + 1]]
        flag[mine] = 1
        if 4 * other.sum() < len(docs):
            places = np.flatnonzero(other)
            both = np.array([int(flag[local[first[p] : first[p + 1]]].sum()) for p in places])
        else:
            places = np.arange(len(docs))
            both = np.add.reduceat(flag[local], first[:-1], dtype=np.int64)
        flag[mine] = 0
        linked = places[(100 * both >= LIKE * (size[places] + size[k] - both)) & other[places]]
        out += [(docs[k], docs[p]) for p in linked]
        joined = np.unique(group[linked])
        group[np.isin(group, joined)] = group[k]
    return out


def confirmed(work: DataFrame) -> DataFrame:
    """Links (a, b) within each piece of work: (family, shard, chunk, doc, component, asks, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, tuple] = {}
        key, out = None, []

        def done() -> None:
            if len(rows) > 1:
                docs = list(rows)
                component, asks, sets = zip(*rows.values(), strict=True)
                out.extend(compare(docs, list(sets), np.array(asks), np.array(component)))
            rows.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("family", "shard", "chunk", "doc", "component", "asks")]
            raw, at = as_values(batch.column("shingles"))
            for k, (*now, doc, component, asks) in enumerate(zip(*columns, strict=True)):
                if now != key:
                    done()
                    key = now
                seen = rows.get(doc)
                rows[doc] = component, asks or bool(seen and seen[1]), raw[at[k] : at[k + 1]].copy()
            if out:
                yield batch_of()
        done()
        yield batch_of()

    n = partitions(work.sparkSession)
    keys = ["family", "shard", "chunk"]
    return work.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def as_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as unsigned 64-bit numbers, and where each value begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(np.frombuffer(data, np.uint8)[at[0] : at[-1]].tobytes(), U64), (at - at[0]) // 8


def link(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that join all texts of classes (doc, n_shingles, parts) that belong together."""
    family = families(classes).toDF("doc", "family").join(classes.select("doc", "n_shingles"), "doc")
    size = family.groupBy("family").agg(
        F.ceil(F.sum("n_shingles") / SHARD).cast("long").alias("shards"), F.count("*").alias("members")
    )
    placed = family.join(size, "family").select(
        "doc", "family", "n_shingles", "shards", F.pmod(F.xxhash64("doc"), F.col("shards")).alias("shard")
    )
    sets = written(full_sets(docs, placed))
    work = sets.select("*", F.lit(0).cast("long").alias("chunk"), F.col("doc").alias("component"), F.lit(True).alias("asks"))
    columns = ["family", "shard", "chunk", "doc", "component", "asks", "shingles"]
    large = work.where("shards > 1")
    # Hubs: of each of HUBS draws the text with the least hash, a bounded number for every family.
    draws = [F.min(F.struct(F.xxhash64("doc", F.lit(h)), "doc")).alias(f"h{h}") for h in range(HUBS)]
    drawn = large.groupBy("family").agg(*draws).select(F.explode(F.array(*[F.col(f"h{h}.doc") for h in range(HUBS)])).alias("doc"))
    everywhere = large.join(drawn.distinct(), "doc", "left_semi").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    first = written(confirmed(work.select(columns).unionByName(everywhere.select(columns))))
    if large.isEmpty():
        return first
    # Texts outside the largest component of a family of several shards are compared with all its shards.
    found = components(first).toDF("doc", "component")
    known = large.drop("component").join(found, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    counted = known.groupBy("family", "component").agg(F.count("*").alias("n"))
    giant = counted.groupBy("family").agg(F.max(F.struct("n", "component")).alias("top")).select("family", F.col("top.component").alias("giant"))
    outside = known.join(giant, "family").where("component <> giant").drop("giant")
    chunk = outside.groupBy("family").agg(F.ceil(F.sum("n_shingles") / SHARD).cast("long").alias("chunks"))
    asking = outside.join(chunk, "family").withColumn("chunk", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("chunks")))
    spread = asking.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    answers = known.join(chunk, "family").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    more = spread.select(columns).unionByName(answers.withColumn("asks", F.lit(False)).select(columns))
    return first.unionByName(written(confirmed(more)))


def group_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``."""
    signed = written(signatures(docs))
    digest = ["n_shingles", "one", "two"]
    classes = written(
        signed.where("n_shingles > 0")
        .groupBy(*digest)
        .agg(F.min(F.struct("doc_id", "parts")).alias("least"))
        .select(*digest, F.col("least.doc_id").alias("doc"), F.col("least.parts").alias("parts"))
    )
    found = components(link(docs, classes)).toDF("doc", "component")
    named = classes.join(found, "doc", "left").select(*digest, F.coalesce("component", "doc").alias("component"))
    joined = signed.join(named, digest, "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
