"""Removal of repeated passages by compaction of a token de Bruijn graph.

A window is ``WINDOW`` consecutive words of one text; every word of a window that occurs anywhere else goes.

1. Nodes are sampled ``GRAM``-word sequences: the least hash of every window, so that equal windows have equal nodes.
   Only sequences that occur twice can lie in repeated windows.
2. Edges are token k-mers: from a node to the first later one with which they span a window at least. Edges that
   occur twice are repeated, with all windows inside.
3. Where a repeated edge has one follower, and that follower one predecessor, they belong to one path. Joins
   count followers, and the components of these pairs are the compacted paths (unitigs); consecutive edges of a
   path become one long span of the source text.
4. Source coordinates verify what the paths leave open: near the ends of spans, windows whose least sequence occurs twice are
   hashed from the text and counted. Only repeated ones are added.

Hashes have 64 bits; a false match needs two different word sequences with equal hashes.

Null and empty texts have no words. Repeated rows are texts that repeat each other; rows with equal doc_id and different texts
are told apart. Columns other than doc_id and text are left out. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlink.llm.common import U64, Keyed, Rolling, Words, anchors, chunks, shuffles_dropped, sliding_min, texts, written
from eventlink.llm.components import components
from eventlink.operators.joins import attach

WINDOW, GRAM = 35, 16
WIDTH = WINDOW - GRAM + 1

Spans = list[list[dict]]


class Graph:
    """Words, nodes and windows of a chunk of texts. Places count the chunk's words."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.words = Words(raw, at)
        self.rolling = Rolling(self.words.hash)
        self.inside = self.words.inside(WINDOW)
        self.grams = self.rolling.windows(GRAM)
        self.nodes = anchors(self.grams, WIDTH, self.inside)

    def shifted(self, lists: pa.Array) -> np.ndarray:
        """Places of a list column that count from each text's first word, as places of the chunk, in order."""
        n = np.diff(lists.offsets.to_numpy())
        return np.unique(lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(self.words.first[:-1], n))

    def covered(self, spans: pa.Array) -> np.ndarray:
        """For each word whether a span (lo, hi) of its text holds it."""
        depth = np.zeros(len(self.words.start) + 1, np.int64)
        n = np.diff(spans.offsets.to_numpy())
        first = np.repeat(self.words.first[:-1], n)
        flat = spans.flatten()
        np.add.at(depth, flat.field("lo").to_numpy(zero_copy_only=False) + first, 1)
        np.subtract.at(depth, flat.field("hi").to_numpy(zero_copy_only=False) + first, 1)
        return np.cumsum(depth[:-1]) > 0

    def edges(self, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of edges between nodes that occur twice."""
        to = np.searchsorted(twice, twice + WINDOW - GRAM)
        start, to = twice[to < len(twice)], to[to < len(twice)]
        last = twice[to]
        keep = self.words.doc[start] == self.words.doc[last]
        return start[keep], last[keep] + GRAM

    def windows(self, twice: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose least sequence occurs twice, and whether each has a word that is not covered.

        The other nodes inside a window may have been chosen for its neighbours, so they tell nothing.
        """
        if not self.inside.any():
            return np.empty(0, np.int64), np.empty(0, bool)
        least = sliding_min(self.grams, WIDTH)
        found = np.flatnonzero(self.inside & np.isin(least, self.grams[twice]))
        full = np.concatenate([[0], np.cumsum(covered)])
        return found, full[found + WINDOW] - full[found] < WINDOW


def _nodes(table: DataFrame) -> DataFrame:
    """(key, gram, place) of all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches):
            g = Graph(raw, at)
            yield _rows(batch, g, g.nodes, ("gram", g.grams[g.nodes].view(np.int64)))

    return table.mapInArrow(run, "key long, place int, gram long")


def _rows(batch: pa.RecordBatch, g: Graph, places: np.ndarray, *more: tuple[str, np.ndarray]) -> pa.RecordBatch:
    """key and place within the text for places of a chunk, and further columns."""
    ids = batch.column(batch.schema.get_field_index("key")).take(pa.array(g.words.doc[places]))
    columns = [ids, pa.array(g.words.place[places].astype(np.int32)), *(pa.array(c) for _, c in more)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "place", *(n for n, _ in more)])


def _edges(table: DataFrame) -> DataFrame:
    """(key, place, length, edge) of edges between nodes that occur twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches):
            g = Graph(raw, at)
            start, end = g.edges(g.shifted(batch.column("nodes")))
            edge = g.rolling.between(start, end).view(np.int64)
            yield _rows(batch, g, start, ("length", (end - start).astype(np.int32)), ("edge", edge))

    return table.mapInArrow(run, "key long, place int, length int, edge long")


def compacted(edges: DataFrame) -> DataFrame:
    """(key, path, lo, hi): long spans of the source texts along the nonbranching paths of repeated edges."""
    twice = edges.groupBy(F.col("edge").alias("_edge")).agg(F.count("*").alias("n")).where("n > 1").select("_edge")
    by_text = Window.partitionBy("key").orderBy("place")
    repeated = written(
        attach(edges, twice, [(F.col("edge"), "_edge")], "inner")
        .withColumn("follower", F.lead(F.struct("edge", "place")).over(by_text))
        .withColumn("follower", F.expr("CASE WHEN follower.place < place + length THEN follower.edge END"))
    )
    arcs = repeated.where("follower IS NOT NULL").select("edge", "follower").distinct()
    out = arcs.groupBy("edge").agg(F.count("*").alias("n"), F.min("follower").alias("follower")).where("n = 1")
    into = arcs.groupBy("follower").agg(F.count("*").alias("n")).where("n = 1").select("follower")
    single = out.select("edge", "follower").join(into, "follower").withColumn("single", F.lit(True))
    # Within a text a run of such pairs is known to be one path: each of its edges is linked with the run's least.
    in_run = repeated.join(single, ["edge", "follower"], "left").withColumn(
        "run", F.sum(F.when(F.lag("single").over(by_text), 0).otherwise(1)).over(by_text)
    )
    stars = in_run.select(F.col("edge").alias("a"), F.min("edge").over(Window.partitionBy("key", "run")).alias("b"))
    paths = components(stars.distinct()).toDF("_edge", "path")
    on_path = attach(repeated, paths, [(F.col("edge"), "_edge")]).select(
        "key", F.coalesce("path", "edge").alias("path"), F.col("place").alias("lo"), (F.col("place") + F.col("length")).alias("hi")
    )
    in_order = Window.partitionBy("key", "path").orderBy("lo", "hi")
    reach = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("lo") <= reach, 0).otherwise(1)
    spans = on_path.withColumn("begins", begins).withColumn("span", F.sum("begins").over(in_order))
    return spans.groupBy("key", "path", "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("span")


def _window_counts(table: DataFrame) -> DataFrame:
    """(hash, n): windows whose least sequence occurs twice, counted once or twice per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches):
            g = Graph(raw, at)
            places, _ = g.windows(g.shifted(batch.column("nodes")), g.covered(batch.column("spans")))
            value, n = np.unique(g.rolling.between(places, places + WINDOW), return_counts=True)
            columns = [pa.array(value.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "n"])

    return table.mapInArrow(run, "hash long, n int")


def _open_windows(table: DataFrame) -> DataFrame:
    """(key, place, hash) of such windows that paths do not cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches):
            g = Graph(raw, at)
            places, uncovered = g.windows(g.shifted(batch.column("nodes")), g.covered(batch.column("spans")))
            places = places[uncovered]
            yield _rows(batch, g, places, ("hash", g.rolling.between(places, places + WINDOW).view(np.int64)))

    return table.mapInArrow(run, "key long, place int, hash long")


_SPANS = "array<struct<lo:int,hi:int>>"
REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _lists(spans: DataFrame, name: str) -> DataFrame:
    """The spans of each text in one list, which is no longer than the text."""
    return spans.groupBy("key").agg(F.collect_list(F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))).alias(name))


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(key, spans) of texts (key, text) with repeated windows: spans of words (lo, hi) that may overlap."""
    nodes = _nodes(keyed)
    twice = nodes.groupBy(F.col("gram").alias("_gram")).agg(F.count("*").alias("n")).where("n > 1").select("_gram")
    listed = written(attach(nodes, twice, [(F.col("gram"), "_gram")], "inner").groupBy("key").agg(F.collect_list("place").alias("nodes")))
    edges = written(_edges(keyed.join(listed, "key")))
    paths = written(compacted(edges))
    known = written(
        listed.join(_lists(paths, "spans"), "key", "left").withColumn(
            "spans", F.coalesce("spans", F.array().cast(_SPANS))
        )
    )
    table = keyed.join(known, "key")
    counts = _window_counts(table).groupBy(F.col("hash").alias("_hash")).agg(F.sum("n").alias("n")).where("n > 1").select("_hash")
    more = attach(_open_windows(table), counts, [(F.col("hash"), "_hash")], "inner").select("key", F.col("place").alias("lo"), (F.col("place") + WINDOW).alias("hi"))
    return _lists(paths.select("key", "lo", "hi").unionByName(more), "spans")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and a number of the row as key, so that no two rows share one."""
    return texts(docs).withColumn("key", F.monotonically_increasing_id())


def _without(keyed: DataFrame, spans: DataFrame, schema: str, digest: bool) -> DataFrame:
    joined = keyed.select("key", "doc_id", "text").join(spans, "key", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches):
            words = Words(raw, at)
            g = Graph.__new__(Graph)
            g.words = words
            gone = g.covered(batch.column("spans"))
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            data, said = raw.tobytes(), []
            for k in range(batch.num_rows):
                if removed[k]:
                    places = np.flatnonzero(~gone[words.first[k] : words.first[k + 1]]) + words.first[k]
                    said.append(b" ".join([data[a:b] for a, b in zip(words.start[places], words.end[places], strict=True)]))
                elif digest:
                    said.append(b" ".join(data[at[k] : at[k + 1]].split()))
                else:
                    said.append(None)
            n = pa.array(words.count.astype(np.int64)), pa.array(removed.astype(np.int64))
            if digest:
                out = [batch.column(1), *n, pa.array([sha256(s).hexdigest() for s in said])]
                yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in REMOVED.split(", ")])
            else:
                kept = pa.array([None if s is None else s.decode() for s in said], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(1), *n, kept], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: its words, how many go, and the digest of the kept words joined by spaces (see ``REMOVED``)."""
    with shuffles_dropped(docs.sparkSession):
        keyed = Keyed(keyed_texts(docs), "key")
        try:
            return written(_without(keyed.frame(), repeated_spans(keyed.frame()), REMOVED, True))
        finally:
            keyed.drop()


def kept_texts(docs: DataFrame) -> DataFrame:
    """Of documents that lose words: doc_id, n_words, n_removed, and kept_text, the kept words joined by spaces."""
    with shuffles_dropped(docs.sparkSession):
        keyed = Keyed(keyed_texts(docs), "key")
        try:
            out = _without(keyed.frame(), repeated_spans(keyed.frame()), "doc_id long, n_words long, n_removed long, kept_text string", False)
            return written(out.where("n_removed > 0"))
        finally:
            keyed.drop()


SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, k, list_aggregate(list_slice(w, k, k + 34), 'string_agg', ' ') AS said
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM words)
), twice AS (
    SELECT doc_id, k FROM windows QUALIFY count(*) OVER (PARTITION BY said) > 1
), gone AS (
    SELECT DISTINCT doc_id, k + j AS k FROM twice, (SELECT unnest(range(0, 35)) AS j)
), each AS (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM words
), kept AS (
    SELECT doc_id, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone.k IS NULL) AS said
    FROM each LEFT JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
