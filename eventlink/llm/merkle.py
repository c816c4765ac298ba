"""Merkle manifest of a table, and a persistent version of its tree for every tampered row.

A leaf is the digest of a row's fields. Per group (language) the leaves ascend by id and pair up level by level until one
node is left, the group's subroot; subroots, ordered by group, give the root in the same way. The tree is built in aligned
blocks of ``2 ** HEIGHT`` neighbouring nodes: a block of leaves gives one node of the next table of nodes, so that no task
holds more than a block however many rows a group has.

A tampered leaf makes a version of the tree by path copying. Within its block only the ancestors are copied and all other
nodes shared (:class:`Block`); above it the version goes on as a row that copies one node a level, next to the siblings it
shares (:func:`copied`), wherever that row lies. So a version costs one digest a level, and versions are never gathered.

Every field but the id may be null (written ``-``); null ids come first and are not tampered with. Rows with equal ids go
by their leaves, repeated rows are leaves of their own. A null group is a group of its own, before all others. Empty and long texts are digested whole.
Other columns are left out. An empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlink.llm.common import partitions, written
from eventlink.operators.joins import attach

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of an aligned block.
HEIGHT = 12
EVERY = 7


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon, and the value."""
    said = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaves(docs: DataFrame, tampered: Column, changes: dict[str, Column], group: str = "lang") -> DataFrame:
    """doc_id, key (the group as a field), leaf, and the leaf with ``changes`` where the row is tampered with."""
    plain = [field(F.col(c)) for c in FIELDS]
    other = [field(changes.get(c, F.col(c))) for c in FIELDS]
    return docs.select(
        "doc_id",
        field(F.col(group)).alias("key"),
        digest(*plain).alias("node"),
        F.when(tampered, digest(*other)).alias("changed"),
    )


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their place (``pos``, from 0) within their key by ``order``, and the key's number of rows (``total``).

    Rows are sorted by ranges and numbered where they lie; places follow from the sizes of each key's runs.
    """
    n = partitions(rows.sparkSession)
    # Numbered first, so that rows alike in all else have an order of their own and may be dealt to several tasks.
    given = written(rows.withColumn("at", F.monotonically_increasing_id()))
    by = ["key", *order, "at"]
    lying = written(given.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id()))
    part = F.shiftright("seq", 33)
    runs = lying.groupBy("key", part.alias("part")).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("key").alias("_key"),
        F.col("part").alias("_part"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("total"),
    )
    placed = attach(lying, runs, [(F.col("key"), "_key"), (part, "_part")], "inner")
    return placed.withColumn("pos", F.col("seq") + F.col("shift")).drop("at", "seq", "shift")


class Block:
    """The nodes over neighbouring nodes of one block; ``levels[0]`` are its own, the last level is its top.

    A block that is all of its group is climbed until one node is left, any other one for ``height`` levels.
    """

    def __init__(self, nodes: list[str], height: int, alone: bool):
        self.levels = [nodes]
        while len(self.levels[-1]) > 1 if alone else len(self.levels) <= height:
            below = self.levels[-1]
            self.levels.append([hashlib.sha256("".join(below[k : k + 2]).encode()).hexdigest() for k in range(0, len(below), 2)])

    def siblings(self) -> pa.ListArray:
        """For each node of the block the siblings on its way to the top; empty text where there is none."""
        n, steps = len(self.levels[0]), len(self.levels) - 1
        table = np.empty((n, steps), object)
        for k, level in enumerate(self.levels[:-1]):
            others = [s for pair in zip([*level[1::2], ""], level[::2], strict=False) for s in pair][: len(level)]
            table[:, k] = np.array(others, object)[np.arange(n) >> k]
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * steps)
        return pa.ListArray.from_arrays(ends, pa.array(table.ravel(), pa.string()))

    def version(self, place: int, node: str) -> list[str]:
        """The copies that a change of one node needs, the changed node first, the version's top last."""
        copies = [node]
        for level in self.levels[:-1]:
            pair = level[place & ~1 : (place & ~1) + 2]
            pair[place & 1] = copies[-1]
            copies.append(hashlib.sha256("".join(pair).encode()).hexdigest())
            place >>= 1
        return copies


def grown(nodes: DataFrame, height: int) -> DataFrame:
    """Nodes (key, pos, total, node, ..) with their siblings up to the top of their block, and that top.

    ``copies``: of a node that has a value in ``changed``, the version's copied nodes up to the block's top.
    """
    extra = [c for c in nodes.columns if c not in ("key", "pos", "total", "node", "changed")]
    given = nodes if "changed" in nodes.columns else nodes.withColumn("changed", F.lit(None).cast("string"))
    given = given.select("key", F.call_function("shiftright", F.col("pos"), F.lit(height)).alias("block"), "pos", "total", "node", "changed", *extra)

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        block = Block(rows.column("node").to_pylist(), height, rows.column("total")[0].as_py() <= 1 << height)
        copies = [None if c is None else block.version(k, c) for k, c in enumerate(rows.column("changed").to_pylist())]
        n = rows.num_rows
        return (
            rows.drop_columns("changed")
            .append_column("siblings", block.siblings())
            .append_column("top", pa.array([block.levels[-1][0]] * n, pa.string()))
            .append_column("copies", pa.array(copies, pa.list_(pa.string())))
        )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.drop("changed").schema)
    return given.groupBy("key", "block").applyInArrow(build, f"{kinds}, siblings array<string>, top string, copies array<string>")


def climbed(nodes: DataFrame, height: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All blocks over ``nodes``, level of blocks by level: the nodes as :func:`grown`, the blocks, and the tops of the keys.

    Blocks (key, block): ``above``, the siblings from the block's top to the key's, and ``subroot``, that top.
    """
    size = 1 << height
    levels = [written(grown(nodes, height))]
    while True:
        first = levels[-1].where(F.col("pos") % size == 0)
        going = first.where(F.col("total") > size)
        if going.isEmpty():
            break
        up = going.select("key", F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"), F.col("top").alias("node"))
        levels.append(written(grown(up, height)))
    blocks = subroots = None
    for level in reversed(levels):
        first = level.where(F.col("pos") % size == 0)
        own = first.where(F.col("total") <= size).select("key", "block", F.array().cast("array<string>").alias("above"), F.col("top").alias("subroot"))
        subroots = own if subroots is None else subroots.unionByName(own)
        if blocks is not None:
            # A block of this level is a node of the next one; its way up is that node's, then that of the node's block.
            nodes_above = higher.select("key", F.col("pos").alias("block"), "siblings", F.col("block").alias("_over"))
            over = blocks.select(F.col("key").alias("_key"), F.col("block").alias("_block"), "above", "subroot")
            joined = attach(nodes_above, over, [(F.col("key"), "_key"), (F.col("_over"), "_block")], "inner")
            own = own.unionByName(joined.select("key", "block", F.concat("siblings", "above").alias("above"), "subroot"))
        blocks, higher = written(own), level
    return levels[0], blocks, subroots.select("key", "subroot")


def copied(node: Column, siblings: Column, pos: Column) -> Column:
    """The nodes on the way up from ``node``, itself first, made of shared siblings; ``pos`` is its place in its level."""

    def step(found: Column, at: Column) -> Column:
        below = F.element_at(found, -1)
        pair = F.when(at["right"], F.concat(at["node"], below)).otherwise(F.concat(below, at["node"]))
        return F.concat(found, F.array(F.sha2(pair, 256)))

    steps = F.transform(
        siblings,
        lambda s, k: F.struct(s.alias("node"), (F.call_function("shiftright", pos, k) % 2 == 1).alias("right")),
    )
    return F.aggregate(steps, F.array(node), step)


def manifest(found: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Rows of :func:`leaves` with subroot, root, their siblings up to the root, and the nodes of their version.

    ``copies`` are the copied nodes of a tampered row's version, its own root last; for other rows the nodes of the tree
    itself above their block.
    """
    base, blocks, subroots = climbed(ranked(found, "doc_id", "node"), height)
    name = F.when(F.col("key") != "-", F.expr("substring(key, instr(key, ':') + 1)"))
    tops = subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), name.alias("name"), F.col("subroot").alias("node"))
    upper, over, _ = climbed(ranked(tops, "name"), height)
    over = over.select(F.col("block").alias("_block"), "above", F.col("subroot").alias("root"))
    upper = attach(upper, over, [(F.col("block"), "_block")], "inner")
    upper = upper.select(F.col("group").alias("_group"), F.col("pos").alias("rank"), F.concat("siblings", "above").alias("beyond"), "root")
    way = attach(blocks, upper, [(F.col("key"), "_group")], "inner")
    way = written(way.select(F.col("key").alias("_key"), F.col("block").alias("_block"), "above", "subroot", "rank", "beyond", "root"))
    rows = attach(base, way, [(F.col("key"), "_key"), (F.col("block"), "_block")], "inner")
    start = F.coalesce(F.element_at("copies", -1), "top")
    to_subroot = copied(start, F.col("above"), F.col("block"))
    rows = rows.select(
        "doc_id",
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        F.concat("siblings", "above", "beyond").alias("siblings"),
        F.coalesce("copies", F.array("top")).alias("low"),
        to_subroot.alias("middle"),
        "beyond",
        "rank",
    )
    to_root = copied(F.element_at("middle", -1), F.col("beyond"), F.col("rank"))

    def without_last(nodes: str) -> Column:
        return F.slice(nodes, F.lit(1), F.size(nodes) - 1)

    copies = F.concat(without_last("low"), without_last("middle"), to_root)
    return rows.select("doc_id", "leaf", "subroot", "root", "siblings", copies.alias("copies"))


def tampering(docs: DataFrame) -> tuple[Column, dict[str, Column]]:
    """Rows whose id's checksum is a multiple of ``EVERY`` have one character more."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return checksum % EVERY == 0, {"n_chars": F.col("n_chars") + 1}


def verify(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest's digests, the root that each row's version folds to, and whether it is the untampered one."""
    rows = manifest(leaves(docs, *tampering(docs)), height)
    folded = F.element_at("copies", -1)
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


#: Rows of the query. The checksum is made of a table of its 256 byte steps.
SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, step: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(256)) AS n)
), rows AS (
    SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
        lambda crc, byte: xor(crc >> 8, t[(xor(crc, byte) & 255) + 1])) AS crc
    FROM documents, crc_table
), fields AS (
    SELECT doc_id, lang, coalesce(xor(crc, 4294967295) % 7 = 0, false) AS tampered,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS size,
        coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS changed_size,
        coalesce(strlen(text) || ':' || text, '-') AS body
    FROM rows
), leaves AS (
    SELECT doc_id, lang, tampered, sha256(head || size || body) AS leaf, sha256(head || changed_size || body) AS changed FROM fields
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), nodes AS (
    SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM placed
    UNION ALL
    SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2
    FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2
), subroots AS (
    SELECT lang, node AS subroot, level AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS level, rank AS pos, subroot AS node, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2
    FROM tops WHERE n > 1 GROUP BY level, pos // 2
), steps AS (
    SELECT p.lang, p.pos AS row, n.level AS step, n.node AS sibling, n.pos % 2 = 0 AS is_left
    FROM placed p JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.pos = xor(p.pos >> n.level, 1)
    UNION ALL
    SELECT p.lang, p.pos, s.height + t.level, t.node, t.pos % 2 = 0
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN tops t ON t.pos = xor(s.rank >> t.level, 1)
), root AS (
    SELECT node AS root, level AS height FROM tops WHERE n = 1
), folds AS (
    SELECT lang, pos AS row, 0 AS step, CASE WHEN tampered THEN changed ELSE leaf END AS node FROM placed
    UNION ALL
    SELECT f.lang, f.row, f.step + 1, sha256(CASE WHEN is_left THEN sibling || f.node ELSE f.node || coalesce(sibling, '') END)
    FROM folds f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang JOIN root r ON f.step < s.height + r.height
    LEFT JOIN steps e ON e.lang IS NOT DISTINCT FROM f.lang AND e.row = f.row AND e.step = f.step
), proofs AS (
    SELECT lang, row, string_agg(sibling, '' ORDER BY step) AS siblings FROM steps GROUP BY lang, row
), last AS (
    SELECT f.lang, f.row, f.node FROM folds f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang JOIN root r ON f.step = s.height + r.height
)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(siblings, '')) AS proof_sha256, l.node AS folded_root, l.node = r.root AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN last l ON l.lang IS NOT DISTINCT FROM p.lang AND l.row = p.pos
LEFT JOIN proofs o ON o.lang IS NOT DISTINCT FROM p.lang AND o.row = p.pos CROSS JOIN root r
"""
