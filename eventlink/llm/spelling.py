"""Words that are spelling variants of one another: one inserted, deleted or replaced code point apart.

Runs of letters are counted per task and summed (:func:`words`). For pairs whose longer word has m + 1 code points, a pair is
one edit apart exactly if its common prefix and suffix together reach m. The prefix then ends in one of ``SLOTS`` slots of the
m + 1 places, and everything before and after that slot is common. So a word is dealt out once per slot and per length of
the longer word (its own, or one more), under a digest of what lies outside the slot, and only words alike there meet.

Where they meet they are compared as tiles: words in the order of their digests are laid into blocks of padded code-point
matrices, and blocks whose digests overlap are compared place by place, all words of one with all of the other
(:func:`near_in`). A pair is reported in the slot where its prefix ends, so it is found once. Crowded digests (more than
``SIDE`` words) are cut into parts, and each pair of parts is a tile of its own, so no task takes a crowded digest whole.

A null text has no words, a null doc_id is written as empty text before the colon. Very long runs take blocks of fewer words.
Ties between forms go to the word smaller in code-point order. Repeated rows count again. Other columns are
left out. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from eventlink.llm.common import partitions, written
from eventlink.operators.joins import attach

_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
# Which runs lose a code point, how long and frequent a word is at least, how much more frequent its form is.
EVERY = 199
LETTERS = 6
LEAST = 5
TIMES = 5

#: Slots in which the common prefix of two words may end.
SLOTS = 4
#: Words of one digest that one tile compares at most with as many others.
SIDE = 2048
#: Words of a block; longer words take smaller blocks, so that a comparison has ``CELLS`` places at most.
ROWS = 64
CELLS = 1 << 20
#: Distinct words that a task sums up before it hands them on.
HELD = 200_000
#: What a tile's rows have in common.
TILE = ["longest", "slot", "outside", "low", "high"]


def as_found(key: str, run: bytes) -> bytes:
    """The run, or the run less one code point where its checksum says so."""
    h = zlib.crc32(f"{key}:".encode() + run)
    if h % EVERY:
        return run
    text = run.decode()
    k = h % len(text)
    return (text[:k] + text[k + 1 :]).encode()


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts with their numbers of occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def summed() -> pa.RecordBatch:
            kept = [(w.decode(), n) for w, n in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for run, n in Counter(_RUN.findall(text.as_py().lower())).items():
                    if len(run) >= LETTERS:
                        held[run if zlib.crc32(run, start) % EVERY else as_found("" if key is None else str(key), run)] += n
            if len(held) >= HELD:
                yield summed()
                held.clear()
        if held:
            yield summed()

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    found = docs.select("doc_id", text).mapInArrow(count, "word string, n long")
    total = found.where(F.length("word") >= LETTERS).groupBy("word").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") >= LEAST)


def dealt(counted: DataFrame, side: int = SIDE) -> DataFrame:
    """Words under the digests of what lies outside a slot, in tiles: (longest, slot, outside, low, high, part, word, n).

    ``longest`` is the length of the longer word of a pair. A digest under which one word lies is left out. ``part`` is the
    word's own, ``low`` and ``high`` are the two parts that the tile compares.
    """
    size = F.length("word")
    ways = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    rows = counted.select("word", "n", F.explode(F.array(size, size + 1)).alias("longest"))
    rows = rows.select("*", F.explode(ways).alias("slot"))
    # The places 0 .. m of a longer word of m + 1 code points, cut into slots as even as can be.
    begin = F.floor(F.col("longest") * F.col("slot") / SLOTS).cast("int")
    end = F.floor(F.col("longest") * (F.col("slot") + 1) / SLOTS).cast("int")
    behind = F.col("longest") - end
    outside = F.xxhash64(F.substring("word", F.lit(1), begin), F.when(behind > 0, F.right("word", behind)).otherwise(""))
    rows = rows.select("longest", "slot", outside.alias("outside"), "word", "n")
    keys = ["longest", "slot", "outside"]
    crowds = rows.groupBy(*keys).agg(F.count("*").alias("crowd")).where("crowd > 1")
    crowds = crowds.withColumnsRenamed({k: f"_{k}" for k in keys})
    rows = attach(rows, crowds, [(F.col(k), f"_{k}") for k in keys], "inner")
    parts = F.ceil(F.col("crowd") / side).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("word", F.lit(1)), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.select(*keys, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "word", "n")


def _matrix(values: list[bytes], width: int, pad: int, turned: bool) -> np.ndarray:
    """Code points (below 256) of words, from the left or, turned, from the right, padded to a width."""
    fill = bytes([pad])
    rows = [(v[::-1] if turned else v).ljust(width, fill) for v in values]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(values), width)


class Block:
    """Words next to one another in the order of their tiles; ``longest`` is the same for all of them."""

    def __init__(self, rows: pa.RecordBatch, tile: np.ndarray):
        def numbers(name: str) -> np.ndarray:
            return rows.column(name).to_numpy(zero_copy_only=False).astype(np.int64)

        self.words, self.counts, self.tile = rows.column("word").to_pylist(), numbers("n"), tile
        self.longest, self.slot, self.part = int(numbers("longest")[0]), numbers("slot"), numbers("part")
        self.apart = numbers("low") != numbers("high")
        codes = [w.encode("latin-1") for w in self.words]
        self.size = np.fromiter(map(len, codes), np.int64, len(codes))
        turned = [c[::-1] for c in codes]
        self.matrices = [[self._matrix(side, bytes([pad])) for side in (codes, turned)] for pad in (0, 1)]

    def _matrix(self, codes: list[bytes], pad: bytes) -> np.ndarray:
        width = self.longest + 1
        return np.frombuffer(b"".join(c.ljust(width, pad) for c in codes), np.uint8).reshape(len(codes), width)

    def near(self, other: Block) -> tuple[np.ndarray, np.ndarray]:
        """Places in this block and in the other (at or after it) of words one edit apart whose prefix ends in their slot."""
        # The pads differ, so a common prefix or suffix ends with the shorter word at the latest.
        prefix, suffix = ((a[:, None] == b[None]).argmin(2) for a, b in zip(self.matrices[0], other.matrices[1], strict=True))
        m = self.longest - 1
        begin, end = (self.longest * (self.slot + k) // SLOTS for k in (0, 1))
        found = (self.tile[:, None] == other.tile[None]) & (prefix + suffix >= m) & (prefix >= begin[:, None]) & (prefix < end[:, None])
        found &= np.maximum(self.size[:, None], other.size[None]) == self.longest
        # A tile of two parts compares across them only; each part has a tile of its own.
        found &= (self.part[:, None] != other.part[None]) | ~self.apart[:, None]
        if self is other:
            found = np.triu(found, 1)
        return np.nonzero(found)


def near_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`dealt` in the order of their tiles to pairs (word, near, near_n), both ways."""
    held: list[Block] = []  # blocks of the tile that goes on
    last, number = None, 0
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in TILE], 1)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        new[:1] = last is None or (keys[0] != last).any()
        tile, longest, at = number + np.cumsum(new), keys[:, 0], 0
        while at < len(keys):
            rows = min(ROWS, max(1, int((CELLS / (longest[at] + 1)) ** 0.5)))
            end = min(at + rows, int(np.searchsorted(longest, longest[at], "right")))
            block = Block(batch.slice(at, end - at), tile[at:end])
            held = [b for b in held if b.tile[-1] == block.tile[0]]
            left, right, more = [], [], []
            for earlier in (*held, block):
                i, j = earlier.near(block)
                left += [earlier.words[k] for k in i] + [block.words[k] for k in j]
                right += [block.words[k] for k in j] + [earlier.words[k] for k in i]
                more += [block.counts[j], earlier.counts[i]]
            held.append(block)
            if left:
                columns = [pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(np.concatenate(more))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])
            at = end
        if len(keys):
            last, number = keys[-1], int(tile[-1])


def links(counted: DataFrame, side: int = SIDE) -> DataFrame:
    """(word, near, near_n) for all pairs of words one edit apart, both ways."""
    tiles = dealt(counted, side)
    ordered = tiles.repartition(partitions(tiles.sparkSession), *TILE).sortWithinPartitions(*TILE)
    return ordered.mapInArrow(near_in, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Every round doubles the steps, and is a written table."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        seen = Observation()
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = attach(now, ahead, [(F.col("root"), "_word")])
        moved = moved.observe(seen, F.count("_root").alias("moved"))
        now = written(moved.select("word", F.coalesce("_root", "root").alias("root")))
        if not seen.get["moved"]:
            return now


def variants(docs: DataFrame, side: int = SIDE) -> DataFrame:
    """Every word with its form (the near word of largest n, if frequent enough), its root, and its number of near words."""
    counted = written(words(docs))
    best = links(counted, side).groupBy(F.col("word").alias("_word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("fewer"), "near")).alias("best")
    )
    joined = attach(counted, best, [(F.col("word"), "_word")])
    near_n = -F.col("best.fewer")
    enough = near_n >= TIMES * F.col("n")
    rows = written(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, near_n).alias("form_n"),
        )
    )
    ends = roots(rows.where("form IS NOT NULL")).withColumnRenamed("word", "_word")
    rows = attach(rows, ends, [(F.col("word"), "_word")])
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Rows of the query. Near words meet under what is left when one letter is taken out.
SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, step: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(256)) AS n)
), found AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
), runs AS (
    SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM found WHERE length(run) >= 6 GROUP BY doc_id, run
), summed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(bytes) // 2),
            lambda i: ('0x' || substr(bytes, (2 * i + 1)::INT, 2))::BIGINT)),
        lambda crc, byte: xor(crc >> 8, t[(xor(crc, byte) & 255) + 1])), 4294967295) AS h
    FROM runs, crc_table
), words AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM summed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), shorter AS (
    SELECT word, n, k, substr(word, 1, k::INT - 1) || substr(word, k::INT + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM words)
), pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), ways AS (
    SELECT word, word AS root FROM formed WHERE form IS NULL
    UNION ALL
    SELECT f.word, w.root FROM formed f JOIN ways w ON f.form = w.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ways USING (word)
"""
