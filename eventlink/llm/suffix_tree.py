"""Scores of a probabilistic suffix tree over words.

Learning. Sequences of one word, two words, and so on are counted over all training texts. A sequence is worth keeping if it
occurs ``LEAST`` times; a longer one is counted where both its parts are kept, which loses none that occurs so often, and
where the context that it would refine is a state. A context is a state of the tree if its distribution of next words
diverges from that of its longest suffix: the log-likelihood ratio over all its occurrences is at least ``GAIN``. Contexts
grow word by word as long as there are states whose next words still cost as much as that in all (else no longer context could
gain it) and sequences that occur twice; no length is set, and a context that does not diverge is not refined. Next words
are smoothed by absolute discounting: what is taken off, and all next words that are not kept, go to the suffix's
distribution, and at the root to add-one word frequencies.

Scoring. A word's probability is read at the state of the longest suffix before it. It is settled, and added to its text's score,
as soon as no longer context can change it; a block is dropped once only its front (:class:`Front`) goes on.

Nothing is sent to the driver or to every task, so the tree grows with the corpus. Texts are gathered in blocks of tokens. A
block asks for its distinct sequences, dealt out by ranges of their hashes; each range sums up what was asked and answers every
block (:func:`exchange`). A message holds a block's sorted hashes of a range and a byte for most counts; the number of ranges follows the number of
tokens, so a range's size does not, and there is a message for each block and range, as there is a segment in a shuffle. One of the blocks that
ask for a sequence owns it and hands it on as a next word of its context; shares and
gains of contexts are aggregates, unless a context has one kept next word only, and blocks ask for the shares of their own contexts.
Entries go before the shares are handed on, as counts. Fronts of few tokens lie in fewer files, and their sequences in fewer ranges.

Hashes have 64 bits. Null and empty texts consist of the end alone. Repeated rows count and are scored as often as they occur. Null
ids count as an empty string in the split. Columns other than doc_id and text are left out. An empty table gives an empty
table; without any training text every word is unknown.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlink.llm.common import U64, Keyed, Words, chunks, mixed, partitions, shuffles_dropped, texts, written
from eventlink.operators.joins import attach

#: Occurrences of a context, and of a context with a next word, at least.
LEAST = 2
GAIN, DISCOUNT = 10.0, 0.5
#: Words in the contexts that are looked at for all tokens; longer ones are looked at where contexts still grow.
DENSE = 2
END = U64(0xE0D)
#: Tokens of a block (the last text of a block goes in whole).
BLOCK = 1 << 18
#: Bytes that Spark hands to Python at once, as blocks are large rows.
HANDED = "4m"
#: Tokens for each range of hashes, and ranges at least; a front has no more ranges than one for every ``FEW`` of its tokens.
RANGE, RANGES, FEW = 1 << 22, 64, 1 << 14
#: Tokens of fronts in a file, and fronts, as texts go with them.
FRONT, FRONTS = 1 << 17, 64


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words and its end, and their number in each text."""
    words = Words(raw, at, lower=True)
    return np.insert(words.hash, words.first[1:], END), words.count + 1


def extended(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of all but the last word, and the last."""
    return mixed(before * U64(0x9E3779B97F4A7C15) + word)


def shifted(x: np.ndarray) -> np.ndarray:
    """Of each token what the token before it has (0 at the first)."""
    return np.concatenate([np.zeros(1, x.dtype), x[:-1]])


def numbered(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, where each comes first, and of every value its place among them.

    One sort of the values' upper bits with their places below these; only where cut values lie out of order are whole ones sorted.
    """
    if not len(value):
        return value, np.empty(0, np.int64), np.empty(0, np.int64)
    least, width = value.min(), (len(value) - 1).bit_length()
    room = U64(64 - int(value.max() - least).bit_length())
    below = U64((1 << width) - 1)
    key = (((value - least) << np.minimum(room, U64(63))) & ~below) | np.arange(len(value), dtype=U64)
    key.sort()
    order = (key & below).view(np.int64)
    ordered = value[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(value, kind="stable")
        ordered = value[order]
    new = np.ones(len(value), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    place = np.empty(len(value), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], order[new], place


BLOCKS = "block long, tokens long, trained long, ids array<long>, held array<boolean>, sizes array<int>, words binary, codes binary"


def blocks(table: DataFrame) -> DataFrame:
    """Texts of (doc_id, text, held_out) as blocks: ids, whether each is held out, its tokens, distinct tokens, and their places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 36, 0, []

        def row() -> pa.RecordBatch:
            ids, out, sizes, value = zip(*held, strict=True)
            words, _, codes = numbered(np.concatenate(value))
            lists = [pa.concat_arrays([c.cast(kind) for c in x]) for x, kind in ((ids, pa.int64()), (out, pa.bool_()))]
            lists.append(pa.array(np.concatenate(sizes).astype(np.int32)))
            columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            planes = np.ascontiguousarray(codes.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()
            data = [pa.array([zstandard.compress(x, 1)], pa.binary()) for x in (coded(words), planes)]
            trained = sum(int(n.sum()) - int(n[h.to_numpy(zero_copy_only=False)].sum()) for h, n in zip(out, sizes, strict=True))
            numbers = [pa.array([number]), pa.array([len(codes)]), pa.array([trained])]
            return pa.RecordBatch.from_arrays([*numbers, *columns, *data], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch, raw, at in chunks(batches):
            value, sizes = tokens(raw, at)
            held.append((batch.column(0), batch.column(2), sizes, value))
            size += len(value)
            if size >= BLOCK:
                yield row()
                number, size, held = number + 1, 0, []
        if held:
            yield row()

    return table.mapInArrow(run, BLOCKS)


@dataclass
class Level:
    """Sequences of one length: the hash at each token (the last word), where they are looked at, the distinct ones there, and of
    each token's sequence its place among these; then what is known of the distinct ones.

    ``led``: tokens before which the sequence one word shorter may be a context; ``asked``: those contexts among the distinct shorter ones.
    """

    whole: np.ndarray
    ok: np.ndarray
    value: np.ndarray
    place: np.ndarray
    led: np.ndarray | None = None
    n: np.ndarray | None = None
    owned: np.ndarray | None = None
    share: np.ndarray | None = None
    grows: np.ndarray | None = None

    @cached_property
    def places(self) -> np.ndarray:
        """``place`` of every token; the number of distinct sequences where none is looked at."""
        out = np.full(len(self.ok), len(self.value))
        out[self.ok] = self.place
        return out

    def at_tokens(self, x: np.ndarray) -> np.ndarray:
        return np.append(x, np.zeros(1, x.dtype)).take(self.places)

    @cached_property
    def counts(self) -> np.ndarray:
        """``n`` at each token."""
        return self.at_tokens(self.n)


class Block:
    """The tokens of a block, and its levels as far as their counts (``n1``, ..) and shares (``share1``, ..) are there."""

    def __init__(self, row: dict, further: bool):
        """``further``: with one more level that has no counts yet."""
        words = decoded(zstandard.decompress(row["words"]))
        planes = np.frombuffer(zstandard.decompress(row["codes"]), np.uint8).reshape(4, -1)
        codes = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
        self.row, self.word = row, words[codes]
        sizes = np.array(row["sizes"], np.int64)
        self.held = np.array(row["held"], bool)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.train = ~self.held[self.doc]
        self.levels = [Level(self.word, np.ones(len(codes), bool), words, codes)]
        while f"n{len(self.levels)}" in row:
            k = len(self.levels)
            level = self.levels[-1]
            level.n, level.owned = counts_of(row[f"n{k}"])
            if not further and f"n{k + 1}" not in row:
                break
            self.levels.append(self.longer())
            if f"share{k}" in row:
                # The shares of a level's contexts are asked for by the tokens after them.
                level.share, level.grows = np.zeros(len(level.n)), np.zeros(len(level.n), bool)
                at = self.contexts()
                level.share[at], level.grows[at] = shares_of(row[f"share{k}"], level.n[at])

    def longer(self) -> Level:
        """The next level: sequences of which both parts are kept, and whose context refines a state."""
        kept, led = self.leading()
        whole = extended(shifted(self.levels[-1].whole), self.word)
        ok = led & kept
        value, _, place = numbered(whole[ok])
        return Level(whole, ok, value, place, led)

    def leading(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens whose sequence on the last level is kept, and those before which one may be a context of the next level."""
        below, k = self.levels[-1], len(self.levels)
        kept = below.counts >= LEAST
        led = shifted(kept) & (self.place >= k)
        if k > 1:
            refined = self.levels[k - 2]
            led &= shifted(refined.at_tokens(refined.grows))
        return kept, led

    def contexts(self) -> np.ndarray:
        """Places of the last level's contexts among the sequences of the level before it."""
        context, led = self.levels[-2], self.levels[-1].led
        asked = np.zeros(len(context.value), bool)
        asked[context.places[np.flatnonzero(led) - 1]] = True
        return np.flatnonzero(asked)

    def root(self, tree: Tree) -> np.ndarray:
        return self.levels[0].at_tokens(tree.root(self.levels[0].n))

    def probability(self, tree: Tree, depth: int, at: np.ndarray) -> np.ndarray:
        """Of the tokens at these places, by contexts of ``depth`` words at most."""
        words = self.levels[0]
        p = (10.0 ** tree.root(words.n))[words.place[at]]
        for k in range(1, depth + 1):
            context, whole = self.levels[k - 1], self.levels[k]
            share = np.append(context.share, 0.0)[context.places[at - 1]]
            rows = np.flatnonzero(whole.led[at] & (share > 0))
            n = whole.counts[at[rows]]
            p[rows] = share[rows] * p[rows] + np.where(n >= LEAST, n - DISCOUNT, 0.0) / context.counts[at[rows] - 1]
        return p


def packed(n: np.ndarray) -> bytes:
    """Counts, one byte each; those beyond a byte follow behind the others."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype(np.int64).tobytes()


def unpacked(data: bytes, size: int, at: int = 0) -> tuple[np.ndarray, int]:
    """So many counts of ``data`` from a place on, and the place behind them."""
    n = np.frombuffer(data, np.uint8, size, at).astype(np.int64)
    large = np.flatnonzero(n == 255)
    n[large] = np.frombuffer(data, np.int64, len(large), at + size)
    return n, at + size + 8 * len(large)


def bits(data: bytes, size: int, at: int) -> tuple[np.ndarray, int]:
    end = at + -(-size // 8)
    return np.unpackbits(np.frombuffer(data, np.uint8, end - at, at), count=size).astype(bool), end


def counts_of(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts, and whether the block owns the sequence, out of the answers of all ranges."""
    n, owned, at = [np.empty(0, np.int64)], [np.empty(0, bool)], 0
    data = data or b""
    while at < len(data):
        (size,) = struct.unpack_from("<I", data, at)
        mine, at = bits(data, size, at + 4)
        some, at = unpacked(data, size, at)
        n.append(some), owned.append(mine)
    return np.concatenate(n), np.concatenate(owned)


def shares_of(data: bytes | None, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (0: no state) of contexts with these counts, and whether longer contexts are looked for, out of the answers of all ranges."""
    left, grows, at = [np.empty(0, np.int64)], [np.empty(0, bool)], 0
    data = data or b""
    while at < len(data):
        (size,) = struct.unpack_from("<I", data, at)
        state, at = bits(data, size, at + 4)
        more, at = bits(data, size, at)
        some = np.zeros(size, np.int64)
        some[state], at = unpacked(data, int(state.sum()), at)
        left.append(some), grows.append(more)
    return np.concatenate(left) / np.maximum(2 * n, 1), np.concatenate(grows)


@dataclass
class Front:
    """The few tokens of a block at which contexts still grow, and those before them; and the block's texts.

    ``whole`` and ``n`` are of the sequences of so many words that end at a token, ``p`` is its probability by shorter
    contexts than that, and ``led`` tells the tokens whose sequence may be looked at with one more word in front.
    Of each text: ``sizes`` and ``seen``, its tokens and the known ones; ``base``; and ``score``, that of the tokens that are settled.
    """

    block: int
    ids: list
    held: list
    pos: np.ndarray
    word: np.ndarray
    whole: np.ndarray
    n: np.ndarray
    p: np.ndarray
    led: np.ndarray
    train: np.ndarray
    sizes: np.ndarray
    seen: np.ndarray
    base: np.ndarray
    score: np.ndarray

    KINDS = {"pos": np.uint32, "word": U64, "whole": U64, "n": np.int64, "p": np.float64, "led": bool, "train": bool}
    TEXTS = {"sizes": np.int64, "seen": np.int64, "base": np.float64, "score": np.float64}
    LISTS = {"ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_())}
    SCHEMA = ", ".join(["block long, tokens long, ids array<long>, held array<boolean>", *(f"{name} binary" for name in (*KINDS, *TEXTS))])

    @staticmethod
    def of(row: dict) -> Front:
        """Columns that are not read are None."""
        arrays = {name: np.frombuffer(row[name], kind) if name in row else None for name, kind in (Front.KINDS | Front.TEXTS).items()}
        return Front(row["block"], row.get("ids"), row.get("held"), **arrays)

    def settled(self, rows: np.ndarray) -> Front:
        """Without these tokens, whose probabilities are added to the scores."""
        text = np.searchsorted(np.cumsum(self.sizes), self.pos[rows], "right")
        score = self.score + np.bincount(text, np.log10(self.p[rows]), len(self.sizes))
        return replace(self, score=score, **{name: getattr(self, name)[~rows] for name in Front.KINDS})

    def row(self) -> pa.RecordBatch:
        lists = [pa.array([getattr(self, name)], kind) for name, kind in Front.LISTS.items()]
        columns = [pa.array([getattr(self, name).astype(kind).tobytes()], pa.binary()) for name, kind in (Front.KINDS | Front.TEXTS).items()]
        numbers = [pa.array([x], pa.int64()) for x in (self.block, len(self.pos))]
        return pa.RecordBatch.from_arrays([*numbers, *lists, *columns], names=["block", "tokens", *Front.LISTS, *Front.KINDS, *Front.TEXTS])

    def before(self, x: np.ndarray) -> np.ndarray:
        """Of each token what the token before it has; 0 where that one is not here."""
        out = shifted(x)
        out[1:][self.pos[1:] != self.pos[:-1] + np.uint32(1)] = 0
        return out

    def longer(self) -> Level:
        kept = self.n >= LEAST
        led = self.led & self.before(kept)
        ok = led & kept
        whole = extended(self.before(self.whole), self.word)
        value, _, place = numbered(whole[ok])
        return Level(whole, ok, value, place, led)

    def contexts(self, level: Level) -> tuple[np.ndarray, np.ndarray]:
        """The distinct contexts of the tokens that are led, and of each such token its place among these."""
        value, _, place = numbered(self.before(self.whole)[level.led])
        return value, place


def coded(value: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte, so that their leading zeros stand together."""
    return np.ascontiguousarray(np.diff(value, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def decoded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


ASK = "bucket long, block long, asked binary, given binary"


def dealt(buckets: int, block: int, value: np.ndarray, given: Callable[[slice], bytes]) -> pa.RecordBatch:
    """Rows of ``ASK``: sorted values and what comes with them, by ranges of values."""
    bucket = ((value >> U64(32)) * U64(buckets)) >> U64(32)
    names, at = np.unique(bucket, return_index=True)
    ends = [*at[1:], len(value)]
    asked = [coded(value[a:b]) for a, b in zip(at, ends, strict=True)]
    with_them = [given(slice(a, b)) for a, b in zip(at, ends, strict=True)]
    columns = [pa.array(names.astype(np.int64)), pa.array([block] * len(names), pa.int64()), pa.array(asked, pa.binary()), pa.array(with_them, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ASK.split(", ")])


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows with the same key, which follow each other."""
    now, rows = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
            if row[key] != now:
                if rows:
                    yield now, rows
                now, rows = row[key], []
            rows.append(row)
    if rows:
        yield now, rows


def exchange(asks: DataFrame, answer: Callable[[list[dict]], Iterator[tuple[int, bytes]]], name: str, n: int | None = None) -> Keyed:
    """(block, name): the answers to each block, for its asked values in order, in ``n`` files. ``answer`` sees all rows of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches, "bucket"):
            block, said = zip(*answer(rows), strict=True) if len(rows) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array([bucket] * len(block), pa.int64()), pa.array(said, pa.binary())], names=["block", "bucket", "said"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in grouped(batches, "block"):
            whole = b"".join(r["said"] for r in rows)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([whole], pa.binary())], names=["block", name])

    n = n or partitions(asks.sparkSession)
    answers = asks.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "block long, bucket long, said binary")
    return Keyed(answers.repartition(n, "block").sortWithinPartitions("block", "bucket").mapInArrow(joined, f"block long, {name} binary"), "block", dealt=True, n=n)


def totals(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """The sum of the counts of each asked value; the first block that asked owns it."""
    asked = [decoded(r["asked"]) for r in rows]
    given = np.concatenate([unpacked(r["given"], len(x))[0] for r, x in zip(rows, asked, strict=True)])
    value, first, place = numbered(np.concatenate(asked))
    n = np.bincount(place, given, len(value)).astype(np.int64)[place]
    owned = np.zeros(len(n), bool)
    owned[first] = True
    at = 0
    for r, x in zip(rows, asked, strict=True):
        end = at + len(x)
        yield r["block"], struct.pack("<I", len(x)) + np.packbits(owned[at:end]).tobytes() + packed(n[at:end])
        at = end


def shares(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """What is left of each asked context, 0 if it is no state, and whether it grows (the last bit). States come with block -1."""
    known = [(x := decoded(r["asked"]), unpacked(r["given"], len(x))[0]) for r in rows if r["block"] < 0]
    value, left = (np.concatenate(c) for c in zip(*known, strict=True)) if known else (np.empty(0, U64), np.empty(0, np.int64))
    order = np.argsort(value)
    value, left = np.append(value[order], U64(0)), np.append(left[order], 0)
    for r in rows:
        if r["block"] >= 0:
            asked = decoded(r["asked"])
            at = np.searchsorted(value[:-1], asked)
            found = np.where((value[at] == asked) & (at < len(value) - 1), left[at], 0)
            flags = np.packbits(found > 0).tobytes() + np.packbits(found & 1).tobytes()
            yield r["block"], struct.pack("<I", len(asked)) + flags + packed(found[found > 0] >> 1)


@dataclass
class Tree:
    """The training tokens, how many are distinct, and the states (context, share, grows) of each length of contexts."""

    total: int = 0
    distinct: int = 0
    states: list[DataFrame] = field(default_factory=list)

    def root(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + 1) - math.log10(self.total + self.distinct + 1)


def split(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, held_out: the checksum of the id modulo 7 is 2."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return texts(docs, (F.crc32(name) % 7 == 2).alias("held_out"))


class Known:
    """The blocks, and what they were answered so far; all dealt out by block. ``drop`` it when nothing reads it any more.

    In the end only the answer ``front`` is left, which has the scores.
    """

    def __init__(self, table: DataFrame):
        self.blocks, self.answers = Keyed(blocks(table), "block"), {}

    def each(self, work: Callable[[Block], Iterator[pa.RecordBatch]], schema: str, levels: int, depth: int = 0, further: bool = False) -> DataFrame:
        """What ``work`` gives for every block, with the counts of so many levels and the shares of contexts up to ``depth`` words."""
        frame = self.blocks.frame()
        for name in [*(f"n{k + 1}" for k in range(levels)), *(f"share{k + 1}" for k in range(depth))]:
            frame = frame.join(self.answers[name].frame(), "block", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from work(Block({n: batch.column(n)[k].as_py() for n in batch.schema.names}, further))

        return frame.mapInArrow(run, schema)

    def drop(self) -> None:
        for t in (self.blocks, *self.answers.values()):
            t.drop()
        self.answers = {}


class Found:
    """Rows of ``FOUND`` as a table by ``kind``, of which one kind can go before the others. ``drop`` it when nothing reads it any more."""

    def __init__(self, df: DataFrame):
        self.spark, self.name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy("kind").saveAsTable(self.name)

    def frame(self, kind: int, schema: str) -> DataFrame:
        return self.spark.table(self.name).where(F.col("kind") == kind).select(*names_of(schema))

    def without(self, kind: int) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (kind = {kind})")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark hands rows to Python in batches of ``HANDED`` bytes, and writes a table's few kinds of rows side by side, without a sort."""
    given = {"spark.sql.execution.arrow.maxBytesPerBatch": HANDED, "spark.sql.maxConcurrentOutputFileWriters": "4"}
    before = {name: spark.conf.get(name) for name in given}
    for name, value in given.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


ENTRY = "context long, n long, n_context long, below double"
#: Of a state, twice the count of its context that is left to the suffix: what is not kept, and one half for each kept next word.
STATE = "context long, n_context long, left long, grows boolean"
ENTRIES, STATES, ASKS = range(3)
FOUND = f"kind int, {ENTRY}, left long, grows boolean, {ASK}"


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def rows_of(kind: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of ``FOUND``; the other columns are null."""
    size = len(next(iter(columns.values())))
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    rest = {name: pa.nulls(size, kinds[type_]) for name, type_ in (c.split() for c in FOUND.split(", "))}
    return pa.RecordBatch.from_pydict(rest | {"kind": pa.array(np.full(size, kind, np.int32))} | columns)


def learn(table: DataFrame) -> tuple[Tree, Known]:
    """The tree, and the scores of all texts."""
    known = Known(table)
    try:
        return _learned(known), known
    except BaseException:
        known.drop()
        raise


def _learned(known: Known) -> Tree:
    size = known.blocks.frame().agg(F.sum("tokens")).first()[0] or 0
    buckets = max(RANGES, -(-size // RANGE))
    def asks_of(block: int, level: Level, train: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.bincount(level.place, train[level.ok], len(level.value)).astype(np.int64)
        if len(level.value):
            yield dealt(buckets, block, level.value, lambda some: packed(n[some]))

    def entries_of(context: np.ndarray, n: np.ndarray, n_context: np.ndarray, below: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Where too few other words follow to be kept, a next word is its context's only one, and nothing is summed.
        rest = n_context - n
        lone = rest < LEAST
        at = ~lone
        yield rows_of(ENTRIES, **{k: pa.array(x[at]) for k, x in zip(names_of(ENTRY), (context.view(np.int64), n, n_context, below), strict=True)})
        context, n, n_context, below, rest = (x[lone] for x in (context, n, n_context, below, rest))
        own = (n - DISCOUNT) / n_context
        p = own + (1 - own) * below
        at = n * np.log(p / below) + rest * np.log(1 - own) >= GAIN
        state = context.view(np.int64), n_context, 2 * rest + 1, -n * np.log(p) >= GAIN
        yield rows_of(STATES, **{k: pa.array(x[at]) for k, x in zip(names_of(STATE), state, strict=True)})

    def contexts_of(block: int, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(value):
            asks = dealt(buckets, block, value, lambda some: b"")
            yield rows_of(ASKS, **dict(zip(asks.schema.names, asks.columns, strict=True)))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, left, grows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            value, said = value.view(U64), 2 * left + grows
            order = np.argsort(value)
            if len(order):
                value, said = value[order], said[order]
                yield dealt(buckets, -1, value, lambda some, said=said: packed(said[some]))

    def judged(all_: DataFrame, name: str, n: int | None = None) -> Keyed:
        """From entries, states and asks for contexts the states, and the shares that the blocks asked for."""
        rows = Found(all_)
        try:
            states = written(_states(rows.frame(ENTRIES, ENTRY)).unionByName(rows.frame(STATES, STATE)))
            tree.states.append(states.select("context", (F.col("left") / (2 * F.col("n_context"))).alias("share"), "grows"))
            for kind in (ENTRIES, STATES):
                rows.without(kind)
            return exchange(rows.frame(ASKS, ASK).unionByName(states.mapInArrow(listed, ASK)), shares, name, n)
        finally:
            rows.drop()

    # Contexts of one and two words are looked at for all tokens.
    def counts(block: Block) -> Iterator[pa.RecordBatch]:
        yield from asks_of(block.row["block"], block.levels[-1], block.train)

    def entries_and_contexts(block: Block) -> Iterator[pa.RecordBatch]:
        k = len(block.levels) - 1
        whole, context = block.levels[k], block.levels[k - 1]
        at = np.empty(len(whole.value), np.int64)
        at[whole.place] = np.flatnonzero(whole.ok)
        own = whole.owned & (whole.n >= LEAST)
        at, n_context = at[own], context.counts
        yield from entries_of(context.whole[at - 1], whole.n[own], n_context[at - 1], block.probability(root, k - 1, at))
        yield from contexts_of(block.row["block"], context.value[block.contexts()])

    known.answers["n1"] = exchange(known.each(counts, ASK, 0), totals, "n1")
    tree = Tree(*_words(known))
    root = Tree(tree.total, tree.distinct)
    for k in range(1, DENSE + 1):
        known.answers[f"n{k + 1}"] = exchange(known.each(counts, ASK, k, k - 1, further=True), totals, f"n{k + 1}")
        known.answers[f"share{k}"] = judged(known.each(entries_and_contexts, FOUND, k + 1, k - 1), f"share{k}")

    # Longer ones at the few tokens where contexts still grow.
    def first_front(block: Block) -> Iterator[pa.RecordBatch]:
        led, level, size = block.leading()[1], block.levels[-1], len(block.held)
        there = led | np.append(led[1:], False)
        words = block.levels[0]
        p, n, seen = block.probability(root, DENSE, np.arange(len(led))), level.counts, words.counts > 0
        sums = (np.bincount(block.doc, x, size) for x in (seen, block.root(root)))
        tokens_ = (np.arange(len(led)), block.word, level.whole, n, p, led, block.train)
        front = Front(block.row["block"], block.row["ids"], block.row["held"], *tokens_, np.array(block.row["sizes"], np.int64), *sums, np.zeros(size))
        yield front.settled(~there).row()

    def asks(front: Front, row: dict) -> Iterator[pa.RecordBatch]:
        if len(front.pos):
            yield from asks_of(front.block, front.longer(), front.train)

    def front_entries(front: Front, row: dict) -> Iterator[pa.RecordBatch]:
        if not len(front.pos):
            return
        level = front.longer()
        level.n, level.owned = counts_of(row["counts"])
        at = np.empty(len(level.value), np.int64)
        at[level.place] = np.flatnonzero(level.ok)
        own = level.owned & (level.n >= LEAST)
        at = at[own]
        yield from entries_of(front.before(front.whole)[at], level.n[own], front.before(front.n)[at], front.p[at])
        yield from contexts_of(front.block, front.contexts(level)[0])

    def next_front(front: Front, row: dict) -> Iterator[pa.RecordBatch]:
        if not len(front.pos):
            yield front.row()
            return
        level = front.longer()
        level.n, _ = counts_of(row["counts"])
        n = level.counts
        _, place = front.contexts(level)
        n_context, share, grows = front.before(front.n), np.zeros(len(n)), np.zeros(len(n), bool)
        if len(place):
            n_asked = np.zeros(int(place.max()) + 1, np.int64)
            n_asked[place] = n_context[level.led]
            share[level.led], grows[level.led] = (x[place] for x in shares_of(row["shares"], n_asked))
        own = np.where(n >= LEAST, n - DISCOUNT, 0.0) / np.maximum(n_context, 1)
        p = np.where(share > 0, share * front.p + own, front.p)
        moved = replace(front, whole=level.whole, n=n, p=p)
        moved.led = grows & moved.before(n >= LEAST)
        follows = np.append(front.pos[1:] == front.pos[:-1] + np.uint32(1), False)
        stays = moved.led | (np.append(moved.led[1:], False) & follows)
        yield moved.settled(~stays).row()

    # Fronts stay dealt out by block, as the answers are, so that none is moved to meet them; one at a time is kept. When few tokens
    # are left, fewer files, tasks and ranges do.
    front = Keyed(known.each(first_front, Front.SCHEMA, DENSE + 1, DENSE), "block", dealt=True)
    known.drop()
    known.answers["front"] = front
    while not tree.states[-1].where("grows").isEmpty():
        size, number = front.frame().agg(F.sum("tokens"), F.count("block")).first()
        if not size:
            break
        # The functions above are handed on with the number of ranges of the time when a frame is made with them.
        buckets = min(buckets, -(-size // FEW))
        n = max(-(-size // FRONT), -(-number // FRONTS))
        if 2 * n <= front.n:
            moved = Keyed(front.frame(), "block", n=n)
            known.answers["front"] = moved
            front.drop()
            front = moved
        n = front.n
        counted = exchange(fronted(front.frame().drop("p", *Front.LISTS, *Front.TEXTS), asks, ASK), totals, "counts", n)
        share = judged(fronted(front.frame().drop("train", *Front.LISTS, *Front.TEXTS), front_entries, FOUND, counted), "shares", n)
        moved = Keyed(fronted(front.frame(), next_front, Front.SCHEMA, counted, share), "block", dealt=True, n=n)
        known.answers["front"] = moved
        for t in (front, counted, share):
            t.drop()
        front = moved
    return tree


def fronted(front: DataFrame, work: Callable[[Front, dict], Iterator[pa.RecordBatch]], schema: str, *answers: Keyed) -> DataFrame:
    """What ``work`` gives for every front, with the answers to its block."""
    for answer in answers:
        front = front.join(answer.frame(), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                yield from work(Front.of(row), row)

    return front.mapInArrow(run, schema)


def _words(known: Known) -> tuple[int, int]:
    """All training tokens, and how many are distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known_ = [counts_of(said.as_py()) for said in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(int((owned & (n > 0)).sum()) for n, owned in known_)])], names=["distinct"])

    total = known.blocks.frame().agg(F.sum("trained")).first()[0]
    distinct = known.answers["n1"].frame().select("n1").mapInArrow(run, "distinct long").agg(F.sum("distinct")).first()[0]
    return int(total or 0), int(distinct or 0)


def _states(entries: DataFrame) -> DataFrame:
    """``STATE`` of the contexts whose next words (see ``ENTRY``) diverge from what is below them.

    A longer context gains at most what the kept next words still cost: minus their summed log-probabilities. Others cost it.
    """
    rest = F.max("n_context") - F.sum("n")
    sums = entries.groupBy(F.col("context").alias("_context")).agg(rest.alias("rest"), (2 * rest + F.count("n")).alias("left"))
    share = F.col("left") / (2 * F.col("n_context"))
    p = (F.col("n") - DISCOUNT) / F.col("n_context") + share * F.col("below")
    gain, cost = F.col("n") * F.log(p / F.col("below")), -F.col("n") * F.log(p)
    # Divergence: kept next words by the ratio of both probabilities, all others together by the share they are left. Sums are
    # the small side, so a table of them saves the sort of the entries.
    gains = attach(entries, sums.hint("shuffle_hash"), [(F.col("context"), "_context")], "inner").groupBy("context").agg(
        F.sum(gain).alias("gain"),
        F.sum(cost).alias("cost"),
        F.max("n_context").alias("n_context"),
        F.max("left").alias("left"),
        F.max("rest").alias("rest"),
    )
    states = gains.where(F.col("gain") + F.col("rest") * F.log(share) >= GAIN)
    return states.select("context", "n_context", "left", (F.col("cost") >= GAIN).alias("grows"))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with small_batches(docs.sparkSession), shuffles_dropped(docs.sparkSession):
        return _scored(docs)


def _scored(docs: DataFrame) -> DataFrame:
    tree, known = learn(split(docs))
    names = [c.split()[0] for c in SCORED.split(", ")]
    total = tree.total

    def run(front: Front, row: dict) -> Iterator[pa.RecordBatch]:
        front = front.settled(np.ones(len(front.pos), bool))
        lists = [pa.array(getattr(front, name), kind.value_type) for name, kind in Front.LISTS.items()]
        numbers = [pa.array(x.astype(np.int64)) for x in (front.sizes, front.seen, np.full(len(front.sizes), total))]
        yield pa.RecordBatch.from_arrays([*lists, *numbers, pa.array(front.base), pa.array(front.score)], names=names)

    try:
        return written(fronted(known.answers["front"].frame(), run, SCORED))
    finally:
        known.drop()
