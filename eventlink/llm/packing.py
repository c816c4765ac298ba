"""Vector bin packing of tokenised examples into sequences.

Every example asks for three resources of a sequence: tokens, segments (one, or as many as its turns make), and loss-bearing
tokens (its last ``n_loss`` tokens; for plain documents all of them). A sequence is filled from a pool of waiting examples: of
those that fit under all three limits the one with the largest dot product of its demands with what the sequence has left, each
in shares of its limit, goes in. Ties go to the one that has waited longest. When none fits, the largest is cut so that it fills the sequence. Examples longer than a sequence give whole sequences first.
A sequence that stays short (the segments are used up, or a partition ends) is laid into sequences whose lengths are
powers of two, which need no padding.

Each partition of the input is packed where it is read, by a pool of bounded size: no shuffle, and memory independent of
the number of rows. A sequence id holds the partition's number, so ids are unique.

Null and empty texts are one token (the end id). Equal rows are packed one by one. Rows with a null id are packed
too. Columns other than the named ones are left out. An empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlink.llm.common import as_bytes, chunks, texts

#: Examples that wait in a task's pool at most.
POOL = 1024
#: Distinct words whose ids a worker remembers in either of two generations; the older one makes room.
MEMORY = 900_000
#: New words encoded as one line.
LINE = 200
#: What often stands behind a word.
MARKS = ".,;:!?"
#: Bytes of text whose words are looked up at once.
LOOKED_UP = 1 << 22
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
#: Ids that are handed on at once (a sequence goes in whole).
HANDED = 1 << 20


@dataclass(frozen=True)
class Limits:
    """What a sequence can hold. ``loss`` must not exceed ``tokens``."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass
class Piece:
    key: object
    start: int
    tokens: int
    loss: int
    ids: bytes | None
    whole: int
    segments: int = 1

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n tokens, and the rest. Either may hold any of the segments, so both ask for as many."""
        head = max(0, n - (self.tokens - self.loss))
        ids = (None, None) if self.ids is None else (self.ids[: 4 * n], self.ids[4 * n :])
        return (
            Piece(self.key, self.start, n, head, ids[0], self.whole, self.segments),
            Piece(self.key, self.start + n, self.tokens - n, self.loss - head, ids[1], self.whole, self.segments),
        )

    def longest(self, tokens: int, loss: int) -> int:
        """How many of its first tokens fit."""
        return min(self.tokens, tokens, self.tokens - self.loss + loss)


class Pool:
    """Waiting pieces, all of them able to fit into an empty sequence, in the order in which they came."""

    def __init__(self, limits: Limits):
        # Whole numbers as floats, so that no product has to convert them.
        self.limit = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pieces: list[Piece] = []
        self.needs = np.empty((3, 2 * POOL))

    def __len__(self) -> int:
        return len(self.pieces)

    def add(self, piece: Piece) -> None:
        n = len(self.pieces)
        if n == self.needs.shape[1]:
            self.needs = np.concatenate([self.needs, np.empty_like(self.needs)], axis=1)
        self.needs[:, n] = piece.tokens, piece.segments, piece.loss
        self.pieces.append(piece)

    def fill(self) -> Iterator[list[Piece]]:
        """Sequences until no piece waits."""
        while self.pieces:
            yield self._one()

    def best(self, room: np.ndarray, waiting: np.ndarray) -> int | None:
        """The waiting piece that fits and has the largest product of its needs with the room, each in shares of the limits."""
        needs = self.needs[:, : len(waiting)]
        fits = waiting & (needs <= room[:, None]).all(axis=0)
        if room[1] == 1:
            fits &= needs[0] == room[0]  # the last segment should fill the sequence
        if not fits.any():
            return None
        gain = (room / self.limit**2) @ needs
        return int(np.argmax(np.where(fits, gain, -1)))

    def _one(self) -> list[Piece]:
        room, chosen, rest = self.limit.copy(), [], None
        waiting = np.ones(len(self.pieces), bool)
        while room[0] and room[1] and waiting.any():
            k = self.best(room, waiting)
            if k is None:
                open_ = waiting & (self.needs[1, : len(waiting)] <= room[1])
                k = int(np.argmax(np.where(open_, self.needs[0, : len(waiting)], -1)))
                whole = self.pieces[k]
                n = whole.longest(int(room[0]), int(room[2])) if open_[k] else 0
                if n <= 0:
                    break
                piece, rest = whole.cut(n) if n < whole.tokens else (whole, None)
            else:
                piece = self.pieces[k]
            waiting[k] = False
            chosen.append(piece)
            room -= (piece.tokens, piece.segments, piece.loss)
            if rest is not None:
                break
        left = np.flatnonzero(waiting)
        self.needs[:, : len(left)] = self.needs[:, left]
        self.pieces = [self.pieces[k] for k in left]
        if rest is not None and rest.tokens:
            self.add(rest)
        return chosen


def packed(examples: Iterator[Piece], limits: Limits) -> Iterator[list[Piece]]:
    """Sequences, each a list of pieces."""
    pool = Pool(limits)
    for piece in examples:
        while piece.tokens > limits.tokens or piece.loss > limits.loss:
            head, piece = piece.cut(piece.longest(limits.tokens, limits.loss))
            if head.tokens == limits.tokens:
                yield [head]
            else:
                pool.add(head)
        if piece.tokens:
            pool.add(piece)
        if len(pool) >= POOL:
            for sequence in pool.fill():
                yield from by_powers(sequence, limits.tokens)
                if len(pool) < POOL // 2:
                    break
    for sequence in pool.fill():
        yield from by_powers(sequence, limits.tokens)


def by_powers(pieces: list[Piece], full: int) -> Iterator[list[Piece]]:
    """The sequence itself if full; else sequences whose lengths are the powers of two that make up its length."""
    n = sum(p.tokens for p in pieces)
    if n == full:
        yield pieces
        return
    waiting = list(reversed(pieces))
    while n:
        size, sequence = 1 << (n.bit_length() - 1), []
        n -= size
        while size:
            piece = waiting.pop()
            if piece.tokens > size:
                piece, rest = piece.cut(size)
                waiting.append(rest)
            sequence.append(piece)
            size -= piece.tokens
        yield sequence


class Encoder:
    """Ids of whole texts from the ids of their words.

    The tokenizer never joins what white space separates, so words are encoded on their own and remembered. New words are
    encoded many to a line; the places of their tokens in the line tell them apart.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has given every core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        #: Marks that the tokenizer parts from a letter before them, whatever follows.
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.marks = "".join(m for m in MARKS if m not in added and self.parts(m)).encode()

    def parts(self, mark: str) -> bool:
        before = self.tokenizer.pre_tokenizer
        return before is not None and [span for _, span in before.pre_tokenize_str(f"a{mark}")] == [(0, 1), (1, 2)]

    def learn(self, words: list[bytes]) -> None:
        """Put the distinct words among the young, from the old ones where they are known there."""
        if len(self.young) + len(words) > MEMORY:
            self.old, self.young = self.young, {}
        fresh = []
        for word, ids in zip(words, map(self.old.get, words), strict=True):
            if ids is None:
                fresh.append(word)
            else:
                self.young[word] = ids
        if not self.marks:
            self.young.update(self.encoded(fresh))
            return
        # What is in front of the marks is often known, or the same for many words.
        stems = [word.rstrip(self.marks) for word in fresh]
        apart = [len(stem) < len(word) and stem[-1:].isalpha() for word, stem in zip(fresh, stems, strict=True)]
        stems = [stem if split else word for word, stem, split in zip(fresh, stems, apart, strict=True)]
        tails = {word[len(stem) :] for word, stem, split in zip(fresh, stems, apart, strict=True) if split}
        parts = dict.fromkeys(stems)
        parts.update(zip(parts, map(self.young.get, parts), strict=True))
        parts.update(self.encoded([part for part, ids in parts.items() if ids is None]))
        ends = self.encoded(list(tails))
        self.young.update((word, parts[stem] + ends[word[len(stem) :]] if split else parts[stem]) for word, stem, split in zip(fresh, stems, apart, strict=True))

    def encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct words, encoded many to a line."""
        out = {}
        lines = [words[k : k + LINE] for k in range(0, len(words), LINE)]
        texts_ = [[w.decode() for w in line] for line in lines]
        found = self.tokenizer.encode_batch([" ".join(t) for t in texts_], add_special_tokens=False)
        for line, text, e in zip(lines, texts_, found, strict=True):
            starts = np.cumsum([0, *map((1).__add__, map(len, text))])
            places = np.fromiter(map(itemgetter(0), e.offsets), np.int64, len(e.ids))
            ends = (4 * np.searchsorted(places, starts)).tolist()
            data = array("I", e.ids).tobytes()
            out.update(zip(line, [data[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        # Each distinct word is looked up once; Arrow lays its ids out wherever it stands.
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.young.get, distinct))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        self.learn([distinct[k] for k in gaps])
        for k in gaps:
            found[k] = self.young[distinct[k]]
        raw, at = as_bytes(pa.array(found, pa.large_binary()).take(coded.indices))
        data, ends = raw.tobytes(), at[words.offsets.to_numpy()].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder per Python worker; later tasks find the words of earlier ones."""
    return Encoder(path)


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): see ``PIECES``. All tokens bear loss. ``ids`` are null if not asked for."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = array("I", [END_ID]).tobytes()

        def examples() -> Iterator[Piece]:
            for part, raw, at in chunks(batches, size=LOOKED_UP):
                data = raw.tobytes()
                found = encoder([data[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)])
                for key, ids in zip(part.column(0).to_pylist(), found, strict=True):
                    n = len(ids) // 4 + 1
                    yield Piece(key, 0, n, n, ids + end, n)

        yield from placed(packed(examples(), limits), with_ids)

    return texts(docs).mapInArrow(pack, PIECES)


def placed(sequences: Iterator[list[Piece]], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ``PIECES``, some thousands at a time."""
    number = TaskContext.get().partitionId() << 36
    names = [c.split()[0] for c in PIECES.split(", ")]
    rows: list[tuple] = []
    ids: list[bytes | None] = []
    size = 0

    def batch() -> pa.RecordBatch:
        values = pa.array(np.frombuffer(b"".join(x for x in ids if x), np.int32))
        ends = np.cumsum([0, *(len(x or b"") // 4 for x in ids)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([x is None for x in ids]))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), lists], names=names)

    for sequence in sequences:
        offset = 0
        for p in sequence:
            crc = None if p.ids is None else zlib.crc32(p.ids)
            rows.append((p.key, p.start, p.tokens, crc, p.whole, number, offset))
            ids.append(p.ids if with_ids else None)
            offset += p.tokens
        number += 1
        size += offset
        if len(rows) >= 8192 or size >= HANDED:
            yield batch()
            rows, ids, size = [], [], 0
    if rows:
        yield batch()


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same for tokenised examples (doc_id, n_tokens, n_loss): instruction data whose last n_loss tokens bear loss.

    With a column ``ids`` (array of int) the pieces hold theirs and n_tokens is not read; without it ids and ids_crc32 are null. A
    column ``n_segments`` gives the segments of an example (null, 0 or no column: one; more than a sequence holds: as many). Null
    counts are taken as 0; examples without tokens give no piece.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[Piece]:
            for batch in batches:
                for key, n, loss, segments, *ids in zip(*batch.columns, strict=True):
                    n, loss, segments = n.as_py(), loss.as_py(), segments.as_py()
                    data = ids[0].values.to_numpy().astype(np.int32).tobytes() if ids else None
                    yield Piece(key.as_py(), 0, n, min(loss, n), data, n, min(max(segments, 1), limits.segments))

        yield from placed(packed(pieces(), limits), True)

    zero = F.lit(0).cast("long")
    held = [F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids")] if "ids" in examples.columns else []
    n = F.size(held[0]) if held else F.col("n_tokens")
    segments = F.col("n_segments") if "n_segments" in examples.columns else zero
    given = ((n, "n_tokens"), (F.col("n_loss"), "n_loss"), (segments, "n_segments"))
    counts = [F.greatest(F.coalesce(c.cast("long"), zero), zero).alias(name) for c, name in given]
    return examples.select("doc_id", *counts, *held).mapInArrow(pack, PIECES)
