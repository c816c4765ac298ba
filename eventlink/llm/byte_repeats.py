"""Removal of repeated bytes by a merge of front-coded, sorted suffix runs.

A byte goes if a ``WINDOW``-byte string that covers it also starts earlier: in a document with a smaller doc_id, or before
in the same one.

1. Of texts that are equal only the first is worked on; the others lose everything if a window fits into them.
2. Every window belongs to its ``GRAM``-byte string with the least hash, so equal windows belong to equal strings, and only strings
   that occur twice matter. An entry is the suffix that starts at such a string, cut where the last window of the string ends,
   followed by the bytes from the first of its windows on.
3. A task sorts its entries into runs, keeps the earliest of equal ones (the others go as a whole, with all their windows), and
   exchanges the runs front-coded: of each entry the length of the prefix shared with the one before, and the rest. Ranges
   are cut by sampled splitters; a task merges one range after the other.
4. A range merges its runs with a loser tree that keeps for every run the common prefix with the last entry given out. Longer common
   prefixes win without a look at bytes; equal ones are compared behind the known prefix only. The prefixes given out tell
   equal entries (again only the earliest stays) and entries of one string.
5. The prefixes also tell how far an entry agrees with any other of its string from there on; an order of the bytes before, how far
   backwards. Windows within both (all, where a string may go on in the next range) are settled one by one: their suffixes
   go through a second merge of the same kind. Neighbours with a common prefix of a whole window are equal; all but the earliest go.

Everything is settled by bytes; hashes only choose where windows belong. Equal strings are reduced to one in every run, so a range holds a
string once per run however often it occurs, and a crowded string with many surroundings is cut by splitters like others.

Null and empty texts have no bytes. Rows with equal doc_id and text are one document and get equal rows; rows with equal doc_id and
different texts are ordered by a digest. A null doc_id counts as -2^63. Columns other than doc_id and text are left out. An empty
table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlink.llm.common import U64, Keyed, Rolling, anchors, as_bytes, chunks, mixed, partitions, powers, sliding_min, texts, written
from eventlink.operators.joins import attach

WINDOW, GRAM = 100, 32
WIDTH = WINDOW - GRAM + 1
LEFT = WINDOW - GRAM
#: Bytes of an entry: the suffix and its length, the bytes before and their length.
ENTRY = WINDOW + 1 + LEFT + 1
#: Suffixes in a sorted run, and those of the table per range; ranges at most (their splitters are sent to every task).
RUN, RANGE, RANGES = 100_000, 40_000, 16_384
#: Sampled suffixes per range, of which the splitters are taken.
SAMPLES = 8
#: Places worked on at once.
BLOCK = 8192


def sampled(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings that windows belong to: text, place, hash, and how far before the string its first and its last window begin."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = doc[: len(raw) - WINDOW + 1] == doc[WINDOW - 1 :] if len(raw) >= WINDOW else np.empty(0, bool)
    if not inside.any():
        return (np.empty(0, np.int64),) * 5
    grams = Rolling(raw.astype(U64) + U64(1)).windows(GRAM)
    places = anchors(grams, WIDTH, inside)
    edge = np.zeros(LEFT, U64)
    least = np.concatenate([edge, np.where(inside, sliding_min(grams, WIDTH), U64(0)), edge])
    back, ahead = np.empty_like(places), np.empty_like(places)
    for start in range(0, len(places), BLOCK):
        some = places[start : start + BLOCK]
        own = least[some[:, None] + np.arange(WIDTH)] == grams[some][:, None]
        first = own.argmax(axis=1)
        back[start : start + BLOCK] = LEFT - first
        ahead[start : start + BLOCK] = LEFT + 1 - first - own.sum(axis=1)
    return doc[places], places, grams[places].view(np.int64), back, ahead


def _nodes(table: DataFrame) -> DataFrame:
    """(key, at, gram); ``at`` holds the place and, in 7 bits each, where its windows begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches):
            doc, places, grams, back, ahead = sampled(raw, at)
            key = batch.column(0).to_numpy(zero_copy_only=False)[doc]
            packed = (places - at[doc]) << 14 | back << 7 | ahead
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, packed, grams)], names=["key", "at", "gram"])

    return table.select("key", "text").mapInArrow(run, "key long, at long, gram long")


def _listed_blocks(batch: pa.RecordBatch, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place in the chunk, and window bounds of the listed strings, a block at a time."""
    lists = batch.column(batch.schema.get_field_index("places"))
    packed = lists.flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    for start in range(0, len(packed), BLOCK):
        some, of = packed[start : start + BLOCK], doc[start : start + BLOCK]
        yield of, (some >> 14) + at[of], some >> 7 & 127, some & 127


def _stretch(raw: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Bytes from ``begin`` on, zeros after ``length``."""
    step = np.arange(width)
    return np.where(step < length[:, None], raw[np.minimum(begin[:, None] + step, len(raw) - 1)], 0).astype(np.uint8)


class Suffixes:
    """Strings of equal width, and where they stand: the document, the text's rank among all, the place in it."""

    FIELDS = (("doc", "<i8"), ("rank", "<i8"), ("place", "<i4"))

    def __init__(self, text: np.ndarray, **numbers: np.ndarray):
        self.text, self.numbers = text, numbers

    def __len__(self) -> int:
        return len(self.text)

    def take(self, rows: np.ndarray) -> Suffixes:
        return Suffixes(self.text[rows], **{n: v[rows] for n, v in self.numbers.items()})

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(
            np.concatenate([p.text for p in parts]),
            **{n: np.concatenate([p.numbers[n] for p in parts]) for n, _ in Suffixes.FIELDS},
        )

    def strings(self, width: int) -> np.ndarray:
        return np.ascontiguousarray(self.text[:, :width]).view(f"S{width}").ravel()

    def sort(self) -> Suffixes:
        return self.take(np.argsort(self.strings(self.text.shape[1]), kind="stable"))

    def shared(self) -> np.ndarray:
        """Of each suffix the length of the prefix that it shares with the one before."""
        out = np.zeros(len(self), np.int64)
        if len(self) > 1:
            differs = self.text[1:] != self.text[:-1]
            out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), self.text.shape[1])
        return out

    def earliest(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted suffixes the earliest of each set of equal ones, and the others that start elsewhere.

        In a text of short periods a window belongs to several strings, and comes as often.
        """
        if not len(self):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        group = np.cumsum(shared < self.text.shape[1])
        order = np.lexsort((self.numbers["place"], self.numbers["rank"], self.numbers["doc"], group))
        first = np.append(True, group[order][1:] != group[order][:-1])
        source = order[first][np.cumsum(first) - 1]
        elsewhere = np.zeros(len(order), bool)
        for numbers in self.numbers.values():
            elsewhere |= numbers[order] != numbers[source]
        return order[first], order[elsewhere]

    def before(self) -> np.ndarray:
        """The bytes before entries' strings, the nearest first."""
        step, left = np.arange(LEFT), self.text[:, -1:].astype(np.int64)
        turned = np.take_along_axis(self.text, WINDOW + 1 + np.maximum(left - 1 - step, 0), axis=1)
        return np.where(step < left, turned, 0).astype(np.uint8)

    def windows(self, after: np.ndarray, before: np.ndarray) -> Suffixes:
        """The suffixes at the windows of entries that share so many bytes with others: from their strings on, and before them."""
        right, left = self.text[:, WINDOW].astype(np.int64), self.text[:, -1].astype(np.int64)
        at = np.arange(LEFT + WINDOW)
        source = np.where(at < left[:, None], WINDOW + 1 + at, np.minimum(at - left[:, None], WINDOW - 1))
        whole = np.take_along_axis(self.text, source, axis=1)
        # A window that begins b bytes before the string needs b bytes before it, and the rest from it on.
        b = left[:, None] - np.arange(WIDTH)
        row, step = np.nonzero((b >= (WINDOW - np.minimum(after, right))[:, None]) & (b <= before[:, None]))
        text = np.lib.stride_tricks.sliding_window_view(whole, WINDOW, axis=1)[row, step]
        numbers = {n: v[row] for n, v in self.numbers.items()}
        numbers["place"] = (numbers["place"] - left[row] + step).astype("<i4")
        return Suffixes(text, **numbers)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all windows: rank, from, to."""
        place = self.numbers["place"].astype(np.int64)
        if self.text.shape[1] == WINDOW:
            return self.numbers["rank"], place, place + WINDOW
        return self.numbers["rank"], place - self.text[:, -1], place + self.text[:, WINDOW]

    def front_coded(self) -> bytes:
        width, shared = self.text.shape[1], self.shared()
        rest = self.text[np.arange(width) >= shared[:, None]]
        parts = [shared.astype("u1").tobytes(), *(self.numbers[n].astype(t).tobytes() for n, t in self.FIELDS), rest.tobytes()]
        return struct.pack("<II", len(self), width) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @staticmethod
    def decoded(data: bytes) -> tuple[Suffixes, np.ndarray]:
        """The suffixes of a run, and their shared prefixes."""
        n, width = struct.unpack("<II", data[:8])
        raw = zstandard.ZstdDecompressor().decompress(data[8:])
        shared = np.frombuffer(raw, "u1", n).astype(np.int64)
        done, numbers = n, {}
        for name, kind in Suffixes.FIELDS:
            numbers[name] = np.frombuffer(raw, kind, n, done)
            done += n * np.dtype(kind).itemsize
        own = np.arange(width) >= shared[:, None]
        text = np.zeros((n, width), np.uint8)
        text[own] = np.frombuffer(raw, "u1", offset=done)
        # A byte of a shared prefix is that of the last suffix above which has the byte of its own.
        source = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), axis=0)
        return Suffixes(np.take_along_axis(text, source, axis=0), **numbers), shared


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix shared with the suffix given out before) of sorted runs, in order.

    A loser tree over the runs' heads; ``known[run]`` is the prefix that the run's head shares with the last suffix
    given out, or with the winner it lost to.
    """
    size = 1
    while size < len(runs):
        size *= 2
    done = len(runs)  # an exhausted run
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - done)
    known, at = [0] * size, [0] * size
    whole = max((len(h) for h in heads if h), default=0)

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser learns what it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        i, j = known[a], known[b]
        if i > j:
            return a, b
        if i < j:
            return b, a
        x, y = int.from_bytes(x[i:]), int.from_bytes(y[i:])
        common = whole - ((x ^ y).bit_length() + 7) // 8
        if x <= y:
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    losers = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while heads[winner] is not None:
        place = at[winner]
        yield winner, place, known[winner]
        texts_, shared = runs[winner]
        place += 1
        at[winner] = place
        if place < len(texts_):
            heads[winner], known[winner] = texts_[place], shared[place]
        else:
            heads[winner] = None
        node = (winner + size) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1


SENT = "rank long, lo int, hi int, bucket long, run binary"


def united(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a text that meet, as one."""
    order = np.lexsort((lo, rank))
    rank, lo, hi = rank[order], lo[order], hi[order]
    text = np.cumsum(np.append(0, rank[1:] != rank[:-1])) << 32
    reach = np.maximum.accumulate(text + hi)
    begins = np.flatnonzero(np.append(True, (text + lo)[1:] > reach[:-1]))
    return rank[begins], lo[begins], (reach[np.append(begins[1:], len(rank)) - 1] - text[begins])


def _gone(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Spans on their way to the end of the merges, dealt out by text."""
    if sum(len(p[0]) for p in parts):
        rank, lo, hi = united(*(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)))
        none = pa.nulls(len(rank), pa.binary())
        columns = [pa.array(rank), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(-1 - rank % (1 << 20)), none]
        yield pa.RecordBatch.from_arrays(columns, names=["rank", "lo", "hi", "bucket", "run"])


class Runs:
    """Suffixes gathered into sorted runs, cut by splitters. Of equal ones in a run the earliest stays; the others are spans."""

    def __init__(self, splitters: list[bytes]):
        self.splitters = np.array(splitters, f"S{WINDOW}")
        self.held: list[Suffixes] = []
        self.size = 0

    def add(self, rows: Suffixes) -> Iterator[pa.RecordBatch]:
        self.held.append(rows)
        self.size += len(rows)
        if self.size >= RUN:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            self.held = []
            return
        rows = Suffixes.joined(self.held).sort()
        self.held, self.size = [], 0
        first, later = rows.earliest(rows.shared())
        yield from _gone([rows.take(later).spans()])
        rows = rows.take(first)
        bucket = np.searchsorted(self.splitters, rows.strings(WINDOW), "right")
        some, starts = np.unique(bucket, return_index=True)
        ends = np.append(starts[1:], len(rows))
        for number, a, b in zip(some.tolist(), starts, ends, strict=True):
            sent = {"rank": None, "lo": None, "hi": None, "bucket": number, "run": rows.take(np.arange(a, b)).front_coded()}
            yield pa.RecordBatch.from_pylist([sent], _SENT)


_SENT = pa.schema([("rank", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("bucket", pa.int64()), ("run", pa.binary())])


def merged_range(blobs: list[bytes]) -> tuple[Suffixes, np.ndarray]:
    """All suffixes of a range in order, and the prefix that each shares with the one before."""
    found = [Suffixes.decoded(b) for b in blobs]
    first = np.cumsum([0] + [len(rows) for rows, _ in found])
    rows = Suffixes.joined([r for r, _ in found])
    lists = []
    for part, shared in found:
        data, width = part.text.tobytes(), part.text.shape[1]
        lists.append(([data[k : k + width] for k in range(0, len(data), width)], shared.tolist()))
    order, common = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for k, (run, place, shared) in enumerate(merged(lists)):
        order[k], common[k] = first[run] + place, shared
    return rows.take(order), common


def most_shared(shared: np.ndarray) -> np.ndarray:
    """Of sorted rows the longest prefix shared with any other, from those shared with the row before."""
    return np.maximum(shared, np.append(shared[1:], 0))


def shared_before(rows: Suffixes, string: np.ndarray) -> np.ndarray:
    """Of entries the most bytes before the string that are shared with another entry of the string."""
    text = rows.before()
    order = np.argsort(np.ascontiguousarray(text).view(f"S{LEFT}").ravel(), kind="stable")
    order = order[np.argsort(string[order], kind="stable")]
    text, string = text[order], string[order]
    shared = np.zeros(len(order), np.int64)
    differs = text[1:] != text[:-1]
    shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), LEFT)
    shared[1:][string[1:] != string[:-1]] = 0
    out = np.empty_like(shared)
    out[order] = most_shared(shared)
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes] | pa.RecordBatch]:
    """Of rows sorted by bucket the runs of each range; spans come through as they are."""
    bucket, blobs = None, []
    for batch in batches:
        numbers = batch.column(3).to_numpy(zero_copy_only=False)
        spans = int(np.searchsorted(numbers, 0))
        if spans:
            yield batch.slice(0, spans)
        for k in range(spans, len(numbers)):
            if numbers[k] != bucket and blobs:
                yield blobs
                blobs = []
            bucket = numbers[k]
            blobs.append(batch.column(4)[k].as_py())
    if blobs:
        yield blobs


def _sent(table: DataFrame, run) -> DataFrame:  # noqa: ANN001
    """``run`` over ranges that are dealt out anew."""
    return table.repartition(partitions(table.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, SENT)


def splitters(table: DataFrame, rate: float, ranges: int) -> list[bytes]:
    """Strings that cut the suffixes of samples (key, text, places) into ``ranges`` of about equal size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = powers(WINDOW)[0][:WINDOW]
        for batch, raw, at in chunks(batches):
            for _, places, _, ahead in _listed_blocks(batch, at):
                text = _stretch(raw, places, WINDOW - ahead, WINDOW)
                value = mixed((text + U64(1)) @ power) >> U64(11)
                few = value < U64(int(min(rate, 1.0) * (1 << 53)))
                said = pa.array([t.tobytes() for t in text[few]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(value[few].view(np.int64)), said], names=["value", "said"])

    found = table.select("key", "text", "places").mapInArrow(run, "value long, said binary").distinct()
    said = sorted(bytes(r.said) for r in found.orderBy("value").limit(SAMPLES * ranges).collect())
    return sorted({said[len(said) * k // ranges] for k in range(1, ranges)}) if said else []


def suffix_spans(table: DataFrame, cuts: list[bytes]) -> DataFrame:
    """(rank, lo, hi): bytes that go, from samples (key, text, order, rank, places)."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(cuts)
        for batch, raw, at in chunks(batches):
            order, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("order", "rank"))
            for doc, places, back, ahead in _listed_blocks(batch, at):
                right = WINDOW - ahead
                parts = [_stretch(raw, places, right, WINDOW), right[:, None], _stretch(raw, places - back, back, LEFT), back[:, None]]
                text = np.concatenate([p.astype(np.uint8) for p in parts], axis=1)
                yield from runs.add(Suffixes(text, doc=order[doc], rank=rank[doc], place=(places - at[doc]).astype("<i4")))
        yield from runs.flush()

    def by_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(cuts)
        for blobs in _ranges(batches):
            if isinstance(blobs, pa.RecordBatch):
                yield blobs
                continue
            rows, shared = merged_range(blobs)
            first, later = rows.earliest(shared)
            yield from _gone([rows.take(later).spans()])
            rows, shared = rows.take(first), shared[shared < ENTRY]
            string = np.cumsum(shared < GRAM)
            after = most_shared(np.where(shared < GRAM, 0, np.minimum(shared, WINDOW)))
            before = shared_before(rows, string)
            open_ = (string == string[0]) | (string == string[-1])  # these may go on in the next range
            after[open_], before[open_] = WINDOW, LEFT
            some = np.flatnonzero(after + before >= WINDOW)
            for start in range(0, len(some), BLOCK // 8):
                part = some[start : start + BLOCK // 8]
                yield from runs.add(rows.take(part).windows(after[part], before[part]))
        yield from runs.flush()

    def by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _ranges(batches):
            if isinstance(blobs, pa.RecordBatch):
                yield blobs
                continue
            rows, shared = merged_range(blobs)
            yield from _gone([rows.take(rows.earliest(shared)[1]).spans()])

    sent = table.select("key", "text", "order", "rank", "places").mapInArrow(entries, SENT)
    return _sent(_sent(sent, by_entry), by_window).select("rank", "lo", "hi")


REMOVED = "key long, spans array<struct<lo:int,hi:int>>, kept binary"


def _removed(table: DataFrame) -> DataFrame:
    """What goes and what is left of texts (key, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = as_bytes(batch.column(1))
            out = []
            for k, spans in enumerate(batch.column(2)):
                gone = np.zeros(at[k + 1] - at[k] + 1, np.int32)
                flat = spans.values
                np.add.at(gone, flat.field("lo").to_numpy(), 1)
                np.subtract.at(gone, flat.field("hi").to_numpy(), 1)
                gone = np.cumsum(gone[:-1]) > 0
                lo, hi = (np.flatnonzero(x) for x in (gone & ~np.append(False, gone[:-1]), gone & ~np.append(gone[1:], False)))
                merged = [{"lo": a, "hi": b + 1} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                out.append((merged, raw[at[k] : at[k + 1]][~gone].tobytes()))
            merged, kept = zip(*out, strict=True) if out else ((), ())
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, kind), pa.array(kept, pa.binary())], names=["key", "spans", "kept"])

    return table.select("key", "text", "spans").mapInArrow(run, REMOVED)


def _judged(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, digest of its text, the merged ``spans`` that go, and ``kept``, the bytes left (null: all, unless asked for)."""
    keyed = Keyed(texts(docs).withColumn("key", F.monotonically_increasing_id()), "key")
    try:
        table = keyed.frame()
        lowest = F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("order")
        size = F.octet_length("text").cast("long").alias("n_bytes")
        known = written(table.select("key", lowest, "doc_id", size, F.sha2("text", 256).alias("digest")))
        least = known.groupBy("digest").agg(F.min(F.struct("order", "key")).alias("one")).orderBy("digest")
        one = [F.col("one.order").alias("first"), F.col("one.key").alias("own"), F.monotonically_increasing_id().alias("rank")]
        first = written(least.select("digest", *one))
        sources = first.select(F.col("own").alias("key"), F.col("first").alias("order"), "rank")
        nodes = _nodes(table.join(sources.select("key"), "key"))
        twice = nodes.groupBy(F.col("gram").alias("_gram")).agg(F.count("*").alias("n")).where("n > 1")
        marked = attach(nodes, twice, [(F.col("gram"), "_gram")], "inner").groupBy("key")
        listed = written(marked.agg(F.collect_list("at").alias("places"), F.sum(1 / F.col("n")).alias("strings")))
        some = table.join(listed.join(sources, "key"), "key")
        count, strings = listed.agg(F.sum(F.size("places")), F.sum("strings")).first()
        ranges = max(partitions(docs.sparkSession), min(RANGES, (count or 0) // RANGE))
        cuts = splitters(some, SAMPLES * ranges / strings, ranges) if count else []
        spans = suffix_spans(some, cuts).groupBy("rank").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        lists = written(spans.join(sources, "rank").select("key", "spans"))
        left = written(_removed(table.join(lists, "key")))
        copy = F.col("order") != F.col("first")
        gone = copy & (F.col("n_bytes") >= WINDOW)
        kept = copy | F.col("spans").isNull()
        none = F.array().cast("array<struct<lo:int,hi:int>>")
        whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("n_bytes").cast("int").alias("hi")))
        judged = (
            known.join(first, "digest")
            .withColumn("source", F.when(~copy, F.col("own")))
            .join(left.withColumnRenamed("key", "source"), "source", "left")
            .select(
                "key",
                "doc_id",
                "n_bytes",
                "digest",
                F.when(gone, whole).when(kept, none).otherwise(F.col("spans")).alias("spans"),
                F.when(gone, F.lit(b"")).when(kept, F.lit(None)).otherwise(F.col("kept")).alias("kept"),
            )
        )
        if with_bytes:
            own = table.select("key", "text")
            judged = written(judged.join(own, "key").withColumn("kept", F.coalesce("kept", "text")).drop("text"))
        return judged
    finally:
        keyed.drop()


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the merged spans of bytes (lo, hi) that go, and ``kept``, the bytes left, of every document."""
    return _judged(docs, with_bytes=True).select("doc_id", "n_bytes", "spans", "kept")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document: counts and digest of what :func:`kept_texts` gives."""
    return _judged(docs).select(
        "doc_id",
        "n_bytes",
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.when(F.col("kept").isNull(), F.col("digest")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"),
    )
