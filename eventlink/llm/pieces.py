"""SentencePiece encoding and decoding of distinct words along a shared trie.

A text is cut into marked words (spaces, then other characters), which no piece crosses. The distinct new words of each
batch are sorted, so that neighbours share prefixes: going through them in order is a depth-first walk of their trie,
and the forward states of the common prefix stay on a stack and are reused.

The forward state of a prefix is its last piece (and, for a unigram model, the best score):

- ``unigram``: the best sum of scores over all ways to cut the prefix (Viterbi); unknown characters cost a penalty.
- ``bpe``: the merges of a byte-pair model decide, not a sum. Every leading part of an encoding is the encoding of the
  text it covers, so a prefix has exactly one last piece: the one whose merges with the piece before it
  give the two of them again. With this test in place of the sum, results equal the model's own encoding exactly.
  The pieces that end at a character are listed by an automaton (:class:`Endings`), whose state belongs to the prefix too.

Characters unknown to the vocabulary become byte pieces. Null and empty texts have no pieces. Repeated rows are encoded
alike, each on its own. Columns other than doc_id and text are left out. An empty table gives an empty table. The mark
U+2581 in a text counts as a space, as in the model itself, so such a text does not come back and its round_trip is false. Batches are encoded where they are read; a task remembers a
bounded number of words.

:func:`encode` gives the ids of every text, :func:`decode` the texts of any ids, by the vocabulary's table of bytes alone.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlink.llm.common import texts

MARK = "▁"
#: Distinct words a task remembers before it starts anew, and their characters.
MEMORY, MEMORY_CHARS = 500_000, 8_000_000
#: Pairs of pieces whose merges a task remembers, and steps of the automaton beyond the trie's own.
PAIRS, MOVES = 300_000, 500_000
_MARKED = re.compile(" *[^ ]+| +")
ENCODED = "doc_id long, text binary, ids binary"


def marked_words(text: str) -> list[str]:
    """The words of a text with a space in front; spaces stand for marks."""
    return _MARKED.findall(" " + text.replace(MARK, " ")) if text else []


class Endings:
    """The pieces that end at each character of a word, by one step a character (an Aho-Corasick automaton; state 0 at first)."""

    def __init__(self, pieces: Iterable[str]):
        """``ends``: of each state the lengths and numbers of the pieces that end there, longest first."""
        self.moves: list[dict[str, int]] = [{}]
        self.shorter, self.ends, self.room = [0], [()], MOVES
        edges, own = [], {}
        for number, piece in enumerate(pieces):
            node = 0
            for depth, c in enumerate(piece):
                found = self.moves[node].get(c)
                if found is None:
                    found = self.moves[node][c] = len(self.moves)
                    self.moves.append({})
                    edges.append((depth, node, c, found))
                node = found
            own[node] = (len(piece), number)
        self.shorter += [0] * len(edges)
        self.ends += [()] * len(edges)
        inner = {node for _, node, _, _ in edges}
        for depth, node, c, found in sorted(edges):
            shorter = self.shorter[found] = self.move(self.shorter[node], c) if depth else 0
            self.ends[found] = ((own[found],) if found in own else ()) + self.ends[shorter]
            if found not in inner:
                self.moves[found] = self.moves[shorter]

    def move(self, node: int, c: str) -> int:
        """The state after one more character; a bounded number of them is remembered."""
        found = self.moves[node].get(c)
        if found is None:
            found = self.move(self.shorter[node], c) if node else 0
            if self.room:
                self.moves[node][c] = found
                self.room -= 1
        return found


class Model:
    """Pieces with scores, and the forward step."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int], kind: str = "bpe", others: dict[int, bytes] | None = None):
        """``others``: ids that no text is encoded as, and what they are decoded as."""
        assert kind in ("bpe", "unigram")
        self.scores, self.ids, self.byte_ids, self.kind = scores, ids, byte_ids, kind
        self.others = others or {}
        self.longest = max(map(len, scores), default=1)
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.packed = {piece: found for piece in scores if (found := self.ids_of(piece)) is not None}
        merged = [piece for piece in self.packed if len(piece) > 1] if kind == "bpe" else []
        self.endings, self.codes = Endings(merged), [self.packed[piece] for piece in merged]
        self.penalty = min(scores.values(), default=0.0) - 10
        self.pairs: dict[int, bool] = {}
        self.starts, self.sums = [0], [0.0]
        self.nodes, self.lasts = [0], [0]
        self.word = ""
        self.steps = 0

    @classmethod
    def from_file(cls, path: str) -> Model:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        known = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        plain = {i: p.id_to_piece(i).replace(MARK, " ") for i in known}
        others = {i: p.decode([i]).encode() if p.is_unknown(i) else b"" for i in range(p.get_piece_size()) if i not in plain and not p.is_byte(i)}
        byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls({s: p.get_score(i) for i, s in plain.items()}, {s: i for i, s in plain.items()}, byte_ids, others=others)

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge gives the piece; None if merging its characters does not give it."""
        if piece not in self.splits:
            parts, last = list(piece), None
            while len(parts) > 1:
                pairs = [(self.scores.get(a + b, -math.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                score, k = max(pairs)
                if score == -math.inf:
                    last = None
                    break
                last = parts[-k], parts[1 - k]
                parts[-k : 2 - k] = ["".join(last)]
            self.splits[piece] = last
        return self.splits[piece]

    def follows(self, before: str, piece: str) -> bool:
        """Whether merging the characters of both gives just these two pieces.

        Merges happen best score first. Going back from the end, whichever of the two inner edges was made
        last is undone; no merge across the border may have been better than the one undone.
        """
        scores, least, left, right = self.scores, -math.inf, before, piece
        while True:
            across = scores.get(left + right)
            if across is not None and across > least:
                return False
            one = scores[left] if len(left) > 1 else math.inf
            two = scores[right] if len(right) > 1 else math.inf
            if one == two == math.inf:
                return True
            if one < two:
                least, left = one, self.halves(left)[1]
            else:  # of two merges to the same piece the left one comes first, here the one across
                least, right = math.nextafter(two, -math.inf), self.halves(right)[0]

    def ids_of(self, piece: str) -> bytes | None:
        """The piece's id, or those of its bytes for an unknown character; None if merges do not give the piece."""
        if piece in self.ids:
            usable = self.kind == "unigram" or len(piece) == 1 or self.halves(piece) is not None
            return array("I", [self.ids[piece]]).tobytes() if usable else None
        return array("I", [self.byte_ids[b] for b in piece.encode()]).tobytes() if len(piece) == 1 else None

    def merge_steps(self, word: str, shared: int) -> None:
        """Push the states of the prefixes longer than ``shared``: the automaton's, where the last piece starts, and that
        piece's number (a character alone: its code point, above the others)."""
        starts, nodes, lasts, pairs = self.starts, self.nodes, self.lasts, self.pairs
        moves, ends, size = self.endings.moves, self.endings.ends, len(self.codes)
        node, end = nodes[shared], shared
        for c in word[shared:]:
            end += 1
            after = moves[node].get(c)
            node = self.endings.move(node, c) if after is None else after
            for length, piece in ends[node]:
                start = end - length
                if start:
                    key = lasts[start] * size + piece
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) > PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self.follows(word[starts[start] : start], word[start:end])
                    if not fits:
                        continue
                starts.append(start)
                lasts.append(piece)
                break
            else:
                starts.append(end - 1)
                lasts.append(size + ord(c))
            nodes.append(node)

    def score_step(self, word: str, end: int) -> None:
        """The same by the best sum of scores."""
        scores, sums = self.scores, self.sums
        known = word[end - 1] in scores
        best, start = (-math.inf, 0) if known else (sums[end - 1] + self.penalty, end - 1)
        for k in range(max(0, end - self.longest), end):
            s = scores.get(word[k:end])
            if s is not None and sums[k] + s > best:
                best, start = sums[k] + s, k
        self.starts.append(start)
        sums.append(best)

    def encode(self, word: str) -> bytes:
        """The ids of a word, read back from its end; the forward states of the prefix that it shares with the word
        before are reused."""
        before, shared = self.word, 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del self.starts[shared + 1 :], self.sums[shared + 1 :], self.nodes[shared + 1 :], self.lasts[shared + 1 :]
        self.steps += len(word) - shared
        self.word = word
        if self.kind == "bpe":
            self.merge_steps(word, shared)
        else:
            for end in range(shared + 1, len(word) + 1):
                self.score_step(word, end)
        pieces, end, size = [], len(word), len(self.codes)
        while end:
            start = self.starts[end]
            if self.kind == "bpe" and self.lasts[end] < size:
                pieces.append(self.codes[self.lasts[end]])
            else:
                piece = word[start:end]
                pieces.append(self.packed.get(piece) or self.ids_of(piece))
            end = start
        pieces.reverse()
        return b"".join(pieces)

    def decoder(self) -> dict[int, bytes]:
        return self.others | {i: s.encode() for s, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}


class Codec:
    """Encodes and decodes whole texts by their distinct words."""

    def __init__(self, model: Model):
        self.model, self.decode_id = model, model.decoder()
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def learn(self, words: Iterable[str]) -> None:
        for word in sorted(words):
            self.chars += len(word)
            self.known[word] = self.model.encode(word)

    def split(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        split = [marked_words(t) for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(new) > MEMORY or self.chars + sum(map(len, new)) > MEMORY_CHARS:
            self.known, self.chars = {}, 0
            new = {w for words in split for w in words}
        self.learn(new)
        return split

    def encode(self, words: list[str]) -> bytes:
        """The ids of known words as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.known.__getitem__, words))

    def decode(self, packed: bytes) -> bytes:
        """What any ids stand for, without the space put in front. An id beyond the vocabulary is an error."""
        ids = array("I")
        ids.frombytes(packed)
        said = b"".join(map(self.decode_id.__getitem__, ids))
        lead = next((i for i in ids if self.decode_id[i]), None)
        return said if lead in self.model.others else said.removeprefix(b" ")


@lru_cache(maxsize=1)
def codec(model_file: str) -> Codec:
    """One codec per Python worker; later tasks find the words of earlier ones."""
    return Codec(Model.from_file(model_file))


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, the text as bytes, and its ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = own.split([t.decode() for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(own.encode, words), pa.binary())], names=["doc_id", "text", "ids"])

    return texts(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its column ``ids`` (as in :func:`encode`) stands for. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            where = batch.schema.get_field_index("ids")
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                said = [None if x is None else own.decode(x) for x in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.select("*", F.lit(None).cast("binary").alias("decoded")).schema)


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document: the number and checksum of its ids, and whether decoding them gives the text again."""
    return decode(encode(docs, model_file), model_file).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
