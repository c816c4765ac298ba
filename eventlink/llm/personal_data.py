"""Personal data: base patterns, and further spans found by a semi-Markov conditional random field.

Base spans (:func:`base_spans`) always stay. The model looks at the text between them. Candidate segments (an obfuscated
address, a phone number in international or national form, a card number or host address in unusual groups) run from
every token to every later one that a loose form allows, up to a bounded length. Features describe a candidate as a whole: its kind, shape, count of digits,
checksum, separators, and the words in front of it. The best set of non-overlapping segments, boundaries and kinds
together, is found by dynamic programming over the candidates' ends (semi-Markov Viterbi); training maximises the
conditional likelihood by the forward and backward sums over the same candidates.

The model is trained on a bounded sample: at most ``SAMPLE`` texts of up to ``SAMPLE_CHARS`` characters, one for
each of ``SAMPLE`` ranges of a hash. Its labels come
from the base patterns; so that it learns forms the patterns cannot match, base spans are rewritten in such forms
(:func:`rewritten`) before the sums are taken. Everything else runs on every whole text.

Null and empty texts have no spans. Repeated rows get equal rows. Columns other than doc_id and text are left out. An
empty table gives an empty table. Long texts are searched in time proportional to their length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlink.llm.common import texts

KINDS = ("email", "ip", "card", "phone")
#: Texts that the model is trained on at most, and the length up to which a text is taken for that.
SAMPLE, SAMPLE_CHARS = 400, 20_000
#: A candidate's length at most; nothing else bounds how many tokens, parts or letters it may have.
LONGEST = 96
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each @ outwards, so that a long run of letters is passed once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    spans = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


# Candidates of the model: all segments of whole tokens that a loose form allows, each of bounded length.
_GROUP = re.compile("[0-9]+")
_BETWEEN = {
    "ip": re.compile(r" ?(?:\.|\[\.\]|\(\.\)) ?"),
    "card": re.compile(r"[./_ -]{1,2}"),
    "phone": re.compile(r"[ ()./-]{1,3}"),
}
_PREFIX = re.compile(r"(?:\(?\+ ?|\()$")
#: Digits of one kind at least and at most.
_SIZE = {"ip": (4, 12), "card": (13, 19), "phone": (7, 17)}
_AT_SIGN = re.compile(r" ?(?:@|\(at\)|\[at\]) ?| at ", re.I)
_NAME_START = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]")
_HOST = re.compile("[A-Za-z0-9-]+")
_DOT = re.compile(r"(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)([A-Za-z0-9-]+)", re.I)
_DOT_AFTER = re.compile(r"(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[A-Za-z0-9]", re.I)
_NAME_BEFORE = re.compile(r"[A-Za-z0-9][._%+-]$")
#: A text without these cannot hold a candidate.
_AT = re.compile(r"\((?:at|dot)\)|\[(?:at|dot)\]| at [^ ]++ dot |@", re.I)
_DIGITS = re.compile(r"[0-9][^0-9]{0,3}[0-9]")
_HINTS = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
}


def numbers(text: str) -> Iterator[Span]:
    """From each group of digits to each later one, as long as separators, digits and length allow a kind."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    for i, (start, first_end) in enumerate(groups):
        front = _PREFIX.search(text, max(0, start - 3), start)
        open_, digits = dict.fromkeys(_BETWEEN, True), 0
        for j in range(i, len(groups)):
            a, b = groups[j]
            digits += b - a
            if b - start > LONGEST - 3 or digits > 19 or j > i and a - groups[j - 1][1] > 5:
                break
            for kind, between in _BETWEEN.items():
                if j > i and open_[kind]:
                    open_[kind] = bool(between.fullmatch(text, groups[j - 1][1], a))
                if kind == "ip" and b - a > 3:
                    open_[kind] = False
                least, most = _SIZE[kind]
                if not open_[kind] or not least <= digits <= most:
                    continue
                if kind == "ip" and j - i == 3 or kind == "card":
                    yield kind, start, b
                elif kind == "phone" and (j > i or front or text.startswith("0", start)):
                    yield kind, start, b
                    if front:
                        yield kind, front.start(), b
            if not any(open_.values()):
                break


def addresses(text: str) -> Iterator[Span]:
    """Around each sign or word for @: names from each of their tokens, hosts to each of their parts.

    What is looked at around a sign is no longer than a candidate, so the work is in proportion to the text.
    """
    for m in _AT_SIGN.finditer(text):
        begin, name = max(0, m.start() - LONGEST), m.start()
        while name > begin and text[name - 1] in _LOCAL:
            name -= 1
        limit = name + LONGEST
        host = _HOST.match(text, m.end(), limit)
        if name == m.start() or not host:
            continue
        ends, end = [], host.end()
        while part := _DOT.match(text, end, limit + 1):
            end = part.end()
            ends.append(end)
        for start in (x.start() for x in _NAME_START.finditer(text, name, m.start())):
            yield from (("email", start, end) for end in ends if end - start <= LONGEST)


def candidates(text: str, taken: Iterable[Span] = ()) -> list[Span]:
    """By end, then start; none touches a span already taken. Their number is in proportion to the text's length."""
    found: set[Span] = set()
    if _AT.search(text):
        found.update(addresses(text))
    if _DIGITS.search(text):
        found.update(numbers(text))
    used = sorted((s, e) for _, s, e in taken)
    starts, reach = [s for s, _ in used], list(accumulate((e for _, e in used), max))
    free = (x for x in found if not (k := bisect_left(starts, x[2])) or reach[k - 1] <= x[1])
    return sorted(free, key=lambda x: (x[2], x[1], x[0]))


def features(text: str, span: Span) -> list[str]:
    """Of the whole segment."""
    kind, start, end = span
    said, before = text[start:end], text[max(0, start - 24) : start].lower()
    digits, after = _NO_DIGIT.sub("", said), text[end : end + 3]
    out = ["", f"digits={min(len(digits), 20)}", f"separators={''.join(sorted({c for c in said if not c.isalnum()}))[:4]}"]
    if 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if kind == "ip":
        out.append(f"bytes={all(int(x) <= 255 for x in re.findall('[0-9]+', said))}")
    if kind == "email":
        out.append(f"words={min(len(re.split('[^A-Za-z0-9]+', said)), 6)}")
        # A name or host that goes on beyond the segment tells a part from a whole.
        out.append(f"whole={not _NAME_BEFORE.search(before)},{not _DOT_AFTER.match(text, end)}")
        out.append(f"spelled={bool(re.search('at', said.lower())) and '@' not in said}")
    else:
        out.append(f"groups={'-'.join(str(min(len(g), 9)) for g in _GROUP.findall(said)[:8])}")
    out.append(f"prefix={re.match(r'00|0|[(]?[+]|[(]|', said)[0]}")
    out.append(f"hint={any(h in before for h in _HINTS[kind])}")
    out.append(f"inside={bool(before) and before[-1].isalnum()}")
    out.append(f"cut={bool(after) and after[0].isalnum()}")
    # What goes on on either side tells a part from a whole.
    out.append(f"goes_on={bool(re.match(r'[^0-9A-Za-z]{1,2}[0-9]', after))},{bool(re.search(r'[0-9][^0-9a-z]{1,2}$', before))}")
    return [f"{kind}:{x}" for x in out]


class Field:
    """Weights of features, and the sums over all sets of non-overlapping candidates."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = dict(weights or {})

    def score(self, text: str, span: Span) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(text, span))

    def best(self, text: str, spans: list[Span]) -> list[Span]:
        """Of all sets of non-overlapping candidates the one with the largest sum; a segment's score is over 0 there."""
        ends, values = [0], [0.0]
        back: list[tuple[int, Span | None]] = [(0, None)]
        for span in spans:
            k = int(np.searchsorted(ends, span[1], "right")) - 1
            value = values[k] + self.score(text, span)
            ends.append(span[2])
            values.append(max(value, values[-1]))
            back.append((k, span) if value > values[-2] else (len(values) - 2, None))
        out, k = [], len(values) - 1
        while k:
            k, span = back[k]
            if span:
                out.append(span)
        return out[::-1]

    def marginals(self, scores: list[float], spans: list[Span]) -> list[float]:
        """The probability of each candidate: forward and backward sums (in logarithms) over ends and starts."""
        n = len(spans)
        ends = [s[2] for s in spans]
        forward = [0.0]  # forward[k]: all sets among the first k candidates
        into = []
        for span, score in zip(spans, scores, strict=True):
            k = int(np.searchsorted(ends, span[1], "right"))
            into.append(forward[k] + score)
            forward.append(float(np.logaddexp(forward[-1], into[-1])))
        backward = [0.0] * n  # backward[k]: all sets among candidates that begin after the k-th ends
        order = sorted(range(n), key=lambda k: -spans[k][1])
        starts, sums = [], [0.0]  # starts: negative, so that they rise
        for k in order:
            later = bisect_right(starts, -spans[k][2])
            backward[k] = sums[later]
            starts.append(-spans[k][1])
            sums.append(float(np.logaddexp(sums[-1], backward[k] + scores[k])))
        return [math.exp(min(0.0, into[k] + backward[k] - forward[-1])) for k in range(n)]

    def fit(self, examples: list[tuple[str, list[Span], set[Span]]], rounds: int = 30, rate: float = 0.5, decay: float = 0.01) -> Field:
        """Gradient ascent on the conditional likelihood of the labelled sets; all weights shrink towards 0."""
        described = [[features(text, s) for s in spans] for text, spans, _ in examples]
        for _ in range(rounds):
            gradient: dict[str, float] = {}
            for (_, spans, true), each in zip(examples, described, strict=True):
                scores = [sum(self.weights.get(f, 0.0) for f in found) for found in each]
                for span, found, p in zip(spans, each, self.marginals(scores, spans), strict=True):
                    for f in found:
                        gradient[f] = gradient.get(f, 0.0) + (span in true) - p
            scale = rate / math.sqrt(max(1, len(examples)))
            for f, g in gradient.items():
                self.weights[f] = (1 - decay) * self.weights.get(f, 0.0) + scale * g
        return self


#: Forms that the base patterns cannot match: kind, what is replaced, by what.
_FORMS = {
    "email": ((re.compile("@"), " at "), (re.compile("@"), "(at)"), (re.compile("@"), " [at] ")),
    "ip": ((re.compile(r"\."), "[.]"), (re.compile(r"\."), " . ")),
    "card": ((re.compile("[ -]?([0-9]{4})"), r".\1"), (re.compile("[ -]?([0-9]{4})"), r"/\1")),
    "phone": ((re.compile(r"^\+"), "00"), (re.compile(r"^\+([0-9]{1,2})"), r"(+\1)"), (re.compile(r"^\+[0-9]{1,2}[ .-]?"), "0")),
}


def rewritten(text: str, spans: list[Span]) -> list[tuple[str, list[Span], set[Span]]]:
    """Short examples around each base span: rewritten (true), and around other candidates as they are (false)."""
    out = []
    for number, (kind, start, end) in enumerate(spans):
        pattern, to = _FORMS[kind][number % len(_FORMS[kind])]
        said = pattern.sub(to, text[start:end]).strip("./")
        if kind == "email" and to != "(at)":
            # Dots of the name stay, as people spell them out in hosts.
            name, host = text[start:end].rsplit("@", 1)
            said = name + to + host.replace(".", " dot " if to == " at " else "[dot]")
        if number % 5 == 4:
            said = said.upper()
        front = text[max(0, start - 40) : start]
        line = front + said + text[end : end + 40]
        true = (kind, len(front), len(front) + len(said))
        found = candidates(line)
        if true in found:
            out.append((line, found, {true}))
    done = shown = 0
    for span in candidates(text, spans):
        if span[1] < done or shown == 20:
            continue
        done, shown = span[2] + 40, shown + 1
        lo = max(0, span[1] - 40)
        line = text[lo : span[2] + 40]
        if found := candidates(line):
            out.append((line, found, set()))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted to at most ``sample`` whole texts of bounded length that hold a base span or a candidate."""
    held = docs.where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike(r"@|[0-9][ ().-]?[0-9]{2}"))
    keyed = held.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    # One key per remainder: an aggregate of ``sample`` numbers, so that no task sends its texts to the driver.
    chosen = keyed.groupBy(F.pmod("key", F.lit(sample))).agg(F.min("key").alias("key")).collect()
    some = keyed.where(F.col("key").isin([r["key"] for r in chosen])).groupBy("key").agg(F.min("text").alias("text"))
    examples = []
    for row in some.orderBy("key").collect():
        examples += rewritten(row["text"], base_spans(row["text"]))
    return Field().fit(examples)


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by kind, then start."""
    base = base_spans(text)
    more = field.best(text, candidates(text, base))
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def cleaned(text: str, field: Field) -> str:
    """The text without spans. A number that was too long for any kind may be one when a part of it is gone, so it ends
    only when nothing is found."""
    while spans := find(text, field)[1]:
        text = redacted(text, spans)
    return text


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: counts and digest of its base spans, and all spans (see ``FOUND``)."""
    weights = (field or train(docs)).weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column(1):
                    base, spans = find(text.as_py().decode(), own)
                    kinds = [k for k, _, _ in base]
                    rows.append((*map(kinds.count, KINDS), sha256(listed(base).encode()).hexdigest(), listed(spans)))
                columns = [part.column(0), *(pa.array(c) for c in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    return texts(docs).mapInArrow(run, FOUND)


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with all spans of its texts replaced; other columns stay, nulls stay null."""
    weights = (field or train(docs)).weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights)
        for batch in batches:
            where = batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                said = [t if t is None else cleaned(t, own) for t in part.column(where).to_pylist()]
                yield part.set_column(where, part.schema.field(where), pa.array(said, part.schema.field(where).type))

    return docs.mapInArrow(run, docs.schema)
